"""Readers and writers, each by what comes back of rows that were written to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import scratch, table
from ..operators.extract import extracted
from ..plans.gateway import NotReadOnly, require_read_only
from ..sources import readers as R
from .registry import query


def _events(spark, sf):
    logs = table(spark, sf, "log_records").where("run_id is not null")
    return logs.select(F.col("run_id").alias("runId"), F.col("log_id").alias("seq"), F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.lower("log_level").alias("type"), F.col("component").alias("stage"), F.lit(None).cast("string").alias("role"), F.col("task_id").alias("taskId"))


_EVENTS = "SELECT run_id AS \"runId\", log_id AS seq, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS at, lower(log_level) AS type, component AS stage, CAST(NULL AS VARCHAR) AS role, task_id AS \"taskId\" FROM log_records WHERE run_id IS NOT NULL"


@query(_EVENTS)
def event_lines_strict(spark, sf):
    """Events appended as JSON lines in two writes and read back; a line that does not parse would end the query."""
    path = scratch(spark)
    e = _events(spark, sf)
    R.append_events(e.where("type = 'error'"), path)
    R.append_events(e.where("type is null or type <> 'error'"), path)
    return R.read_events_strict(spark, path)


@query(f"SELECT e.*, CAST(NULL AS VARCHAR) AS _corrupt FROM ({_EVENTS}) e UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, message FROM log_records WHERE message IS NOT NULL AND NOT contains(message, chr(10)) AND NOT contains(message, chr(13)) AND trim(message) <> '' AND left(trim(message), 1) NOT IN ('{{', '[')")
def event_lines_lenient(spark, sf):
    """Events among lines that are none: those come back with their text."""
    path = scratch(spark)
    R.append_events(_events(spark, sf), path)
    message = F.col("message")
    noise = table(spark, sf, "log_records").where(message.isNotNull() & ~F.contains(message, F.lit("\n")) & ~F.contains(message, F.lit("\r")) & (F.trim(message) != "") & ~F.substring(F.trim(message), 1, 1).isin("{", "["))
    noise.select(message.alias("value")).write.mode("append").text(path)
    return R.read_events_lenient(spark, path)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def enveloped_payloads(spark, sf):
    """Rows as enveloped JSON documents, and the payloads read back."""
    path = scratch(spark)
    R.write_envelopes(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "supplier", "r1")
    return R.read_payloads(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("SELECT r_regionkey, r_name FROM region")
def restored_snapshot(spark, sf):
    """A table kept as an immutable snapshot and restored."""
    path = scratch(spark)
    R.snapshot({"region": table(spark, sf, "region").select("r_regionkey", "r_name")}, path)
    return R.restore(spark, path, ["region"])["region"]


@query("SELECT mktsegment, customers FROM (SELECT c_mktsegment AS mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment)")
def checked_export(spark, sf):
    """A report that is written only as its facts hold, read back."""
    path = scratch(spark)
    report = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(F.count("*").alias("customers"))
    R.export_checked(report, path, {"names": (F.count_if(F.col("mktsegment").isNull()), 0)})
    return spark.read.schema("mktsegment string, customers bigint").json(path)


@query("SELECT 'art_' || sha256(item_text) AS id, item_set AS kind, item_id AS bytes FROM eval_items WHERE item_text IS NOT NULL")
def artifact_index(spark, sf):
    """An index kept as one JSON array, written by the query and read back."""
    items = table(spark, sf, "eval_items").where("item_text is not null")  # a table of fixed size
    rows = items.select(F.to_json(F.struct(F.concat(F.lit("art_"), F.sha2("item_text", 256)).alias("id"), F.col("item_set").alias("kind"), F.col("item_id").alias("bytes"))).alias("j"))
    path = scratch(spark)
    # the format is one array in one file
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.text(path)
    return R.read_index(spark, path).select("id", "kind", "bytes")


@query("SELECT statement_id AS id, 'out/' || coalesce(verb, 'none') || '-r' || statement_no || '-attempt-task_' || statement_id || '.json' AS path, coalesce(verb, 'none') AS kind, CAST(statement_no AS INTEGER) AS iteration, 'task_' || statement_id AS task FROM sql_statements")
def versioned_names(spark, sf):
    s = table(spark, sf, "sql_statements")
    named = s.select(F.col("statement_id").alias("id"), F.concat(F.lit("out/"), F.coalesce("verb", F.lit("none")), F.lit("-r"), "statement_no", F.lit("-attempt-task_"), F.col("statement_id"), F.lit(".json")).alias("path"))
    return named.join(R.versioned_files(named.select("path")), "path").select("id", "path", "kind", "iteration", "task")


@query()
def source_tree(spark, sf):
    """The files below a folder with their sizes, text and lines; here those that a query wrote."""
    path = scratch(spark)
    table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")).repartition(2).write.text(path)
    root = path.removeprefix("file:") if path.startswith("file:") else path
    return R.scan_tree(spark, "/" + root.lstrip("/") if path.startswith("file:") else root).where(F.endswith("path", F.lit(".txt"))).select("bytes", "text", "lines")


@query()
def folder_entries(spark, sf):
    path = scratch(spark)
    table(spark, sf, "region").select("r_name").write.text(path)
    root = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return R.list_folder(spark, root)[0].where(F.endswith("path", F.lit(".txt"))).select("bytes")


_WORDS = "insert|update|delete|drop|alter|create|truncate|grant|revoke|copy|call|do|set|reset|lock|vacuum|reindex|cluster|analyze|begin|commit|rollback|savepoint|prepare|execute|deallocate|merge|refresh|listen|notify|discard|import"


@query(rf"""WITH b AS (SELECT statement_id, lower(regexp_replace(trim(regexp_replace(raw_text, '''(?:[^'']|'''')*''|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*[\s\S]*?\*/|\$\$[\s\S]*?\$\$', ' ', 'g'), E' \n\t\r'), '[;\s]+$', '')) AS t FROM sql_statements WHERE raw_text IS NOT NULL AND NOT regexp_matches(raw_text, '\$\w+\$'))
  SELECT statement_id, NOT contains(t, ';') AND regexp_matches(t, '^[^a-z_]*(select|with|show|explain|values|table)\b') AND NOT regexp_matches(t, '\b({_WORDS})\b') AS allowed FROM b""")
def read_only_statements(spark, sf):
    """Whether the gateway would run each statement."""
    def allowed(sql):
        try:
            require_read_only(sql)
        except NotReadOnly:
            return [(False,)]
        return [(True,)]
    s = table(spark, sf, "sql_statements").where(~F.col("raw_text").rlike(r"\$\w+\$"))
    return extracted(s, "statement_id", ["raw_text"], allowed, "allowed boolean")
