"""Queries over source-like tables: artifacts, migrations, settings, reports, quality rules, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..operators import quality as Q
from ..sources import readers
from ..streaming import events as stream
from .registry import query


def files(spark, sf):
    return table(spark, sf, "model_files")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS corrupt FROM (SELECT event_id % 19 = 0 AS bad FROM events)")
def lenient_json_lines(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props")).alias("value"))
    parsed = e.select(F.from_json("value", "k bigint, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.agg(F.count("*").alias("n"), F.count_if(F.col("e._corrupt").isNotNull()).alias("corrupt"))


@query("SELECT 'art_' || sha256(file_content) AS artifact_id, count(*) AS copies FROM model_files WHERE file_content IS NOT NULL GROUP BY 1")
def content_addresses(spark, sf):
    return readers.content_ids(files(spark, sf).where("file_content is not null"), "file_content").groupBy("artifact_id").agg(F.count("*").alias("copies"))


@query("""SELECT file_id::VARCHAR AS path, CASE WHEN file_id % 11 = 0 THEN 'missing' WHEN file_id % 7 = 0 THEN 'tampered' WHEN file_id % 5 = 0 THEN 'size-mismatch' ELSE 'ok' END AS state FROM model_files WHERE file_content IS NOT NULL AND file_content <> ''""")
def artifact_integrity(spark, sf):
    f = files(spark, sf).where("file_content is not null and file_content <> ''").select(F.col("file_id").cast("string").alias("path"), "file_id", "file_content")
    index = f.select("path", F.sha2("file_content", 256).alias("sha256"), (F.octet_length("file_content") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("bytes"))
    found = f.where("file_id % 11 <> 0").select("path", F.when(F.col("file_id") % 7 == 0, F.concat("file_content", F.lit("x"))).otherwise(F.col("file_content")).alias("content"))
    return readers.verify_artifacts(index, found)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT -n_nationkey - 1, 'added' FROM nation")
def index_upsert(spark, sf):
    index = table(spark, sf, "documents").select("doc_id", "source")
    rows = index.where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("source")).unionByName(table(spark, sf, "nation").select((-F.col("n_nationkey") - 1).cast("bigint").alias("doc_id"), F.lit("added").alias("source")))
    return readers.upsert(index, rows, ["doc_id"])


@query("""SELECT file_id, regexp_extract(n, '(?i)^V([0-9]+(?:[._][0-9]+)*)__', 1) AS version, replace(regexp_extract(n, '(?i)__(.+)\\.sql$', 1), '_', ' ') AS description FROM (SELECT file_id, regexp_extract(file_path, '([^/]+)$', 1) AS n FROM model_files) WHERE regexp_matches(n, '(?i)^V[0-9]+(?:[._][0-9]+)*__.+\\.sql$')""")
def migration_catalogue(spark, sf):
    paths = files(spark, sf).select("file_id", F.col("file_path").alias("path"))
    found = readers.migrations(paths.select("path").distinct())
    return paths.join(found, "path").where("version is not null").select("file_id", "version", "description")


@query("SELECT pos, line FROM (SELECT 0 AS pos, '# Entries by type' AS line UNION ALL SELECT 1, '| entry_type | n |' UNION ALL SELECT 2, '| --- | --- |' UNION ALL SELECT row_number() OVER (ORDER BY entry_type) + 2, '| ' || entry_type || ' | ' || n || ' |' FROM (SELECT entry_type, count(*) AS n FROM ledger_entries GROUP BY entry_type))")
def markdown_report(spark, sf):
    rows = table(spark, sf, "ledger_entries").groupBy("entry_type").agg(F.count("*").alias("n"))
    return readers.markdown_report(rows, "Entries by type", "entry_type")


@query("""SELECT log_id, rule FROM (SELECT log_id, unnest(list_filter([CASE WHEN run_id IS NULL THEN 'run-required' WHEN NOT regexp_matches(run_id, '^run[_-]') THEN 'run-pattern' END, CASE WHEN message IS NULL OR trim(message) = '' THEN 'message-required' END, CASE WHEN received_at < logged_at THEN 'received-after-logged' END,
  CASE WHEN upper(log_level) NOT IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL', 'TRACE') THEN 'known-level' END], lambda x: x IS NOT NULL)) AS rule FROM log_records)""")
def schema_violations(spark, sf):
    return Q.violations(table(spark, sf, "log_records"), "log_id", {
        "run-required": F.col("run_id").isNull(), "run-pattern": ~F.col("run_id").rlike("^run[_-]"), "message-required": F.col("message").isNull() | (F.trim("message") == ""),
        "received-after-logged": F.col("received_at") < F.col("logged_at"), "known-level": ~F.upper("log_level").isin("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "TRACE")})


@query("""SELECT 'has-documents' AS criterion, (SELECT count(*) FROM documents) >= 10 AS satisfied UNION ALL SELECT 'every-source-known', (SELECT count(*) FROM documents WHERE source IS NULL) = 0
  UNION ALL SELECT 'no-unknown-language', (SELECT count(*) FROM documents WHERE lang = 'und') = 0 UNION ALL SELECT 'commands-pass', (SELECT bool_and(coalesce(exit_code, 1) = 0) FROM command_results)""")
def acceptance_criteria(spark, sf):
    d = table(spark, sf, "documents")
    return Q.acceptance(spark, {
        "has-documents": Q.at_least(d, 10), "every-source-known": Q.none_where(d, F.col("source").isNull()), "no-unknown-language": Q.none_where(d, F.col("lang") == "und"),
        "commands-pass": Q.all_where(table(spark, sf, "command_results"), F.coalesce("exit_code", F.lit(1)) == 0)})


@query("SELECT span_id, comment_text IS NULL AND raw_text IS NULL AS demoted FROM source_spans WHERE origin = 'comment' OR literal_value IS NULL")
def claims_without_evidence(spark, sf):
    s = table(spark, sf, "source_spans").where("origin = 'comment' or literal_value is null")
    kept, demoted = Q.demote(s, F.col("comment_text").isNull() & F.col("raw_text").isNull())
    return kept.select("span_id", F.lit(False).alias("demoted")).unionByName(demoted.select("span_id", F.lit(True).alias("demoted")))


@query("""SELECT 'rows' AS field, target_name AS key FROM (SELECT target_name, sum(row_count) AS stored, sum(len(result_rows)) AS counted FROM query_results GROUP BY target_name) WHERE stored IS DISTINCT FROM counted""")
def recount_audit(spark, sf):
    q = table(spark, sf, "query_results").groupBy("target_name").agg(F.sum("row_count").alias("stored"), F.sum(F.size("result_rows")).alias("counted"))
    return Q.recount(q, "target_name", {"rows": ("stored", "counted")})


@query("""WITH s AS (SELECT run_id, arg_max(exit_code, command_id) AS last FROM command_results WHERE run_id IS NOT NULL GROUP BY run_id), k AS (SELECT DISTINCT run_id FROM log_records WHERE run_id IS NOT NULL), t AS (SELECT DISTINCT run_id FROM model_files WHERE run_id IS NOT NULL AND file_content IS NULL)
  SELECT run_id FROM s WHERE last = 0 AND run_id IN (SELECT run_id FROM k) AND run_id NOT IN (SELECT run_id FROM t)""")
def successful_predecessors(spark, sf):
    last = table(spark, sf, "command_results").where("run_id is not null").groupBy("run_id").agg(F.max_by("exit_code", "command_id").alias("last")).where("last = 0").select("run_id")
    broken = files(spark, sf).where("run_id is not null and file_content is null").select("run_id")
    return last.join(table(spark, sf, "log_records").where("run_id is not null").select("run_id"), "run_id", "left_semi").join(broken, "run_id", "left_anti")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_daily_counts(spark, sf):
    """A stream over the event files, read to its end, with a tumbling window."""
    out = stream.drain(stream.daily_counts(stream.open_parquet(spark, f"{sf}/events.parquet")), "streamed_daily_counts", "update", ["day", "event_type"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_first_per_key(spark, sf):
    once = stream.first_per_key(stream.open_parquet(spark, f"{sf}/events.parquet"), ["user_id", "event_type"])
    return stream.drain(once.select("user_id", "event_type"), "streamed_first_per_key", "append")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM n GROUP BY user_id, k""")
def streamed_sessions(spark, sf):
    """A stream of events as sessions of each user, which end after thirty quiet minutes."""
    out = stream.drain(stream.sessions(stream.open_parquet(spark, f"{sf}/events.parquet").where("user_id is not null")), "streamed_sessions", "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")
