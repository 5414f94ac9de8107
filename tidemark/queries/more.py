"""Further queries: lookups, unpivots, unions, dependency edges, SQL functions, redaction."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import table
from ..functions import jsons as J
from ..operators import extract as E
from ..operators import graph as G
from ..operators import relational as R
from .registry import query


def files(spark, sf):
    return table(spark, sf, "model_files")


@query("SELECT log_id FROM log_records WHERE component = (SELECT min(component) FROM log_records) AND upper(log_level) IN ('WARN', 'ERROR') AND task_id IS NOT NULL")
def optional_metadata_filters(spark, sf):
    logs = table(spark, sf, "log_records")
    first = logs.agg(F.min("component").alias("component"))
    asked = {"level": F.upper("log_level").isin("WARN", "ERROR"), "task": F.col("task_id").isNotNull(), "nothing": None}
    out = logs.join(F.broadcast(first), "component", "left_semi")  # one row is broadcast
    for condition in asked.values():
        out = out if condition is None else out.where(condition)
    return out.select("log_id")


@query("SELECT event_id, event_type FROM events WHERE event_id = 42")
def point_lookup(spark, sf):
    return table(spark, sf, "events").where("event_id = 42").select("event_id", "event_type")


# Response headers that tell of the transport alone.
_HEADERS = ("date", "connection", "keep-alive", "transfer-encoding", "content-length", "server", "via", "x-request-id", "x-powered-by", "set-cookie")


@query("WITH h(name, value) AS (VALUES ('Content-Length', '3'), ('X-Request-Id', 'a'), ('DATE', 'b'), ('content-type', 'c'), ('Via', 'x'), (NULL, 'd')) SELECT name, value FROM h WHERE lower(name) NOT IN ('date', 'connection', 'keep-alive', 'transfer-encoding', 'content-length', 'server', 'via', 'x-request-id', 'x-powered-by', 'set-cookie')")
def transport_headers_left_out(spark, sf):
    h = spark.createDataFrame([("Content-Length", "3"), ("X-Request-Id", "a"), ("DATE", "b"), ("content-type", "c"), ("Via", "x"), (None, "d")], "name string, value string")
    return h.where(~F.lower("name").isin(*_HEADERS))


@query("SELECT a.method_id AS a, min(b.statement_id) AS b FROM java_methods a JOIN sql_statements b ON sha256(a.repository) = sha256(b.repository) GROUP BY a.method_id")
def join_on_content_hash(spark, sf):
    m = table(spark, sf, "java_methods").select(F.col("method_id").alias("a"), F.sha2("repository", 256).alias("h"))
    s = table(spark, sf, "sql_statements").groupBy(F.sha2("repository", 256).alias("h")).agg(F.min("statement_id").alias("b"))
    return m.join(s, "h").select("a", "b")


@query("""WITH u AS (SELECT statement_id, unnest(tables_used) AS t FROM sql_statements), p(t, priority) AS (VALUES ('accounts', 1), ('transfers', 2), ('ledger_entries', 3), ('audit_log', 4), ('request_log', 5)),
  r AS (SELECT statement_id, u.t, row_number() OVER (PARTITION BY statement_id ORDER BY priority, u.t) AS rn FROM (SELECT DISTINCT * FROM u) u JOIN p ON p.t = u.t) SELECT statement_id, t, rn FROM r WHERE rn <= 4""")
def exploded_lookup_by_priority(spark, sf):
    """The first four known tables of a statement by priority; others are dropped, a bound of the brief."""
    p = spark.createDataFrame([("accounts", 1), ("transfers", 2), ("ledger_entries", 3), ("audit_log", 4), ("request_log", 5)], "t string, priority int")
    u = table(spark, sf, "sql_statements").select("statement_id", F.explode(F.array_distinct("tables_used")).alias("t")).join(p, "t")
    rn = F.row_number().over(W.partitionBy("statement_id").orderBy("priority", "t"))
    return u.withColumn("rn", rn.cast("bigint")).where("rn <= 4").select("statement_id", "t", "rn")


@query("""SELECT s_suppkey, field, value FROM (SELECT s_suppkey, unnest(['name', 'nation']) AS field, unnest([s_name, CAST(s_nationkey AS VARCHAR)]) AS value FROM supplier)""")
def unpivoted_fields(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.expr("stack(2, 'name', s_name, 'nation', cast(s_nationkey as string)) as (field, value)"))


@query("SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.n, 0) AS logs, coalesce(b.n, 0) AS files FROM (SELECT run_id, count(*) AS n FROM log_records WHERE run_id IS NOT NULL GROUP BY run_id) a FULL JOIN (SELECT run_id, count(*) AS n FROM model_files WHERE run_id IS NOT NULL GROUP BY run_id) b ON a.run_id = b.run_id")
def full_outer_groups(spark, sf):
    n = lambda t, name: table(spark, sf, t).where("run_id is not null").groupBy("run_id").agg(F.count("*").alias(name))
    return n("log_records", "logs").join(n("model_files", "files"), "run_id", "full_outer").na.fill(0, ["logs", "files"])


@query("SELECT f.file_id, coalesce(n, 0) AS spans FROM model_files f LEFT JOIN (SELECT file_id, count(*) AS n FROM source_spans GROUP BY file_id) s ON s.file_id = f.file_id")
def inventory_with_counts(spark, sf):
    s = table(spark, sf, "source_spans").groupBy("file_id").agg(F.count("*").alias("spans"))
    return files(spark, sf).select("file_id").join(s, "file_id", "left").na.fill(0, ["spans"])


def first_wins(a, b):
    """At most 200 rows of two lists one after the other, the first of each id."""
    u = a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)))
    first = u.groupBy("id").agg(F.min(F.struct("src", "name")).alias("x"))
    return first.orderBy("x.src", "id").limit(200).select("id", "x.name")


@query("SELECT command_id, array_to_string(list_sort(list_distinct(list_filter(argv, lambda x: list_contains(['test', 'run', 'build', 'install'], x)))), ',') AS granted, least(coalesce(duration_ms, 60000), 60000) AS budget FROM command_results WHERE argv IS NOT NULL")
def granted_and_budgets(spark, sf):
    allowed = F.array(*(F.lit(x) for x in ("test", "run", "build", "install")))
    return table(spark, sf, "command_results").where("argv is not null").select("command_id", F.array_join(F.array_sort(F.array_intersect("argv", allowed)), ",").alias("granted"), F.least(F.coalesce("duration_ms", F.lit(60000)), F.lit(60000)).alias("budget"))


@query("SELECT run_id, count(DISTINCT lower(log_level)) AS levels, count(*) FILTER (WHERE lower(log_level) = 'error') AS errors, count(*) FILTER (WHERE lower(log_level) = 'warn') AS warnings FROM log_records WHERE run_id IS NOT NULL GROUP BY run_id")
def stage_record_map(spark, sf):
    per = table(spark, sf, "log_records").where("run_id is not null and log_level is not null").groupBy("run_id", F.lower("log_level").alias("level")).agg(F.count("*").alias("n"))
    m = per.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))  # bounded by the levels
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return m.select("run_id", F.size("m").alias("levels"), of("error").alias("errors"), of("warn").alias("warnings"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal > 5000 THEN 5000 ELSE s_acctbal END AS clamped FROM supplier")
def sql_scalar_function(spark, sf):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clamp_to(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE DETERMINISTIC RETURN CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END")
    return table(spark, sf, "supplier").select("s_suppkey", F.expr("clamp_to(s_acctbal, 0D, 5000D)").alias("clamped"))


@query("SELECT method_id FROM java_methods WHERE body IS NOT NULL AND regexp_matches(trim(body), '^(?:return (?:this\\.)?\\w+;|this\\.\\w+ = \\w+;)$')")
def trivial_accessors(spark, sf):
    return table(spark, sf, "java_methods").where(F.trim("body", F.lit(" \t\n\r")).rlike(r"^(?:return (?:this\.)?\w+;|this\.\w+ = \w+;)$")).select("method_id")


@query()
def scheduled_jobs(spark, sf):
    java = files(spark, sf).where(F.lower("file_path").endswith(".java"))
    return E.extracted(java, "file_id", ["file_content"], E.scheduled_jobs, "kind string, value string, line bigint")


@query()
def declared_dependencies(spark, sf):
    return E.extracted(files(spark, sf), "file_id", ["file_path", "file_content"], E.dependencies, "name string, version string, scope string")


@query()
def json_found_in_text(spark, sf):
    return E.extracted(table(spark, sf, "command_results"), "command_id", ["stdout"], E.json_in_prose, "json string")


@query()
def flattened_json_settings(spark, sf):
    """(file_id, path, value, secret) of every leaf of JSON settings; values under secret names are withheld."""
    f = files(spark, sf).where(F.lower("file_path").endswith(".json"))
    leaves = J.leaves(f, "file_content", ["file_id"])
    secret = F.col("path").rlike(E.SECRET_SETTINGS.pattern)
    return leaves.select("file_id", "path", F.when(~secret, F.to_json("value")).alias("value"), secret.alias("secret"))


@query("SELECT id, name, CAST(amount AS DOUBLE) AS amount FROM (VALUES (1, 'a', 10.5), (2, NULL, -3.25), (3, 'c', NULL)) v(id, name, amount)")
def inline_rows(spark, sf):
    return spark.sql("SELECT id, name, CAST(amount AS DOUBLE) AS amount FROM VALUES (1, 'a', 10.5), (2, NULL, -3.25), (3, 'c', NULL) AS v(id, name, amount)")


@query("""WITH u AS (SELECT doc_id AS id, 0 AS src, source AS name FROM documents UNION ALL SELECT log_id, 1, component FROM log_records), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, name NULLS FIRST) AS rn FROM u) SELECT id, name FROM f WHERE rn = 1 ORDER BY src, id LIMIT 200""")
def ordered_union_first_wins(spark, sf):
    """Two lists one after the other, over all rows, the first of each id, at most 200: the bound of the evidence list."""
    return first_wins(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name")), table(spark, sf, "log_records").select(F.col("log_id").alias("id"), F.col("component").alias("name")))


@query("SELECT command_id, row_number() OVER (ORDER BY started_at, command_id) AS place FROM command_results WHERE started_at IS NOT NULL")
def history_in_order(spark, sf):
    """The place of each command in the whole history; places come from sorted ranges, not from one task."""
    return R.number_after(table(spark, sf, "command_results").where("started_at is not null").select("command_id", "started_at"), ["started_at", "command_id"], None, "place").select("command_id", "place")


_CODE = r"""//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''"""


@query(rf"SELECT file_id, length(file_content) AS n, md5(regexp_replace(regexp_replace(file_content, '{_CODE}', '', 'g'), '[ \t\n\r\f]+', '', 'g')) AS code FROM model_files WHERE lower(file_path) LIKE '%.java' AND file_content IS NOT NULL")
def masked_sources(spark, sf):
    """Strings and comments blanked: the length stays, and what is left but white space is the code."""
    java = files(spark, sf).where(F.lower("file_path").endswith(".java"))
    def one(text):
        m = E.masked(text)
        return [(len(m), hashlib.md5(re.sub(r"[ \t\n\r\f]+", "", m).encode("utf-8", "surrogatepass")).hexdigest())]
    return E.extracted(java, "file_id", ["file_content"], one, "n bigint, code string")


@query()
def redacted_settings(spark, sf):
    """JSON files with the values of secret-named keys replaced at any level."""
    f = files(spark, sf).where(F.lower("file_path").endswith(".json") & F.col("file_content").isNotNull())
    return f.select("file_id", J.redacted(F.col("file_content")).alias("redacted")).where("redacted is not null")


_SECRETS = [
    (1, '{"user": "x", "password": "hunter22", "n": 1}', '{"n":1,"password":"hunt***redacted***","user":"x"}'),
    (2, '{"a": {"apiKey": 12, "b": [{"client_secret": null}, 3]}, "Authorization": {"x": 1}}', '{"Authorization":"***redacted***","a":{"apiKey":"***redacted***","b":[{"client_secret":"***redacted***"},3]}}'),
    (3, '["token", {"token": ["a"], "say": "the \\"password\\": 1"}]', '["token",{"say":"the \\"password\\": 1","token":"***redacted***"}]'),
    (4, '{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"a":1}}}}}}}}}', '{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"a":"[truncated]"}}}}}}}}}'),
    (5, '"plain"', '"plain"'), (6, "no json", None), (7, None, None),
]


@query("SELECT * FROM (VALUES " + ", ".join("(" + str(i) + ", " + ("NULL" if w is None else "'" + w + "'") + ")" for i, _, w in _SECRETS) + ") t(id, redacted)")
def redacted_values(spark, sf):
    """Redaction by key on texts whose result is known: strings keep four characters, objects and lists under a secret name go whole, beyond eight levels all is cut."""
    rows = spark.createDataFrame([(i, t) for i, t, _ in _SECRETS], "id int, text string")
    return rows.select("id", J.redacted(F.col("text")).alias("redacted"))


@query("SELECT repository, count(*) AS total, count(*) FILTER (WHERE verb NOT IN ('select', 'unknown')) AS captured, CAST(coalesce(sum(len(tables_used)), 0) AS BIGINT) AS assertions, count(*) FILTER (WHERE writes) AS defects FROM sql_statements GROUP BY repository")
def assertions_totals(spark, sf):
    """Totals of a suite: cases, those whose status is none of two, the sizes of their lists, those that are flagged."""
    s = table(spark, sf, "sql_statements")
    size = F.when(F.col("tables_used").isNotNull(), F.size("tables_used"))
    return s.groupBy("repository").agg(F.count("*").alias("total"), F.count_if(~F.col("verb").isin("select", "unknown")).alias("captured"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("assertions"), F.count_if("writes").alias("defects"))


@query(rf"""WITH j AS (SELECT file_id, regexp_extract(file_content, '(?m)^\s*package\s+([\w.]+)\s*;', 1) AS p, regexp_extract(regexp_replace(file_content, '{_CODE}', ' ', 'g'), '\b(?:class|interface|enum|record)\s+(\w+)', 1) AS c, list_distinct(regexp_extract_all(file_content, '(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;', 1)) AS i FROM model_files WHERE lower(file_path) LIKE '%.java'),
  u AS (SELECT file_id, CASE WHEN p = '' THEN c ELSE p || '.' || c END AS src, unnest(i) AS dst FROM j WHERE c <> '') SELECT src, dst, count(*) AS files FROM u GROUP BY ALL""")
def dependency_edges(spark, sf):
    """Imports by class, over all repositories; the graph of all kinds is dependency_graph_edges."""
    java = files(spark, sf).where(F.lower("file_path").endswith(".java"))
    edges = E.extracted(java, "file_id", ["file_content"], E.imports, "src string, dst string")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("files"))


@query()
def dependency_hotspots(spark, sf):
    return G.hotspots(dependency_edges(spark, sf).select("src", "dst"))
