"""Queries of the differential engine, on events as baseline and derived probe and candidate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..operators import differential as D
from .registry import query

_LEAVES = """base AS (SELECT event_id, unnest(['k', 'value', 'event_type', 'userId', 'timestamp']) AS path, unnest(['"' || json_extract_string(props, '$.k') || '"', CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), '"' || event_type || '"', CAST(user_id AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR)]) AS value FROM events),
  probe AS (SELECT event_id, path, CASE WHEN path = 'timestamp' OR path = 'userId' AND event_id % 3 = 0 THEN value || '9' ELSE value END AS value FROM base),
  cand AS (SELECT event_id, path, CASE WHEN path = 'value' AND event_id % 7 = 0 THEN CAST(CAST(value AS DECIMAL(18,4)) + 0.0001 AS VARCHAR) WHEN path = 'value' AND event_id % 5 = 0 THEN '"' || value || '"' WHEN path = 'value' AND event_id % 2 = 0 THEN value || '00' WHEN path = 'event_type' AND event_id % 11 = 0 THEN '17' WHEN path IN ('timestamp', 'userId') THEN value || '1' ELSE value END AS value FROM base WHERE event_id % 13 <> 0 AND NOT (path = 'k' AND event_id % 17 = 0))"""
_COMPARED = _LEAVES + """, j AS (SELECT b.event_id, b.path, b.value AS expected, c.value AS actual, p.event_id IS NOT NULL AND b.value IS DISTINCT FROM p.value AS varied FROM base b LEFT JOIN probe p USING (event_id, path) LEFT JOIN cand c ON c.event_id = b.event_id AND c.path = b.path),
  x AS (SELECT *, path IN ('timestamp') OR (varied AND path IN ('userId', 'timestamp')) AS excused, starts_with(expected, '"') AS se, starts_with(actual, '"') AS sa FROM j),
  cmp AS (SELECT *, CASE WHEN excused OR se = sa AND (se AND expected = actual OR NOT se AND CAST(CASE WHEN NOT se THEN expected END AS DOUBLE) = CAST(CASE WHEN NOT sa THEN actual END AS DOUBLE)) THEN NULL WHEN actual IS NULL THEN 'missing-field' WHEN se <> sa THEN 'type-difference'
    WHEN NOT se AND floor(CAST(CASE WHEN NOT se THEN expected END AS DOUBLE) + 0.5) = floor(CAST(CASE WHEN NOT sa THEN actual END AS DOUBLE) + 0.5) THEN 'precision' ELSE 'value-difference' END AS difference FROM x),
  cases AS (SELECT event_id, event_id % 19 = 0 AS skipped, event_id % 37 = 0 AS uncaught, event_id % 31 = 0 AS drifted, event_id % 13 = 0 AS absent, event_id % 23 = 0 AS unreached, CASE WHEN event_id % 29 = 0 THEN 'error' WHEN event_id % 41 = 0 THEN 'timeout' END AS broken FROM events),
  outc AS (SELECT c.*, n, CASE WHEN skipped THEN 'not passing against legacy' WHEN uncaught THEN 'no captured baseline' WHEN drifted THEN 'baseline has drifted' WHEN absent THEN 'no execution' WHEN unreached THEN 'unreachable' WHEN broken IS NOT NULL THEN 'ended ' || broken END AS reason FROM cases c JOIN (SELECT event_id, count(difference) AS n FROM cmp GROUP BY event_id) USING (event_id)),
  outcomes AS (SELECT event_id, reason, CASE WHEN reason = 'unreachable' THEN 'modern-unreachable' WHEN reason IS NOT NULL THEN 'inconclusive' WHEN n > 0 THEN 'divergent' ELSE 'equal' END AS outcome, CASE WHEN reason IS NULL THEN n ELSE 0 END AS mismatches, CASE WHEN reason IS NULL AND n > 0 THEN 'MAJOR' END AS severity FROM outc)"""
_VERDICT = """count(*) AS cases, count(*) FILTER (WHERE outcome = 'equal') AS equal, count(*) FILTER (WHERE outcome = 'divergent') AS divergent, count(*) FILTER (WHERE outcome = 'modern-unreachable') AS unreachable, count(*) FILTER (WHERE outcome = 'inconclusive') AS inconclusive,
  CASE WHEN count(*) FILTER (WHERE outcome IN ('divergent', 'modern-unreachable')) > 0 THEN 'NOT_EQUIVALENT' WHEN count(*) = 0 OR count(*) FILTER (WHERE outcome = 'inconclusive') > 0 THEN 'INCONCLUSIVE' ELSE 'EQUIVALENT' END AS verdict, round(count(*) FILTER (WHERE outcome IN ('equal', 'divergent')) / count(*), 4) AS confidence"""


def _leaves(spark, sf):
    e = table(spark, sf, "events")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = {"k": quoted(F.get_json_object("props", "$.k")), "value": F.col("value").cast("decimal(18,4)").cast("string"), "event_type": quoted(F.col("event_type")), "userId": F.col("user_id").cast("string"), "timestamp": F.unix_micros(F.col("ts").cast("timestamp")).cast("string")}
    base = e.select("event_id", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in pairs.items()))).alias("x")).select("event_id", "x.path", "x.value")
    path, ident, value = F.col("path"), F.col("event_id"), F.col("value")
    probe = base.withColumn("value", F.when((path == "timestamp") | ((path == "userId") & (ident % 3 == 0)), F.concat(value, F.lit("9"))).otherwise(value))
    raised = (value.try_cast("decimal(18,4)") + F.lit("0.0001").cast("decimal(18,4)")).cast("decimal(18,4)").cast("string")
    cand = base.where((ident % 13 != 0) & ~((path == "k") & (ident % 17 == 0))).withColumn(
        "value", F.when((path == "value") & (ident % 7 == 0), raised).when((path == "value") & (ident % 5 == 0), quoted(value)).when((path == "value") & (ident % 2 == 0), F.concat(value, F.lit("00")))
        .when((path == "event_type") & (ident % 11 == 0), "17").when(path.isin("timestamp", "userId"), F.concat(value, F.lit("1"))).otherwise(value))
    return base, probe, cand


def _compared(spark, sf):
    return D.compare(*_leaves(spark, sf), ["event_id"])


def _outcomes(spark, sf):
    every = lambda n: F.col("event_id") % n == 0
    cases = table(spark, sf, "events").select(
        "event_id", F.when(every(19), "inconclusive").otherwise("passing-against-legacy").alias("status"), F.when(~every(37), ~every(31)).alias("holds"),
        F.when(every(13), None).when(every(23), "unreachable").when(every(29), "error").when(every(41), "timeout").otherwise("completed").alias("execution"))
    return D.case_outcomes(_compared(spark, sf), cases, ["event_id"])


@query(f"WITH {_COMPARED} SELECT event_id, path, varied, excused, difference FROM cmp WHERE varied OR difference IS NOT NULL")
def leaf_differences(spark, sf):
    return _compared(spark, sf).where("varied or difference is not null").select("event_id", "path", "varied", "excused", "difference")


@query(f"WITH {_COMPARED} SELECT * FROM outcomes")
def case_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query(f"WITH {_COMPARED} SELECT {_VERDICT} FROM outcomes")
def verdict_rollup(spark, sf):
    return D.verdict(_outcomes(spark, sf))


@query(f"WITH {_COMPARED} SELECT event_id // 3 AS suite, {_VERDICT} FROM outcomes GROUP BY ALL")
def verdict_by_suite(spark, sf):
    """A verdict for each three cases, so that every branch of it occurs."""
    return D.verdict(_outcomes(spark, sf).withColumn("suite", F.floor(F.col("event_id") / 3)), ["suite"])


@query(f"WITH {_COMPARED} SELECT s.severity, count(o.event_id) AS cases, CAST(coalesce(sum(mismatches), 0) AS BIGINT) AS mismatches FROM (VALUES ('INFO'), ('MINOR'), ('MAJOR'), ('CRITICAL')) s(severity) LEFT JOIN outcomes o ON o.severity = s.severity GROUP BY s.severity")
def mismatch_summary(spark, sf):
    names = ("INFO", "MINOR", "MAJOR", "CRITICAL")
    row = _outcomes(spark, sf).agg(*(a for n in names for a in (F.count_if(F.col("severity") == n).alias(f"c{n}"), F.coalesce(F.sum(F.when(F.col("severity") == n, F.col("mismatches"))), F.lit(0)).alias(f"m{n}"))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("severity"), F.col(f"c{n}").alias("cases"), F.col(f"m{n}").alias("mismatches")) for n in names))).alias("x")).select("x.*")


@query(f"WITH {_COMPARED} SELECT event_id, severity FROM outcomes WHERE outcome = 'divergent' ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, event_id")
def repair_targets(spark, sf):
    """All divergent cases, worst first, then by id."""
    return _outcomes(spark, sf).where("outcome = 'divergent'").select("event_id", "severity").orderBy(F.when(F.col("severity") == "CRITICAL", 0).otherwise(1), "event_id")


@query(f"WITH {_COMPARED} SELECT difference, path, count(*) AS n FROM cmp WHERE difference IS NOT NULL GROUP BY ALL")
def differences_by_kind(spark, sf):
    return _compared(spark, sf).where("difference is not null").groupBy("difference", "path").agg(F.count("*").alias("n"))


@query(f"WITH {_COMPARED} SELECT event_id, bool_and(difference IS NULL) AS passed, count(*) FILTER (WHERE excused) AS excused FROM cmp GROUP BY event_id")
def cases_that_pass(spark, sf):
    return _compared(spark, sf).groupBy("event_id").agg(F.bool_and(F.col("difference").isNull()).alias("passed"), F.count_if("excused").alias("excused"))


#: Known cases of the comparison, judged as a whole: (case, status, captured value, candidate's
#: status, kind, path, expected, actual, tolerance, normalized, critical) and, in the SQL below,
#: what must come of them.
_OK, _FEE = "passing-against-legacy", "transfer.responseBody.fee"
_KNOWN = [
    ("same fee", _OK, "2.01", "completed", "json-value", _FEE, "2.01", "2.01", None, False, False),
    ("last cent", _OK, "2.01", "completed", "json-value", _FEE, "2.01", "2", None, False, False),
    ("rounds apart", _OK, "1.5", "completed", "json-value", _FEE, "1.5", "1.4", None, False, False),
    ("http status", _OK, "200", "completed", "http-status", "transfer.http-status", "200", "500", None, False, False),
    ("critical invariant", _OK, "2.01", "completed", "json-value", _FEE, "2.01", "2", None, False, True),
    ("normalized", _OK, '"TR-1"', "completed", "json-value", "transfer.responseBody.transferId", '"TR-1"', '"TR-9"', None, True, False),
    ("clock reading", _OK, '"2026-08-21T07:10:28.81881"', "completed", "json-value", "transfer.responseBody.createdAt", '"2026-08-21T07:10:28.81881"', '"2026-08-21T07:01:49Z"', None, False, False),
    ("number against text", _OK, "60", "completed", "json-value", _FEE, "60", '"60.0000"', None, False, False),
    ("number written otherwise", _OK, "60", "completed", "json-value", _FEE, "60", "60.0000", None, False, False),
    ("null against text", _OK, "null", "completed", "json-value", _FEE, "null", '"null"', None, False, False),
    ("missing field", _OK, "1", "completed", "json-value", _FEE, "1", None, None, False, False),
    ("within tolerance", _OK, "1.0", "completed", "json-value", _FEE, "1.0", "1.004", 0.01, False, False),
    ("key order", _OK, '{"a":1,"b":2}', "completed", "json-value", _FEE, '{"a":1,"b":2}', '{"b":2,"a":1}', None, False, False),
    ("list order", _OK, "[1,2]", "completed", "json-value", _FEE, "[1,2]", "[2,1]", None, False, False),
    ("row count", _OK, "3", "completed", "row-count", "rows.row-count", "3", "4", None, False, False),
    ("error present", _OK, '"completed"', "completed", "error-present", "transfer.error-present", '"completed"', '"error"', None, False, False),
    ("never passed", "inconclusive", "2.01", "completed", "json-value", _FEE, "2.01", "2.01", None, False, False),
    ("no capture", _OK, None, "completed", "json-value", _FEE, "2.01", "2.01", None, False, False),
    ("drifted", _OK, "2.05", "completed", "json-value", _FEE, "2.01", "2.01", None, False, False),
    ("unreachable", _OK, "2.01", "unreachable", "json-value", _FEE, "2.01", None, None, False, False),
    ("errored", _OK, "2.01", "error", "json-value", _FEE, "2.01", None, None, False, False),
    ("timed out", _OK, "2.01", "timeout", "json-value", _FEE, "2.01", None, None, False, False),
    ("no execution", _OK, "2.01", None, "json-value", _FEE, "2.01", None, None, False, False),
]


@query("""SELECT * FROM (VALUES ('same fee', 'equal', NULL, NULL), ('last cent', 'divergent', 'precision', 'MAJOR'), ('rounds apart', 'divergent', 'value-difference', 'MAJOR'), ('http status', 'divergent', 'http-status', 'CRITICAL'),
  ('critical invariant', 'divergent', 'precision', 'CRITICAL'), ('normalized', 'equal', NULL, NULL), ('clock reading', 'equal', NULL, NULL), ('number against text', 'divergent', 'type-difference', 'MAJOR'), ('number written otherwise', 'equal', NULL, NULL),
  ('null against text', 'divergent', 'type-difference', 'MAJOR'), ('missing field', 'divergent', 'missing-field', 'MAJOR'), ('within tolerance', 'equal', NULL, NULL), ('key order', 'equal', NULL, NULL), ('list order', 'divergent', 'value-difference', 'MAJOR'),
  ('row count', 'divergent', 'row-count', 'MAJOR'), ('error present', 'divergent', 'error-vs-success', 'CRITICAL'), ('never passed', 'inconclusive', NULL, NULL), ('no capture', 'inconclusive', NULL, NULL), ('drifted', 'inconclusive', NULL, NULL),
  ('unreachable', 'modern-unreachable', NULL, NULL), ('errored', 'inconclusive', NULL, NULL), ('timed out', 'inconclusive', NULL, NULL), ('no execution', 'inconclusive', NULL, NULL)) t(case_id, outcome, difference, severity)""")
def known_cases(spark, sf):
    names = "case_id string, status string, captured string, execution string, kind string, path string, value string, actual string, tolerance double, normalized boolean, critical boolean"
    known = spark.createDataFrame(_KNOWN, names)
    of = lambda c: known.where(f"{c} is not null").select("case_id", "path", F.col(c).alias("value"))
    held = D.evaluated(known, of("captured"), ["case_id"]).groupBy("case_id").agg(F.bool_and(F.col("difference").isNull()).alias("kept"))
    cases = known.join(held, "case_id").select("case_id", "status", F.when(F.col("captured").isNotNull(), F.col("kept")).alias("holds"), "execution")
    found = D.evaluated(known, of("actual"), ["case_id"])
    out = D.case_outcomes(found, cases, ["case_id"], known.where("execution is not null"))
    return out.join(found.select("case_id", "difference"), "case_id").select("case_id", "outcome", F.when(F.col("outcome") == "divergent", F.col("difference")).alias("difference"), "severity")


@query("""WITH b AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0) AS before, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1 AND event_type <> 'view') AS after FROM events GROUP BY user_id), c AS (SELECT user_id, coalesce(before, []) AS before, coalesce(after, []) AS after FROM b)
  SELECT user_id, CASE WHEN len(after) = 0 THEN 'RESOLVED' WHEN len(list_filter(after, lambda x: NOT list_contains(before, x))) > 0 THEN 'REGRESSED' WHEN len(list_filter(before, lambda x: NOT list_contains(after, x))) > 0 THEN 'IMPROVED' ELSE 'NO_CHANGE' END AS status FROM c""")
def repair_classification(spark, sf):
    kinds = lambda cond: F.collect_set(F.when(cond, F.col("event_type")))
    e = table(spark, sf, "events").groupBy("user_id").agg(kinds(F.col("event_id") % 2 == 0).alias("before"), kinds((F.col("event_id") % 2 == 1) & (F.col("event_type") != "view")).alias("after"))
    return e.select("user_id", D.repair_status(F.col("before"), F.col("after"), F.lit(True)).alias("status"))


@query("SELECT DISTINCT c.run_id FROM command_results c WHERE c.run_id IS NOT NULL AND c.run_id NOT IN (SELECT run_id FROM log_records WHERE run_id IS NOT NULL)")
def referenced_but_absent(spark, sf):
    return table(spark, sf, "command_results").where("run_id is not null").select("run_id").distinct().join(table(spark, sf, "log_records").where("run_id is not null"), "run_id", "left_anti")
