"""Keyed comparison of recorded values: baseline, probe and candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import canonical

# Last steps of a path that may differ from run to run, and those that read a clock.
MINTED_NAMES = r"(?i)^(?:id|uuid|guid|seq|sequence|nonce|pid|time|timestamp|datetime)$"
MINTED_ENDS = r"(?:Id|Uuid|Guid|Ref|Number|Token|Nonce)$"
CLOCK_NAMES = r"(?i)^(?:time|timestamp|datetime)$"
CLOCK_ENDS = r"(?:At|Time)$"
DURATION_ENDS = r"(?:Ms|Millis|Micros|Nanos)$"


def _leaf(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"([^.]+)\.*$", 1), F.lit(""))


def _clock(path: Column) -> Column:
    return _leaf(path).rlike(CLOCK_NAMES) | _leaf(path).rlike(CLOCK_ENDS)


def excuse(path: Column, varied: Column) -> Column:
    """Whether a difference is put down to the run: clocks always, other minted names if they varied before."""
    leaf = _leaf(path)
    return _clock(path) | (varied & (leaf.rlike(MINTED_NAMES) | leaf.rlike(MINTED_ENDS) | leaf.rlike(DURATION_ENDS)))


def type_of(value: Column) -> Column:
    """string, number, boolean or object (null and lists among them) of a JSON text; null where there is none."""
    first = F.substring(F.ltrim(value), 1, 1)
    return F.when(value.isNull(), None).when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first.isin("{", "[", "n"), "object").otherwise("number")


def satisfied(expected: Column, actual: Column, tolerance: Column) -> Column:
    """Whether two JSON texts hold the same value of the same type; null, as absent, satisfies nothing.

    Numbers are equal by value, or within the tolerance where one was recorded; key order does
    not matter, array order does; 60 is not "60".
    """
    e, a = expected.try_cast("double"), actual.try_cast("double")
    numbers = (type_of(expected) == "number") & (type_of(actual) == "number")
    plain = type_of(expected) != "object"
    same = (type_of(expected) == type_of(actual)) & F.when(plain, expected == actual).otherwise(canonical(expected).eqNullSafe(canonical(actual)))
    return F.coalesce(F.when(numbers & tolerance.isNotNull(), F.abs(a - e) <= tolerance).when(numbers, a == e).otherwise(same), F.lit(False))


def difference_kind(kind: Column, expected: Column, actual: Column) -> Column:
    """What kind of difference lies between two JSON texts that are not the same; null texts are absent."""
    e, a = expected.try_cast("double"), actual.try_cast("double")
    numbers = (type_of(expected) == "number") & (type_of(actual) == "number")
    return (
        F.when(kind.isin("http-status", "row-count"), kind).when(kind == "error-present", "error-vs-success").when(kind == "exit-code", "value-difference")
        .when(actual.isNull(), "missing-field").when(expected.isNull(), "extra-field")
        .when(type_of(expected) != type_of(actual), "type-difference")
        .when(numbers & (F.floor(e + 0.5) == F.floor(a + 0.5)), "precision")
        .otherwise("value-difference")
    )


def severity_of(difference: Column, critical: Column) -> Column:
    return F.when(difference.isin("http-status", "error-vs-success", "one-side-unreachable") | critical, "CRITICAL").when(difference.isNotNull(), "MAJOR")


#: What an assertion has besides its keys, path and expected value, and what is taken where a frame lacks it.
_DEFAULTS = {"kind": ("string", "json-value"), "tolerance": ("double", None), "normalized": ("boolean", False), "critical": ("boolean", False)}


def evaluated(assertions: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, kind, expected, actual, excused, difference, severity) of each assertion.

    ``assertions`` has the keys, ``path``, ``value`` (JSON text) and, where they are known,
    ``kind``, ``tolerance``, ``normalized`` and ``critical``; ``recorded`` has keys, path and
    value of an execution, unique by keys and path. One implementation judges a captured
    baseline and a candidate alike. Normalized assertions and clock readings are excused. A path
    without a row is absent; null keys match nothing.
    """
    known = {c: F.col(c) if c in assertions.columns else F.lit(v).cast(t).alias(c) for c, (t, v) in _DEFAULTS.items()}
    asked = assertions.select(*keys, "path", F.col("value").alias("expected"), *known.values())
    rows = asked.join(recorded.select(*keys, "path", F.col("value").alias("actual")), [*keys, "path"], "left")
    return _judged(rows.withColumn("excused", F.coalesce("normalized", F.lit(False)) | _clock(F.col("path"))), keys, ["kind"])


def _judged(rows: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    kind = F.when(~F.col("excused") & ~satisfied(F.col("expected"), F.col("actual"), F.col("tolerance")), difference_kind(F.col("kind"), F.col("expected"), F.col("actual")))
    rows = rows.withColumn("difference", kind)
    return rows.select(*keys, "path", *more, "expected", "actual", "excused", "difference", severity_of(F.col("difference"), F.coalesce("critical", F.lit(False))).alias("severity"))


def compare(baseline: DataFrame, probe: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, varied, expected, actual, excused, difference, severity) of each baseline leaf.

    The frames have the keys, ``path`` and ``value`` (JSON text); they are grouped once by keys
    and path. A leaf that the probe shows otherwise has varied; a leaf without a row in the
    candidate is missing; what only the probe or candidate has is no assertion. Of rows repeated
    by keys and path the greatest value counts; null keys form groups of their own.
    """
    sides = {"expected": baseline, "again": probe, "actual": candidate}
    rows = None
    for name, df in sides.items():
        one = df.select(*keys, "path", F.lit(name).alias("side"), "value")
        rows = one if rows is None else rows.unionByName(one)
    value = lambda s: F.max(F.when(F.col("side") == s, F.col("value"))).alias(s)
    had = lambda s: F.bool_or(F.col("side") == s)
    one = rows.groupBy(*keys, "path").agg(*map(value, sides), had("expected").alias("asked"), had("again").alias("probed")).where("asked")
    one = one.withColumn("varied", F.col("probed") & ~F.col("expected").eqNullSafe(F.col("again"))).withColumn("excused", excuse(F.col("path"), F.col("varied")))
    return _judged(one.withColumn("kind", F.lit("json-value")).withColumn("tolerance", F.lit(None).cast("double")).withColumn("critical", F.lit(False)), keys, ["varied"])


def case_outcomes(compared: DataFrame, cases: DataFrame, keys: list[str], executions: DataFrame | None = None) -> DataFrame:
    """(keys, outcome, reason, mismatches, severity) of each case.

    ``cases`` has the keys, ``status``, ``holds`` (whether the captured baseline satisfies its
    own assertions; null if there is none) and ``execution`` (the candidate's status, null if
    there is none). A case that cannot be judged is ``inconclusive``, never passed; one that was
    not reached is ``modern-unreachable``. Rows of ``executions`` whose case is unknown are an
    error at run time.
    """
    found = compared.groupBy(*keys).agg(F.count("difference").alias("n"), F.bool_or(F.col("severity") == "CRITICAL").alias("critical"))
    reason = (
        F.when(~F.col("status").eqNullSafe("passing-against-legacy"), "not passing against legacy")
        .when(F.col("holds").isNull(), "no captured baseline").when(~F.col("holds"), "baseline has drifted")
        .when(F.col("execution").isNull(), "no execution").when(F.col("execution") == "unreachable", "unreachable")
        .when(F.col("execution").isin("error", "timeout"), F.concat(F.lit("ended "), "execution"))
    )
    rows = cases.join(found, keys, "left").withColumn("reason", reason)
    n = F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint")
    outcome = F.when(F.col("reason") == "unreachable", "modern-unreachable").when(F.col("reason").isNotNull(), "inconclusive").when(n > 0, "divergent").otherwise("equal")
    out = rows.select(*keys, outcome.alias("outcome"), "reason", n.alias("mismatches"), F.when(n > 0, F.when(F.col("critical"), "CRITICAL").otherwise("MAJOR")).alias("severity"))
    if executions is None:
        return out
    unknown = executions.select(*keys).distinct().join(cases.select(*keys), keys, "left_anti")
    failing = F.raise_error(F.concat(F.lit("an execution was supplied for an unknown case: "), F.concat_ws("/", *keys)))
    return out.unionByName(unknown.select(*keys, failing.cast("string").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("mismatches"), F.lit(None).cast("string").alias("severity")))


def verdict(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group: counts by outcome, verdict and confidence (share of cases that were decided)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    equal, divergent, unreachable, unclear, total = n("equal"), n("divergent"), n("modern-unreachable"), n("inconclusive"), F.count("*")
    return outcomes.groupBy(*(by or [])).agg(
        total.alias("cases"), equal.alias("equal"), divergent.alias("divergent"), unreachable.alias("unreachable"), unclear.alias("inconclusive"),
        F.when(divergent + unreachable > 0, "NOT_EQUIVALENT").when((total == 0) | (unclear > 0), "INCONCLUSIVE").otherwise("EQUIVALENT").alias("verdict"),
        F.when(total > 0, F.round((equal + divergent) / total, 4)).otherwise(0.0).alias("confidence"))


def repair_status(before: Column, after: Column, equivalent: Column) -> Column:
    """RESOLVED, REGRESSED, IMPROVED or NO_CHANGE from the mismatch sets before and after."""
    return (
        F.when(equivalent & (F.size(after) == 0), "RESOLVED")
        .when(F.size(F.array_except(after, before)) > 0, "REGRESSED")
        .when(F.size(F.array_except(before, after)) > 0, "IMPROVED")
        .otherwise("NO_CHANGE")
    )
