"""Data quality: rule violations, acceptance criteria, demotion of claims, recounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule whose condition of violation holds; an unknown condition is no violation."""
    names = F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))
    return df.select(key, F.explode(names).alias("rule"))


def at_least(df: DataFrame, n: int) -> DataFrame:
    return df.agg((F.count("*") >= n).alias("satisfied"))


def none_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg((F.count_if(condition) == 0).alias("satisfied"))


def all_where(df: DataFrame, condition: Column) -> DataFrame:
    """True over nothing; an unknown condition does not hold."""
    return df.agg((F.count_if(~F.coalesce(condition, F.lit(False))) == 0).alias("satisfied"))


def acceptance(spark: SparkSession, checks: dict[str, DataFrame]) -> DataFrame:
    """(criterion, satisfied), one row per check; each check is one row with ``satisfied``."""
    return reduce(DataFrame.unionByName, (c.select(F.lit(n).alias("criterion"), F.coalesce("satisfied", F.lit(False)).alias("satisfied")) for n, c in checks.items()))


def demote(df: DataFrame, unsupported: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep their standing and rows that lose it; an unknown condition keeps a row."""
    lost = F.coalesce(unsupported, F.lit(False))
    return df.where(~lost), df.where(lost)


def recount(df: DataFrame, key: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(field, key) wherever a stored number is not the counted one."""
    return reduce(DataFrame.unionByName, (df.where(~F.col(a).eqNullSafe(F.col(b))).select(F.lit(n).alias("field"), F.col(key).alias("key")) for n, (a, b) in pairs.items()))
