"""Keyed operators over tables: first, last and best rows, sequences, islands, deltas, checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import stored


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; of equal rows any one. Null keys form a key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """``values`` of the row with the greatest ``order`` in each key, by an aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(*(F.max_by(v, order).alias(v) for v in values))


def with_sequence(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """A dense number from 0 in each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their rank ``rn`` and how many rows of the key are left out."""
    counts = df.groupBy(*keys).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("overflow"))
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)
    return ranked.join(counts, keys)


def islands(df: DataFrame, keys: list[str], at: str, gap: int, distance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Runs of rows of a key whose neighbours are at most ``gap`` apart: (keys, lo, hi, size)."""
    w = W.partitionBy(*keys).orderBy(at)
    apart = (distance or (lambda a, b: a - b))(F.col(at), F.lag(at).over(w))
    flagged = df.withColumn("_new", F.when(apart <= gap, 0).otherwise(1))
    numbered = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("size")).drop("_island")


def reset_sessions(df: DataFrame, keys: list[str], order: list[Column], seq: str, name: str = "session") -> DataFrame:
    """Sessions that begin at the first row of a key and wherever ``seq`` does not rise."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(seq).over(w)
    fresh = F.when(before.isNull() | (F.col(seq) <= before), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def between_days(df: DataFrame, ts: str, first: str = "1900-01-01", last: str | None = None) -> DataFrame:
    """Rows whose day lies in a closed range, as bounds on the timestamp itself so that they reach the scan."""
    low = F.col(ts) >= F.lit(first).cast("timestamp_ntz")
    return df.where(low if last is None else low & (F.col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))


def of_type(df: DataFrame, column: str, asked: str | None) -> DataFrame:
    """Rows of a type; ALL or nothing asks for every row; anything but letters and underscores is refused."""
    kind = (asked or "ALL").strip().upper()
    if not kind.replace("_", "").isalpha() or not kind.isascii():
        raise ValueError(f"not a type: {asked!r}")
    return df if kind == "ALL" else df.where(F.col(column) == kind)


def daily_rollup(ledger: DataFrame) -> DataFrame:
    """(account_id, day, entry_type, n, total)."""
    return ledger.groupBy("account_id", F.to_date("created_at").alias("day"), "entry_type").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def with_lookup_sum(df: DataFrame, facts: DataFrame, key: str, fact_key: str, value: Column, name: str) -> DataFrame:
    """Each row with the sum of ``value`` over the facts of its key, 0 where there are none."""
    sums = facts.groupBy(F.col(fact_key).alias("_k")).agg(F.sum(value).alias(name))
    return df.join(sums, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def within_tolerance(diff: Column, tolerance: str) -> Column:
    """A difference other than zero within a tolerance, bounds included."""
    return (F.abs(diff) > 0) & (F.abs(diff) <= F.lit(tolerance).cast("decimal(18,4)"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(column, n), most frequent first, equals by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def seen_before(df: DataFrame, key: str, raw: str) -> DataFrame:
    """``dup`` is 1 for rows whose raw text equals the lower-cased text of an earlier row: texts with capitals never match."""
    first = df.groupBy(F.lower(raw).alias("_low")).agg(F.min(key).alias("_first"))
    return df.join(first, F.col(raw) == F.col("_low"), "left").withColumn("dup", F.when(F.col("_first") < F.col(key), 1).otherwise(0)).drop("_low", "_first")


def number_after(df: DataFrame, order: str | list[str], top: DataFrame | None, name: str, ranges: int = 64) -> DataFrame:
    """Consecutive ids from ``top`` + 1 (1 where there is none) in an order, without a sort in one task: rows are counted
    in ranges of the order, and each range numbers its own rows from the count before it."""
    order = [order] if isinstance(order, str) else order
    ranged = stored(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))  # ranges are sampled, so they are fixed here
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per range
    start = F.lit(0) if top is None else top.select(F.coalesce(F.col(top.columns[0]), F.lit(0))).scalar()
    counted = before.select("_part", (F.col("_before") + start).alias("_before"))
    numbered = ranged.withColumn("_rn", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return numbered.join(counted, "_part").withColumn(name, F.col("_before") + F.col("_rn")).drop("_part", "_before", "_rn")


def apply_deltas(base: DataFrame, deltas: DataFrame, key: str, delta_key: str, column: str) -> DataFrame:
    """Relative updates: their sum per key, applied once, as their order does not matter."""
    sums = deltas.groupBy(F.col(delta_key).alias("_k")).agg(F.sum("delta").alias("_d"))
    return base.join(sums, F.col(key) == F.col("_k"), "left").withColumn(column, F.col(column) + F.coalesce("_d", F.lit(0))).drop("_k", "_d")


def rule_counts(spark: SparkSession, violations: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) of the frames of violating rows, zero counts included."""
    return reduce(DataFrame.unionByName, (v.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, v in violations.items()))


def immutability_violations(old: DataFrame, new: DataFrame, key: str, fixed: str, columns: list[str]) -> DataFrame:
    """(key, violation): rows that satisfied ``fixed`` and were changed or deleted since."""
    n = new.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    changed = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in columns))
    joined = old.where(fixed).join(n, F.col(key) == F.col("_k"), "left")
    return joined.where(F.col("_k").isNull() | changed).select(key, F.when(F.col("_k").isNull(), "deleted").otherwise("changed").alias("violation"))


def legs(df: DataFrame, amounts: dict[str, Column], kind: str, amount: str) -> DataFrame:
    """Each row once per leg, with the leg's name and amount."""
    pairs = F.array(*(F.struct(F.lit(k).alias("_kind"), a.alias("_amount")) for k, a in amounts.items()))
    return df.withColumn("_leg", F.explode(pairs)).withColumn(kind, F.col("_leg._kind")).withColumn(amount, F.col("_leg._amount")).drop("_leg")


def guarded_fold(df: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """(key, order, accepted, balance): amounts applied in order, each only if the balance stays at or above zero.

    A running sum cannot say this, as a refused row does not count; state is carried from row
    to row of a key in sorted Arrow batches, so the rows of a key are streamed, not gathered.
    """
    import pandas as pd

    key_type, order_type = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()

    def run(batches):
        current, balance = object(), None
        for pdf in batches:
            accepted, balances = [], []
            for k, a in zip(pdf[key], pdf[amount]):
                if k != current:
                    current, balance = k, a * 0
                ok = balance + a >= 0
                if ok:
                    balance += a
                accepted.append(ok)
                balances.append(balance)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "accepted": accepted, "balance": balances})

    ordered = df.select(key, order, amount).where(F.col(key).isNotNull() & F.col(amount).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(run, f"{key} {key_type}, {order} {order_type}, accepted boolean, balance decimal(38,4)")
