"""Numeric, date and conditional functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up_to_plus(c: Column) -> Column:
    """Nearest whole number, ties towards plus infinity."""
    return F.floor(c + 0.5)


def band(c: Column) -> Column:
    """Bands of a confidence between 0 and 1."""
    return F.when(c >= 0.85, "HIGH").when(c >= 0.6, "MEDIUM").when(c > 0, "LOW").otherwise("NONE")


def cents_text(c: Column) -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(F.abs(c) / 100).cast("string"), F.lit("."), F.lpad(F.pmod(F.abs(c), F.lit(100)).cast("string"), 2, "0"))


def lenient_decimal(c: Column) -> Column:
    return F.trim(c).try_cast("decimal(18,4)")


def lenient_long(c: Column) -> Column:
    """Whole part of a number; null for anything else."""
    return F.trim(c).try_cast("decimal(38,6)").cast("bigint")


def next_business_day(d: Column) -> Column:
    return F.date_add(d, F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1))


def value_date(ts: Column, cut_off_hour: int = 17) -> Column:
    """The day of a timestamp, or the next business day from the cut-off on."""
    return F.when(F.hour(ts) >= cut_off_hour, next_business_day(F.to_date(ts))).otherwise(F.to_date(ts))


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7)


def parse_day_or_time(c: Column) -> Column:
    """A ten-character day (its start) or a local date and time; null for blank or other texts."""
    t = F.trim(c)
    return F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t).try_cast("timestamp_ntz")


def is_instant(c: Column) -> Column:
    """An ISO-8601 instant with an offset and at most nine digits of a second."""
    return F.coalesce(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$") & c.try_cast("timestamp").isNotNull(), F.lit(False))


def display_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, never below 0."""
    ms = lambda c: F.unix_micros(c.cast("timestamp")) / 1000
    return F.greatest(F.lit(0), F.floor(ms(end) - ms(start))).cast("bigint")


def branch_count(body: Column) -> Column:
    """Branching words and operators of a body of code."""
    return F.size(F.regexp_extract_all(body, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"), F.lit(0)))
