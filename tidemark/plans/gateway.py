"""Read-only SQL entry over registered tables, with a row cap that is reported."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Statements that may run and words that may not occur in them.
READING = frozenset("select with show explain values table".split())
WRITING = frozenset("insert update delete drop alter create truncate grant revoke copy call do set reset lock vacuum reindex cluster analyze begin commit rollback savepoint prepare execute deallocate merge refresh listen notify discard import".split())

_LITERALS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*[\s\S]*?\*/|\$(\w*)\$[\s\S]*?\$\1\$")


class NotReadOnly(ValueError):
    """The statement could change data or is more than one statement."""


def require_read_only(sql: str) -> None:
    bare = _LITERALS.sub(" ", sql).strip().rstrip(";").strip()
    words = re.findall(r"[A-Za-z_]\w*", bare.lower())
    if not words or ";" in bare:
        raise NotReadOnly("one statement is expected")
    if words[0] not in READING:
        raise NotReadOnly(f"{words[0]} is not a reading statement")
    bad = sorted(WRITING & set(words))
    if bad:
        raise NotReadOnly(f"words not allowed: {', '.join(bad)}")


@dataclass
class Page:
    """At most ``max_rows`` rows of a result and whether there were more."""

    rows: DataFrame
    truncated: bool


def run(spark: SparkSession, sql: str, max_rows: int = 500, args: dict | list | None = None, read_only: bool = True) -> Page:
    """Run a statement and keep its first rows; one row more is asked for to see whether it was cut."""
    if read_only:
        require_read_only(sql)
    df = spark.sql(sql, args=args) if args is not None else spark.sql(sql)
    return Page(df.limit(max_rows), df.limit(max_rows + 1).count() > max_rows)
