"""Functions over JSON texts by the VARIANT type, which tells null from absent."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _path(dotted: str) -> str:
    """``a.0.b`` as a path of VARIANT."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def get_path(json: Column, dotted: str) -> Column:
    """The text of the value at a dotted path; null if it or a step before it is null or absent, or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(json), _path(dotted), "string")


def has_path(json: Column, dotted: str) -> Column:
    """Whether there is a value, null included, at a path."""
    return F.coalesce(F.variant_get(F.try_parse_json(json), _path(dotted), "variant").isNotNull(), F.lit(False))


def canonical(json: Column) -> Column:
    """The JSON text with sorted keys and without blanks; null for a text that is no JSON."""
    return F.to_json(F.try_parse_json(json))


def content_hash(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def same_value(a: Column, b: Column) -> Column:
    """Equality by type and value: key order does not matter, array order does, 60 is not "60"."""
    return canonical(a).eqNullSafe(canonical(b))


def rendered(json: Column, dotted: str, most: int = 200) -> Column:
    """A value for reading: ``absent``, ``null`` or its canonical text, clipped."""
    v = F.variant_get(F.try_parse_json(json), _path(dotted), "variant")
    text = F.to_json(v)
    return F.when(v.isNull(), "absent").otherwise(F.substring(text, 1, most))


def leaves(df: DataFrame, column: str, keep: list[str], depth: int = 8) -> DataFrame:
    """(keep, path, value variant) of every scalar leaf of a JSON column.

    Levels are opened one after the other up to ``depth``; empty objects and arrays are leaves
    themselves, and what lies deeper stays one leaf. Texts that are no JSON give no rows.
    """
    level = df.select(*keep, F.lit("").alias("path"), F.try_parse_json(column).alias("value")).where("value is not null")
    done = None
    for _ in range(depth):
        kind = F.schema_of_variant("value")
        is_open = (kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~F.to_json("value").isin("{}", "[]")
        closed = level.where(~is_open)
        done = closed if done is None else done.unionByName(closed)
        opened = level.where(is_open)
        opened.createOrReplaceTempView("_open_leaves")
        names = ", ".join(f"t.{k}" for k in keep)
        level = df.sparkSession.sql(f"SELECT {names}, concat(t.path, CASE WHEN t.path = '' THEN '' ELSE '.' END, coalesce(x.key, cast(x.pos AS string))) AS path, x.value AS value FROM _open_leaves t, LATERAL variant_explode(t.value) x")
    return done.unionByName(level)


# Names of keys whose values are withheld, and what stands for them.
SECRET_KEYS = re.compile(r"(?i)api[_-]?key|authorization|password|secret|token")
WITHHELD, TRUNCATED = "***redacted***", "[truncated]"


def _withheld(value, depth: int, most: int):
    if depth > most:
        return TRUNCATED
    if isinstance(value, list):
        return [_withheld(v, depth + 1, most) for v in value]
    if isinstance(value, dict):
        return {k: (v[:4] + WITHHELD if isinstance(v, str) else WITHHELD) if SECRET_KEYS.search(k) else _withheld(v, depth + 1, most) for k, v in value.items()}
    return value


def redacted(json_text: Column, depth: int = 8) -> Column:
    """A JSON text with the values of secret-named keys replaced at any level, in canonical form.

    Strings keep their first four characters, anything else goes whole; what lies more than
    ``depth`` levels down is cut. Null for null and for a text that is no JSON.
    """
    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                return None
            return json.dumps(_withheld(value, 0, depth), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return texts.map(one)
    return work(json_text)
