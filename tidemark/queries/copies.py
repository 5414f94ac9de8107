"""Differences between the copies of the legacy and the modern system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators import copydiff
from .registry import query

_FIELDS = {
    "accounts": "id account_number owner_name account_type status balance opened_at",
    "transfers": "id idempotency_key transfer_type from_account_id to_account_id beneficiary_name amount fee currency status retries memo value_date created_at settled_at",
    "ledger_entries": "id account_id entry_type amount reference memo status value_date created_at",
}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _oracle() -> str:
    """Every field of every target by its two names, in one long form, joined fully."""
    numbers = ", ".join(f"'{f}'" for f in copydiff.NUMERIC_FIELDS)
    instants = ", ".join(f"'{f}'" for f in copydiff.INSTANT_FIELDS)
    names = ", ".join(f"('{t}', '{f}', '{_camel(f)}')" for t, fs in _FIELDS.items() for f in fs.split())
    return f"""
    WITH pages AS (SELECT lower(trim(system_label)) AS sys, target_name, executed_at, result_id, result_rows FROM query_results),
    items AS (SELECT sys, target_name, executed_at, result_id, unnest(result_rows) AS j, generate_subscripts(result_rows, 1) AS pos FROM pages),
    ids AS (SELECT *, CAST(json_extract_string(j, '$.id') AS BIGINT) AS row_id FROM items WHERE sys IN ('legacy', 'modern')),
    last AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY sys, target_name, row_id ORDER BY executed_at DESC, result_id DESC, pos DESC) = 1),
    names(t, f, c) AS (VALUES {names}),
    raw AS (SELECT sys, target_name, row_id, f, coalesce(json_extract_string(j, '$.' || f), json_extract_string(j, '$.' || c)) AS v FROM last JOIN names ON t = target_name),
    cells AS (SELECT sys, target_name, row_id, f, CASE
        WHEN f IN ({numbers}) THEN CAST(CAST(v AS DECIMAL(38,10)) AS VARCHAR)
        WHEN f IN ({instants}) THEN CAST(epoch_us(CAST(CASE WHEN regexp_matches(v, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN v ELSE v || 'Z' END AS TIMESTAMPTZ)) AS VARCHAR)
        ELSE v END AS v FROM raw),
    l AS (SELECT * FROM cells WHERE sys = 'legacy'), m AS (SELECT * FROM cells WHERE sys = 'modern'),
    lr AS (SELECT DISTINCT target_name, row_id FROM l), mr AS (SELECT DISTINCT target_name, row_id FROM m)
    SELECT target_name, row_id, '*' AS field_name, 'missing_in_modern' AS diff_kind FROM lr ANTI JOIN mr USING (target_name, row_id)
    UNION ALL SELECT target_name, row_id, '*', 'missing_in_legacy' FROM mr ANTI JOIN lr USING (target_name, row_id)
    UNION ALL SELECT l.target_name, l.row_id, l.f, 'value' FROM l JOIN m ON l.target_name = m.target_name AND l.row_id = m.row_id AND l.f = m.f WHERE l.v IS DISTINCT FROM m.v
    """


@query(_oracle())
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return copydiff.page_differences(table(spark, sf, "query_results"))


@query(f"WITH d AS ({_oracle()}) SELECT target_name, field_name, diff_kind, count(*) AS rows_affected FROM d GROUP BY ALL")
def p4_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Differences by target, field and kind."""
    return p4_found(spark, sf).groupBy("target_name", "field_name", "diff_kind").agg(F.count("*").alias("rows_affected"))
