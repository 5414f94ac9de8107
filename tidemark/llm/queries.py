"""Queries over the training-data operators, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from . import codetext, credentials, doclang, leakage, mixing, neardup, sharedspans, syntax

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the registered queries.
RUN = 120
LEAK_WORDS = 13
LEAK_EDITS = 1
CLONE_GRAM, CLONE_SIMILARITY, CLONE_TOKENS = 5, Fraction(7, 10), 30


def _secret_texts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("log_records", "log_id", ["message"]), ("command_results", "command_id", ["stdout", "stderr"]), ("model_files", "file_id", ["file_content"])]
    out = None
    for name, key, fields in parts:
        fields_of = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("content")) for f in fields)))
        t = table(spark, sf, name).select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), fields_of.alias("x")).select("source_table", "record_id", "x.*")
        out = t if out is None else out.unionByName(t)
    return out


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.find_credentials(_secret_texts(spark, sf))


def p1_redacted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold credentials, with these masked and every other character in place."""
    files = table(spark, sf, "model_files").where("file_id is not null")
    texts = files.select(F.lit("model_files").alias("source_table"), F.col("file_id").alias("record_id"), F.lit("file_content").alias("field_name"), F.col("file_content").alias("content"))
    places = credentials.find_credentials(texts).groupBy("record_id").agg(F.collect_set(F.struct("start_pos", "end_pos")).alias("places"))  # bounded by one text
    held = files.join(places, F.col("file_id") == F.col("record_id"))
    return held.select("file_id", "file_path", F.size("places").alias("credentials"), credentials.redact(F.col("file_content"), F.col("places")).alias("redacted"))


def _span_records(spark: SparkSession, sf: str) -> DataFrame:
    java = table(spark, sf, "java_methods").select(F.lit(0).alias("src"), F.col("method_id").alias("id"), F.col("body").alias("text"))
    sql = table(spark, sf, "sql_statements").select(F.lit(1).alias("src"), F.col("statement_id").alias("id"), F.col("raw_text").alias("text"))
    return java.unionByName(sql)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("source_table", F.when(F.col("src") == 0, "java_methods").otherwise("sql_statements"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    shared = sharedspans.shared_chars(_span_records(spark, sf), RUN)
    return _named(shared).select("source_table", F.col("id").alias("record_id"), "shared_chars")


def p2_record_share(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with how much of it is shared elsewhere."""
    rec = _span_records(spark, sf).where("id is not null").select("src", "id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    shared = sharedspans.shared_chars(_span_records(spark, sf), RUN)
    out = _named(rec.join(shared, ["src", "id"], "left"))
    n = F.coalesce("shared_chars", F.lit(0))
    return out.select("source_table", F.col("id").alias("record_id"), "chars", n.alias("shared_chars"), F.when(F.col("chars") > 0, F.round(n / F.col("chars"), 4)).otherwise(0.0).alias("share"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return codetext.span_languages(table(spark, sf, "source_spans")).select("span_id", "lang")


def p3_file_shares(spark: SparkSession, sf: str) -> DataFrame:
    return codetext.file_shares(table(spark, sf, "model_files"), table(spark, sf, "source_spans"))


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "java_methods").select(F.col("method_id").alias("id"), F.col("normalized_body").alias("text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.near_pairs(_methods(spark, sf), CLONE_GRAM, CLONE_SIMILARITY, CLONE_TOKENS)
    return pairs.select(F.col("id_a").alias("method_a"), F.col("id_b").alias("method_b"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = neardup.near_groups(_methods(spark, sf), CLONE_GRAM, CLONE_SIMILARITY, CLONE_TOKENS)
    return groups.withColumnRenamed("id", "method_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.check_files(table(spark, sf, "model_files")).where("not valid").select("file_id")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, sf, "model_files"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), LEAK_WORDS, LEAK_EDITS)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Of the operator's matches within the error budget those without an edit."""
    return _leaks(spark, sf).where("distance = 0").select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per test item the documents with an exact and with an edited passage of it; all items are listed."""
    hits = _leaks(spark, sf).groupBy("item_id").agg(
        F.count_distinct(F.when(F.col("distance") == 0, F.col("doc_id"))).alias("exact_docs"), F.count_distinct(F.when(F.col("distance") > 0, F.col("doc_id"))).alias("edited_docs"))
    items = table(spark, sf, "eval_items").where("item_id is not null").select("item_id", "item_set").distinct()
    return items.join(hits, "item_id", "left").na.fill(0, ["exact_docs", "edited_docs"])


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(mixing.counted(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(mixing.counted(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs in another language than the label names, or without such a label."""
    parts = doclang.paragraph_languages(table(spark, sf, "documents"))
    return parts.where("named is null or named <> lang").select("doc_id", "seg_no", "lang")


def p9_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Every part of a document that is not blank; ``counts`` marks those that p9_found looks at."""
    return doclang.part_languages(table(spark, sf, "documents"))


def p9_documents(spark: SparkSession, sf: str) -> DataFrame:
    return doclang.document_languages(table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (p1_found, p1_redacted_files, p2_found, p2_record_share, p3_found, p3_file_shares, p5_found, p5_groups, p6_found, p6_rates, p7_found, p7_leaked_items, p8_mix, p8_shares, p9_found, p9_paragraphs, p9_documents)}


_WORDS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))"
_RECORDS = "SELECT 'java_methods' AS source_table, method_id AS record_id, body AS t FROM java_methods UNION ALL SELECT 'sql_statements', statement_id, raw_text FROM sql_statements"
_SHARED = f"""r AS ({_RECORDS}), w AS (SELECT source_table, record_id, s, substr(t, s, {RUN}) AS x FROM (SELECT *, unnest(range(1, length(t) - {RUN} + 2)) AS s FROM r WHERE length(t) >= {RUN})),
  hot AS (SELECT x FROM w GROUP BY x HAVING count(DISTINCT (source_table, record_id)) > 1), k AS (SELECT source_table, record_id, s, lead(s) OVER (PARTITION BY source_table, record_id ORDER BY s) AS n FROM w WHERE x IN (SELECT x FROM hot)),
  shared AS (SELECT source_table, record_id, CAST(sum(least({RUN}, coalesce(n - s, {RUN}))) AS BIGINT) AS shared_chars FROM k GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say: exact windows, exact shingle sets and exact runs of words."""
    doc, item = _WORDS.format("text"), _WORDS.format("item_text")
    return {
        "p2_found": f"WITH {_SHARED} SELECT * FROM shared",
        "p2_record_share": f"WITH {_SHARED} SELECT r.source_table, r.record_id, coalesce(length(t), 0) AS chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(t) > 0 THEN round(coalesce(shared_chars, 0) / length(t), 4) ELSE 0 END AS share FROM r LEFT JOIN shared USING (source_table, record_id)",
        "p5_found": f"""WITH t AS (SELECT method_id AS id, regexp_extract_all(normalized_body, '[A-Za-z0-9_$]+|[^\\sA-Za-z0-9_$]') AS t FROM java_methods WHERE normalized_body IS NOT NULL),
  g AS (SELECT id, list_distinct(list_transform(range(1, len(t) - {CLONE_GRAM - 2}), lambda i: array_to_string(t[i:i + {CLONE_GRAM - 1}], ' '))) AS g FROM t WHERE len(t) >= {CLONE_TOKENS}),
  u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g), c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
  SELECT a AS method_a, b AS method_b FROM c WHERE k * {CLONE_SIMILARITY.denominator} >= {CLONE_SIMILARITY.numerator} * (na + nb - k)""",
        "p7_found": f"""WITH d AS (SELECT doc_id, {doc} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {item} AS w FROM eval_items WHERE item_text IS NOT NULL),
  dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {LEAK_WORDS - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LEAK_WORDS - 2})) AS k FROM d)), iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + {LEAK_WORDS - 1}], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - {LEAK_WORDS - 2})) AS k FROM i))
  SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)""",
    }
