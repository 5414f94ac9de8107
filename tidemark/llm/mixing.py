"""Mixing sources to target weights by token counts."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import spread, stored

#: Folder of the public tokenizers' vocabularies and the file that is used; both are parameters.
TOKENIZER_DIR = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents for each range of the hash keys. Sums per range make the prefix sums; only the range with the cut is sorted.
RANGE_DOCS, LEAST_RANGES = 100_000, 1024


def encoding(path: str):
    """The tokenizer of a vocabulary file in rank form."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents that have an id, a source and at least one token."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            counts = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": counts})

    held = documents.where("doc_id is not null and source is not null and text is not null and text <> ''").select("doc_id", "source", "text")
    return spread(held).mapInPandas(run, "doc_id bigint, source string, tokens bigint").where("tokens > 0")


def ranges_for(counts: DataFrame) -> int:
    """Ranges for a stored table of counts: they grow with the documents, so that none does."""
    return max(LEAST_RANGES, counts.count() // RANGE_DOCS)


def _slot(key: Column, ranges: int) -> Column:
    """The range of a key when the whole space of hashes is cut into the next power of two above ``ranges``, in ascending order."""
    bits = (ranges - 1).bit_length()
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("bigint")


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, ranges: int = LEAST_RANGES) -> tuple[DataFrame, DataFrame]:
    """(budgets, ranges table) of each mix.

    Without ``total_tokens`` a mix is made as large as its scarcest source allows: the least of
    size x max_repeats / share. With it, no mix is larger than that. Sources of a mix without
    any document make its size 0.
    """
    keyed = counts.withColumn("slot", _slot(F.xxhash64("doc_id", F.lit(seed)), ranges))
    per = keyed.groupBy("source", "slot").agg(F.sum("tokens").alias("tokens"))
    per = per.withColumn("before", F.sum("tokens").over(W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)))  # one row per range and source
    per = per.withColumn("before", F.coalesce("before", F.lit(0)))
    size = per.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = targets.where("mix_name is not null and source_name is not null and target_share > 0 and max_repeats > 0").select("mix_name", "source_name", "target_share", "max_repeats")
    t = t.join(size, t["source_name"] == size["source"], "left").drop("source").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.min(F.floor(F.col("available") * F.col("max_repeats") / F.col("target_share"))).over(W.partitionBy("mix_name"))  # a mix has one row per source
    limit = F.least(most, F.lit(total_tokens)) if total_tokens is not None else most
    budget = F.least(F.floor(F.col("target_share") * F.col("mix_tokens")), F.col("available") * F.col("max_repeats")).cast("bigint")
    budgets = t.withColumn("mix_tokens", limit.cast("bigint")).withColumn("budget", budget)
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.greatest("available", F.lit(1)))).otherwise(0).cast("int")
    budgets = budgets.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    return budgets, per


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, ranges: int | None = None) -> DataFrame:
    """(mix_name, source_name, doc_id, tokens, uses, used_tokens): the documents of each mix.

    In each source documents stand in the order of a hash-random key, whatever the number of ranges. A budget takes whole
    epochs and of the last one all documents up to the cut; the document that the cut meets
    gives only its first tokens, so that the budget is met to the token. ``uses`` counts the
    epochs that use a document, the last in part if ``used_tokens`` is less than uses x tokens.

    Documents without a text or source and sources without a target take no part; ties of the
    key fall to the lower id. ``counts`` are those of token_counts.
    """
    ranges = ranges or ranges_for(counts)
    budgets, per = plan(counts, targets, total_tokens, seed, ranges)
    share = budgets.select("mix_name", "source_name", "epochs", "rest")
    cuts = per.join(share, per["source"] == share["source_name"]).select("mix_name", "source", "slot", "epochs", F.greatest(F.lit(0), F.least("tokens", F.col("rest") - F.col("before"))).cast("bigint").alias("part"), F.col("tokens").alias("slot_tokens"))
    docs = counts.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).withColumn("slot", _slot(F.col("key"), ranges))
    rows = docs.join(cuts, ["source", "slot"])
    whole = rows.where((F.col("part") == 0) | (F.col("part") == F.col("slot_tokens"))).withColumn("last", F.when(F.col("part") == 0, 0).otherwise(F.col("tokens")).cast("bigint"))
    order = W.partitionBy("mix_name", "source").orderBy("key", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    met = rows.where((F.col("part") > 0) & (F.col("part") < F.col("slot_tokens")))  # one range of each source and mix
    met = met.withColumn("last", F.greatest(F.lit(0), F.least("tokens", F.col("part") - F.coalesce(F.sum("tokens").over(order), F.lit(0)))).cast("bigint"))
    out = whole.unionByName(met).withColumn("uses", F.col("epochs") + (F.col("last") > 0).cast("int")).where("uses > 0")
    return out.select("mix_name", F.col("source").alias("source_name"), "doc_id", "tokens", "uses", (F.col("epochs") * F.col("tokens") + F.col("last")).alias("used_tokens"))


def shares(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(mix_name, source_name, target_share, actual_share, used_tokens, available_tokens, documents, most_uses) as the mix came out."""
    made = mix(counts, targets, total_tokens, seed).groupBy("mix_name", "source_name").agg(F.sum("used_tokens").alias("used_tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    budgets, _ = plan(counts, targets, total_tokens, seed)
    out = budgets.select("mix_name", "source_name", "target_share", "available").join(made, ["mix_name", "source_name"], "left").na.fill(0, ["used_tokens", "documents", "most_uses"])
    total = F.sum("used_tokens").over(W.partitionBy("mix_name"))
    return out.select("mix_name", "source_name", "target_share", F.when(total > 0, F.round(F.col("used_tokens") / total, 6)).otherwise(0.0).alias("actual_share"), "used_tokens", F.col("available").alias("available_tokens"), "documents", "most_uses")


def counted(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token counts as a stored table, as every step of a mix reads them again."""
    return stored(token_counts(documents, vocabulary))
