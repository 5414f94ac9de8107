"""Near-duplicate records: set similarity of token runs with count-vector bounds.

Exact copies form classes first. Pairs of classes come from a prefix index over shingles in
ascending order of frequency, are bounded by their count vectors and verified on whole sets.
The README says why the prefix index stands where an R-tree over the vectors was named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, stored
from ..operators.components import connected_components

#: A token is a run of word characters or any other single character that is not white space.
CODE_TOKEN = re.compile(r"[A-Za-z0-9_$]+|[^\sA-Za-z0-9_$]")
#: Groups of the count vectors.
GROUPS = 64
#: Shingles are told apart by 48 bits of their hash; two of one pair of sets agree by chance less than once in 10**9 pairs.
GRAM_BYTES = 6
#: The order of shingles in the prefix index, which sets its cost and not its result: one set in
#: ORDER_SAMPLE is counted, shingles counted ORDER_FROM times or more come last by count, at most
#: ORDER_MOST of them (so the table of counts has a bounded size), the rest by hash.
ORDER_SAMPLE, ORDER_FROM, ORDER_MOST = 8, 4, 1 << 22


def shingles(text: str, k: int, min_tokens: int) -> np.ndarray | None:
    """Sorted distinct 48-bit hashes of the runs of ``k`` tokens; None for texts that are too short."""
    tokens = CODE_TOKEN.findall(text)
    if len(tokens) < max(k, min_tokens):
        return None
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(" ".join(tokens[i : i + k])) for i in range(len(tokens) - k + 1)], np.uint64) >> np.uint64(64 - 8 * GRAM_BYTES))


def packed(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // GRAM_BYTES, 8), np.uint8)
    wide[:, :GRAM_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, GRAM_BYTES)
    return wide.reshape(-1).view("<u8")


def counts(grams: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each group; minima of two such vectors sum to no less than the overlap."""
    return np.bincount((grams % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)


def _sets(k: int, min_tokens: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h1, h2, text in zip(pdf["h1"].tolist(), pdf["h2"].tolist(), pdf["text"]):
                s = shingles(text, k, min_tokens)
                if s is not None:
                    data = packed(s)
                    out.append((h1, h2, xxhash.xxh3_64_intdigest(data) - (1 << 63), len(s), data))
            yield pd.DataFrame(out, columns=["h1", "h2", "cid", "n", "grams"])
    return work


def _token(grams: np.ndarray) -> np.ndarray:
    """32 bits of each shingle, by which the index joins; more shingles than one may share them."""
    return (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sample_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            token, n = np.unique(np.concatenate([_token(unpacked(g)) for g in pdf["grams"]]), return_counts=True)
            yield pd.DataFrame({"token": token.view(np.int32), "c": n.astype(np.int64)})


def _order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens in ascending order, and the count of each in the sample."""
    sample = sets.where(F.pmod("cid", F.lit(ORDER_SAMPLE)) == 0).select("grams")
    df = stored(sample.mapInPandas(_sample_counts, "token int, c bigint").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= ORDER_FROM))
    # counts by eighths of their logarithm, a few hundred rows: where to cut so that no more than ORDER_MOST are left
    level = F.floor(F.log2("c") * 8).cast("int")
    least, left = 1 << 30, ORDER_MOST
    for row in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        left -= row["n"]
        if left < 0:
            break
        least = row["level"]
    top = df.where(level >= least).toPandas()
    token = top["token"].to_numpy(np.int32).view(np.uint32)
    order = np.argsort(token)
    return token[order], top["c"].to_numpy(np.int64)[order]


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()  # classes of this task
    for pdf in batches:
        out = []
        for cid, n, data in zip(pdf["cid"].tolist(), pdf["n"].tolist(), pdf["grams"]):
            if cid not in seen:
                seen.add(cid)
                c = counts(unpacked(data))
                out.append((cid, n, c.astype(np.uint8 if c.max() < 256 else np.int32).tobytes()))
        yield pd.DataFrame(out, columns=["cid", "n", "counts"])


def _within_bound(p: int, q: int):
    """Of pairs with count vectors those whose summed minima reach the overlap that they need, once each for a batch."""
    def vector(data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint8 if len(data) == GROUPS else np.int32)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [int(np.minimum(vector(x), vector(y)).sum(dtype=np.int64)) * (p + q) >= (n + m) * p for x, y, n, m in zip(pdf["counts_a"], pdf["counts_b"], pdf["n_a"].tolist(), pdf["n_b"].tolist())]
            yield pdf.loc[kept, ["cid_a", "cid_b"]].drop_duplicates()
    return work


def class_pairs(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b, common, n_a, n_b), a < b: pairs of different sets (cid, n, grams) with at least
    the given Jaccard similarity. Exact.

    Two such sets share one of the first n - ceil(t n) + 1 shingles of either, for any one order
    of the shingles. In ascending order of frequency these are rare ones. The index joins by 32
    bits of a shingle, so it may propose more pairs than share one, and never fewer. Rows
    repeated by cid hold equal sets.
    """
    p, q = similarity.numerator, similarity.denominator
    shared = sets.sparkSession.sparkContext.broadcast(_order(sets))  # ORDER_MOST bounds it

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, count = shared.value
        seen: set[int] = set()  # classes of this task
        for pdf in batches:
            parts = []
            for cid, n, data in zip(pdf["cid"].tolist(), pdf["n"].tolist(), pdf["grams"]):
                if cid in seen:
                    continue
                seen.add(cid)
                grams = unpacked(data)
                token = _token(grams)
                rank = np.zeros(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    rank = np.where(frequent[at] == token, count[at], 0)
                length = n - -(-n * p // q) + 1
                first = np.lexsort((grams, token, rank))[:length]
                parts.append((cid, n, token[first]))
            if parts:
                size = [len(t) for _, _, t in parts]
                yield pd.DataFrame({"token": np.concatenate([t for _, _, t in parts]).view(np.int32), "cid": np.repeat(np.array([c for c, _, _ in parts], np.int64), size), "place": np.repeat(np.array([n for _, n, _ in parts], np.int64) << 32, size) + np.concatenate([np.arange(x) for x in size])})

    prefix = sets.select("cid", "n", "grams").mapInPandas(prefixes, "token int, cid bigint, place bigint")  # the size of the set above the place in it
    a, b = (prefix.select("token", F.col("cid").alias(f"cid_{s}"), F.col("place").alias(f"place_{s}")) for s in ("a", "b"))
    (n_a, pos_a), (n_b, pos_b) = ((F.shiftright(f"place_{s}", 32), F.col(f"place_{s}").bitwiseAND(F.lit(0xFFFFFFFF))) for s in ("a", "b"))
    near = a.join(b, "token").where((F.col("cid_a") < F.col("cid_b")) & (n_a * q >= n_b * p) & (n_b * q >= n_a * p) & (F.least(n_a - pos_a, n_b - pos_b) * (p + q) >= (n_a + n_b) * p))

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))

    vectors = sets.select("cid", "n", "grams").mapInPandas(_vectors, "cid bigint, n int, counts binary").dropDuplicates(["cid"])
    near = near.select("cid_a", "cid_b").distinct().join(side(vectors, "a"), "cid_a").join(side(vectors, "b"), "cid_b")
    near = stored(near.mapInPandas(_within_bound(p, q), "cid_a bigint, cid_b bigint"))
    wanted = stored(near.select(F.col("cid_a").alias("cid")).unionAll(near.select("cid_b")).distinct())
    held = sets.select("cid", "grams").join(wanted, "cid", "left_semi").dropDuplicates(["cid"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y, gx, gy in zip(pdf["cid_a"].tolist(), pdf["cid_b"].tolist(), pdf["grams_a"], pdf["grams_b"]):
                u, v = unpacked(gx), unpacked(gy)
                common = len(np.intersect1d(u, v, assume_unique=True))
                if common * (p + q) >= (len(u) + len(v)) * p:
                    out.append((x, y, common, len(u), len(v)))
            yield pd.DataFrame(out, columns=["a", "b", "common", "n_a", "n_b"])

    return near.join(side(held, "a"), "cid_a").join(side(held, "b"), "cid_b").select("cid_a", "cid_b", "grams_a", "grams_b").mapInPandas(verify, "a bigint, b bigint, common int, n_a int, n_b int")


def classes(records: DataFrame, k: int = 5, min_tokens: int = 30) -> tuple[DataFrame, DataFrame]:
    """Members (id, cid) of classes of equal shingle sets, and the sets (cid, n, grams).

    ``records``: (id, text). Null texts and texts of fewer than ``min_tokens`` tokens take no
    part; rows repeated under one id count once (the set of greatest digest). Texts that are
    equal up to white space are one before they are read, so that copies cost nothing more.
    """
    rec = records.where("id is not null and text is not null").select("id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    digest = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    sets = stored(rec.groupBy("text").agg(F.count("*").alias("copies")).select("text", *digest).mapInPandas(_sets(k, min_tokens), "h1 bigint, h2 bigint, cid bigint, n int, grams binary"))
    members = rec.select("id", *digest).join(sets.select("h1", "h2", "cid"), ["h1", "h2"]).groupBy("id").agg(F.max("cid").alias("cid"))
    return members, sets.select("cid", "n", "grams")


def near_pairs(records: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), min_tokens: int = 30) -> DataFrame:
    """(id_a, id_b) of every pair of records, copies expanded: for results of which every pair is asked."""
    members, sets = classes(records, k, min_tokens)
    pairs = class_pairs(sets, similarity)
    m = lambda cid, name: members.select(F.col("cid").alias(cid), F.col("id").alias(name))
    across = pairs.select("a", "b").join(m("a", "x"), "a").join(m("b", "y"), "b")
    within = m("r", "x").join(m("r", "y"), "r").where("x < y")
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(within.select(F.col("x").alias("id_a"), F.col("y").alias("id_b")))


def near_groups(records: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), min_tokens: int = 30) -> DataFrame:
    """(id, copy_class, group_id, class_size, links): one row per record with its class of
    equal sets, its group of linked classes and the number of its similar classes. Classes and groups are named by their least id."""
    members, sets = classes(records, k, min_tokens)
    reps = checkpointed(members.groupBy("cid").agg(F.min("id").alias("rep"), F.count("*").alias("class_size")))
    named = lambda c, name: reps.select(F.col("cid").alias(c), F.col("rep").alias(name))
    pairs = checkpointed(class_pairs(sets, similarity).join(named("a", "x"), "a").join(named("b", "y"), "b").select("x", "y"))
    groups = connected_components(pairs, "x", "y")
    links = pairs.select(F.col("x").alias("rep")).unionAll(pairs.select(F.col("y").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(reps, "cid").join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("id", F.col("rep").alias("copy_class"), F.coalesce("component", "rep").alias("group_id"), "class_size", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
