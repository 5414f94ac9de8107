"""Containment similarity between bodies of code by their consecutive token pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import stored


def code_tokens(text):
    """Names and single other characters of a body of code, with string literals as STR and numbers as NUM."""
    plain = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\n]|\\.)*"', " STR "), r"\b\d+(?:\.\d+)?\b", " NUM ")
    return F.regexp_extract_all(plain, F.lit(r"([A-Za-z_$][\w$]*|[^\sA-Za-z_$])"), F.lit(1))


def bigrams(text):
    """The set of neighbouring token pairs of a text."""
    t = code_tokens(text)
    return F.when(F.size(t) > 1, F.array_distinct(F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))


def contained_pairs(bodies: DataFrame, containment: tuple[int, int] = (3, 4), size_ratio: tuple[int, int] = (3, 5), least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members`` (id, rep) gives each body the least id with the same pairs;
    ``pairs`` (a, b, common, size_a, size_b) of representatives whose smaller set the other holds
    to at least ``containment``, with sizes no further apart than ``size_ratio``.

    The smaller set of such a pair shares one of its rarest ``size - need + 1`` pairs with the
    other, so only these are looked up, by 64-bit hashes; nothing is cut off by how frequent a pair of tokens is.
    ``bodies`` is (id, text); null texts and sets under ``least`` pairs take no part.
    """
    p, q = containment
    hashed = F.array_sort(F.transform(bigrams(F.col("text")), lambda g: F.xxhash64(g)))
    sets = stored(bodies.where("id is not null and text is not null").select("id", hashed.alias("grams")).where(F.size("grams") >= least))
    keyed = sets.withColumn("key", F.sha2(F.array_join("grams", ","), 256))
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = keyed.join(reps, "key").select("id", "rep")
    kept = stored(keyed.join(reps, (keyed["key"] == reps["key"]) & (keyed["id"] == reps["rep"]), "left_semi").select("id", "grams", F.size("grams").alias("n")).dropDuplicates(["id"]))
    posts = kept.select("id", "n", F.explode("grams").alias("gram"))
    often = posts.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(often, "gram")
    ranked = shared.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))  # bounded by one text
    length = F.col("n") - F.floor((F.col("n") * p + q - 1) / q).cast("int") + 1 - (F.col("n") - F.size("g"))
    probe = ranked.withColumn("k", length).where("k > 0").select(F.col("id").alias("s"), F.col("n").alias("ns"), F.explode(F.expr("slice(g, 1, k)")).alias("x")).select("s", "ns", "x.gram")
    full = shared.select(F.col("id").alias("t"), F.col("n").alias("nt"), "gram")
    r0, r1 = size_ratio
    near = probe.join(full, "gram").where((F.col("s") != F.col("t")) & ((F.col("ns") < F.col("nt")) | ((F.col("ns") == F.col("nt")) & (F.col("s") < F.col("t")))) & (F.col("ns") * r1 >= F.col("nt") * r0)).select("s", "t").distinct()
    side = lambda n: kept.select(F.col("id").alias(n), F.col("grams").alias(f"g{n}"), F.col("n").alias(f"n{n}"))
    both = near.join(side("s"), "s").join(side("t"), "t").withColumn("common", F.size(F.array_intersect("gs", "gt"))).where(F.col("common") * q >= F.col("ns") * p)
    pairs = both.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "common", F.when(F.col("s") < F.col("t"), F.col("ns")).otherwise(F.col("nt")).alias("size_a"), F.when(F.col("s") < F.col("t"), F.col("nt")).otherwise(F.col("ns")).alias("size_b"))
    return members, pairs
