"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): each vertex of ``edges`` with the least vertex of its component.

    Each round hangs every vertex on the least of its neighbours, so stars form in
    O(log**2 n) rounds. Least neighbours are counted with partial aggregation and joined
    back, so a vertex with very many neighbours is not gathered in one task. Rounds are cut
    by reliable checkpoints. Null ends and self-loops are ignored; repeated edges count once;
    without edges the result is empty.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(e.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(v.alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where("u > v")
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(u.alias("id"), v.alias("component")).unionByName(e.select(v.alias("id"), v.alias("component")).distinct())
