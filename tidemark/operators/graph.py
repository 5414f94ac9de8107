"""Graph operators over edge tables: chains, reachability, cycles, degrees, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed


def chains(edges: DataFrame, starts: DataFrame, max_depth: int, confidence: Column | None = None) -> DataFrame:
    """Simple paths of 1 to ``max_depth`` edges from the vertices of ``starts`` (column id):
    (start, end, depth, path, strength). Strength is the least confidence of the edges, 1 where
    none is given. Depth is the feature's bound; every step is a join of the open paths with the
    edges, so nothing is gathered. Null ends match nothing."""
    e = edges.select(F.col("src"), F.col("dst"), F.coalesce(confidence if confidence is not None else F.lit(1.0), F.lit(1.0)).cast("double").alias("conf")).where("src is not null and dst is not null")
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path"), F.lit(1.0).alias("strength"))
    out = None
    for depth in range(1, max_depth + 1):
        level = level.join(e, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(
            "start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"), F.least("strength", "conf").alias("strength"))
        found = level.withColumn("depth", F.lit(depth))
        out = found if out is None else out.unionByName(found)
    return out


def support_chains(edges: DataFrame, goals: DataFrame, max_depth: int = 12) -> DataFrame:
    """(goal, root, depth, path, strength): every simple path of edges into a vertex of ``goals``
    (column id), followed back to a vertex that nothing leads to, or over ``max_depth`` edges.

    ``path`` runs from the root to the goal; ``strength`` is the least ``conf`` of its edges, 1
    where none is given. A way that could only go on in a circle is no chain, nor is a goal
    alone. Repeated edges give repeated chains; null ends match nothing.
    """
    e = edges.select(F.col("src"), F.col("dst"), F.coalesce("conf", F.lit(1.0)).cast("double").alias("conf")).where("src is not null and dst is not null")
    led = e.select(F.col("dst").alias("root")).distinct().withColumn("more", F.lit(True))
    level = goals.select(F.col("id").alias("goal"), F.col("id").alias("root"), F.array("id").alias("path"), F.lit(1.0).alias("strength"))
    out = None
    for depth in range(1, max_depth + 1):
        level = level.join(e, F.col("root") == F.col("dst")).where(~F.array_contains("path", F.col("src"))).select(
            "goal", F.col("src").alias("root"), F.concat(F.array("src"), "path").alias("path"), F.least("strength", "conf").alias("strength"))
        known = level.join(led, "root", "left")
        done = (known if depth == max_depth else known.where("more is null")).select("goal", "root", F.lit(depth).alias("depth"), "path", "strength")
        out = done if out is None else out.unionByName(done)
        if depth < max_depth and depth % 4 == 0:
            level = checkpointed(level)
            if level.isEmpty():
                break
    return out


def explained(chains: DataFrame, goals: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, answered, chains, roots, unsupported, strength) of each goal: whether chains lead to it and every claim on them is supported.

    ``claims`` (id) are the vertices that need support, which is any edge into them. Counts are
    of chains, distinct roots and distinct claims without support; strength is that of the best chain.
    """
    bare = claims.select(F.col("id").alias("at")).distinct().join(edges.select(F.col("dst").alias("at")).distinct(), "at", "left_anti").withColumn("bare", F.lit(True))
    on = chains.select("goal", F.explode("path").alias("at")).distinct().join(bare, "at", "left").groupBy("goal").agg(F.count("bare").alias("unsupported"))
    sums = chains.groupBy("goal").agg(F.count("*").alias("chains"), F.count_distinct("root").alias("roots"), F.max("strength").alias("strength"))
    rows = goals.select("id").distinct().join(sums.join(on, "goal").withColumnRenamed("goal", "id"), "id", "left").na.fill(0, ["chains", "roots", "unsupported"])
    return rows.select("id", ((F.col("chains") > 0) & (F.col("unsupported") == 0)).alias("answered"), "chains", "roots", "unsupported", "strength")


def breadth_first(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, id, depth): the vertices within ``max_depth`` edges of each start, with their least depth."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, max_depth + 1):
        reached = front.join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        front = checkpointed(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = checkpointed(seen.unionByName(front))
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(id, inbound, outbound) of every vertex with an edge."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.where("id is not null").groupBy("id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))


def hotspots(edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` vertices with most inbound, then outbound edges, equals by id; a top-k report."""
    return degrees(edges).orderBy(F.desc("inbound"), F.desc("outbound"), "id").limit(n)


def strong_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): vertices that lie on a common cycle, with the least id as component.

    In each round vertices take the least id that reaches them; those of a colour that the
    colour's own vertex is reached from form its component and leave the graph. Vertices on no
    cycle get no row. Null ends and self-loops are ignored; repeated edges count once.
    """
    e = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    out = None
    for _ in range(max_rounds):
        # only vertices with edges both ways can lie on a cycle
        while True:
            both = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
            kept = checkpointed(e.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
            if kept.count() == e.count():
                break
            e = kept
        if e.isEmpty():
            break
        colours = _least_reaching(e)
        coloured = e.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        # backwards from the colour's vertex within the colour
        found = colours.where("id = colour")
        front = found
        back = checkpointed(coloured.select("src", "dst", F.col("cs").alias("colour")))
        while True:
            front = checkpointed(front.select(F.col("id").alias("dst"), "colour").join(back, ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct().join(found, ["id", "colour"], "left_anti"))
            if front.isEmpty():
                break
            found = checkpointed(found.unionByName(front))
        part = found.select("id", F.col("colour").alias("component"))
        out = part if out is None else out.unionByName(part)
        gone = found.select("id")
        e = checkpointed(e.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    else:
        raise RuntimeError(f"cycles did not settle in {max_rounds} rounds")
    if out is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).where("false")
    sized = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(sized, "component", "left_semi").select("id", "component")


def _least_reaching(e: DataFrame) -> DataFrame:
    """(id, colour): the least vertex from which each vertex can be reached.

    A colour also takes the colour of its own vertex, which reaches further back, so that long paths settle in few rounds.
    """
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    colours = checkpointed(ids.withColumn("colour", F.col("id")))
    before = None
    while True:
        pushed = e.join(colours, e["src"] == colours["id"]).select(F.col("dst").alias("id"), "colour")
        step = colours.unionByName(pushed).groupBy("id").agg(F.min("colour").alias("colour"))
        jump = step.select(F.col("id").alias("colour"), F.col("colour").alias("further"))
        colours = checkpointed(step.join(jump, "colour").select("id", F.least("colour", "further").alias("colour")))
        now = colours.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(38,0)"))).first()
        if now == before:
            return colours
        before = now


def integrity(nodes: DataFrame, edges: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(issue, id): duplicate nodes and edges, dangling edges, self-loops, claims (id) that no edge leads to, nodes without any edge.

    The id of an edge's issue is its source. Null ids and ends are no nodes."""
    known = nodes.select("id").where("id is not null")
    dup = known.groupBy("id").count().where("count > 1").select(F.lit("duplicate-node").alias("issue"), "id")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    dangling = ends.join(known, "id", "left_anti").select(F.lit("dangling-edge").alias("issue"), "id")
    loops = edges.where("src = dst").select(F.lit("self-loop").alias("issue"), F.col("src").alias("id")).distinct()
    orphan = known.distinct().join(ends, "id", "left_anti").select(F.lit("orphan").alias("issue"), "id")
    twice = edges.where("src is not null and dst is not null").groupBy("src", "dst").count().where("count > 1").select(F.lit("duplicate-edge").alias("issue"), F.col("src").alias("id"))
    out = dup.unionByName(dangling).unionByName(loops).unionByName(orphan).unionByName(twice)
    if claims is None:
        return out
    bare = claims.select("id").where("id is not null").distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return out.unionByName(bare.select(F.lit("unsupported-claim").alias("issue"), "id"))
