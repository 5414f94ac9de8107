"""Queries over graphs that grow with the data: classes with their imports and packages, and components of a run in order of their records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import checkpointed, table
from ..operators import graph as G
from ..operators.components import connected_components
from .registry import query

# strings and comments of a source, as both engines write it (without repeats within repeats for the engine that backtracks)
_OPAQUE_SQL = r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''"""
_OPAQUE = r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'"""
_PACKAGE, _TYPE, _IMPORT = r"(?m)^[ \t]*package[ \t]+([\w.]+)[ \t]*;", r"\b(?:class|interface|enum|record)\s+(\w+)", r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"

_CLASSES = rf"""j AS (SELECT regexp_extract(file_content, '{_PACKAGE}', 1) AS p, regexp_extract(regexp_replace(file_content, '{_OPAQUE_SQL}', ' ', 'g'), '{_TYPE}', 1) AS c, regexp_extract_all(file_content, '{_IMPORT}', 1) AS i FROM model_files WHERE lower(file_path) LIKE '%.java'),
  u AS (SELECT CASE WHEN p = '' THEN c ELSE p || '.' || c END AS src, unnest(i) AS dst FROM j WHERE c <> ''), d AS (SELECT DISTINCT src, dst FROM u WHERE src <> dst)"""
_EDGES = f"""{_CLASSES}, up0 AS (SELECT src AS id FROM d UNION SELECT dst FROM d), up AS (SELECT id FROM up0 UNION SELECT regexp_replace(id, '\\.[^.]*$', '') FROM up WHERE contains(id, '.')),
  e AS (SELECT src, dst, CASE WHEN ends_with(dst, '*') THEN 0.5::DOUBLE END AS conf FROM d UNION ALL SELECT id, regexp_replace(id, '\\.[^.]*$', ''), 0.9 FROM up WHERE contains(id, '.'))"""


def classes(spark, sf):
    """(src, dst): each class with what it imports, once."""
    f = table(spark, sf, "model_files").where(F.lower("file_path").endswith(".java") & F.col("file_content").isNotNull()).select("file_content")
    p, c = F.regexp_extract("file_content", _PACKAGE, 1), F.regexp_extract(F.regexp_replace("file_content", _OPAQUE, " "), _TYPE, 1)
    own = f.select(F.when(p == "", c).otherwise(F.concat(p, F.lit("."), c)).alias("src"), c.alias("c"), F.regexp_extract_all("file_content", F.lit(_IMPORT), F.lit(1)).alias("i")).where("c <> ''")
    return own.select("src", F.explode("i").alias("dst")).where("src <> dst").distinct()


def edges(spark, sf):
    """Classes to their imports, and every name to the package that holds it, with a confidence."""
    d = checkpointed(classes(spark, sf))
    ids = d.select(F.col("src").alias("id")).union(d.select("dst")).distinct()
    parts = F.split("id", r"\.")
    ups = ids.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("id")).distinct().where(F.contains("id", F.lit(".")))
    held = ups.select(F.col("id").alias("src"), F.regexp_replace("id", r"\.[^.]*$", "").alias("dst"), F.lit(0.9).alias("conf"))
    return checkpointed(d.select("src", "dst", F.when(F.endswith("dst", F.lit("*")), 0.5).alias("conf")).unionByName(held))


def _starts(e):
    """Vertices that nothing leads to."""
    return e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


_STARTS = "s AS (SELECT DISTINCT src AS id FROM e WHERE src NOT IN (SELECT dst FROM e))"


@query(f"""WITH RECURSIVE {_EDGES}, {_STARTS}, c AS (SELECT id AS start, id AS last, [id] AS path, 0 AS depth, 1.0::DOUBLE AS strength FROM s
  UNION ALL SELECT start, dst, list_append(path, dst), depth + 1, least(strength, coalesce(conf, 1.0)) FROM c JOIN e ON e.src = c.last WHERE depth < 8 AND NOT list_contains(path, dst))
  SELECT start, last AS "end", depth, array_to_string(path, '>') AS path, strength FROM c WHERE depth > 0""")
def call_chains(spark, sf):
    """Simple paths of up to eight edges from every vertex that nothing leads to."""
    e = edges(spark, sf)
    return G.chains(e, _starts(e), 8, F.col("conf")).select("start", "end", "depth", F.array_join("path", ">").alias("path"), "strength")


@query(f"""WITH RECURSIVE {_EDGES}, {_STARTS}, b AS (SELECT id AS start, id, 0 AS depth FROM s UNION SELECT start, dst, depth + 1 FROM b JOIN e ON e.src = b.id WHERE depth < 4) SELECT start, id, min(depth) AS depth FROM b GROUP BY ALL""")
def data_flow_depths(spark, sf):
    e = edges(spark, sf)
    return G.breadth_first(e, _starts(e), 4)


@query(f"WITH RECURSIVE {_EDGES}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src) SELECT id, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) ORDER BY inbound DESC, outbound DESC, id LIMIT 20")
def hotspots(spark, sf):
    return G.hotspots(edges(spark, sf))


# One vertex for each component of a run, named by its first record; an edge for each change from one record of the run to the next.
_RUNS = """v AS (SELECT run_id, component, min(log_id) AS id FROM log_records WHERE run_id IS NOT NULL AND component IS NOT NULL GROUP BY ALL),
  o AS (SELECT run_id, component, lead(component) OVER (PARTITION BY run_id ORDER BY logged_at, log_id) AS next FROM log_records WHERE run_id IS NOT NULL AND component IS NOT NULL AND logged_at IS NOT NULL),
  t AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM o JOIN v a ON a.run_id = o.run_id AND a.component = o.component JOIN v b ON b.run_id = o.run_id AND b.component = o.next)"""


def transitions(spark, sf):
    """(src, dst) bigint: changes of component within a run, once each."""
    logs = table(spark, sf, "log_records").where("run_id is not null and component is not null").select("run_id", "component", "log_id", "logged_at")
    v = logs.groupBy("run_id", "component").agg(F.min("log_id").alias("id"))
    # the records of one run are its window: runs are bounded by a process's life
    nxt = logs.where("logged_at is not null").withColumn("next", F.lead("component").over(W.partitionBy("run_id").orderBy("logged_at", "log_id"))).where("next is not null").select("run_id", "component", "next").distinct()
    a, b = v.withColumnRenamed("id", "src"), v.select("run_id", F.col("component").alias("next"), F.col("id").alias("dst"))
    return nxt.join(a, ["run_id", "component"]).join(b, ["run_id", "next"]).select("src", "dst").distinct(), v


@query(f"WITH RECURSIVE {_RUNS}, r AS (SELECT src, dst FROM t WHERE src <> dst UNION SELECT r.src, t.dst FROM r JOIN t ON t.src = r.dst) SELECT a.src AS id, min(least(a.src, a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src")
def cycles(spark, sf):
    return G.strong_components(transitions(spark, sf)[0])


@query(f"WITH RECURSIVE {_RUNS}, x AS (SELECT src, dst FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst), r AS (SELECT src AS id, src AS seen FROM x UNION SELECT r.id, x.dst FROM r JOIN x ON x.src = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY id")
def undirected_components(spark, sf):
    return connected_components(transitions(spark, sf)[0])


@query(f"""WITH {_RUNS}, m AS (SELECT run_id, component, lower(log_level) AS l FROM log_records WHERE lower(log_level) IN ('warn', 'error') GROUP BY ALL), n AS (SELECT id FROM v JOIN m USING (run_id, component)), c AS (SELECT id FROM v JOIN m USING (run_id, component) WHERE l = 'error')
  SELECT 'duplicate-node' AS issue, id FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'dangling-edge', x FROM (SELECT src AS x FROM t UNION SELECT dst FROM t) WHERE x NOT IN (SELECT id FROM n)
  UNION ALL SELECT DISTINCT 'self-loop', src FROM t WHERE src = dst UNION ALL SELECT DISTINCT 'orphan', id FROM n WHERE id NOT IN (SELECT src FROM t) AND id NOT IN (SELECT dst FROM t)
  UNION ALL SELECT DISTINCT 'unsupported-claim', id FROM c WHERE id NOT IN (SELECT dst FROM t)""")
def graph_integrity(spark, sf):
    """Nodes are the components with warnings and with errors, one list after the other; the latter are claims."""
    t, v = transitions(spark, sf)
    level = F.lower("log_level")
    marked = table(spark, sf, "log_records").where(level.isin("warn", "error")).select("run_id", "component", level.alias("l")).distinct()
    n = v.join(marked, ["run_id", "component"])
    return G.integrity(n.select("id"), t, n.where("l = 'error'").select("id"))


_CHAINS = """g AS (SELECT DISTINCT dst AS goal FROM d), c AS (SELECT goal, goal AS root, [goal] AS path, 1.0::DOUBLE AS strength, 0 AS depth FROM g
  UNION ALL SELECT goal, src, list_prepend(src, path), least(strength, coalesce(conf, 1.0)), depth + 1 FROM c JOIN e ON e.dst = c.root WHERE depth < 12 AND NOT list_contains(path, src)),
  k AS (SELECT * FROM c WHERE depth > 0 AND (depth = 12 OR root NOT IN (SELECT dst FROM e)))"""


@query(f"WITH RECURSIVE {_EDGES}, {_CHAINS} SELECT goal, root, depth, array_to_string(path, '>') AS path, strength FROM k")
def support_chains(spark, sf):
    """Every chain that leads to an imported name, back to where it begins, at most twelve edges."""
    e = edges(spark, sf)
    goals = classes(spark, sf).select(F.col("dst").alias("id")).distinct()
    return G.support_chains(e, goals, 12).select("goal", "root", "depth", F.array_join("path", ">").alias("path"), "strength")


@query(f"""WITH RECURSIVE {_EDGES}, {_CHAINS}, claims AS (SELECT DISTINCT src AS id FROM d WHERE regexp_matches(src, '^com\\.fnb\\.[a-m]')), bare AS (SELECT id FROM claims WHERE id NOT IN (SELECT dst FROM e)), o AS (SELECT goal, unnest(path) AS id FROM k),
  b AS (SELECT goal, count(DISTINCT id) AS n FROM o WHERE id IN (SELECT id FROM bare) GROUP BY goal), t AS (SELECT goal, count(*) AS chains, count(DISTINCT root) AS roots, max(strength) AS strength FROM k GROUP BY goal)
  SELECT g.goal AS id, coalesce(chains, 0) > 0 AND coalesce(n, 0) = 0 AS answered, coalesce(chains, 0) AS chains, coalesce(roots, 0) AS roots, coalesce(n, 0) AS unsupported, strength FROM g LEFT JOIN t ON t.goal = g.goal LEFT JOIN b ON b.goal = g.goal""")
def explained_claims(spark, sf):
    """Why an imported name is there: chains, their roots, and claims among them that nothing supports (classes of the first half of the packages count as claims)."""
    e = edges(spark, sf)
    d = classes(spark, sf)
    goals = d.select(F.col("dst").alias("id")).distinct()
    claims = d.where(F.col("src").rlike(r"^com\.fnb\.[a-m]")).select(F.col("src").alias("id")).distinct()
    chains = checkpointed(G.support_chains(e, goals, 12))
    return G.explained(chains, goals, claims, e)
