"""Structure, dependency graph and findings of the Java and SQL files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions import javasource as J
from ..operators import codegraph as C
from ..operators import extract as E
from .registry import query


def _files(spark, sf):
    return table(spark, sf, "model_files").select("repository", "file_id", "file_path", "file_content")


def _java(spark, sf):
    return _files(spark, sf).where(F.lower("file_path").endswith(".java"))


@query()
def dependency_graph_edges(spark, sf):
    """Edges of all seven kinds, by repository."""
    return C.edges(C.facts(_files(spark, sf)))


@query()
def dependency_graph_nodes(spark, sf):
    f = C.facts(_files(spark, sf))
    names = C.Names(f)
    return C.nodes(f, C.edges(f, names), names)


@query()
def code_findings(spark, sf):
    """Findings of eleven detectors; the twelfth, duplicated calculations, is duplicated_calculation_groups."""
    return C.findings(C.facts(_files(spark, sf)))


@query()
def entry_points(spark, sf):
    """Routes with their handlers, and methods that start a process or run by a schedule."""
    f = C.facts(_files(spark, sf)).where("fact in ('route', 'entry')")
    kind = F.when(F.col("fact") == "route", "http").otherwise(F.substring_index("other", " ", 1))
    return f.select("repository", "file_id", kind.alias("kind"), F.col("name").alias("label"), F.col("owner").alias("handler"), F.col("other").alias("notes"), "line")


@query("""WITH l AS (SELECT file_id, regexp_extract_all(file_content, '(?m)^[ \\t]*import[ \\t]+([\\w$.]+(?:\\.\\*)?)[ \\t]*;', 1) AS i FROM model_files WHERE lower(file_path) LIKE '%.java' AND file_content IS NOT NULL)
  SELECT file_id, unnest(i) AS imported FROM l""")
def java_imports(spark, sf):
    return E.extracted(_java(spark, sf), "file_id", ["file_content"], lambda t: [(x,) for x in J.analyse(t).imports], "imported string")


@query()
def java_members(spark, sf):
    """Types, methods, constructors and fields with their owners, modifiers and annotations."""
    def rows(text):
        return [(m.what, m.name, m.owner, " ".join(m.modifiers), ",".join(n for n, _ in m.annotations), m.type, m.parameters, ",".join([*m.extends, *m.implements]), m.line, m.end_line) for m in J.analyse(text).members]
    return E.extracted(_java(spark, sf), "file_id", ["file_content"], rows, "what string, name string, owner string, modifiers string, annotations string, type string, parameters string, supertypes string, line bigint, end_line bigint")


@query()
def java_signals(spark, sf):
    names = list(J.signals(J.analyse("")))
    return E.extracted(_java(spark, sf), "file_id", ["file_content"], lambda t: [tuple(J.signals(J.analyse(t)).values())], ", ".join(f"{n} bigint" for n in names))


@query()
def literal_table_access(spark, sf):
    """The tables that each method reaches by SQL literals on its lines; one write makes it writing."""
    f = C.facts(_files(spark, sf)).where("fact = 'access'")
    return f.groupBy("file_id", F.col("owner").alias("method"), F.col("name").alias("table_name")).agg(F.bool_or(F.col("other") == "writes").alias("writes"))
