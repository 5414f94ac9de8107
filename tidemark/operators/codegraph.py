"""Dependency graph and findings over the Java and SQL sources of repositories.

Each file is read once into facts, rows of one narrow table; nodes, edges and findings are joins
of facts. Names are resolved within a repository by equi-joins on grouped candidates, so a name
that many files declare is never paired with all its uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import spread, stored
from ..functions import javasource as J
from .extract import CLOCKS, REPEATABLE, SQL_CLOCKS, TRANSACTIONS, UNFINISHED, WRITES, ddl_objects, split_statements

FACTS = "repository string, file_id bigint, fact string, name string, owner string, other string, line int, end_line int"
#: How far a method is looked for among the supertypes.
SUPERTYPE_DEPTH = 4

# Base types of generated stores, the verbs of their methods, annotations of routes and guards, numbers that need no name.
STORES = {"Repository", "CrudRepository", "PagingAndSortingRepository", "JpaRepository", "ListCrudRepository", "ListPagingAndSortingRepository"}
WRITING = r"^(?:save|delete|remove|insert|update|persist)"
READING = r"^(?:find|read|get|query|count|exists|stream)"
ROUTES = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": "GET", "GET": "GET", "POST": "POST", "PUT": "PUT", "PATCH": "PATCH", "DELETE": "DELETE", "HEAD": "HEAD", "OPTIONS": "OPTIONS"}
GUARDED_ROUTES = ("GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping", "RequestMapping", "Path")
GUARDS = ("PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed")
PLAIN_NUMBERS = {"0", "1", "2", "-1", "10", "0.0", "1.0"}

_NUMBER = re.compile(r"(?:[<>=!]=?|\+|-|\*|/|%|\breturn\b)[ \t]*(-?\d+(?:\.\d+)?)")
_ACCESSOR = re.compile(r"(?:return\s+(?:this\s*\.\s*)?[\w$]+\s*;|this\s*\.\s*[\w$]+\s*=\s*[\w$]+\s*;)")
_TABLES = re.compile(r"\b(?:FROM|JOIN|INTO|UPDATE|ON|TABLE(?:\s+IF\s+(?:NOT\s+)?EXISTS)?)\s+([A-Za-z_][\w$.]*)", re.I)
_NO_TABLE = {"SELECT", "UNNEST", "GENERATE_SERIES", "LATERAL", "DUAL", "ONLY", "OF", "SET", "WHERE"}


def simple_name(raw: str) -> str:
    """The bare name of a type, without package, arguments and brackets."""
    return re.sub(r"<.*>|\[\s*\]", "", raw, flags=re.S).strip().rsplit(".", 1)[-1]


def bound_types(f: J.JavaFile, m: J.Member) -> dict[str, str]:
    """Types of the names that a method sees: fields, parameters, locals with an initial value."""
    out = {x.name: simple_name(x.type) for x in f.of("field")}
    for part in J._split(m.parameters):
        words = re.sub(r"@[\w.]+(?:\([^)]*\))?|\bfinal\b", " ", part).split()
        if len(words) > 1:
            out[words[-1]] = simple_name(" ".join(words[:-1]))
    out.update((n, t) for t, n in re.findall(r"\b([A-Z][\w$]*)\s+([a-z_$][\w$]*)\s*=", m.masked_body))
    return out


def sql_access(text: str) -> tuple[list[str], bool]:
    """The tables that a statement names, and whether it writes."""
    names = {t for t in _TABLES.findall(text) if t.upper() not in _NO_TABLE}
    return sorted(names), re.match(r"\s*(?:insert|update|merge|delete|alter|drop|truncate|create)\b", text, re.I) is not None


def route_paths(arguments: str) -> list[str]:
    return re.findall(r'"([^"]*)"', re.sub(r"\b(?:produces|consumes|headers|params|name)\s*=\s*(?:\{[^}]*\}|\"[^\"]*\"|[\w.]+)", "", arguments)) or [""]


def joined_path(prefix: str, path: str) -> str:
    return re.sub("/{2,}", "/", f"/{prefix}/{path}").rstrip("/") or "/"


def java_facts(source: str) -> list[tuple]:
    """(fact, name, owner, other, line, end line) of a Java file; ``owner`` is a method as Type#name or a type."""
    f = J.analyse(source)
    out: list[tuple] = []
    types = [m for m in f.of("class", "interface", "enum", "record")]
    for x in f.imports:
        out.append(("import", x.rsplit(".", 1)[-1], x, None, None, None))
    for t in types:
        own = f.qualified(t.name)
        out.append(("type", t.name, own, t.what, t.line, t.end_line))
        for i, parent in enumerate([*t.extends, *t.implements]):
            out.append(("super", simple_name(parent), own, str(i), t.line, None))
            if simple_name(parent) in STORES:
                entity = re.search(r"<\s*([\w$.]+)", parent)
                if entity:
                    out.append(("store", simple_name(entity[1]), own, t.name, t.line, None))
        for n, args in t.annotations:
            table = re.search(r'name\s*=\s*"([^"]+)"', args)
            if n == "Table" and table:
                out.append(("entity", table[1], own, None, t.line, None))
    prefix = next((p for t in types for n, a in t.annotations if n in ("RequestMapping", "Path") for p in route_paths(a)), "")
    controlled = any(t.has("RestController", "Controller", "Path") for t in types)
    sql = [(line, text) for line, text in f.literals if J.looks_like_sql(text)]
    for m in f.of("method"):
        if m.owner is None:
            continue
        me = f"{m.owner}#{m.name}"
        body = " ".join(re.sub(r'"(?:[^"\\\n]|\\.)*"', '""', m.body or "").split())
        out.append(("method", m.name, m.owner, "accessor" if _ACCESSOR.fullmatch(body) else None, m.line, m.end_line))
        known = bound_types(f, m)
        for receiver, called in set(re.findall(r"([A-Za-z_$][\w$]*)\s*\.\s*([A-Za-z_$][\w$]*)\s*\(", m.masked_body)):
            of = known.get(receiver) or (receiver if receiver[0].isupper() else None)
            if of:
                out.append(("call", called, me, of, m.line, None))
        access: dict[str, tuple[bool, int]] = {}
        for line, text in sql:
            if m.line <= line <= m.end_line:
                tables, writes = sql_access(text)
                for t in tables:
                    access[t] = (access.get(t, (False, line))[0] or writes, access.get(t, (False, line))[1])
        out.extend(("access", t, me, "writes" if w else "reads", line, None) for t, (w, line) in access.items())
        for n, args in m.annotations:
            if n in ROUTES:
                verb = re.search(r"RequestMethod\.(\w+)", args)
                out.extend(("route", f"{verb[1] if verb and n == 'RequestMapping' else ROUTES[n]} {joined_path(prefix if controlled else '', p)}", me, "any verb" if n == "RequestMapping" and not verb else None, m.line, m.end_line) for p in route_paths(args))
        if m.name == "main" and {"public", "static"} <= set(m.modifiers) and m.type == "void":
            out.append(("entry", f"{f.package or ''}.{me}".lstrip("."), me, "startup", m.line, m.end_line))
        for n, args in m.annotations:
            if n == "Scheduled":
                cron = re.search(r'cron\s*=\s*"([^"]*)"', args)
                out.append(("entry", me, me, f"scheduled {f'cron: {cron[1]}' if cron else args}", m.line, m.end_line))
    return [*out, *_findings(f)]


def _findings(f: J.JavaFile) -> list[tuple]:
    """("finding", category, what, detail, line, end line); and what is needed to judge dead code and gaps over a whole repository."""
    out: list[tuple] = []
    at = lambda place: f.masked.count("\n", 0, place) + 1
    found = lambda category, what, detail, line, end=None: out.append(("finding", category, what, detail, line, end))
    for place, empty in J.swallowed(f.masked):
        found("swallowed-exception", None, "empty" if empty else "only logs", at(place))
    for x in f.of("field"):
        if "static" in x.modifiers and "final" not in x.modifiers:
            found("static-mutable-state", x.name, x.type, x.line)
    owners = {t.name: t for t in f.of("class", "interface", "enum", "record")}
    for m in f.of("method", "constructor"):
        body, where = m.body or "", (m.name, m.line, m.end_line)
        hit = lambda category, detail=None: found(category, where[0], detail, where[1], where[2])  # noqa: B023, E731
        if re.search(CLOCKS, body):
            hit("time-dependence")
        if re.search(TRANSACTIONS, body):
            hit("transaction-boundary-anomaly", "manual")
        managed = next((a for n, a in m.annotations if n == "Transactional"), None)
        if managed is not None and "private" in m.modifiers:
            hit("transaction-boundary-anomaly", "private")
        if managed is not None and "REQUIRES_NEW" in managed:
            hit("transaction-boundary-anomaly", "REQUIRES_NEW")
        again = re.search(r"(?i)retry|retries|attempt", body) or re.search(r"(?i)retry", m.name)
        if again and re.search(WRITES, body) and not re.search(REPEATABLE, body) and not re.search(REPEATABLE, m.parameters):
            hit("retry-without-idempotency")
        if any("unchecked" in a for _, a in m.annotations):
            hit("unchecked-cast")
        numbers = [n for n in dict.fromkeys(_NUMBER.findall(re.sub(r'"(?:[^"\\\n]|\\.)*"', '""', body))) if n not in PLAIN_NUMBERS][:5]
        if numbers:
            hit("magic-number", ", ".join(numbers))
        if m.what == "method" and m.has(*GUARDED_ROUTES):
            guarded = m.has(*GUARDS) or m.owner in owners and owners[m.owner].has(*GUARDS)
            out.append(("handler", m.name, m.owner, "guarded" if guarded else None, m.line, m.end_line))
        if m.what == "method" and "private" in m.modifiers and not m.has("Scheduled", "PostConstruct"):
            out.append(("private", m.name, m.owner, None, m.line, m.end_line))
    for line, text in f.comments:
        if re.search(UNFINISHED, text):
            found("misleading-comment", None, " ".join(text.split())[:2000], line)
    clock = re.search(SQL_CLOCKS, f.source) if any(J.looks_like_sql(t) for _, t in f.literals) else None
    if clock:
        found("time-dependence", None, clock[0], at(clock.start()))
    out.extend(("word", w, None, str(n), None, None) for w, n in pd.Series(re.findall(r"([A-Za-z_$][\w$]*)\s*\(", f.masked), dtype=object).value_counts().items())
    return out


_TRIGGER_TABLE = re.compile(r"\bON\s+\"?([A-Za-z_][\w.]*)", re.I)


def sql_facts(source: str) -> list[tuple]:
    """Tables that statements name, objects, and the table of a trigger."""
    out: list[tuple] = []
    for _, line, text in split_statements(source):
        out.extend(("table", t, None, None, line, None) for t in sql_access(re.sub(r"--[^\n]*|/\*[\s\S]*?\*/", " ", text).strip())[0])
        bare = re.sub(r"--[^\n]*|/\*[\s\S]*?\*/", " ", text)
        for kind, name in {(k, n) for k, n, *_ in ddl_objects(text)}:
            on = _TRIGGER_TABLE.search(bare) if kind == "trigger" else None
            out.append(("object", name, None, kind, line, None))
            if on:
                out.append(("trigger", name, on[1], None, line, None))
            if kind in ("trigger", "function"):
                out.append(("finding", "db-side-behavior", name, kind, line, None))
    return out


def facts(files: DataFrame) -> DataFrame:
    """FACTS of the Java and SQL files of (repository, file_id, file_path, file_content), written as a table; every file is read once, whole.

    Null contents, ids and paths give no facts; a null repository is one of its own; repeated rows give repeated facts.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, fid, low, text in zip(pdf["repository"], pdf["file_id"].tolist(), pdf["low"], pdf["file_content"]):
                out.extend((repo, fid, *x) for x in (java_facts if low.endswith(".java") else sql_facts)(text))
            yield pd.DataFrame(out, columns=["repository", "file_id", "fact", "name", "owner", "other", "line", "end_line"]).astype({"line": "Int32", "end_line": "Int32"})

    low = F.lower("file_path")
    held = files.where((low.endswith(".java") | low.endswith(".sql")) & F.col("file_id").isNotNull() & F.col("file_content").isNotNull()).select(F.coalesce("repository", F.lit("")).alias("repository"), "file_id", low.alias("low"), "file_content")
    return stored(spread(held).mapInPandas(run, FACTS))


def _of(f: DataFrame, *kinds: str) -> DataFrame:
    return f.where(F.col("fact").isin(*kinds))


def types_of(f: DataFrame) -> DataFrame:
    """(repository, qualified, name, file_id): each type once, from its first file."""
    return _of(f, "type").groupBy("repository", F.col("owner").alias("qualified"), "name").agg(F.min("file_id").alias("file_id"))


class Names:
    """What simple names mean: candidates grouped once and written as tables, as many joins look them up."""

    def __init__(self, f: DataFrame) -> None:
        known = types_of(f)
        only = lambda df, *by: df.groupBy(*by).agg(F.when(F.count_distinct("qualified") == 1, F.min("qualified")).alias("_q"))
        brought = _of(f, "import").select("repository", "file_id", F.col("owner").alias("qualified")).distinct().join(known.select("repository", "qualified", "name"), ["repository", "qualified"])
        self.facts = f
        self.anywhere = stored(only(known, "repository", "name"))
        self.here = stored(only(known, "repository", "file_id", "name"))
        self.brought = stored(only(brought, "repository", "file_id", "name"))
        self._methods: DataFrame | None = None

    @property
    def methods(self) -> DataFrame:
        if self._methods is None:
            self._methods = stored(_methods_of(self))
        return self._methods


def resolved(names: Names, uses: DataFrame, name: str, out: str) -> DataFrame:
    """``uses`` (repository, file_id, ...) with the type ``out`` that the simple name in column ``name`` means there.

    In this order: the only type of that name in the repository, the only one in the same file,
    the only one that the file imports. Names without such a type are left out.
    """
    as_ = lambda df, q: df.withColumnRenamed("name", name).withColumnRenamed("_q", q) if name != "name" else df.withColumnRenamed("_q", q)
    rows = uses.join(as_(names.anywhere, "_any"), ["repository", name]).join(as_(names.here, "_here"), ["repository", "file_id", name], "left").join(as_(names.brought, "_brought"), ["repository", "file_id", name], "left")
    return rows.withColumn(out, F.coalesce("_any", "_here", "_brought")).drop("_any", "_here", "_brought").where(F.col(out).isNotNull())


def methods_of(f: DataFrame) -> DataFrame:
    """(repository, type, name, file_id, line, end_line, accessor): each method of a known type once."""
    return Names(f).methods


def _methods_of(names: Names) -> DataFrame:
    own = resolved(names, _of(names.facts, "method").select("repository", "file_id", "name", "owner", "line", "end_line", F.col("other").isNotNull().alias("accessor")), "owner", "type")
    first = own.groupBy("repository", "type", "name").agg(F.min(F.struct("file_id", "line", "end_line", "accessor")).alias("m"))
    return first.select("repository", "type", "name", "m.*")


def _method_id(type_: Column, name: Column) -> Column:
    return F.concat(F.lit("method:"), type_, F.lit("#"), name)


def _found_methods(names: Names, wanted: DataFrame) -> DataFrame:
    """``wanted`` (repository, type, name) with the type ``target`` that declares the method: itself or its nearest supertype, at most SUPERTYPE_DEPTH away."""
    has = names.methods.select("repository", F.col("type").alias("at"), "name", F.lit(True).alias("known"))
    parents = resolved(names, _of(names.facts, "super").select("repository", "file_id", F.col("name").alias("parent"), F.col("owner").alias("at"), F.col("other").cast("int").alias("place")), "parent", "up").select("repository", "at", "up", "place").distinct()
    level = wanted.select("repository", "type", "name").distinct().withColumn("at", F.col("type")).withColumn("rank", F.array(F.lit(0)))
    done = None
    for depth in range(SUPERTYPE_DEPTH + 1):
        here = level.join(has, ["repository", "at", "name"], "left")
        hit = here.where("known").select("repository", "type", "name", F.struct("rank", "at").alias("x"))
        done = hit if done is None else done.unionByName(hit)
        if depth < SUPERTYPE_DEPTH:
            level = here.where("known is null").join(parents, ["repository", "at"]).select("repository", "type", "name", F.col("up").alias("at"), F.concat("rank", F.array(F.col("place") + 1)).alias("rank"))
    return done.groupBy("repository", "type", "name").agg(F.min("x")["at"].alias("target"))


def edges(f: DataFrame, names: Names | None = None) -> DataFrame:
    """(repository, src, dst, kind), each once, without self-loops: imports, extends, calls, reads, writes, triggers, http."""
    names = names or Names(f)
    text = lambda s: F.lit(s)
    known = types_of(f)
    own = _of(f, "type").select("repository", "file_id", F.col("owner").alias("of")).distinct()
    imports = _of(f, "import").select("repository", "file_id", F.col("owner").alias("qualified")).join(known.select("repository", "qualified"), ["repository", "qualified"]).join(own, ["repository", "file_id"])
    out = [imports.select("repository", F.concat(text("class:"), "of").alias("src"), F.concat(text("class:"), "qualified").alias("dst"), text("imports").alias("kind"))]
    ups = resolved(names, _of(f, "super").select("repository", "file_id", F.col("name").alias("parent"), F.col("owner").alias("of")), "parent", "up")
    out.append(ups.select("repository", F.concat(text("class:"), "of").alias("src"), F.concat(text("class:"), "up").alias("dst"), text("extends").alias("kind")))

    caller = lambda df: df.withColumn("_t", F.substring_index("owner", "#", 1)).withColumn("_m", F.substring_index("owner", "#", -1))
    by = lambda df: resolved(names, caller(df), "_t", "_type").withColumn("src", _method_id(F.col("_type"), F.col("_m")))
    calls = by(resolved(names, _of(f, "call").select("repository", "file_id", F.col("name").alias("called"), "owner", F.col("other").alias("receiver")), "receiver", "type"))
    entity = _of(f, "entity").select("repository", F.col("owner").alias("entity"), F.col("name").alias("table")).distinct()
    stores = resolved(names, _of(f, "store").select("repository", "file_id", F.col("name").alias("of"), F.col("owner").alias("type")), "of", "entity").join(entity, ["repository", "entity"]).groupBy("repository", "type").agg(F.min("table").alias("table"))
    calls = stored(calls)
    target = _found_methods(names, calls.select("repository", "type", F.col("called").alias("name"))).withColumnRenamed("name", "called")
    calls = calls.join(target, ["repository", "type", "called"], "left").join(stores, ["repository", "type"], "left")
    reached = F.coalesce("target", F.when(F.col("table").isNotNull(), F.col("type")))
    out.append(calls.where(reached.isNotNull()).select("repository", "src", _method_id(reached, F.col("called")).alias("dst"), text("calls").alias("kind")))
    derived = calls.where("table is not null and target is null").select("repository", "type", F.col("called").alias("name"), "table").unionByName(names.methods.join(stores, ["repository", "type"]).select("repository", "type", "name", "table"))
    verb = F.when(F.col("name").rlike(WRITING), "writes").when(F.col("name").rlike(READING), "reads")
    out.append(derived.where(verb.isNotNull()).select("repository", _method_id(F.col("type"), F.col("name")).alias("src"), F.concat(text("table:"), "table").alias("dst"), verb.alias("kind")))
    access = by(_of(f, "access").select("repository", "file_id", "name", "owner", "other"))
    out.append(access.groupBy("repository", "src", F.concat(text("table:"), "name").alias("dst")).agg(F.max("other").alias("kind")))  # writes wins over reads
    out.append(_of(f, "trigger").select("repository", F.concat(text("trigger:"), "name").alias("src"), F.concat(text("table:"), "owner").alias("dst"), text("triggers").alias("kind")))
    routes = by(_of(f, "route").select("repository", "file_id", F.col("name").alias("route"), "owner"))
    out.append(routes.select("repository", F.concat(text("endpoint:"), "route").alias("src"), F.col("src").alias("dst"), text("http").alias("kind")))
    union = out[0]
    for x in out[1:]:
        union = union.unionByName(x)
    return union.where("src <> dst").distinct()


def nodes(f: DataFrame, e: DataFrame, names: Names | None = None) -> DataFrame:
    """(repository, id, kind), each once: classes, functions, tables, endpoints."""
    ids = types_of(f).select("repository", F.concat(F.lit("class:"), "qualified").alias("id")).unionByName((names or Names(f)).methods.select("repository", _method_id(F.col("type"), F.col("name")).alias("id")))
    ids = ids.unionByName(_of(f, "table").select("repository", F.concat(F.lit("table:"), "name").alias("id"))).unionByName(_of(f, "object").where("other in ('table', 'trigger', 'function')").select("repository", F.concat("other", F.lit(":"), "name").alias("id")))
    ids = ids.unionByName(_of(f, "route").select("repository", F.concat(F.lit("endpoint:"), "name").alias("id"))).unionByName(e.select("repository", F.col("src").alias("id"))).unionByName(e.select("repository", F.col("dst").alias("id")))
    head = F.substring_index("id", ":", 1)
    return ids.distinct().withColumn("kind", F.when(head.isin("method", "trigger", "function"), "function").otherwise(head))


def findings(f: DataFrame) -> DataFrame:
    """(repository, file_id, category, name, detail, line, end_line) of what deserves a look, the file-wide and the repository-wide ones.

    A handler without a guard counts where another of its repository has one; a private method is
    dead if its name is followed by a bracket no more than once in the repository.
    """
    own = _of(f, "finding").select("repository", "file_id", F.col("name").alias("category"), F.col("owner").alias("name"), F.col("other").alias("detail"), "line", "end_line")
    handlers = _of(f, "handler")
    guarded = handlers.where("other is not null").groupBy("repository").agg(F.count("*").alias("n"))
    gaps = handlers.where("other is null").join(guarded, "repository").select("repository", "file_id", F.lit("authorization-gap").alias("category"), "name", F.col("n").cast("string").alias("detail"), "line", "end_line")
    uses = _of(f, "word").groupBy("repository", "name").agg(F.sum(F.col("other").cast("bigint")).alias("uses"))
    dead = _of(f, "private").join(uses, ["repository", "name"], "left").where("coalesce(uses, 0) <= 1").select("repository", "file_id", F.lit("dead-code").alias("category"), "name", F.lit(None).cast("string").alias("detail"), "line", "end_line")
    return own.unionByName(gaps).unionByName(dead)
