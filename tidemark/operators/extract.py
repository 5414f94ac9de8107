"""Relations drawn from source texts: statements, tables, signals, routes, methods, settings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import spread

# Kinds of statements by their first word, words after FROM and the like that are
# no tables, and the words by which a literal is taken for SQL.
_KINDS = {"select": ("select", "with"), "insert": ("insert",), "update": ("update", "merge"), "delete": ("delete",), "ddl": ("alter", "drop", "truncate")}
_CREATED = ("trigger", "function", "procedure")
_NO_TABLE = ("SELECT", "UNNEST", "GENERATE_SERIES", "LATERAL", "DUAL", "ONLY", "OF", "SET", "WHERE")
_SQL_FIRST = "SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH|MERGE|TRUNCATE"
_SQL_SECOND = "FROM|INTO|SET|VALUES|TABLE|INDEX|VIEW|TRIGGER|FUNCTION|PROCEDURE|WHERE|SELECT"


def without_leading_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, r"^(?:\s+|--[^\n]*(?:\n|$)|/\*(?:[^*]|\*(?!/))*\*/)+", "")


def verb_of(sql: Column) -> Column:
    """The kind of a statement: select, insert, update, delete, ddl, function, trigger, procedure or unknown."""
    body = F.lower(without_leading_comments(sql))
    created = F.lit("ddl")
    for word in reversed(_CREATED):
        created = F.when(body.rlike(rf"\b{word}\b"), word).otherwise(created)
    out = F.when(body.startswith("create"), created)
    for kind, words in _KINDS.items():
        out = out.when(body.rlike("^(?:" + "|".join(words) + ")"), kind)
    return out.otherwise("unknown")


def tables_of(sql: Column) -> Column:
    """Sorted distinct names after FROM, JOIN, INTO, UPDATE, TABLE and ON, as they are written."""
    names = F.flatten(F.array(*(
        F.regexp_extract_all(sql, F.lit(rf"(?i)\b{word}\s+([A-Za-z_][\w$.]*)"), F.lit(1))
        for word in ("FROM", "JOIN", "INTO", "UPDATE", r"TABLE(?:\s+IF\s+(?:NOT\s+)?EXISTS)?", "ON"))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~F.upper(n).isin(*_NO_TABLE))))


def sql_signals(sql: Column) -> dict[str, Column]:
    s = F.upper(sql)
    return {
        "rounding": s.rlike(r"\b(?:ROUND|TRUNC|NUMERIC)\s*\(|\bCAST\s*\([^)]*\bAS\b[^)]*(?:NUMERIC|DECIMAL)"), "ordering": s.rlike(r"\bORDER\s+BY\b"), "aggregate": s.rlike(r"\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\("),
        "concat": sql.rlike(r"\|\||\bCONCAT\s*\("), "transaction": s.rlike(r"\b(?:BEGIN|COMMIT|ROLLBACK|START\s+TRANSACTION|SAVEPOINT)\b"),
    }


def looks_like_sql(text: Column) -> Column:
    s = F.upper(F.trim(text))
    return (F.length(s) >= 12) & s.rlike(rf"^(?:{_SQL_FIRST})\b") & s.rlike(rf"\b(?:{_SQL_SECOND})\b")


def access_mechanism(body: Column) -> Column:
    """How a body of code reaches the database, the most direct way first."""
    return F.when(body.rlike(r"nativeQuery\s*=\s*true"), "native-query").when(body.rlike(r"\bjdbc\w*\.\w+\("), "jdbc-template").when(body.rlike(r"(?i)\"\s*(?:select|insert|update|delete)\b"), "raw-sql").when(body.rlike(r"\w*[rR]epository\d*\.\w+\("), "orm").otherwise("none")


# What reads a clock or chance, transactions by hand, writing calls, hints of repeatable writes, marks of unfinished work.
CLOCKS = r"\bnew\s+(?:java\.util\.)?Date\s*\(|\bSystem\s*\.\s*currentTimeMillis\s*\(|\bLocal(?:Date|DateTime|Time)\s*\.\s*now\s*\(|\bCalendar\s*\.\s*getInstance\s*\(|\bInstant\s*\.\s*now\s*\(|\bnew\s+Random\s*\(|\bMath\s*\.\s*random\s*\(|\bUUID\s*\.\s*randomUUID\s*\("
SQL_CLOCKS = r"(?i)\b(?:NOW\s*\(\s*\)|CURRENT_DATE|CURRENT_TIMESTAMP|LOCALTIMESTAMP|clock_timestamp\s*\(\s*\))"
TRANSACTIONS = r"\bsetAutoCommit\s*\(|\.commit\s*\(\s*\)|\.rollback\s*\(\s*\)"
WRITES = r"(?i)\.(?:insert|update|delete|save|persist|executeUpdate|execute|send|post|create)\w*\s*\(|\b(?:INSERT|UPDATE|DELETE)\s+"
REPEATABLE = r"(?i)idempoten|dedup|duplicate[-_ ]?key|already[-_ ]?processed"
UNFINISHED = r"(?i)\b(?:TODO|FIXME|HACK|XXX|WORKAROUND|temporar|for now|do not (?:remove|delete|touch)|nobody knows|don'?t ask)\b"


def detectors(body: Column) -> dict[str, Column]:
    """Conditions under which a method's body deserves a look. The patterns are fixed values too."""
    return {
        "swallowed-exception": body.rlike(r"\bcatch[ \t]*\([^)]*\)[ \t]*\{\s*\}|\bcatch[ \t]*\([^)]*\)[ \t]*\{(?:[^{};]*\b(?:log(?:ger)?|LOG|System\.err|System\.out)\b[^{};]*;\s*)+\}"),
        "time-dependence": body.rlike(CLOCKS) | body.rlike(SQL_CLOCKS),
        "transaction-boundary-anomaly": body.rlike(TRANSACTIONS),
        "retry-without-idempotency": body.rlike(r"(?i)retry|retries|attempt|maxAttempts") & body.rlike(WRITES) & ~body.rlike(REPEATABLE),
        "magic-number": F.exists(F.regexp_extract_all(F.regexp_replace(body, r"\"(?:[^\"\\\n]|\\.)*\"", "\"\""), F.lit(r"(?:[<>=!]=?|\+|-|\*|/|%|return)[ \t]*(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda n: ~n.isin("0", "1", "2", "-1", "10", "0.0", "1.0")),
        "misleading-comment": F.exists(F.regexp_extract_all(body, F.lit(r"(//[^\n]*|/\*[\s\S]*?\*/)"), F.lit(1)), lambda c: c.rlike(UNFINISHED)),
    }


def suspicious(body: Column) -> Column:
    """Names of the detectors that fire, in a fixed order."""
    return F.array_compact(F.array(*(F.when(c, n) for n, c in detectors(body).items())))


def split_statements(sql: str) -> list[tuple[int, int, str]]:
    """(number, first line, text) of the statements of a script: semicolons within quotes, dollar
    bodies and comments do not end one; leading blanks and comments do not count for the line."""
    out, start, at, n = [], 0, 0, len(sql)
    token = re.compile(r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|\$(\w*)\$[\s\S]*?(?:\$\1\$|\Z)|;|[^;'\"$/-]+|.", re.S)
    lead = re.compile(r"(?:\s+|--[^\n]*|/\*[\s\S]*?\*/)*")

    def take(end: int) -> None:
        body = lead.match(sql, start, end).end()
        if sql[body:end].strip():
            out.append((len(out), sql.count("\n", 0, body) + 1, sql[start:end].strip()))

    while at < n:
        m = token.match(sql, at)
        if m[0] == ";":
            take(at)
            start = m.end()
        at = m.end()
    take(n)
    return out


_COLUMN = re.compile(r"\s*\"?([A-Za-z_]\w*)\"?\s+([A-Za-z_]\w*(?:\s+(?:precision|varying))?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", re.I)
_OBJECT = re.compile(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unlogged\s+|unique\s+|materialized\s+|constraint\s+)?(table|view|index|sequence|trigger|function|procedure|role|type)\s+(?:if\s+not\s+exists\s+)?\"?([A-Za-z_][\w.]*)", re.I)


def _top_level(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth, begin = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(text[begin:i])
            begin = i + 1
    return [*parts, text[begin:]]


def ddl_objects(sql: str) -> list[tuple[str, str, int, str, str, bool, int | None]]:
    """(kind, name, line, column, type, nullable, precision): one row per column of a table, one per other object."""
    out = []
    for _, line, text in split_statements(sql):
        bare = re.sub(r"--[^\n]*|/\*[\s\S]*?\*/", " ", text).strip()
        m = _OBJECT.match(bare)
        if not m:
            continue
        kind, name = m[1].lower(), m[2].lower()
        rest = bare[m.end() :].strip().strip('"').strip()
        if kind == "table" and rest.startswith("(") and ")" in rest:
            for part in _top_level(rest[1 : rest.rindex(")")]):
                c = _COLUMN.match(part)
                if c and c[1].lower() not in ("constraint", "primary", "unique", "check", "foreign", "exclude", "like"):
                    out.append((kind, name, line, c[1].lower(), c[2].upper(), not re.search(r"(?i)\bnot\s+null\b|\bprimary\s+key\b", part), int(c[3]) if c[3] else None))
        else:
            out.append((kind, name, line, None, None, None, None))
    return out


_JAVA_MASK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def masked(source: str) -> str:
    """Strings and comments of a C-like source as blanks, at the same offsets and lines."""
    return _JAVA_MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


# Fixed value: names of settings whose values are withheld.
SECRET_SETTINGS = re.compile(r"(?i)(password|passwd|secret|token|api[-_.]?key|credential|private[-_.]?key|access[-_.]?key)")


def settings(path: str, text: str) -> list[tuple[str, str | None, bool]]:
    """(key, value, secret) of .properties and YAML files; values of secret keys are withheld."""
    out: list[tuple[str, str | None, bool]] = []

    def add(key: str, value: str) -> None:
        hide = bool(SECRET_SETTINGS.search(key))
        out.append((key, None if hide else value.strip().strip("\"'"), hide))

    if re.search(r"(?i)\.(?:properties|ini)$", path):
        for line in text.splitlines():
            m = re.match(r"\s*([^#!\s=:][^=:]*?)\s*[=:]\s*(.*)$", line)
            if m:
                add(m[1], m[2])
    elif re.search(r"(?i)\.ya?ml$", path):
        stack: list[tuple[int, str]] = []
        for line in text.splitlines():
            m = re.match(r"( *)([A-Za-z_][\w.-]*):(?:\s+(.*))?$", line)
            if m:
                indent = len(m[1])
                while stack and stack[-1][0] >= indent:
                    stack.pop()
                if m[3] and not m[3].startswith("#"):
                    add(".".join([*(k for _, k in stack), m[2]]), m[3])
                else:
                    stack.append((indent, m[2]))
    return out


def extracted(df: DataFrame, key: str, args: list[str], function, columns: str) -> DataFrame:
    """(key, columns) rows of a text function over each row of ``df``; rows with a null argument give none."""
    key_type = df.schema[key].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, *a in pdf[[key, *args]].itertuples(index=False, name=None) for r in function(*a)]
            yield pd.DataFrame(rows, columns=[key, *names]).astype({n: object for n in names})

    held = df.select(key, *args)
    for a in args:
        held = held.where(F.col(a).isNotNull())
    return spread(held).mapInPandas(run, f"{key} {key_type}, {columns}")


def fuzzy_overlap(a: list[str], b: list[str], shortest: int = 4, ratio: float = 0.8) -> float:
    """Dice overlap of two bags of words; words left over may match by a common prefix of at
    least ``ratio`` of the longer one, first come first served."""
    if not a or not b:
        return 0.0
    left, rest, hits = list(b), [], 0
    for w in a:
        if w in left:
            left.remove(w)
            hits += 1
        else:
            rest.append(w)
    for w in rest:
        for x in left:
            if len(w) >= shortest and len(x) >= shortest:
                p = 0
                while p < min(len(w), len(x)) and w[p] == x[p]:
                    p += 1
                if p / max(len(w), len(x)) >= ratio:
                    left.remove(x)
                    hits += 1
                    break
    return 2 * hits / (len(a) + len(b))


def best_window(quote: list[str], lines: list[list[str]], enough: float, least: int = 2, most: int = 5) -> tuple[int, int, float] | None:
    """(first line, last line, score) of the ``least`` to ``most`` lines, no blank ones at the ends, whose words together match a quote best, if well ``enough``."""
    key = lambda w: w[:4]  # noqa: E731 - words that match agree in their first four letters
    wanted = {key(w) for w in quote}
    size, held = [len(ln) for ln in lines], [sum(key(w) in wanted for w in ln) for ln in lines]
    best = None
    for i in range(len(lines)):
        for j in range(i + least - 1, min(i + most, len(lines))):
            total = sum(size[i : j + 1]) + len(quote)
            bound = 2 * min(sum(held[i : j + 1]), len(quote)) / total if total else 0.0
            if size[i] and size[j] and bound >= enough and (best is None or bound > best[2]):
                score = fuzzy_overlap(quote, [w for ln in lines[i : j + 1] for w in ln])
                if score >= enough and (best is None or score > best[2]):
                    best = i, j, score
    return best


def anchor(text: str, quote: str, enough: float = 0.7, gap: int = 3, wrapped: float = 0.6) -> list[tuple[int, int, float]]:
    """(first line, last line, score) of the best place of a quote in a text: lines that match
    well, joined while at most ``gap`` apart; of several places the longest, then best, then first.
    A window of two to five lines that holds the quote's words at ``wrapped`` or more goes before
    it where it scores no less, or where that place has fewer than half of the quote's lines."""
    words = lambda s: [w for w in re.split(r"[^a-z0-9_]+", s.lower()) if w]
    wanted = [q for q in (words(x) for x in quote.splitlines()) if q]
    lines = [words(x) for x in text.splitlines()]
    strong = {}
    for i, ln in enumerate(lines):
        score = max((fuzzy_overlap(q, ln) for q in wanted), default=0.0)
        if score >= enough:
            strong[i] = score
    groups: list[list[int]] = []
    for i in sorted(strong):
        if groups and i - groups[-1][-1] <= gap:
            groups[-1].append(i)
        else:
            groups.append([i])
    window = best_window([w for q in wanted for w in q], lines, wrapped) if wanted else None
    best = max(groups, key=lambda g: (len(g), max(strong[i] for i in g), -g[0])) if groups else []
    if window and (2 * len(best) < len(wanted) or not best or window[2] >= max(strong[i] for i in best)):
        return [(window[0] + 1, window[1] + 1, round(window[2], 4))]
    if not best:
        return []
    return [(best[0] + 1, best[-1] + 1, round(max(strong[i] for i in best), 4))]


def anchors(text: str, quotes: list) -> list[tuple[int, int, int, float]]:
    """(id, first line, last line, score) of the best place of each of a text's quotes (id, quote)."""
    return [(q["span_id"], *place) for q in quotes for place in anchor(text, q["comment_text"])]


def scheduled_jobs(source: str) -> list[tuple[str, str, int]]:
    """(kind, value, line) of scheduled methods: cron, fixedRate or fixedDelay."""
    return [(m[1], m[2].strip("\""), source.count("\n", 0, m.start()) + 1) for m in re.finditer(r"@Scheduled\s*\(\s*(cron|fixedRate|fixedDelay)\s*=\s*(\"[^\"]*\"|\d+)", source)]


def dependencies(path: str, text: str) -> list[tuple[str, str | None, str]]:
    """(name, version, scope) declared by pom.xml, package.json, requirements.txt and Gradle files."""
    name = path.rsplit("/", 1)[-1].lower()
    out: list[tuple[str, str | None, str]] = []
    if name == "pom.xml":
        for block in re.findall(r"<dependency>([\s\S]*?)</dependency>", text):
            tag = lambda t: (re.search(rf"<{t}>\s*([^<]*?)\s*</{t}>", block) or [None, None])[1]  # noqa: B023, E731
            out.append((f"{tag('groupId')}:{tag('artifactId')}", tag("version"), tag("scope") or "compile"))
    elif name == "package.json":
        for scope, key in (("runtime", "dependencies"), ("dev", "devDependencies")):
            body = re.search(rf'"{key}"\s*:\s*\{{([^}}]*)\}}', text)
            out += [(n, v, scope) for n, v in re.findall(r'"([^"]+)"\s*:\s*"([^"]*)"', body[1])] if body else []
    elif name == "requirements.txt":
        out += [(n, v or None, "runtime") for n, v in re.findall(r"(?m)^\s*([A-Za-z0-9_.-]+)\s*(?:==\s*([^\s#;]+))?", text) if n]
    elif name.startswith("build.gradle"):
        out += [(f"{g}:{a}", v or None, s) for s, g, a, v in re.findall(r"(?m)^\s*(\w+)\s*\(?['\"]([\w.-]+):([\w.-]+)(?::([\w.-]+))?['\"]", text)]
    return out


def json_in_prose(text: str) -> list[tuple[str]]:
    """The first JSON object or array that parses: a whole text, a fenced block, or a balanced stretch."""
    import json

    tries = [text, *re.findall(r"```(?:json)?\s*\n([\s\S]*?)```", text)]
    for t in tries:
        try:
            v = json.loads(t)
        except (ValueError, RecursionError):
            continue
        if isinstance(v, (dict, list)):
            return [(json.dumps(v, sort_keys=True),)]
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            v, _ = decoder.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        return [(json.dumps(v, sort_keys=True),)]
    return []


def imports(source: str) -> list[tuple[str, str]]:
    """(class, imported name) edges of a Java file."""
    m = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", source)
    c = re.search(r"\b(?:class|interface|enum|record)\s+(\w+)", masked(source))
    if not c:
        return []
    owner = f"{m[1]}.{c[1]}" if m else c[1]
    return sorted({(owner, x) for x in re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", source)})


# Signatures of other systems in Java code, their kind, and whether they make results vary.
EXTERNAL = {
    "system-clock": ("clock", True, r"\bSystem\s*\.\s*currentTimeMillis\b|\bnew\s+(?:java\.util\.)?Date\s*\(|\bLocal(?:Date|DateTime|Time)\s*\.\s*now\b|\bInstant\s*\.\s*now\b|\bCalendar\s*\.\s*getInstance\b"),
    "random": ("random", True, r"\bnew\s+Random\b|\bMath\s*\.\s*random\b|\bThreadLocalRandom\b"),
    "uuid": ("random", True, r"\bUUID\s*\.\s*randomUUID\b"),
    "http-client": ("network", True, r"\bRestTemplate\b|\bWebClient\b|\bHttpClient\b|\bOkHttpClient\b|\bHttpURLConnection\b"),
    "jdbc": ("database", False, r"\bDriverManager\b|\bDataSource\b|\bJdbcTemplate\b|\bjava\.sql\."),
    "jpa": ("database", False, r"\bEntityManager\b|\borg\.springframework\.data\.jpa\b"),
    "filesystem": ("filesystem", False, r"\bjava\.nio\.file\.Files\b|\bnew\s+File\s*\(|\bFileWriter\b|\bFileInputStream\b"),
    "message-queue": ("queue", True, r"\bKafkaTemplate\b|\bRabbitTemplate\b|\bJmsTemplate\b|\b@KafkaListener\b|\b@RabbitListener\b"),
}
_EXTERNAL = {n: (k, v, re.compile(p)) for n, (k, v, p) in EXTERNAL.items()}


def external_uses(source: str) -> list[tuple[str, str, bool, int]]:
    """(name, kind, nondeterministic, line of the first use) of the systems that a file's code uses."""
    code = masked(source)
    hits = ((n, k, v, p.search(code)) for n, (k, v, p) in _EXTERNAL.items())
    return [(n, k, v, code.count("\n", 0, m.start()) + 1) for n, k, v, m in hits if m]
