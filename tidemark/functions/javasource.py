"""Structure of a Java source: types, methods, fields, literals, comments and signals.

A scanner blanks strings and comments at their offsets. The rest is cut into members, each a
head up to its brace, semicolon or initializer, and types are opened in turn, so that what
belongs to whom follows from the braces. A text that breaks off is read as far as it goes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_OPAQUE = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "synchronized", "default", "native", "strictfp", "transient", "volatile", "sealed")
_CLOSING = {"(": ")", "{": "}", "[": "]"}

# Annotations and calls that the signals name.
HTTP = {"GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping", "RequestMapping", "Path", "GET", "POST", "PUT", "DELETE", "PATCH", "RestController", "Controller"}
SCHEDULES = {"Scheduled", "Schedules", "Schedule", "EnableScheduling"}
ROUNDING = re.compile(r"\bsetScale\s*\(|\bMath\s*\.\s*round\s*\(|\bRoundingMode\b|\bROUND_(?:UP|DOWN|CEILING|FLOOR|HALF_UP|HALF_DOWN|HALF_EVEN)\b|\bdiv\s*\([^)]*,\s*\d")
MAGIC = re.compile(r"(?:[<>=!+\-*/%][ \t]*|[ \t]return[ \t]+|[ \t]case[ \t]+)-?\d{2,}(?:\.\d+)?")
SQL_FIRST = re.compile(r"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH|MERGE|TRUNCATE)\b")
SQL_LATER = re.compile(r"\b(?:FROM|INTO|SET|VALUES|TABLE|INDEX|VIEW|TRIGGER|FUNCTION|PROCEDURE|WHERE|SELECT)\b")


def looks_like_sql(text: str) -> bool:
    up = text.strip().upper()
    return len(up) >= 12 and SQL_FIRST.match(up) is not None and SQL_LATER.search(up) is not None


@dataclass
class Member:
    """A type, method, constructor or field."""

    what: str
    name: str
    owner: str | None
    line: int
    end_line: int
    modifiers: list[str]
    annotations: list[tuple[str, str]]
    type: str = ""
    parameters: str = ""
    body: str | None = None
    masked_body: str = ""
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    place: int = 0

    def has(self, *names: str) -> bool:
        return any(n in names for n, _ in self.annotations)


@dataclass
class JavaFile:
    source: str
    masked: str
    package: str | None
    imports: list[str]
    static_imports: list[str]
    literals: list[tuple[int, str]]
    comments: list[tuple[int, str]]
    members: list[Member]

    def of(self, *what: str) -> list[Member]:
        return [m for m in self.members if m.what in what]

    def qualified(self, name: str) -> str:
        return f"{self.package}.{name}" if self.package else name


class _Reader:
    def __init__(self, source: str) -> None:
        self.source = source
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.literals: list[tuple[int, str]] = []
        self.comments: list[tuple[int, str]] = []
        self.masked = _OPAQUE.sub(self._blank, source)
        self.members: list[Member] = []
        self.todo: list[tuple[int, int, str | None, bool]] = []  # bodies of types that are still to be opened

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def _blank(self, m: re.Match) -> str:
        text = m[0]
        if text.startswith("/"):
            self.comments.append((self.line(m.start()), text))
        elif text[0] == '"':
            edge = 3 if text.startswith('"""') else 1
            inner = text[edge : -edge if len(text) >= 2 * edge and text.endswith('"' * edge) else None]
            self.literals.append((self.line(m.start()), inner if edge == 3 else re.sub(r"\\(.)", r"\1", inner)))
        return re.sub(r"[^\n]", " ", text)

    def close(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at``; the end of the text if it breaks off."""
        opened, shut, depth = self.masked[at], _CLOSING[self.masked[at]], 0
        for m in re.compile(re.escape(opened) + "|" + re.escape(shut)).finditer(self.masked, at):
            depth += 1 if m[0] == opened else -1
            if not depth:
                return m.start()
        return len(self.masked)

    def annotations(self, at: int, end: int) -> tuple[list[tuple[str, str]], int]:
        """The annotations from ``at`` on and where they stop; arguments as written."""
        out = []
        while True:
            m = re.compile(r"\s*@(?!interface\b)([\w$.]+)\s*").match(self.masked, at, end)
            if m is None:
                return out, at
            at, args = m.end(), ""
            if self.masked[at : at + 1] == "(":
                stop = self.close(at)
                args, at = " ".join(self.source[at + 1 : stop].split()), stop + 1
            out.append((m[1].rsplit(".", 1)[-1], args))

    def body(self, start: int, end: int, owner: str | None, enum: bool = False) -> None:
        """Members between ``start`` and ``end``."""
        at = start
        if enum:  # constants up to the first semicolon outside brackets
            at = self._until(start, end, ";")[0] + 1
        while at < end:
            begin, stop = at, end
            notes, head = self.annotations(at, end)
            stop, sign = self._until(head, end, ";{=")
            text = self.masked[head:stop]
            if sign == "{" and not text.strip():  # initializer block
                at = self.close(stop) + 1
                continue
            after = stop + 1
            if sign == "=":
                after = self._until(stop, end, ";")[0] + 1
            elif sign == "{":
                after = self.close(stop) + 1
            self._member(head, text, notes, owner, sign, stop, after)
            at = max(after, begin + 1)

    def _until(self, at: int, end: int, signs: str) -> tuple[int, str]:
        """The first of ``signs`` outside brackets."""
        while at < end:
            ch = self.masked[at]
            if ch in signs:
                return at, ch
            if ch in _CLOSING:
                at = self.close(at)
            at += 1
        return end, ""

    def _member(self, head: int, text: str, notes: list[tuple[str, str]], owner: str | None, sign: str, stop: int, after: int) -> None:
        modifiers: list[str] = []
        at = 0
        while True:  # modifiers, and annotations between them
            m = re.compile(r"\s*(?:([a-z]+)\b|(@(?!interface\b)))").match(text, at)
            if m is None or m[1] and m[1] not in _MODIFIERS:
                break
            if m[2]:
                more, place = self.annotations(head + at, stop)
                notes = [*notes, *more]
                at = place - head
            else:
                modifiers.append(m[1])
                at = m.end()
        own = text[at:]
        first = head + at + len(own) - len(own.lstrip())
        own = own.strip()
        line, last = self.line(first), self.line(max(first, min(after, len(self.masked)) - 1))
        kind = re.match(r"(class|interface|enum|record|@\s*interface)\s+([A-Za-z_$][\w$]*)", own)
        if kind:
            heads = re.split(r"\b(extends|implements|permits)\b", _without_brackets(own[kind.end() :]))
            clauses = {word: [x.strip() for x in _split(text) if x.strip()] for word, text in zip(heads[1::2], heads[2::2])}
            what = "annotation" if kind[1].startswith("@") else kind[1]
            self.members.append(Member(what, kind[2], owner, line, last, modifiers, notes, extends=clauses.get("extends", []), implements=clauses.get("implements", []), place=first))
            if sign == "{":
                self.todo.append((stop + 1, after - 1, kind[2], what == "enum"))
            return
        open_at = own.find("(")
        if open_at >= 0 and sign != "=":
            place = self.masked.index("(", first)
            shut = self.close(place)
            if shut == len(self.masked):
                return
            before = re.sub(r"^<[^(]*?>\s+(?=[\w$.<\[])", "", own[:open_at]).strip()
            m = re.fullmatch(r"(?:(.+?)\s*(?<![\w$]))?([A-Za-z_$][\w$]*)", before, re.S)
            if m is None or m[1] in ("new", "return", "throw", "else") or not m[1] and m[2] != owner:
                return
            inside = sign == "{"
            self.members.append(Member(
                "method" if m[1] else "constructor", m[2], owner, line, last, modifiers, notes, " ".join((m[1] or m[2]).split()), " ".join(self.masked[place + 1 : shut].split()),
                self.source[stop + 1 : after - 1] if inside else None, self.masked[stop + 1 : after - 1] if inside else "", place=first))
            return
        for i, part in enumerate(_split(own)):
            m = re.fullmatch(r"(?:(.+?)\s*(?<![\w$]))?([A-Za-z_$][\w$]*)\s*((?:\[\s*\])*)", part.strip(), re.S)
            if m is None or i == 0 and not m[1] or sign == "{":
                return
            base = " ".join(m[1].split()) if i == 0 else base
            self.members.append(Member("field", m[2], owner, line, last, modifiers, notes, base + m[3], body=self.source[stop + 1 : after - 1].strip() if sign == "=" else None, place=first))


def _without_brackets(text: str) -> str:
    """``text`` without the parameters that follow a type's own name."""
    if not text.lstrip().startswith(("<", "(")):
        return text
    depth = 0
    for i, ch in enumerate(text):
        depth += (ch in "<(") - (ch in ">)")
        if not depth and ch in ">)":
            return text[i + 1 :] if not text[i + 1 :].lstrip().startswith("(") else _without_brackets(text[i + 1 :])
    return ""


def _split(text: str) -> list[str]:
    """Parts between commas outside brackets of any kind."""
    parts, depth, begin = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == "," and depth <= 0:
            parts.append(text[begin:i])
            begin = i + 1
    return [*parts, text[begin:]] if text[begin:].strip() else parts


def analyse(source: str) -> JavaFile:
    r = _Reader(source)
    package = re.search(r"(?m)^[ \t]*package[ \t]+([\w$.]+)[ \t]*;", r.masked)
    found = re.findall(r"(?m)^[ \t]*import[ \t]+(static[ \t]+)?([\w$.]+(?:\.\*)?)[ \t]*;", r.masked)
    start = 0
    for m in re.finditer(r"(?m)^[ \t]*(?:package|import)\b[^;\n]*;", r.masked):
        start = m.end()
    r.todo.append((start, len(r.masked), None, False))
    while r.todo:
        r.body(*r.todo.pop())
    r.members.sort(key=lambda m: m.place)
    return JavaFile(source, r.masked, package and package[1], [x for s, x in found if not s], [x for s, x in found if s], r.literals, r.comments, r.members)


def swallowed(masked: str) -> list[tuple[int, bool]]:
    """(place, empty) of the catch blocks that leave no trace or only log."""
    out = []
    for m in re.finditer(r"\bcatch[ \t]*\([^)]*\)[ \t]*\{", masked):
        depth, stop = 0, None
        for b in re.finditer(r"[{}]", masked[m.end() - 1 :]):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                stop = m.end() - 1 + b.start()
                break
        if stop is None:
            continue
        steps = [s for s in masked[m.end() : stop].split(";") if s.strip()]
        if all(re.search(r"\b(?:log(?:ger)?|LOG|System\.err|System\.out)\b", s) for s in steps):
            out.append((m.end() - 1, not steps))
    return out


def signals(f: JavaFile) -> dict[str, int]:
    """The nine signals of a file; all but the last are 0 or 1."""
    notes = {n.rsplit(".", 1)[-1] for n in re.findall(r"@([A-Za-z_$][\w$.]*)", f.masked)}
    branches = sum(len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?", m.body or "")) for m in f.of("method", "constructor"))
    return {
        "has_sql": int(any(looks_like_sql(t) for _, t in f.literals)), "has_http": int(bool(notes & HTTP)), "has_schedule": int(bool(notes & SCHEDULES)), "has_transaction": int("Transactional" in notes),
        "has_swallowed_catch": int(bool(swallowed(f.masked))), "has_static_mutable_state": int(any("static" in m.modifiers and "final" not in m.modifiers for m in f.of("field"))),
        "has_rounding": int(bool(ROUNDING.search(f.masked))), "has_magic_number": int(bool(MAGIC.search(f.masked))), "cyclomatic": 1 + branches,
    }
