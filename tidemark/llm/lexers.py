"""Token streams of the languages whose files are checked: (token, place) pairs.

A token that cannot belong to a text of the language is ``ERROR``, which no grammar has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Tokens = Iterator[tuple[str, int]]


def _scan(pattern: re.Pattern, text: str, words: frozenset[str], fold: bool = False) -> Tokens:
    """Tokens by named groups: ``skip`` is left out, ``word`` is itself if in ``words`` else ID, ``op`` is itself."""
    at, n = 0, len(text)
    match = pattern.match
    while at < n:
        m = match(text, at)
        if m is None:
            yield "ERROR", at
            return
        kind = m.lastgroup
        if kind == "word":
            w = m[0].lower() if fold else m[0]
            yield (w if w in words else "ID"), at
        elif kind == "op":
            yield m[0], at
        elif kind != "skip":
            yield kind, at
        at = m.end()


# -- JSON -------------------------------------------------------------------
_JSON = re.compile(r'(?P<skip>[ \t\r\n]+)|(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.])|(?P<word>[A-Za-z]+)|(?P<op>[{}\[\]:,])')


def json_tokens(text: str) -> Tokens:
    return _scan(_JSON, text, frozenset({"true", "false", "null"}))


# -- Java -------------------------------------------------------------------
# Reserved words and words with a meaning of their own.
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new"
    " package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record var yield sealed permits non when".split()
)
_JAVA = re.compile(
    r'(?P<skip>[ \t\r\n\f]+|//[^\r\n]*|/\*[\s\S]*?\*/|\x1a)'
    r'|(?P<STR>"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|"(?:[^"\\\r\n]|\\.)*")|(?P<CHAR>\'(?:[^\'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))\')'
    r'|(?P<NUM>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?|0[bB][01_]+|[0-9][0-9_]*(?:\.(?![A-Za-z_.])[0-9_]*)?(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)[lLfFdD]?)(?![\w])'
    r'|(?P<word>[^\W\d][\w$]*|\$[\w$]*)'
    r'|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||<<=|>>>=|>>=|<=|>=|==|!=|[+\-*/%&|^]=|<<|[-+*/%&|^!~?:=<>(){}\[\];,.@])'
)


def java_tokens(text: str) -> Tokens:
    return _scan(_JAVA, text, JAVA_WORDS)


# -- TypeScript ---------------------------------------------------------------
TS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
    " implements interface let package private protected public static yield abstract as asserts any async await declare from get infer is keyof module namespace never of readonly require set type unique satisfies override out accessor global".split()
)
_TS = re.compile(
    r'(?P<skip>[ \t\r\n\f\v﻿\xa0]+|//[^\r\n]*|/\*[\s\S]*?\*/|(?<![\s\S])#![^\r\n]*)'
    r'|(?P<STR>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|\'(?:[^\'\\\r\n]|\\(?:\r\n|[\s\S]))*\')'
    r'|(?P<NUM>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)n?)(?![\w$])'
    r'|(?P<word>#?[^\W\d][\w$]*|#?\$[\w$]*)'
    r'|(?P<op>=>|\.\.\.|\?\.(?![0-9])|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\*\*=|\*\*|<<=|>>>=|>>=|<<|<=|>=|===|!==|==|!=|[+\-*%&|^]=|[-+*%&|^!~?:=<>(){}\[\];,.@])'
)
_TS_REGEX = re.compile(r'/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*')
_TS_PIECE = re.compile(r'(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)')


def ts_tokens(text: str) -> Tokens:
    """Templates with substitutions are TPL_HEAD, the tokens between, TPL_MIDDLE and TPL_TAIL."""
    at, n, before = 0, len(text), ""
    braces: list[int] = []
    depth = 0
    ends_value = frozenset({"ID", "NUM", "STR", "TPL", "TPL_TAIL", ")", "]", "}", "this", "super", "null", "true", "false", "REGEX"})
    while at < n:
        m = _TS.match(text, at)
        if m is not None:
            kind = m.lastgroup
            if kind == "skip":
                at = m.end()
                continue
            t = (m[0] if m[0] in TS_WORDS else "ID") if kind == "word" else m[0] if kind == "op" else kind
            if t == "}" and braces and braces[-1] == depth:
                p = _TS_PIECE.match(text, at + 1)
                if p is None:
                    yield "ERROR", at
                    return
                before = "TPL_TAIL" if p[0].endswith("`") else "TPL_MIDDLE"
                if before == "TPL_TAIL":
                    braces.pop()
                yield before, at
                at = p.end()
                continue
            depth += (t == "{") - (t == "}")
            yield t, at
            before, at = t, m.end()
        elif text[at] == "`":
            p = _TS_PIECE.match(text, at + 1)
            if p is None:
                yield "ERROR", at
                return
            before = "TPL" if p[0].endswith("`") else "TPL_HEAD"
            if before == "TPL_HEAD":
                braces.append(depth)
            yield before, at
            at = p.end()
        elif text.startswith("/*", at):  # a comment without an end
            yield "ERROR", at
            return
        elif text[at] == "/":
            p = _TS_REGEX.match(text, at) if before not in ends_value else None
            if p is not None:
                before = "REGEX"
                yield before, at
                at = p.end()
            else:
                before = "/=" if text.startswith("/=", at) else "/"
                yield before, at
                at += len(before)
        else:
            yield "ERROR", at
            return


# -- SQL ----------------------------------------------------------------------
SQL_WORDS = frozenset(
    "all and any array as asc begin between by case cast check collate comment conflict constraint create cross current default delete desc distinct do drop else elsif end escape except exception exists false fetch filter first following"
    " for foreign from full function group having if ilike in index inner insert intersect interval into is join key language last lateral left like limit loop natural no not nothing null nulls offset on only or order outer over partition"
    " password perform preceding primary procedure raise range recursive references replace return returning returns right role row rows select set similar some table temp temporary then to trigger true unbounded union unique unlogged update user using"
    " values view when where while window with alter add column type declare is_ notnull isnull generated always identity stored schema sequence extension materialized"
    " exclude deferrable initially deferred immediate match restrict cascade action inherit compression storage abort analyze call checkpoint close cluster commit copy deallocate discard execute explain grant import listen load lock merge move notify prepare reassign refresh reindex release reset revoke rollback savepoint security show start truncate unlisten vacuum".split()
)
_SQL = re.compile(
    r"(?P<skip>[ \t\r\n\f\v﻿]+|--[^\r\n]*)"
    r"|(?P<STR>[eEbBxXnN]?'(?:[^'\\]|''|\\(?!'))*'(?!')|[uU]&'(?:[^']|'')*')|(?P<ESTR>[eE]'(?:[^'\\]|''|\\[\s\S])*')"
    r'|(?P<ID>[uU]&"(?:[^"]|"")+"|"(?:[^"]|"")+")|(?P<PARAM>\$[0-9]+|:[A-Za-z_]\w*(?<!::))'
    r"|(?P<NUM>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?![A-Za-z_])"
    r"|(?P<word>[^\W\d][\w$]*)"
    r"|(?P<op>::|:=|\.\.|[(),;.\[\]:])"
    r"|(?P<OP>[-+*/<>=~!@#%^&|`?]+)"
)
# Kinds of objects that are no words of the grammar, steps of the procedural language, marks of a merge.
_KINDS = frozenset("access collation conversion database domain event large owned policy procedural publication routine rule server statistics subscription system tablespace text transform trusted".split())
_STEPS = frozenset("assert continue exit get open".split())
_STEP_AFTER = frozenset(("", ";", "begin", "then", "else", "loop"))
_CONFLICT = re.compile(r"<{7}|={7}|>{7}|\|{7}")
_DOLLAR = re.compile(r"\$([^\W\d]\w*)?\$")
_SQL_WORD = re.compile(r"[^\W\d][\w$]*")
_OPENERS = re.compile(r"/\*|\*/")


def sql_tokens(text: str) -> Tokens:
    """Tokens of SQL. Words that only name something after a verb or at the start of a step are told apart there alone."""
    before = last = ""
    for kind, at in _sql_tokens(text):
        if kind == "ID" and text[at] not in "\"uU":
            word = _SQL_WORD.match(text, at)[0].lower()
            if last in ("create", "alter", "drop") or before == "or" and last == "replace":
                kind = "OPERATOR" if word in ("operator", "aggregate") else "KIND" if word in _KINDS else "SCOPE" if word in ("global", "local") else kind
            elif word == "mapping" and last == "user":
                kind = "KIND"
            elif word in _STEPS and last in _STEP_AFTER:
                kind = "STEP"
        yield kind, at
        before, last = last, kind


def _sql_tokens(text: str) -> Tokens:
    at, n = 0, len(text)
    while at < n:
        if text.startswith("/*", at):
            depth, p = 0, at
            for m in _OPENERS.finditer(text, at):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    p = m.end()
                    break
            if p == at:
                yield "ERROR", at
                return
            at = p
            continue
        d = _DOLLAR.match(text, at)
        if d is not None:
            end = text.find(d[0], d.end())
            if end < 0:
                yield "ERROR", at
                return
            yield "BODY", at
            at = end + len(d[0])
            continue
        m = _SQL.match(text, at)
        if m is None:
            yield "ERROR", at
            return
        kind, value = m.lastgroup, m[0]
        if kind == "OP":
            if (at == 0 or text[at - 1] == "\n") and _CONFLICT.match(value):
                yield "ERROR", at
                return
            for stop in ("--", "/*"):  # a comment may follow an operator at once
                cut = value.find(stop)
                if cut > 0:
                    value = value[:cut]
            yield (value if value in ("=", "*", "<", ">", "-", "+") else "OP"), at
        elif kind == "word":
            w = value.lower()
            yield (w if w in SQL_WORDS else "ID"), at
        elif kind == "op":
            yield value, at
        elif kind != "skip":
            yield ("STR" if kind == "ESTR" else kind), at
        at += len(value)


def sql_bodies(text: str) -> Iterator[tuple[str, int]]:
    """The texts between dollar marks, which hold the bodies of functions."""
    at = 0
    while (d := _DOLLAR.search(text, at)) is not None:
        end = text.find(d[0], d.end())
        if end < 0:
            return
        yield text[d.end() : end], d.end()
        at = end + len(d[0])


# -- Python -------------------------------------------------------------------
PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
)
_PY = re.compile(
    r"(?P<skip>[ \t\f]+|#[^\r\n]*|\\\r?\n)"
    r"|(?P<NEWLINE>\r?\n|\r)"
    r"|(?P<STR>(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'|\"\"(?!\")|''(?!')))"
    r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9]+)?[jJ]?|[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9]+)?[jJ]?))(?![0-9A-Za-z_](?<!if)(?<!or))"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<op>->|:=|\.\.\.|\*\*=|//=|<<=|>>=|\*\*|//|<<|>>|<=|>=|==|!=|[+\-*/%&|^@]=|[-+*/%&|^~<>()\[\]{},:.;@=])"
)
_INDENT = re.compile(r"[ \t\f]*")


def py_tokens(text: str) -> Tokens:
    """Tokens with NEWLINE, INDENT and DEDENT; within brackets line ends do not count."""
    at, n = (1 if text.startswith("﻿") else 0), len(text)
    levels = [0]
    depth = 0
    fresh, content = True, False
    while at < n:
        if fresh and not depth:
            m = _INDENT.match(text, at)
            width = 0
            for c in m[0]:
                width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
            at = m.end()
            if at < n and text[at] not in "#\r\n" and not (text[at] == "\\" and text[at + 1 : at + 2] in "\r\n"):
                if width > levels[-1]:
                    levels.append(width)
                    yield "INDENT", at
                while width < levels[-1]:
                    levels.pop()
                    yield "DEDENT", at
                if width != levels[-1]:
                    yield "ERROR", at
                    return
            fresh = False
            continue
        m = _PY.match(text, at)
        if m is None:
            yield "ERROR", at
            return
        kind, value = m.lastgroup, m[0]
        if kind == "NEWLINE":
            if not depth:
                if content:
                    yield "NEWLINE", at
                fresh, content = True, False
        elif kind == "word":
            yield (value if value in PY_WORDS else "ID"), at
            content = True
        elif kind == "op":
            depth = max(0, depth + (value in "([{") - (value in ")]}"))
            yield value, at
            content = True
        elif kind != "skip":
            yield kind, at
            content = True
        at = m.end()
    if content:
        yield "NEWLINE", n
    for _ in levels[1:]:
        yield "DEDENT", n


# -- XML ----------------------------------------------------------------------
_NAME = r"[^\W\d][\w.:-]*"
_REF = r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"
_XML = re.compile(
    rf"(?P<DECL>(?<![\s\S])﻿?<\?xml\s[^?]*\?>)|(?P<PI><\?(?!(?i:xml)[\s?]){_NAME}(?:\s[\s\S]*?)?\?>)|(?P<COMMENT><!--(?:(?!--)[\s\S])*-->)|(?P<CDATA><!\[CDATA\[[\s\S]*?\]\]>)"
    rf"|(?P<DOCTYPE><!DOCTYPE\s[^\[>]*(?:\[[\s\S]*?\]\s*)?>)"
    rf"|(?P<tag><(?P<close>/?)(?P<name>{_NAME})(?P<attrs>(?:\s+{_NAME}\s*=\s*(?:\"(?:[^<&\"]|{_REF})*\"|'(?:[^<&']|{_REF})*'))*)\s*(?P<empty>/?)>)"
    rf"|(?P<WS>\s+(?=<|\Z))|(?P<TEXT>(?:(?!\]\]>)[^<&\x00-\x08\x0b\x0c\x0e-\x1f]|{_REF})+)"
)
_ATTR = re.compile(rf"\s({_NAME})\s*=\s*(?:\"[^\"]*\"|'[^']*')")


def xml_tokens(text: str) -> Tokens:
    at, n = 0, len(text)
    entities = re.search(r"<!ENTITY", text) is not None
    while at < n:
        m = _XML.match(text, at)
        if m is None:
            if entities and (e := re.compile(rf"&{_NAME};").match(text, at)):
                yield "TEXT", at
                at = e.end()
                continue
            yield "ERROR", at
            return
        if m["tag"]:
            names = _ATTR.findall(m["attrs"])
            if m["close"] and (m["empty"] or names) or len(names) != len(set(names)):
                yield "ERROR", at
                return
            yield ("EMPTY" if m["empty"] else ("</" if m["close"] else "<") + m["name"]), at
        else:
            yield next(k for k in ("DECL", "PI", "COMMENT", "CDATA", "DOCTYPE", "WS", "TEXT") if m[k]), at
        at = m.end()


# -- YAML ---------------------------------------------------------------------
_Y_DQ = re.compile(r'"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\r?\n))*"')
_Y_SQ = re.compile(r"'(?:[^']|'')*'")
_Y_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![\s#]))*")
_Y_PLAIN_FLOW = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?![\s#]))*")
_Y_WORD = re.compile(r"[&*][^\s,\[\]{}]+|!(?:<[^>\s]*>|[^\s,\[\]{}]*)")
_Y_BLOCK = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|\Z)")


class YamlScanner:
    """Structure of a YAML text: block levels by indentation, keys where a value follows on the same line."""

    def __init__(self, text: str) -> None:
        self.t = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
        self.out: list[tuple[str, int]] = []
        self.levels: list[tuple[int, str]] = []  # indentation and MAPSTART or SEQSTART

    def fail(self, at: int) -> list[tuple[str, int]]:
        self.out.append(("ERROR", at))
        return self.out

    def close(self, indent: int, at: int) -> None:
        while self.levels and self.levels[-1][0] > indent:
            self.levels.pop()
            self.out.append(("END", at))

    def open(self, kind: str, col: int, at: int, into: int | None = None) -> bool:
        """Enter a block collection at a column unless it is the current one."""
        top = self.levels[-1] if self.levels else (-1, "")
        if top[0] < col or top[0] == col and top[1] == "MAPSTART" and kind == "SEQSTART" and self.after_value:
            self.levels.append((col, kind))
            self.out.insert(len(self.out) if into is None else into, (kind, at))
            return True
        if top[0] == col and top[1] == "SEQSTART" and kind == "MAPSTART" and len(self.levels) > 1 and self.levels[-2][0] == col:
            self.levels.pop()  # a sequence at the column of its key ends with the next key
            self.out.insert(len(self.out) if into is None else into, ("END", at))
            return True
        return top == (col, kind)

    def scan(self) -> list[tuple[str, int]]:
        t, n, at = self.t, len(self.t), 0
        flow: list[tuple[str, tuple[int, int, int] | None]] = []  # open brackets and what key each may be
        line_start, first_line_start = 0, True
        self.after_value = False
        may_key = True  # a key may begin here
        key_at: tuple[int, int, int] | None = None  # place in out, column, line of a possible key
        while True:
            # blanks, comments, line ends
            moved_line = False
            begin = at
            while at < n:
                c = t[at]
                if c in " \t":
                    at += 1
                elif c == "\n":
                    at += 1
                    line_start, moved_line = at, True
                elif c == "#" and (at == 0 or t[at - 1] in " \t\n"):
                    e = t.find("\n", at)
                    at = n if e < 0 else e
                else:
                    break
            if at >= n:
                break
            fresh = moved_line or begin == 0 and first_line_start
            first_line_start = False
            col = at - line_start
            if fresh:
                if not flow:
                    if t[line_start:at].count("\t") and t[at] not in "#":
                        return self.fail(at)
                    if col == 0 and t[at : at + 3] in ("---", "...") and t[at + 3 : at + 4] in ("", " ", "\t", "\n"):
                        self.close(-1, at)
                        self.out.append(("DOCSTART" if t[at] == "-" else "DOCEND", at))
                        at += 3
                        may_key, key_at, self.after_value = True, None, False
                        continue
                    if col == 0 and t[at] == "%" and not self.levels:
                        e = t.find("\n", at)
                        at = n if e < 0 else e
                        continue
                    self.close(col, at)
                    may_key, key_at = True, None
                elif self.levels and col <= self.levels[-1][0] and t[at] not in "]}":
                    return self.fail(at)
            c, after = t[at], t[at + 1 : at + 2]
            gap = after in ("", " ", "\t", "\n")
            if c in "[{":
                if flow or may_key:
                    key_at = key_at or (len(self.out), col, line_start)
                flow.append((c, key_at))
                self.out.append((c, at))
                at += 1
                key_at = None
                self.after_value = may_key = False
                continue
            if c in "]}":
                if not flow or flow[-1][0] != {"]": "[", "}": "{"}[c]:
                    return self.fail(at)
                key_at = flow.pop()[1]
                self.out.append((c, at))
                at += 1
                continue
            if flow and c == ",":
                self.out.append((",", at))
                at += 1
                key_at = None
                continue
            if not flow and c == "-" and gap:
                if not may_key or not self.open("SEQSTART", col, at):
                    return self.fail(at)
                self.out.append(("ENTRY", at))
                at += 1
                may_key, key_at, self.after_value = True, None, False
                continue
            if c == "?" and gap:
                if not flow and (not may_key or not self.open("MAPSTART", col, at)):
                    return self.fail(at)
                self.out.append(("KEY", at))
                at += 1
                may_key, key_at, self.after_value = True, None, False
                continue
            if c == ":" and (gap or flow and (after in ",[]{}" or self.out and self.out[-1][0] in ("SCALAR", "]", "}") and t[at - 1] in "\"']}")):
                if key_at is not None and key_at[2] == line_start:
                    place, kcol, _ = key_at
                    if not flow:
                        opened = len(self.out)
                        if not self.open("MAPSTART", kcol, at, place):
                            return self.fail(at)
                        place += len(self.out) - opened
                    self.out.insert(place, ("KEY", at))
                elif flow:
                    if self.out[-1][0] == "SCALAR":
                        return self.fail(at)
                elif not (may_key and self.levels and self.levels[-1] == (col, "MAPSTART")):
                    return self.fail(at)  # a value without a key on its line
                self.out.append(("VALUE", at))
                at += 1
                key_at, may_key, self.after_value = None, False, True
                continue
            if c in "&*!":
                m = _Y_WORD.match(t, at)
                if m is None:
                    return self.fail(at)
                if key_at is None and (may_key or flow):
                    key_at = (len(self.out), col, line_start)
                self.out.append(({"&": "ANCHOR", "*": "ALIAS", "!": "TAG"}[c], at))
                at = m.end()
                continue
            if not flow and c in "|>":
                m = _Y_BLOCK.match(t, at)
                if m is None:
                    return self.fail(at)
                parent = self.levels[-1][0] if self.levels else -1
                at = m.end()
                inner = None
                while at < n:
                    e = t.find("\n", at)
                    e = n if e < 0 else e
                    line = t[at:e]
                    width = len(line) - len(line.lstrip(" "))
                    if line.strip():
                        if width <= parent or inner is not None and width < inner and not line.startswith("\t"):
                            break
                        inner = width if inner is None else inner
                    at = min(n, e + 1)
                self.out.append(("BLOCK", at))
                # stand before the next line's start, as after any line end
                line_start = at
                first_line_start = True
                may_key, key_at, self.after_value = True, None, False
                if at < n:
                    at -= 1 if t[at - 1] == "\n" else 0
                continue
            if key_at is None and (may_key or flow) or key_at is not None and self.out[key_at[0] :] and all(k in ("ANCHOR", "TAG") for k, _ in self.out[key_at[0] :]) and key_at[2] == line_start:
                start_key = key_at or (len(self.out), col, line_start)
            else:
                start_key = None
            if self.out and self.out[-1][0] in ("SCALAR", "BLOCK", "ALIAS") and not flow and not fresh:
                return self.fail(at)
            if c in "\"'":
                m = (_Y_DQ if c == '"' else _Y_SQ).match(t, at)
                if m is None:
                    return self.fail(at)
                cut = t.rfind("\n", at, m.end())
                if cut >= 0:
                    if not flow and self.levels and any(len(x) - len(x.lstrip(" ")) <= self.levels[-1][0] for x in t[at : m.end()].split("\n")[1:] if x.strip()):
                        return self.fail(at)
                    line_start, start_key = cut + 1, None
                self.out.append(("SCALAR", at))
                at = m.end()
            else:
                m = (_Y_PLAIN_FLOW if flow else _Y_PLAIN).match(t, at)
                if m is None:
                    return self.fail(at)
                self.out.append(("SCALAR", at))
                at = m.end()
                # following lines that are further in go on with the scalar
                parent = self.levels[-1][0] if self.levels else -1
                while True:
                    e = at
                    while e < n and t[e] in " \t":
                        e += 1
                    if e >= n or t[e] != "\n":
                        break
                    s = e
                    while s < n and t[s] in " \t\n":
                        s += 1
                    start = t.rfind("\n", 0, s) + 1
                    if s >= n or t[s] == "#" or not flow and s - start <= parent or s == start and t[s : s + 3] in ("---", "..."):
                        break
                    more = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?![\s#]))+" if flow else r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![\s#]))+").match(t, s)
                    if more is None:
                        break
                    at, line_start, start_key = more.end(), start, None
            key_at = start_key
            may_key = False
            self.after_value = False
        if flow:
            return self.fail(n)
        self.close(-1, n)
        return self.out


def yaml_tokens(text: str) -> Tokens:
    return iter(YamlScanner(text).scan())
