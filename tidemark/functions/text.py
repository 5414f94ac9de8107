"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def pad_right(c: Column, n: int) -> Column:
    """Blanks up to ``n`` characters; a longer text stays whole, null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)


def clip(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last of which is an ellipsis where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit(ELLIPSIS))).otherwise(c)


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and underscore."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda x: x != "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other holds; 0 for empty sets."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


# Folders of a host that are not shown, and forms of secrets with what stands for them.
HOST_PATHS = r"(?<![\w.-])/(?:Users|home|private|var|tmp|opt|Volumes)/[^\s\"'`)\]},;]*"
SECRETS = (
    (r"\bsk-[A-Za-z0-9_-]{8,}", "[redacted api key]"),
    (r"\bAQ\.[A-Za-z0-9_.-]{8,}", "[redacted api key]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [redacted]"),
    (r"(?i)\bAuthorization\s*[:=]\s*[^\s\"'`]{8,}", "Authorization: [redacted]"),
)


def mask_paths(c: Column) -> Column:
    return F.regexp_replace(c, HOST_PATHS, "[host path withheld]")


def mask_secrets(c: Column) -> Column:
    for pattern, instead in SECRETS:
        c = F.regexp_replace(c, pattern, instead)
    return c


def for_display(c: Column, most: int = 240) -> Column:
    """A text without host paths and secrets, blanks collapsed, clipped."""
    return clip(collapse_blanks(mask_secrets(mask_paths(c))), most)


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")


def slug(c: Column, most: int = 120) -> Column:
    """Lower case with dashes for all but letters, digits, dot and underscore. Null for what could
    leave a folder (two dots, a leading slash or backslash) and where nothing is left."""
    t = F.trim(c)
    s = _dashed(t)
    return F.when(t.contains("..") | t.startswith("/") | t.startswith("\\") | (s == ""), None).otherwise(F.substring(s, 1, most))


def stable_slug(c: Column) -> Column:
    """An id that stays the same for a text: its hash and the end of its slug."""
    s = _dashed(c)
    return F.concat(fnv1a32(c), F.lit("-"), F.substr(s, F.greatest(F.lit(1), F.length(s) - 59)))


def fnv1a32(c: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text as eight hexadecimal digits."""
    folded = F.aggregate(
        F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261).cast("bigint"),
        lambda h, ch: F.pmod(h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(16777619), F.lit(4294967296)))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def occurrences(c: Column, needle: str) -> Column:
    """How often a literal text occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def line_of(c: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset from 0."""
    before = F.substr(c, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def join_path(a: Column, b: Column) -> Column:
    joined = F.regexp_replace(F.concat(F.lit("/"), a, F.lit("/"), b), "/{2,}", "/")
    return F.when(F.length(joined) > 1, F.regexp_replace(joined, "/$", "")).otherwise(joined)


def template_variables(c: Column) -> Column:
    """Names in double braces, each once in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}"), F.lit(1)))


def head_and_tail(c: Column, most: int) -> Column:
    """A long text as its head (60 %), a note of what is left out, and its tail."""
    head = most * 6 // 10
    tail = most - head
    note = F.concat(F.lit("\n…["), (F.length(c) - most).cast("string"), F.lit(" characters omitted]…\n"))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), note, F.substr(c, F.length(c) - tail + 1))).otherwise(c)


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def cited_paths(c: Column, most: int = 8) -> Column:
    """The first distinct path-like words of a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:[\w.-]+/)+[\w.-]+\.\w+)"), F.lit(1))), 1, most)


_GLOB = re.compile(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|[^*?{]+|\{")
_GLOB_PARTS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def _literal(text: str) -> str:
    return re.sub(r"([.^$+()\[\]|\\{}*?])", r"\\\1", text)


def glob_pattern(glob: str) -> str:
    """The anchored regular expression of a glob with **, *, ? and {a,b}; choices in braces are plain texts."""
    out = []
    for part in _GLOB.findall(glob):
        if part.startswith("{") and part.endswith("}"):
            out.append("(?:" + "|".join(_literal(x.strip()) for x in part[1:-1].split(",")) + ")")
        else:
            out.append(_GLOB_PARTS.get(part) or _literal(part))
    return "^" + "".join(out) + "$"


def safe_path(c: Column) -> Column:
    """No empty step, no step upwards or in place, not absolute."""
    return ~F.exists(F.split(c, "/"), lambda s: s.isin("", ".", ".."))


def inside(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")
