"""Credentials embedded in texts: detection rules behind a trigram index, exact places, masking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread
from .trigrams import compile_rules

# Names under which secrets are kept, placeholders that stand in for one, and
# formats of issued tokens.
_KEY = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|api[_.-]?key|x[_-]?auth"
    r"|(?:signing|encryption|access|private|secret|client|shared|auth|tls|ssh|master|hmac|service|account)[_.-]?key)"
    r"(?:[_-]?(?:b64|base64|value))?(?:[_-]?[0-9]+)?"
)
_PLACEHOLDER = re.compile(
    r"(?i)[*x•.#_-]+|\$\{.*|\$\(.*|\{\{.*|<.*>|%[a-z0-9_]+%|\$[a-z_][a-z0-9_]*|\[.*\]|:[a-z_]+|\?"
    r"|(?:your|my|some|insert|enter|the)[-_ ].*|.*[-_ ]here|(?:re-?dacted|masked|hidden|removed|omitted|filtered|placeholder|change[-_ ]?me|changeit"
    r"|none|null|nil|undefined|true|false|empty|example|sample|dummy|todo|tbd|string|secret|password|passwd|token|api[-_ ]?key|vault[:/].*)"
)
_TOKEN_FORMS = (
    r"(?:ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20}|sk_(?:live|test)_[A-Za-z0-9]{20,}|xox[abprs]-[0-9]+-[A-Za-z0-9-]{10,}"
    r"|sk-[A-Za-z0-9_-]{32,}|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
_SEP = r"\s*(?::=|=>|[:=])\s*"
_QUOTED = r"(?P<q>\\?[\"'`])(?P<v>(?:(?!(?P=q))[^\r\n])+)(?P=q)"

RULES = {
    "pem": r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)",
    "quoted": r"(?i)" + _KEY + r"(?:\\?[\"'`])?\]?(?:\s*:\s*[a-z]+)?" + _SEP + r"(?:[\w.$]+(?:\([^()\r\n]*\)|\[[^\[\]\r\n]*\])?\s*(?:\?\?|\|\||\bor\b)\s*)?" + _QUOTED,
    "argument": r"(?i)" + _KEY + r"[\"'`]\s*,\s*" + _QUOTED,
    "attribute": r"(?i)" + _KEY + r"[\"']\s+value\s*=\s*" + _QUOTED,
    "element": r"(?i)<(?P<n>[\w.:-]*" + _KEY + r")>(?P<v>[^<>\r\n]+)</",
    "login": r"(?i)(?:login|log_in|sign_?in|authenticate|basic_?auth|credentials?)\s*\(\s*[\"'`][^\"'`\r\n]*[\"'`]\s*,\s*" + _QUOTED,
    "option": r"(?i)\s(?:-u|--user)[ =]\s*[\"']?[\w.@-]+:(?P<v>[^\s\"'`<>]+)",
    "pair": r"(?i)" + _KEY + r"[\"']\s*,\s*[\"']val(?:ue)?[\"']\s*:\s*" + _QUOTED,
    "docker": r"(?i)[\"']auth[\"']\s*:\s*" + _QUOTED,
    "header": r"(?i)authorization(?:\\?[\"'])?\s*[:=,]\s*(?:\\?[\"'])?(?:bearer|basic|token)\s+(?P<v>[^\s\"'`;,\\]+)",
    "said": r"(?i)\b(?:password|passphrase|passcode|secret|api key|token|pwd)\s+(?:is\s+|was\s+)?(?P<q>[\"'`]?)(?P<v>[^\s\"'`<>,;()]+)(?P=q)",
    "issued": r"(?i)\bpass(?:word|phrase|code)\s+(?P<v>[^\s\"'`<>]+)\s+issued\b",
    "replaced": r"(?i)\b(?:secret|password|token|key)\s+[^\s]+\s+(?:was\s+)?replaced\s+(?:by|with)\s+(?P<v>[^\s\"'`<>,;]+)",
    "short": r"(?i)[ /(]pw[ :=]\s*(?P<q>[\"'`]?)(?P<v>[^\s\"'`<>,;()]+)(?P=q)",
    "former": r"(?i)\b(?:old|former|previous|new|current) (?:value|one|key) (?:was|is) (?P<q>[\"'`]?)(?P<v>[^\s\"'`<>,;()]+)(?P=q)",
    "bare": r"(?i)" + _KEY + r"[\"']?(?P<s>\s*[:=]\s*)(?P<v>[^\s\"'`<>&;,(){}\[\]|\\]+)",
    "urlencoded": r"(?i)" + _KEY + r"%3d(?P<v>(?:(?!%26)[^\s&\"'])+)",
    "userinfo": r"(?i)[a-z][a-z0-9+.-]*://[^\s/:@\"'`<>]+:(?P<v>[^\s/@\"'`<>]+)@",
    "cookie": r"(?i)cookie[\"']?\s*[:=]\s*[\"']?(?:[\w-]+=[^;\s]*;\s*)*(?:[\w-]*sess(?:ion)?[\w-]*|sid|auth|[\w-]*token)=(?P<v>[^\s;,\"']+)",
    "form": r"(?<![A-Za-z0-9])(?P<v>" + _TOKEN_FORMS + r")(?![A-Za-z0-9])",
}


def _turns(v: str) -> int:
    """Changes from lower to upper case: few in names, many in random strings."""
    return sum(a.islower() and b.isupper() for a, b in zip(v, v[1:]))


def _is_name(v: str) -> bool:
    """A bare word that reads as an identifier of code: letters in name shape, at most three digits at the end."""
    return bool(re.fullmatch(r"(?:[A-Za-z]+|[a-z]+(?:[A-Z][a-z]+)*|[A-Z][a-z]+(?:[A-Z][a-z]+)*|[A-Za-z]+(?:_[A-Za-z0-9]+)*)[0-9]{0,3}", v)) and _turns(v) < 3


def _grouped(v: str) -> bool:
    """Groups of one length, as issued passwords have them, also where all are letters."""
    parts = v.split("-")
    return len(parts) > 2 and len(parts[0]) > 3 and len({len(x) for x in parts}) == 1 and v.replace("-", "").isalnum()


def _literal(v: str) -> bool:
    return len(v) >= 4 and not _PLACEHOLDER.fullmatch(v) and "***" not in v and "${" not in v and "{{" not in v


def accepted(rule: str, m: re.Match) -> tuple[int, int] | None:
    """The place of the value if the match is a credential that was written out."""
    start, end = m.span("v")
    v = m["v"]
    text = m.string
    if rule == "pem":
        return start, end
    if v.startswith("-----BEGIN"):
        return None
    scheme = re.match(r"(?i)(?:bearer|basic|token)\s+", v)
    if scheme:
        start += scheme.end()
        v = v[scheme.end() :]
    lead = len(v) - len(v.lstrip())
    start += lead
    v = v.strip()
    end = start + len(v)
    if not _literal(v):
        return None
    if rule in ("quoted", "argument", "attribute", "element", "docker", "login", "pair"):
        words = v.split()
        if len(words) > 1 and (len(words) > 6 or not (re.search(r"[0-9]", v) or re.search(r"(?i)passphrase", m[0][: m.start("v") - m.start()]))):
            return None
        if re.fullmatch(r"[a-z_. -]+|[A-Z_]+", v) and len(words) == 1 and not _grouped(v):
            return None
        if re.fullmatch(r"[\w.]+\(.*\)", v) or re.match(r"(?:process\.env|os\.environ|System\.getenv)", v):
            return None
    elif rule == "bare" and not _grouped(v):
        after = text[m.end("v") : m.end("v") + 1]
        if after in ("(", "[") and after:
            return None
        if v.startswith(("process.env", "os.environ", "System.")) or v.startswith("//") or "://" in v:
            return None
        spaced = m["s"] != "="
        if after == ";" and m["s"].startswith(" ") and re.fullmatch(r"[A-Za-z_$][\w.$]*", v):
            return None
        if spaced and _is_name(v) or re.fullmatch(r"[A-Za-z_.]+", v) and _turns(v) < 3 or re.fullmatch(r"[0-9.]+", v) and spaced:
            return None
        if re.fullmatch(r"[a-z]+(?:[_.-][a-z]+)*", v):
            return None
    elif rule in ("said", "replaced", "short", "former"):
        if not m.groupdict().get("q"):
            stripped = v.rstrip(".:!?") if rule == "said" and not re.search(r"[#!$%]$", v) else v
            end -= len(v) - len(stripped)
            v = stripped
            mixed = re.search(r"[0-9]", v) and re.search(r"[A-Za-z]", v) or re.search(r"[A-Za-z][#!$%_.]", v)
            if not (mixed or _grouped(v)) or len(v) < 6 or "://" in v or "=" in v.rstrip("="):
                return None
        elif re.fullmatch(r"[a-z_]+", v):
            return None
    elif rule in ("userinfo", "option") and re.fullmatch(r"[0-9]{1,5}", v):
        return None
    elif rule == "header":
        if len(v) < 8:
            return None
    return (start, end) if end > start else None


class Scanner:
    """The rules, compiled, with the index of the trigrams that they require."""

    def __init__(self) -> None:
        self.patterns, self.index = compile_rules(RULES)

    def scan(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text number, start, end) of each credential; a place inside another is not reported."""
        found: dict[int, set[tuple[int, int]]] = {}
        for rule, docs in self.index.candidates(texts).items():
            finditer = self.patterns[rule].finditer
            for d in docs.tolist():
                for m in finditer(texts[d]):
                    place = accepted(rule, m)
                    if place:
                        found.setdefault(d, set()).add(place)
        out = []
        for d, places in found.items():
            last = -1
            for s, e in sorted(places, key=lambda p: (p[0], -p[1])):
                if e > last:
                    out.append((d, s, e))
                    last = e
        return out


def find_credentials(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, field_name, start_pos, end_pos) of each credential.

    ``texts`` has (source_table, record_id, field_name, content). Each batch is indexed by
    trigram; a rule's pattern is run only on the texts whose postings hold its required
    trigrams. Nothing is shuffled and whole texts are read. Positions count code points from
    0, the end is exclusive. Null and empty texts hold nothing; repeated rows are reported as
    often as they occur; overlapping places of two rules are reported once, as the longer.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for pdf in batches:
            hits = scanner.scan(pdf["content"].tolist())
            rows = pdf.iloc[[h[0] for h in hits]]
            yield pd.DataFrame({"source_table": rows["source_table"].to_numpy(), "record_id": rows["record_id"].to_numpy(), "field_name": rows["field_name"].to_numpy(), "start_pos": [h[1] for h in hits], "end_pos": [h[2] for h in hits]})

    held = texts.where("record_id is not null and content is not null and content <> ''").select("source_table", "record_id", "field_name", "content")
    return spread(held).mapInPandas(run, "source_table string, record_id bigint, field_name string, start_pos bigint, end_pos bigint")


def redact(content: "F.Column", places: "F.Column") -> "F.Column":
    """``content`` with each of ``places`` (an array of struct(start_pos, end_pos) without
    overlaps) overwritten by as many asterisks, so that all other offsets stay."""
    order = F.array_sort(places)
    zero = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(a, p):
        kept = F.substr(content, a["at"].cast("int") + 1, (p["start_pos"] - a["at"]).cast("int"))
        return F.struct(F.concat(a["done"], kept, F.repeat(F.lit("*"), (p["end_pos"] - p["start_pos"]).cast("int"))).alias("done"), p["end_pos"].alias("at"))

    return F.aggregate(order, zero, step, lambda a: F.concat(a["done"], F.substr(content, a["at"].cast("int") + 1, F.lit(2**31 - 1))))
