"""Trigrams that a regular expression requires, and a trigram index over texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: A condition on the trigrams of a lower-case text: True, ("t", trigram), ("and", ...), ("or", ...).
Condition = bool | tuple


def _both(parts: list[Condition]) -> Condition:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _either(parts: list[Condition]) -> Condition:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_text(text: str) -> Condition:
    return _both([("t", text[i : i + 3]) for i in range(len(text) - 2)])


#: So many spellings of a stretch are followed; beyond, the stretch is cut and stays a weaker, still necessary condition.
SPELLINGS = 24


def _walk(nodes) -> tuple[list[str] | None, Condition]:
    """The exact spellings of a sequence, if few, and a condition that its matches fulfil."""
    runs: list[str] = [""]
    exact, conditions = True, []

    def flush() -> None:
        nonlocal runs
        conditions.append(_either([_of_text(r) for r in runs]))
        runs = [""]

    for op, arg in nodes:
        spell: list[str] | None = None
        condition: Condition = True
        if op is sre.LITERAL:
            spell = [chr(arg).lower()]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            spell = sorted({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            spell, condition = _walk(arg[-1])
        elif op is sre.BRANCH:
            ways = [_walk(w) for w in arg[1]]
            spell = sorted({s for w, _ in ways for s in w}) if all(w is not None for w, _ in ways) else None
            condition = _either([c for _, c in ways])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            s, c = _walk(inner)
            if low == 0 and high == 1 and s is not None:
                spell = sorted({"", *s})
            elif low >= 1:
                condition = c
                if low == high == 1:
                    spell = s
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            spell = [""]
        if spell is not None and len(spell) * len(runs) <= SPELLINGS:
            runs = [r + s for r in runs for s in spell]
        else:
            exact = False
            flush()
            conditions.append(condition)
            if spell is not None and len(spell) <= SPELLINGS:
                runs = list(spell)
    if exact:
        return runs, _either([_of_text(r) for r in runs])
    flush()
    return None, _both(conditions)


def required(pattern: str) -> Condition:
    """A condition that the lower-case form of every text with a match of ``pattern`` fulfils."""
    return _walk(sre_parse.parse(pattern))[1]


def _names(c: Condition) -> set[str]:
    return set() if c is True else {c[1]} if c[0] == "t" else set().union(*map(_names, c[1:]))


#: Characters of a chunk, and of the chunks that are indexed at a time: what the index needs beside the texts themselves does not grow with their length.
CHUNK, BLOCK = 1 << 16, 1 << 20


def chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of chunks, with the number of the text of each; a chunk begins with the last two characters of the one before it, so that no trigram is lost."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - 2), CHUNK):
            owners.append(i)
            parts.append(text[at : at + CHUNK + 2] if len(text) > CHUNK + 2 else text)
            size += len(parts[-1])
            if size >= BLOCK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


class TrigramIndex:
    """Postings, over the chunks of the texts of one batch, of the trigrams that a set of conditions names."""

    def __init__(self, conditions: dict[str, Condition]) -> None:
        self.conditions = conditions
        self.wanted = sorted(set().union(*(_names(c) for c in conditions.values())))
        codes = np.array([self._code(*map(ord, t)) for t in self.wanted], np.uint64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    @staticmethod
    def _code(a, b, c):
        return (a << 42) | (b << 21) | c

    def _of_block(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a trigram and a chunk that holds it."""
        # Only A-Z are folded, so that offsets stay; conditions are lower case.
        c = np.frombuffer("\0\0".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c = np.where((c >= 65) & (c <= 90), c + np.uint64(32), c)
        ends = np.cumsum([len(p) + 2 for p in parts])
        if len(c) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
        at = np.searchsorted(self.codes, g)
        at[at == len(self.codes)] = 0
        hit = np.flatnonzero(self.codes[at] == g)
        return at[hit], np.searchsorted(ends, hit, "right")

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """trigram -> numbers of the texts that hold it, in ascending order.

        Matches may run over chunks, so the postings of the chunks of one text are united before conditions are looked at."""
        pairs = [np.zeros(0, np.int64)]
        for owners, parts in chunks(texts):
            which, chunk = self._of_block(parts)
            pairs.append(np.unique(which * np.int64(len(texts)) + np.array(owners)[chunk]))
        which, doc = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(texts)))
        cuts = np.searchsorted(which, np.arange(len(self.codes) + 1))
        found: dict[str, np.ndarray] = {}
        for i, o in enumerate(self.order):
            found[self.wanted[o]] = doc[cuts[i] : cuts[i + 1]]
        return found

    def candidates(self, texts: list[str]) -> dict[str, np.ndarray]:
        """name -> numbers of the texts that fulfil its condition."""
        post = self.postings(texts)
        everything = np.arange(len(texts))

        def of(c: Condition) -> np.ndarray:
            if c is True:
                return everything
            if c[0] == "t":
                return post[c[1]]
            parts = [of(x) for x in c[1:]]
            if c[0] == "or":
                return np.unique(np.concatenate(parts))
            out = min(parts, key=len)
            for p in parts:
                if p is not out and len(out):
                    out = np.intersect1d(out, p, assume_unique=True)
            return out

        return {name: of(c) for name, c in self.conditions.items()}


def compile_rules(rules: dict[str, str]) -> tuple[dict[str, re.Pattern], TrigramIndex]:
    return {n: re.compile(p) for n, p in rules.items()}, TrigramIndex({n: required(p) for n, p in rules.items()})
