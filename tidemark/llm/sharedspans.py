"""Long exact spans shared between records, by content-defined units with digests grouped globally.

Lines or paragraphs are no sufficient unit: a run of equal characters may begin and end within
lines. The units here are cut where the content says so, in such a way that every run of the
asked length lies in exactly one unit at the same place of it, wherever it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread, stored

#: Length of a unit's anchor, in characters.
ANCHOR = 32
#: Units per anchor up to which they are compared in one task; beyond, window digests are grouped by the cluster.
LOCAL_KINDS = 512
#: Characters that are hashed at a time; longer texts are taken alone, but whole.
BLOCK = 1 << 18

_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_PLACE = np.uint64((1 << 28) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of stretches of one array of code points, by prefix sums."""

    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray, salt: int = 0) -> None:
        n = len(codes) + 1
        if len(Hasher.powers) < n:
            size = max(n, 2 * BLOCK)
            p, q = np.full(size, _B, np.uint64), np.full(size, _INV, np.uint64)
            p[0] = q[0] = 1
            Hasher.powers, Hasher.inverse = np.multiply.accumulate(p), np.multiply.accumulate(q)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 + salt)) * Hasher.powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * Hasher.inverse[start] + (end - start).astype(np.uint64))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, in linear time."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def units(texts: list[str], run: int) -> tuple[np.ndarray, ...]:
    """(text number, start, end, place of the anchor in the unit, anchor, digest) of the units of some texts of at least ``run`` characters.

    The anchor of a run is its ANCHOR-gram with the least hash, the leftmost of equals, so equal
    runs have equal anchors at equal places. Neighbouring runs with one anchor form a unit.
    """
    codes = codes_of("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    hasher = Hasher(codes)
    at = np.arange(len(codes) - ANCHOR + 1)
    h = hasher.of(at, at + ANCHOR)
    best = (_sliding_min((h & ~_PLACE) | at.astype(np.uint64), run - ANCHOR + 1) & _PLACE).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(best)), "right")
    runs = np.flatnonzero(np.arange(len(best)) + run <= ends[doc])
    b = best[runs]
    first = np.r_[True, (b[1:] != b[:-1]) | (runs[1:] != runs[:-1] + 1)]
    s = runs[first]
    e = runs[np.r_[first[1:], True]] + run
    d = doc[s]
    base = np.r_[0, ends[:-1]][d]
    return d, s - base, e - base, b[first] - s, h[b[first]], Hasher(codes, 1).of(s, e)


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    rows, texts, size = [], [], 0
    for i, t in enumerate(pdf["text"]):
        rows.append(i)
        texts.append(t)
        size += len(t)
        if size >= BLOCK:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _unit_rows(run: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            src, rid = pdf["src"].to_numpy(), pdf["id"].to_numpy()
            for rows, texts in _blocks(pdf):
                d, s, e, place, anchor, digest = units(texts, run)
                at = np.array(rows)[d]
                yield pd.DataFrame({"src": src[at], "id": rid[at], "s": s.astype(np.int32), "n": (e - s).astype(np.int32), "p": place.astype(np.int32), "anchor": anchor.view(np.int64), "digest": digest.view(np.int64)})
    return work


def _stretches(flags: list[bool], run: int) -> list[tuple[int, int]]:
    """The stretches of a unit covered by those of its windows that are flagged."""
    out: list[tuple[int, int]] = []
    for i, f in enumerate(flags):
        if f:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + run)
            else:
                out.append((i, i + run))
    return out


_MANY = object()


def compare_units(kinds: list[tuple[object, bool, str]], run: int) -> list[tuple[int, int, int]]:
    """Of (record, in several records, text) of different units with a common middle: the number of
    each unit of one record with the stretches of it that another record holds."""
    seen: dict[str, object] = {}
    for rec, multi, text in kinds:
        for i in range(len(text) - run + 1):
            w = text[i : i + run]
            if multi:
                seen[w] = _MANY
            else:
                before = seen.setdefault(w, rec)
                if before is not _MANY and before != rec:
                    seen[w] = _MANY
    return [
        (k, a, b)
        for k, (_, multi, text) in enumerate(kinds) if not multi
        for a, b in _stretches([seen[text[i : i + run]] is _MANY for i in range(len(text) - run + 1)], run)
    ]


def _local_rows(run: int):
    """Groups come sorted by key, each of at most LOCAL_KINDS rows; a group may go on in the next batch."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush(groups: list[list[tuple]]) -> pd.DataFrame:
            out = []
            for g in groups:
                for k, a, b in compare_units([((r[2], r[3]), r[4], r[5]) for r in g], run):
                    out.append((g[k][6], g[k][1], g[k][7] + a, g[k][7] + b))
            return pd.DataFrame(out, columns=["anchor", "digest", "a", "b"])

        for pdf in batches:
            groups: list[list[tuple]] = []
            for row in pdf[["g", "digest", "src", "id", "multi", "part", "anchor", "base"]].itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    groups.append(held)
                    held = []
                held.append(row)
            yield flush(groups)
        if held:
            yield flush([held])
    return work


def _window_rows(run: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                codes = codes_of(row.part)
                at = np.arange(len(codes) - run + 1)
                yield pd.DataFrame({"anchor": row.anchor, "digest": row.digest, "src": row.src, "id": row.id, "multi": row.multi, "a": (row.base + at).astype(np.int32), "w1": Hasher(codes).of(at, at + run).view(np.int64), "w2": Hasher(codes, 1).of(at, at + run).view(np.int64)})
    return work


def shared_runs(records: DataFrame, run: int = 120) -> DataFrame:
    """(src, id, s, e): stretches of (src, id, text) records that consist of runs of ``run``
    equal consecutive characters found in another record. Stretches may overlap.

    1. Texts are cut into units; units whose anchor occurs once in all texts share nothing.
    2. The digests of the others are grouped. A unit in two records is shared as a whole.
    3. The rest lies on the edge of shared stretches. A common run of two different units holds
       the anchor and, on one of its sides, at least half of the run's other characters: only
       units that agree on the anchor with one of these halves are compared, window by window.
       That happens in one task if they are few, else by grouping 128-bit digests of their
       windows. Of a unit that occurs often one copy takes part.

    Groups are counted by least and greatest record, which combine before the shuffle. Exact
    but for collisions of 128-bit digests. Null and short texts share nothing; rows under one
    (src, id) are one record; empty inputs give no rows.
    """
    if run < 2 * ANCHOR:
        raise ValueError(f"runs must have at least {2 * ANCHOR} characters")
    rec = records.where("src is not null and id is not null").where(F.length("text") >= run).select("src", "id", "text")
    u = stored(spread(rec).mapInPandas(_unit_rows(run), "src int, id bigint, s int, n int, p int, anchor bigint, digest bigint"))
    again = u.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    cand = stored(u.join(again, "anchor"))
    several = (F.min("src") != F.max("src")) | (F.min("id") != F.max("id"))
    kinds = stored(cand.groupBy("anchor", "digest").agg(several.alias("multi"), F.min(F.struct("src", "id", "s", "n", "p")).alias("one")))
    whole = kinds.where("multi").select("anchor", "digest", F.lit(0).alias("a"), F.col("one.n").alias("b"))

    def open_groups(df: DataFrame, key: str) -> DataFrame:
        """Keys of several units, one of which at least is not yet settled."""
        return df.groupBy(key).agg(F.count("*").alias("kinds"), F.bool_and("multi").alias("settled")).where("kinds > 1 and not settled").select(key, "kinds")

    asked = kinds.join(open_groups(kinds, "anchor"), "anchor").select("one.*", "anchor", "digest", "multi")
    texts = rec.join(asked, ["src", "id"]).select("anchor", "digest", "src", "id", "multi", "p", F.expr("substr(text, s + 1, n)").alias("text"), "n")
    texts = texts.where(F.length("text") == F.col("n")).dropDuplicates(["anchor", "digest"])  # other rows may be under the same id
    half = (run - ANCHOR) // 2
    sides = texts.selectExpr("*", f"greatest(p - {half}, 0) as cut").selectExpr(
        "anchor", "digest", "src", "id", "multi",
        f"""explode(array(
            if(n - cut >= {run}, named_struct('g', xxhash64(1, substr(text, p + 1, {ANCHOR + half})), 'base', cut, 'part', substr(text, cut + 1)), null),
            if(p > {half}, named_struct('g', xxhash64(0, substr(text, p - {half} + 1, {ANCHOR + half})), 'base', 0, 'part', substr(text, 1, p - {half} - 1 + {run})), null))) as x""",
    ).where("x is not null").select("anchor", "digest", "src", "id", "multi", "x.*")
    sides = stored(sides)
    pool = stored(sides.join(open_groups(sides, "g"), "g"))
    few = pool.where(F.col("kinds") <= LOCAL_KINDS).drop("kinds").repartition("g").sortWithinPartitions("g")
    local = few.mapInPandas(_local_rows(run), "anchor bigint, digest bigint, a int, b int")
    win = pool.where(F.col("kinds") > LOCAL_KINDS).mapInPandas(_window_rows(run), "anchor bigint, digest bigint, src int, id bigint, multi boolean, a int, w1 bigint, w2 bigint")
    hot = win.groupBy("w1", "w2").agg((several | F.bool_or("multi")).alias("hit"), F.bool_and("multi").alias("settled")).where("hit and not settled").select("w1", "w2")
    wide = win.where("not multi").join(hot, ["w1", "w2"]).select("anchor", "digest", "a", (F.col("a") + run).alias("b"))
    places = whole.unionByName(local).unionByName(wide)
    return cand.join(places, ["anchor", "digest"]).select("src", "id", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("b")).alias("e"))


def shared_chars(records: DataFrame, run: int = 120) -> DataFrame:
    """(src, id, shared_chars): characters of each record in at least one shared run."""
    runs = shared_runs(records, run)
    lists = runs.groupBy("src", "id").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))  # bounded by one text
    # Length of a union of intervals sorted by start: fold with the furthest end so far.
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct(
        (acc["total"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("total"), F.greatest(acc["end"], x["e"]).alias("end"))
    return lists.select("src", "id", F.aggregate("spans", zero, step)["total"].alias("shared_chars"))
