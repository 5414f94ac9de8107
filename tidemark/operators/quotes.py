"""Which other texts hold a quote, by fingerprints chosen alike in quotes and texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import spread, stored

#: Classes of quotes: the least length of each, and the length of its grams. Grams span most of a quote, as sentences made of the same phrases share all shorter ones.
CLASSES = ((12, 10), (14, 12), (16, 14), (20, 17), (24, 21), (32, 28), (48, 40), (64, 56), (96, 80), (192, 160))
#: Quotes below this length have no whole window and are not sought.
SHORTEST = CLASSES[0][0]
#: Characters that are hashed at once, and those that neighbouring pieces of a long text share, so that each window lies in one.
PIECE, OVERLAP = 1 << 18, CLASSES[-1][0] - 1
#: Bits of the table of wanted fingerprints (a Bloom filter): for each fingerprint, and powers of two of them at least and at most. Beyond that the table lets more pass, which the joins drop.
BITS_EACH, BITS_LEAST, BITS_MOST = 32, 20, 27
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A + b * _B
    h ^= h >> np.uint64(31)
    h *= _B
    return h ^ (h >> np.uint64(29))


class _Grams:
    """Hashes of all grams of a text, of any length from those of powers of two."""

    def __init__(self, text: str):
        self.doubled = [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _A]

    def of(self, length: int) -> np.ndarray:
        k = length.bit_length() - 1
        while len(self.doubled) <= k:
            h, n = self.doubled[-1], 1 << len(self.doubled) - 1
            self.doubled.append(_mixed(h[:-n], h[n:]))
        h, more = self.doubled[k], length - (1 << k)
        return _mixed(h[:-more], h[more:]) if more else h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: n - width], h[width - n :]) if n < width else h


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Texts in pieces, joined up to PIECE characters: number of the text and start of each piece, and the whole."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(len(t) - OVERLAP, 1), PIECE):
            part = t[k : k + PIECE + OVERLAP]
            if len(part) >= SHORTEST:
                rows.append(i)
                parts.append(part)
                size += len(part)
            if size >= PIECE:
                yield np.array(rows), np.cumsum([0, *map(len, parts[:-1])]), "".join(parts)
                rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), np.cumsum([0, *map(len, parts[:-1])]), "".join(parts)


def fingerprints(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, hash): the least hash of each window of each class. A text that holds a quote has all of the quote's own.

    Windows over the ends of texts give some more, which belong to none.
    """
    for rows, starts, whole in _pieces(texts):
        grams = _Grams(whole)
        for shortest, gram in CLASSES:
            if len(whole) < shortest:
                break
            least = _least(grams.of(gram), shortest - gram + 1)
            first = np.ones(len(least), bool)
            first[1:] = least[1:] != least[:-1]
            first[starts[starts < len(least)]] = True
            at = np.flatnonzero(first)
            yield rows[np.searchsorted(starts, at, side="right") - 1], least[at]


def own_fingerprints(quotes: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the quote, hash) of the windows within each quote, in its class."""
    lengths = np.array([len(q) for q in quotes], np.int64)
    classes = np.searchsorted([s for s, _ in CLASSES], lengths, side="right") - 1
    for k, (shortest, gram) in enumerate(CLASSES):
        members = np.flatnonzero(classes == k)
        ends = np.cumsum(lengths[members])
        cuts = np.searchsorted(ends, np.arange(PIECE, ends[-1] + PIECE, PIECE)) + 1 if len(members) else []
        for some in np.split(members, cuts):
            if len(some):
                least = _least(_Grams("".join(quotes[i] for i in some)).of(gram), shortest - gram + 1)
                owner = np.repeat(np.arange(len(some)), lengths[some])[: len(least)]
                within = np.arange(len(least)) + shortest <= np.cumsum(lengths[some])[owner]
                yield some[owner[within]], least[within]


#: Odd factors; each gives a fingerprint a bit of the table.
_FACTORS = (_B, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))


def _slots(prints: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
    return ((prints * factor) >> np.uint64(64 - bits)).astype(np.int64)


def _wanted(prints: DataFrame) -> tuple[np.ndarray, int]:
    """A table of bits, of a bounded size, in which those of ``prints`` are set, and the power of two of its bits."""
    bits = min(BITS_MOST, max(BITS_LEAST, (BITS_EACH * prints.count()).bit_length()))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = pdf["print"].to_numpy(np.int64).view(np.uint64)
            s = np.concatenate([_slots(prints, f, bits) for f in _FACTORS])
            yield pd.DataFrame({"part": s >> BITS_LEAST, "at": s & (1 << BITS_LEAST) - 1})

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << BITS_LEAST, bool)
        on[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    table = np.zeros((1 << bits - BITS_LEAST, 1 << BITS_LEAST - 3), np.uint8)
    for r in prints.select("print").mapInPandas(slots, "part bigint, at bigint").groupBy("part").applyInPandas(packed, "part bigint, bits binary").collect():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1), bits


def _columns(key: str, ids: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    pairs = pd.DataFrame([(r, p.view(np.int64)) for r, p in found], columns=["row", "print"])
    rows, prints = (np.concatenate(pairs[c].tolist() or [np.zeros(0, np.int64)]) for c in pairs)
    return pd.DataFrame({key: ids[rows], "print": prints}).drop_duplicates()


def _prints_of_quotes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _columns("qid", pdf["qid"].to_numpy(np.int64), own_fingerprints(pdf["quote"].tolist()))


def _prints_of_texts(wanted):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bits = wanted.value

        def kept(found):
            for rows, prints in found:
                for f in _FACTORS:
                    slot = _slots(prints, f, bits)
                    on = (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                    rows, prints = rows[on], prints[on]
                yield rows, prints

        for pdf in batches:
            yield _columns("file_id", pdf["file_id"].to_numpy(np.int64), kept(fingerprints(pdf["content"].tolist())))
    return work


def held_elsewhere(quotes: DataFrame, texts: DataFrame, most: int = 3) -> DataFrame:
    """(file_id, quote, other): up to ``most`` other texts, by id, that hold a quote character for character.

    ``quotes`` has (file_id, quote), ``texts`` (file_id, content), unique by file_id. Equal quotes
    are sought once: each by that of its fingerprints which the fewest quotes have, and what
    shares that is verified; the first ``most`` + 1 texts of a quote are enough for all its files.
    Texts give only fingerprints that are wanted. Nulls and quotes of fewer than SHORTEST
    characters give no rows.
    """
    q = quotes.where(F.col("file_id").isNotNull() & (F.length("quote") >= SHORTEST)).select("file_id", "quote").distinct()
    distinct = stored(q.select("quote").distinct().withColumn("qid", F.monotonically_increasing_id()))
    own = distinct.select("qid", "quote").mapInPandas(_prints_of_quotes, "qid bigint, print bigint").withColumn("n", F.count("*").over(W.partitionBy("print")))
    rare = stored(own.groupBy("qid").agg(F.min(F.struct("n", "print")).alias("x")).select("qid", "x.print"))
    held = texts.where("file_id is not null and content is not null").select("file_id", "content")
    wanted = quotes.sparkSession.sparkContext.broadcast(_wanted(rare))  # bounded by BITS_MOST
    known = spread(held).mapInPandas(_prints_of_texts(wanted), "file_id bigint, print bigint")
    # the sizes of files say little of those of texts in memory, so no side of a join is sent to all
    pairs = known.join(rare.hint("merge"), "print").select("qid", F.col("file_id").alias("other"))
    both = pairs.join(distinct.hint("merge"), "qid").join(held.withColumnRenamed("file_id", "other").hint("merge"), "other")
    found = both.where(F.contains("content", F.col("quote"))).select("qid", "other")
    first = found.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy("other"))).where(F.col("rn") <= most + 1).groupBy("qid").agg(F.array_sort(F.collect_list("other")).alias("ids"))
    named = first.join(distinct.hint("merge"), "qid").drop("qid")
    return q.join(named.hint("merge"), "quote").select("file_id", "quote", F.explode(F.slice(F.filter("ids", lambda i: i != F.col("file_id")), 1, most)).alias("other"))
