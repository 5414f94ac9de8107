"""Evaluation passages inside a corpus: pigeonhole pieces, exact hits, Myers verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

#: A word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Up to this size of all test items together their index is built once and broadcast (some 30
#: bytes for each byte of text); beyond it, pieces of items and documents are joined.
MAX_ITEM_BYTES = 4 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


def _mixed(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    h = (h ^ ids) * _MUL
    return h ^ h >> np.uint64(29)


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = _mixed(h, ids[j : j + n])
    return h


def myers_distance(pattern: list[int], text: list[int]) -> list[int]:
    """Myers' bit-parallel algorithm over words: for each end position in ``text`` the least
    edit distance of ``pattern`` to a stretch of text that ends there. Python's integers carry
    patterns of any length."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        out.append(score)
    return out


def piece_cuts(size: int, budget: int) -> list[tuple[int, int]]:
    """Where a window of ``size`` words is split into ``budget + 1`` pieces."""
    cuts = [size * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:]))


class PieceIndex:
    """All windows of ``size`` words of the items, each split into ``budget + 1`` pieces.

    With at most ``budget`` edits one piece of a window stays untouched (pigeonhole), so exact
    hits of pieces find every window within the budget. Everything but the vocabulary is held in
    arrays, so that an index is cheap to send and to load.
    """

    def __init__(self, items: list[tuple[int, str]], size: int, budget: int) -> None:
        self.size, self.budget = size, budget
        self.vocab: dict[str, int] = {}
        rows, owners = [np.zeros((0, size), np.int64)], [np.zeros(0, np.int64)]
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int64)
            if len(ids) >= size:
                w = np.lib.stride_tricks.sliding_window_view(ids, size)
                rows.append(w)
                owners.append(np.full(len(w), item, np.int64))
        #: the windows, once each; for each, a slice of the items that hold it
        self.windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
        self.item_ids = pairs[:, 1].copy()
        self.item_starts = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        #: piece length -> hashes in ascending order, and the window and place of each
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for a, b in piece_cuts(size, budget):
            flat = self.windows[:, a:b].astype(np.uint64)
            h = np.zeros(len(flat), np.uint64)
            for j in range(b - a):
                h = _mixed(h, flat[:, j])
            found.setdefault(b - a, []).append((h, a))
        for k, parts in found.items():
            h = np.concatenate([x for x, _ in parts])
            order = np.argsort(h, kind="stable")
            self.pieces[k] = (h[order], np.tile(np.arange(len(self.windows)), len(parts))[order], np.repeat([a for _, a in parts], len(self.windows))[order])

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text number, item, least distance, first word of the best stretch)."""
        ids: list[int] = []
        starts = [0]
        get = self.vocab.get
        for t in texts:
            ids.extend([get(w, 0) for w in words_of(t)])
            ids.append(0)
            starts.append(len(ids))
        arr = np.array(ids, np.uint64)
        bounds = np.array(starts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for k, (hashes, owner, place) in self.pieces.items():
            h = _rolling(arr, k)
            if not len(h) or not len(hashes):
                continue
            low_at = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(low_at, len(hashes) - 1)] == h)
            for p, first, last in zip(hit.tolist(), low_at[hit].tolist(), np.searchsorted(hashes, h[hit], "right").tolist()):
                doc = int(np.searchsorted(bounds, p, "right")) - 1
                low, high = starts[doc], starts[doc + 1] - 1
                for n, a in zip(owner[first:last].tolist(), place[first:last].tolist()):
                    lo, hi = max(low, p - a - self.budget), min(high, p - a + self.size + self.budget)
                    if (doc, n, lo) in done:
                        continue
                    done.add((doc, n, lo))
                    if hi - lo < self.size - self.budget:
                        continue
                    scores = myers_distance(self.windows[n].tolist(), ids[lo:hi])
                    d = min(scores)
                    if d <= self.budget:
                        value = (d, lo + scores.index(d) - self.size + 1 - low)
                        for item in self.item_ids[self.item_starts[n] : self.item_starts[n + 1]].tolist():
                            if (doc, item) not in best or value < best[doc, item]:
                                best[doc, item] = value
        return [(doc, item, d, max(0, at)) for (doc, item), (d, at) in best.items()]


FOUND = "doc_id bigint, item_id bigint, distance int, first_word bigint"


def _piece_hashes(size: int, budget: int, key: str, text: str):
    """(key, k, h): the distinct hashes of the runs of a text that are as long as a piece."""
    lengths = sorted({b - a for a, b in piece_cuts(size, budget)})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, t in zip(pdf[key].tolist(), pdf[text]):
                ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(t)], np.uint64)
                for k in lengths:
                    h = np.unique(_rolling(ids, k)).view(np.int64)
                    yield pd.DataFrame({key: np.full(len(h), ident, np.int64), "k": np.full(len(h), k, np.int32), "h": h})
    return work


def _joined(documents: DataFrame, items: DataFrame, size: int, budget: int) -> DataFrame:
    """The result of ``find_leaks`` where the items are too large for a broadcast: pieces are
    joined by hash, and each pair of a document and an item that share one is verified."""
    pieces = lambda df, key, text: df.mapInPandas(_piece_hashes(size, budget, key, text), f"{key} bigint, k int, h bigint")
    pairs = pieces(documents, "doc_id", "text").join(pieces(items, "item_id", "item_text").distinct(), ["k", "h"]).select("doc_id", "item_id").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, item, text, item_text in zip(pdf["doc_id"].tolist(), pdf["item_id"].tolist(), pdf["text"], pdf["item_text"]):
                out.extend((doc, item, d, at) for _, _, d, at in PieceIndex([(item, item_text)], size, budget).matches([text]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "first_word"])

    held = pairs.join(items, "item_id").join(documents, "doc_id").select("doc_id", "item_id", "text", "item_text")
    best = held.mapInPandas(verify, FOUND).groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "first_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.distance", "b.first_word")


def find_leaks(documents: DataFrame, items: DataFrame, size: int = 13, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, first_word): documents with a stretch of words that is at
    most ``budget`` word edits from ``size`` consecutive words of an item.

    Items of up to MAX_ITEM_BYTES together are indexed once and broadcast, and the corpus is
    read once, without a shuffle; larger ones are joined with it by the hashes of their pieces.
    Null and empty texts match nothing, nor do items of fewer than ``size`` words; repeated
    items give one row per id, repeated documents one per row or per id.
    """
    held = items.select("item_id", "item_text").where("item_id is not null and item_text is not null")
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    if held.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0] > MAX_ITEM_BYTES:
        return _joined(spread(docs), held, size, budget)
    shared = documents.sparkSession.sparkContext.broadcast(PieceIndex([(r[0], r[1]) for r in held.collect()], size, budget))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc_ids = pdf["doc_id"].tolist()
            found = [(doc_ids[d], i, s, at) for d, i, s, at in shared.value.matches(pdf["text"].tolist())]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "first_word"])

    return spread(docs).mapInPandas(run, FOUND)
