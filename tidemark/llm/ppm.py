"""Prediction by partial matching over bytes, with frozen statistics, for many classes at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` bytes that end at each place from ``k - 1`` on, as one number (k <= 8)."""
    n = len(data) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = (out << np.uint64(8)) | data[j : j + n]
    return out


class Keys:
    """Places of sorted keys by a table over their hashes; keys that share a slot are searched for."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 3))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        at = self._slot(keys)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        self.crowded = np.bincount(at, minlength=len(self.slots)) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        slot = self._slot(wanted)
        at = self.slots[slot]
        miss = np.flatnonzero(self.keys[at] != wanted)
        rare = miss[self.crowded[slot[miss]]]
        at[miss] = -1
        if len(rare):
            k = np.searchsorted(self.keys, wanted[rare])
            k[k == len(self.keys)] = 0
            at[rare] = np.where(self.keys[k] == wanted[rare], k, -1)
        return at


@dataclass
class Order:
    """Statistics of one context length: exact code lengths of seen continuations, escape costs of seen contexts."""

    grams: Keys  # context and symbol
    bits: np.ndarray  # grams x classes
    contexts: Keys
    escape: np.ndarray  # contexts x classes; 0 where a class never saw the context


class Ppm:
    """A tree of byte contexts per class, up to ``depth`` bytes, with escape method C.

    The code length of a symbol is that of the longest context in which it was seen, plus the
    cost of the escapes from the longer contexts that were seen without it. As statistics are
    frozen, these sums are worked out once per seen (context, symbol) for all classes, so that
    scoring is a lookup per byte. Exclusions are not applied.
    """

    def __init__(self, samples: list[bytes], depth: int = 4) -> None:
        self.depth, self.classes = depth, len(samples)
        data = [np.frombuffer(b" " * depth + s, np.uint8).astype(np.uint64) for s in samples]
        self.orders: list[Order] = []
        below: Order | None = None
        for d in range(depth + 1):
            counts = [np.unique(_grams(x, d + 1), return_counts=True) for x in data]
            grams = np.unique(np.concatenate([g for g, _ in counts]))
            contexts = np.unique(grams >> np.uint64(8))
            seen = np.zeros((len(grams), self.classes))
            for c, (g, n) in enumerate(counts):
                seen[np.searchsorted(grams, g), c] = n
            ctx = np.searchsorted(contexts, grams >> np.uint64(8))
            total = np.zeros((len(contexts), self.classes))
            kinds = np.zeros((len(contexts), self.classes))
            np.add.at(total, ctx, seen)
            np.add.at(kinds, ctx, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(seen / (total + kinds)[ctx])
            if below is None:
                lower = np.full((len(grams), self.classes), 8.0)
            else:
                lower = self._lookup(grams & np.uint64((1 << 8 * d) - 1), d - 1)
            bits = np.where(seen > 0, direct, escape[ctx] + lower)
            below = Order(Keys(grams), bits.astype(np.float32), Keys(contexts), escape.astype(np.float32))
            self.orders.append(below)

    def _lookup(self, grams: np.ndarray, d: int) -> np.ndarray:
        """Code lengths of the last bytes of ``grams`` in contexts of at most ``d`` bytes."""
        order = self.orders[d]
        at = order.grams.find(grams & np.uint64((1 << 8 * (d + 1)) - 1))
        out = order.bits[at]
        left = np.flatnonzero(at < 0)
        out[left] = 0
        at = order.contexts.find((grams[left] & np.uint64((1 << 8 * (d + 1)) - 1)) >> np.uint64(8))
        out[left[at >= 0]] += order.escape[at[at >= 0]]
        d -= 1
        while d >= 0 and len(left):
            order = self.orders[d]
            g = grams[left] & np.uint64((1 << 8 * (d + 1)) - 1)
            at = order.grams.find(g)
            hit = at >= 0
            out[left[hit]] += order.bits[at[hit]]
            left, g = left[~hit], g[~hit]
            at = order.contexts.find(g >> np.uint64(8))
            known = at >= 0
            out[left[known]] += order.escape[at[known]]
            d -= 1
        out[left] += 8.0
        return out

    def code_lengths(self, text: bytes, starts: np.ndarray) -> np.ndarray:
        """Bits of the stretches of ``text`` that begin at ``starts`` (ascending, each up to the next), by class."""
        data = np.frombuffer(b" " * self.depth + text, np.uint8).astype(np.uint64)
        bits = self._lookup(_grams(data, self.depth + 1), self.depth)
        return np.add.reduceat(bits, starts, axis=0) if len(starts) else np.zeros((0, self.classes), np.float32)
