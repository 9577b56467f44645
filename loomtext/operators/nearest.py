"""The best rows of a table for a block of query vectors, in numpy: matrix products choose, sums in order decide.

A matrix product adds in an order of its own, so its scores only tell which pairs may be among the best, by a margin over
its error and over the rounding; those pairs are scored again by products summed in order, as ``functions.vectors`` does.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Most items that meet all queries of a block at a time, pairs that are scored exactly at a time, and scores of a product.
ITEMS, PAIRS, CELLS = 2048, 1 << 17, 1 << 23


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two arrays, each summed from the first component on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as Spark's ``round`` does it: half up on the shortest decimal form."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled + 0.5)
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    for i in np.flatnonzero(near & (scaled < 2.0**40) | (scaled >= 2.0**40) & (scaled < 2.0**60)):
        whole[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(scaled < 2.0**60, np.sign(x) * whole / 10.0**digits, x)


class Best:
    """The ``n`` best items so far of every query: by rounded score, ties to the smaller key, the query's own key left out."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, n: int, cosine: bool, digits: int) -> None:
        self.ids, self.q, self.n, self.cosine, self.digits = ids, queries, n, cosine, digits
        self.lengths = np.sqrt(in_order(queries, queries))
        self.query, self.key, self.rounded, self.score = np.zeros(0, np.int64), ids[:0], np.zeros(0), np.zeros(0)
        self.floor, self.last, self.seen = np.full(len(ids), -np.inf), np.full(len(ids), ids[0], dtype=ids.dtype), 0

    def add(self, keys: np.ndarray, items: np.ndarray) -> None:
        """Items to be looked at, in the order of their keys, first in small lots, for the floors rise with the first of them."""
        order = np.argsort(keys, kind="stable")
        at = 0
        while at < len(order):
            lot = order[at : at + max(4 * self.n, min(ITEMS, self.seen, CELLS // max(1, len(self.ids))), 16)]
            self._lot(keys[lot], items[lot])
            at, self.seen = at + len(lot), self.seen + len(lot)

    def _lot(self, keys: np.ndarray, items: np.ndarray) -> None:
        lengths = np.sqrt(in_order(items, items))
        near = self.q @ items.T
        error = (8 * items.shape[1] + 64) * np.finfo(float).eps
        if self.cosine:
            both = self.lengths[:, None] * lengths
            np.divide(near, both, out=near, where=both != 0)
            near[both == 0] = 0
            margin = np.full(len(self.ids), error)
        else:
            margin = error * self.lengths * lengths.max()
        unit = 10.0**-self.digits
        better = near >= (self.floor + 0.49 * unit - margin)[:, None]
        tied = near >= (self.floor - 0.51 * unit - margin)[:, None]
        earlier = keys[None, :] < self.last[:, None]
        i, j = np.nonzero(better | tied & earlier)
        apart = self.ids[i] != keys[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        score = np.zeros(len(i))
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            dot = in_order(self.q[a], items[b])
            if self.cosine:
                both = self.lengths[a] * lengths[b]
                dot = np.divide(dot, both, out=np.zeros(len(a)), where=both != 0)
            score[at : at + PAIRS] = dot
        self._keep(np.concatenate([self.query, i]), np.concatenate([self.key, keys[j]]), np.concatenate([self.rounded, half_up(score, self.digits)]), np.concatenate([self.score, score]))

    def _keep(self, query: np.ndarray, key: np.ndarray, rounded: np.ndarray, score: np.ndarray) -> None:
        by_key = np.argsort(key, kind="stable")
        order = by_key[np.lexsort((-rounded[by_key], query[by_key]))]
        query = query[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        kept = order[place < self.n]
        full = order[place == self.n - 1]
        self.query, self.key, self.rounded, self.score = query[place < self.n], key[kept], rounded[kept], score[kept]
        which = query[place == self.n - 1]
        self.floor[which], self.last[which] = rounded[full], key[full]
