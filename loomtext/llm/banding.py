"""Links among texts that share a MinHash band: candidates by band, exact Jaccard, nothing collected.

Texts of one band are gathered to a star on their smallest. Every text is first compared with its star's head; those
that are similar to it are one component already, so only pairs with a text that is not are compared further,
in units of bounded size. A group of near copies so costs in proportion to its size, not to its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, saved

SIMILAR = 0.8
#: Texts of one group that a part holds; a part of those to compare meets a part of all as one unit of work.
PART = 128
#: A group dealt over ``few`` parts gets more if a part would hold over so many texts or bytes of sets.
MOST, BYTES = 2048, 1 << 22
#: Links of a unit that are held before they are joined.
WAITING = 1 << 18


def gathered(pairs: DataFrame) -> DataFrame:
    """Star edges (a, b) among the distinct ``line`` that share a ``band``: each to the smallest of its band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = head = last = None
        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.concatenate([[k[0] != band], k[1:] != k[:-1]])
            where = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            heads = np.where(where >= 0, v[np.maximum(where, 0)], v[0] if head is None else head)
            fresh = np.concatenate([[new[0] or v[0] != last], (v[1:] != v[:-1]) | new[1:]]) & (heads != v)
            band, head, last = k[-1], heads[-1], v[-1]
            yield pa.RecordBatch.from_arrays([pa.array(v[fresh]), pa.array(heads[fresh])], names=["a", "b"])

    return pairs.repartition("band").sortWithinPartitions("band", "line").mapInArrow(run, "a long, b long").distinct()


def similar(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among some texts whose shingle sets have a Jaccard similarity of SIMILAR or more."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    values = np.unique(np.concatenate(sets), return_inverse=True)[1] if starts[-1] else np.zeros(0, dtype=np.int64)
    forest, marked = Forest(len(ids)), np.zeros(len(values), dtype=np.int8)
    ends = np.searchsorted(size, size / SIMILAR + 1e-9, side="right")
    found, waiting = [], 0
    for i in np.flatnonzero(ends > np.maximum(np.arange(len(ids)) + 1, np.searchsorted(size, 1))):
        # Those after it are as large or larger, so none is empty.
        n, end, own = i + 1, ends[i], values[starts[i] : starts[i + 1]]
        marked[own] = 1
        both = np.add.reduceat(marked[values[starts[n] : starts[end]]], starts[n:end] - starts[n], dtype=np.int64)
        marked[own] = 0
        js = n + np.flatnonzero(both >= SIMILAR * (size[i] + size[n:end] - both) - 1e-9)
        found.append((np.full(len(js), i), js))
        waiting += len(js)
        if waiting > WAITING:
            forest.join_all(*map(np.concatenate, zip(*found, strict=True)))
            found, waiting = [], 0
    if found:
        forest.join_all(*map(np.concatenate, zip(*found, strict=True)))
    roots = forest.roots()
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(roots) if i != r]


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)) - 1e-9:
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same >= SIMILAR * (len(both) - same) - 1e-9


def checks(pairs: DataFrame, sets: DataFrame, dtype: type) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether the sets of both have a similarity of SIMILAR or more; and ``size``, the bytes of the set of a. ``sets`` as for ``links``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_alike(np.frombuffer(x.as_buffer(), dtype=dtype), np.frombuffer(y.as_buffer(), dtype=dtype)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            size = [len(x.as_buffer()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_()), pa.array(size, pa.int64())], names=["a", "b", "ok", "size"])

    own = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = own.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long, ok boolean, size long")


def links(star: DataFrame, sets: DataFrame, dtype: type, part: int = PART, few: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs under one head whose similarity is SIMILAR or more.

    ``star`` has edges (a, b), from each text to the head of a band they share; ``sets`` has one row (node, set) for
    every text there: its distinct hashes, sorted, as the bytes of a ``dtype`` array. Both should be written already.
    The joins are left to be split by the engine where a head is hot, so each side is an exchange of its own.
    A group is dealt over parts of ``part`` texts, with ``few`` over that many at most unless they would be too large (MOST, BYTES).
    """

    def parts(count: str, load: str) -> Column:
        by = F.ceil(F.col(count) / part)
        return (F.greatest(F.least(by, F.lit(few)), F.ceil(load)) if few else by).cast("long")

    checked = saved(checks(star, sets, dtype))
    near = checked.where("ok").select("a", "b")
    load, unlike = F.greatest(F.lit(1 / MOST), F.col("size") / BYTES), F.when(~F.col("ok"), 1)
    sums = [(F.count(F.lit(1)) + 1).alias("n"), F.count(unlike).alias("r"), F.sum(load).alias("nl"), F.sum(load * unlike).alias("rl")]
    counts = saved(checked.groupBy(F.col("b").alias("head")).agg(*sums).where("r > 0"))
    members = checked.select(F.col("b").alias("head"), F.col("a").alias("node"), "ok").union(counts.select("head", "head", F.lit(True)))
    parts = members.join(counts, "head").withColumn("p", parts("n", "nl")).withColumn("q", parts("r", "rl")).withColumn("h", F.xxhash64("node"))
    # Parts of those not like the head (y) meet parts of all (x): every text is in a row of units, one not like the head in a column too.
    row = F.expr("transform(sequence(0L, q - 1), y -> named_struct('x', pmod(h, p), 'y', y))")
    column = F.expr("IF(ok, slice(transform(sequence(0L, p - 1), x -> named_struct('x', x, 'y', pmod(h, q))), 1, 0), transform(sequence(0L, p - 1), x -> named_struct('x', x, 'y', pmod(h, q))))")
    units = parts.withColumn("u", F.explode(F.array_union(row, column))).select("head", "u.x", "u.y", "node").join(sets, "node").select("head", "x", "y", "node", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        key = None

        def done() -> list[tuple[int, int]]:
            found = similar(np.array(list(kept)), list(kept.values())) if len(kept) > 1 else []
            kept.clear()
            return found

        for batch in batches:
            found: list[tuple[int, int]] = []
            for i, at in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
                if at != key:
                    found += done()
                    key = at
                kept[batch.column(3)[i].as_py()] = np.frombuffer(batch.column(4)[i].as_py(), dtype=dtype)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
        found = done()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return near.union(units.repartition("head", "x", "y").sortWithinPartitions("head", "x", "y").mapInArrow(compare, "a long, b long"))
