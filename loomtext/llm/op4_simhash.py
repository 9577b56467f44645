"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most two of 64 bits agree in at least two of four 16-bit blocks. Every
distinct fingerprint is therefore filed under its six pairs of blocks, and only fingerprints filed
together are compared: exactly, in numpy tiles of exclusive-or and bit counts, sorted by population
count so that tile pairs whose counts differ beyond the radius are skipped. A task returns a spanning
forest of its links (at most one row per fingerprint), never pairs; components come from star rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, map_arrow, saved, table

BITS, RADIUS, WORDS = 64, 2, 3
TILE = 512
#: Rows of one filing that one task compares; a larger filing is dealt over pairs of parts.
PART = 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a whole text: majority over the XXH64 (seed 42) of its word shingles, repeats included."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)), dtype=np.uint64, count=len(w) - words + 1)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``__fp``): the fingerprint of every row as a signed long. Null and wordless texts have 0."""

    def run(keys, texts):
        yield {"__key": keys, "__fp": np.array([fingerprint(t) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64)}

    kind = df.select(key).schema[0].dataType.simpleString()
    return map_arrow(df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")), ["__key", "__text"], f"__key {kind}, __fp long", run).withColumnRenamed("__key", key)


def tile_pairs(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE, first: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of ``fps`` (uint64; one word or a row of words each) that differ in ``radius`` or fewer bits, tile by tile: places, places, bits.

    With ``first`` = (words, radius), the tiles are of that many words, and only pairs within that radius there are compared whole.
    """
    words = fps.reshape(len(fps), -1)
    many, reach = first or (words.shape[1], radius)
    pop = np.bitwise_count(words[:, :many]).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    words, pop = words[order], pop[order]
    f = np.ascontiguousarray(words[:, :many].T)
    kind = np.uint8 if many < 4 else np.uint16
    for i in range(0, len(pop), tile):
        for j in range(i, len(pop), tile):
            if pop[j] - pop[min(i + tile, len(pop)) - 1] > reach:
                break
            apart = np.bitwise_count(f[0, i : i + tile, None] ^ f[0, None, j : j + tile]).astype(kind, copy=False)
            for w in f[1:]:
                apart += np.bitwise_count(w[i : i + tile, None] ^ w[None, j : j + tile])
            near = apart <= reach
            at = np.flatnonzero(np.triu(near, 1) if i == j else near)
            x, y, bits = i + at // near.shape[1], j + at % near.shape[1], apart.ravel()[at].astype(np.int64)
            if many < words.shape[1]:
                bits += np.bitwise_count(words[x, many:] ^ words[y, many:]).sum(axis=1, dtype=np.int64)
                x, y, bits = x[bits <= radius], y[bits <= radius], bits[bits <= radius]
            yield order[x], order[y], bits


def tile_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """Root index of each of ``fps`` under links at ``radius`` or fewer differing bits."""
    forest = Forest(len(fps))
    for x, y, _ in tile_pairs(fps, radius, tile):
        forest.join_all(x, y)
    return forest.roots()


def compared(filed: DataFrame, columns: list[str], found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], part: int = PART) -> DataFrame:
    """Edges (a, b): what ``found`` makes of the rows that are filed together, so that every two of them meet.

    ``filed`` has the long columns ``c`` and ``v`` (a filing) and ``columns``, the first of which names the row; ``found`` gets them as a
    matrix. A filing of more than ``part`` rows is cut in p parts by hash, and each pair of parts is one unit of work.
    """
    counts = filed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = filed.join(counts, ["c", "v"])
    parts = shared.withColumn("p", F.ceil(F.col("n") / part).cast("long")).withColumn("own", F.when(F.col("p") > 1, F.pmod(F.xxhash64(columns[0]), F.col("p"))).otherwise(F.lit(0)))
    units = parts.withColumn("o", F.explode(F.expr("sequence(0L, p - 1)"))).select(*columns, "c", "v", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = None, []

        for batch in batches:
            *own, c, v, x, y = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns) + 4)]
            if not len(c):
                continue
            rows = np.stack(own, axis=1)
            cuts = np.nonzero(np.any([k[1:] != k[:-1] for k in (c, v, x, y)], axis=0))[0] + 1
            a, b = [], []
            for s, e in zip([0, *cuts], [*cuts, len(c)], strict=True):
                key = tuple(int(k[s]) for k in (c, v, x, y))
                if key != kept_key and kept:
                    ends = found(np.concatenate(kept))
                    a.append(ends[0]), b.append(ends[1])
                    kept = []
                kept_key = key
                kept.append(rows[s:e])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        if kept:
            ends = found(np.concatenate(kept))
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return units.repartition("c", "v", "x", "y").sortWithinPartitions("c", "v", "x", "y").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Star edges (a, b) whose components are those of all links among the distinct fingerprints ``__fp``."""
    if radius != RADIUS:
        raise ValueError("the filing by two of four blocks is exact for a radius of 2")
    block = [F.shiftrightunsigned("__fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    filed = fps.select("__fp", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), (block[i] * 65536 + block[j]).alias("v")) for c, (i, j) in enumerate(combinations(range(4), 2))])).alias("f")).select("__fp", "f.c", "f.v")

    def star(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = rows[:, 0]
        r = tile_links(f.view(np.uint64), radius)
        off = np.nonzero(r != np.arange(len(r)))[0]
        return f[off], f[r[off]]

    return compared(filed, ["__fp"], star, part)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``__fp``, ``component_id``): per row the smallest key reachable over links of 2 or fewer bits.

    Equal fingerprints are linked; wordless texts share the fingerprint 0 and link like any other. Rows
    with a null key take part and get the smallest non-null key of their component (null if there is none).
    Repeated rows stay. An empty table gives an empty result.
    """
    fps = saved(fingerprints(df, key, text))
    distinct = saved(fps.groupBy("__fp").agg(F.min(key).alias("__low")))
    roots = components(links(distinct.select("__fp")))
    named = distinct.join(roots, F.col("__fp") == F.col("node"), "left").select("__fp", "__low", F.coalesce("root", "__fp").alias("__root"))
    lowest = named.groupBy("__root").agg(F.min("__low").alias("component_id"))
    cls = saved(named.join(lowest, "__root").select("__fp", "component_id"))
    return fps.join(cls, "__fp").select(key, "__fp", "component_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its component, in their own columns.

    Rows that repeat key and text are kept once; rows with a null key stay only if their component has no
    other key.
    """
    found = near_duplicates(df, key, text)
    keep = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__k")).distinct()
    return df.join(keep, F.col(key).eqNullSafe(F.col("__k")), "left_semi").dropDuplicates([key, text])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE: dict[str, str] = {}
