"""Near copies of whole documents: SimHash of five-word shingles, tiled comparison, exact Jaccard.

A text is the set of its five-word shingles (A-Z lower-cased; a shorter text is one shingle). Each shingle votes -3, -1,
1 or 3 on every bit of a SimHash. Texts of Jaccard similarity 0.8 or more have a cosine of 0.889 or more, so they differ in a
bit with probability APART at most (the greatest is that of four shingles and the same four with a fifth). The first
PRINT words are the fingerprint; texts are candidates if theirs differ in RADIUS bits or fewer (and in FIRST of the first
words), by the tiles of op4. Up to FILED texts are compared all with all. More are filed under keys of k other bits, and
only texts filed together are compared; as many keys are taken as leave a pair just at 0.8 apart in all of them with
probability MISSED at most. With the radii that makes 0.0001 in all, and less for more similar texts.

Tiles are gone over twice: by the first words only, then by the whole fingerprints of those that had a candidate. A task
returns a spanning forest of its candidate pairs (at most one row per text filed), never the pairs. The trees that these make
together are the clusters; texts of a cluster are compared by exact Jaccard of their shingle sets, first with the
cluster's smallest and then, those unlike it, with all others, in units of bounded size that return spanning
forests too (``banding``). So no rows grow with the square of a group, whether its texts prove alike or not, but those of the units: each
text goes to FEW of them for each side, and to more only in clusters beyond what so many units can hold.
Components come from star rounds. Texts of the same words are one node throughout, so exact copies are never compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import links
from .common import Forest, components, numbered, renamed_back, saved
from .op4_simhash import compared, tile_pairs
from .op7_substrings import _BASE, CHUNK, SHINGLE, Words, mix

APART, MISSED = 0.1641, 0.00004
#: Words of 64 bits of a fingerprint, and the radii; a pair just at 0.8 is beyond RADIUS, or FIRST, with probability 0.00003 at most each.
PRINT, RADIUS, FIRST = 16, 218, (3, 54)
#: Texts of a filing to aim at, the most bits of a key (beyond, filings grow), and the rows of a filing that one task compares.
FILED, WIDEST, PART = 2048, 13, 8192
#: Parts that a cluster is dealt over, if they can hold it.
FEW = 16

#: One hash of a shingle gives 32 votes of two bits.
VOTES = 32
_A = np.random.default_rng(23).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIELDS = np.uint64(0x0303030303030303)
#: Votes of at most 3 that a byte can add up.
_ADDED = 85


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text that has a word: its number, the hash of its words, and the shingle hashes one text after another with where each text's begin (and the end)."""
    if not len(w.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    at = np.concatenate([[0], np.nonzero(w.text[1:] != w.text[:-1])[0] + 1])
    n = np.diff(np.append(at, len(w.hash)))
    place = (np.arange(len(w.hash)) - np.repeat(at, n)).astype(np.uint64)
    whole = mix(np.add.reduceat(mix(w.hash + place * _BASE), at) + n.astype(np.uint64))
    size = np.maximum(n - SHINGLE + 1, 1)
    edges = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(at - edges[:-1], size) + np.arange(edges[-1])
    values = np.zeros(len(index), dtype=np.uint64)
    for k in range(SHINGLE):
        values += w.hash[np.minimum(index + k, len(w.hash) - 1)] * np.uint64(pow(int(_BASE), k + 1, 1 << 64))
    values = mix(values)
    values[edges[:-1][n < SHINGLE]] = whole[n < SHINGLE]
    return w.text[at], whole, values, edges


def hashed(values: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th hash of hashes."""
    h = values * _A[j]
    return h ^ (h >> np.uint64(32))


def simhashes(values: np.ndarray, edges: np.ndarray, hashes: int) -> np.ndarray:
    """(texts, 4 * hashes) bytes: the SimHash of every text's distinct shingles; a bit is 1 if the votes' sum is over zero."""
    owner = np.repeat(np.arange(len(edges) - 1, dtype=np.uint64), np.diff(edges))
    own = np.sort(owner << np.uint64(44) | values >> np.uint64(20))
    own = own[np.append(True, own[1:] != own[:-1])]
    starts = np.searchsorted(own >> np.uint64(44), np.arange(len(edges), dtype=np.uint64))
    n = np.diff(starts)
    pieces = -(-n // _ADDED)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    at = np.repeat(starts[:-1] - _ADDED * first, pieces) + _ADDED * np.arange(pieces.sum())
    own = mix(own & np.uint64((1 << 44) - 1))
    bits = np.empty((len(n), hashes, 4, 8), dtype=bool)
    for j in range(hashes):
        h = hashed(own, j)
        for s in range(4):
            sums = np.add.reduceat(h >> np.uint64(2 * s) & _FIELDS, at).view(np.uint8).reshape(-1, 8)
            bits[:, j, s] = 2 * np.add.reduceat(sums, first, axis=0, dtype=np.int64) > 3 * n[:, None]
    return np.packbits(bits.reshape(len(n), -1), axis=1)


def key_plan(n: int, filed: int = FILED) -> tuple[int, int]:
    """Bits of a key and number of keys for ``n`` rows."""
    width = min(WIDEST, max(0, ceil(log2(max(n, 1) / filed))))
    return (width, ceil(log(MISSED) / log(1 - (1 - APART) ** width))) if width else (0, 1)


def filings(nodes: DataFrame, width: int, keys: int, words: int) -> DataFrame:
    """(node, p0, p1, ..., c, v): ``nodes`` (node, print: a SimHash in bytes, or null) once for each of its keys."""
    columns = ["node", *[f"p{i}" for i in range(words)], "c", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            own = [batch.column(0), *map(pa.array, np.ascontiguousarray(prints[:, : 8 * words]).view(np.int64).T)]
            bits = np.unpackbits(prints[:, 8 * PRINT :], axis=1)
            for c in range(keys):
                v = bits[:, c * width : (c + 1) * width] @ powers if width else np.zeros(batch.num_rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(batch.num_rows, c)), pa.array(v)], names=columns)

    return nodes.where("print is not null").select("node", "print").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def linked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidate pairs: every row that is not the first of its tree, and that first."""
    fps = np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
    forest = Forest(len(rows))
    for x, y, _ in tile_pairs(fps, RADIUS, first=FIRST) if fps.shape[1] > FIRST[0] else tile_pairs(fps, FIRST[1]):
        forest.join_all(x, y)
    root = forest.roots()
    off = np.flatnonzero(root != np.arange(len(root)))
    return rows[off, 0], rows[root[off], 0]


def candidates(nodes: DataFrame, width: int, keys: int, words: int) -> DataFrame:
    """Distinct edges (a, b) whose components are those of the candidate pairs among ``nodes`` filed together, by the first ``words`` of their fingerprints."""
    return compared(filings(nodes, width, keys, words), ["node", *[f"p{i}" for i in range(words)]], linked, PART).distinct()


def _chunks(df: DataFrame, schema: str, one: Callable[[pa.RecordBatch, Words], pa.RecordBatch]) -> DataFrame:
    """``one`` over slices of ``df``, whose last column is ``__text``, of about CHUNK bytes; it gets the slice and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            chunk: list[bytes] = []
            begin = size = 0
            for i in range(batch.num_rows):
                chunk.append((texts[i].as_py() or "").encode())
                size += len(chunk[-1])
                if size > CHUNK or i == batch.num_rows - 1:
                    yield one(batch.slice(begin, i + 1 - begin), Words(chunk))
                    chunk, begin, size = [], i + 1, 0

    return df.mapInArrow(run, schema)


def _signed(rows: DataFrame, kind: str, hashes: int) -> DataFrame:
    """(__row, __key, node, print) of every row; wordless texts have node 0 and no print."""

    def one(batch: pa.RecordBatch, w: Words) -> pa.RecordBatch:
        own, whole, values, edges = shingle_sets(w)
        node, prints = np.zeros(batch.num_rows, dtype=np.uint64), [None] * batch.num_rows
        node[own] = whole
        for i, x in zip(own, simhashes(values, edges, hashes) if len(own) else (), strict=True):
            prints[i] = x.tobytes()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(prints, pa.binary())], names=["__row", "__key", "node", "print"])

    return _chunks(rows.select("__row", "__key", "__text"), f"__row long, __key {kind}, node long, print binary", one)


def _sets(rows: DataFrame) -> DataFrame:
    """(node, set) of candidates: the distinct shingle hashes of each, sorted."""

    def one(batch: pa.RecordBatch, w: Words) -> pa.RecordBatch:
        _, _, values, edges = shingle_sets(w)
        sets = [np.unique(values[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return _chunks(rows.select("node", "__text"), "node long, set binary", one)


def without_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", filed: int = FILED) -> DataFrame:
    """One row, that of the smallest key, of every group of near copies, in the columns of ``df``.

    Groups are the components over pairs of five-word Jaccard similarity 0.8 or more; wordless texts are one group.
    It is decided per row, known by a hash of key and text: a null key comes after all others, equal keys
    go by that hash, and rows that repeat key and text are one.
    """
    df, names = numbered(df)
    key, text = names[key], names[text]
    row = F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text), F.col(text).isNull())
    rows = df.select(row.alias("__row"), F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    low = F.min(F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__row").alias("row"))).alias("low")
    width, keys = key_plan(df.count(), filed)
    hashes = ceil((64 * PRINT + width * keys) / VOTES)
    nodes = saved(_signed(rows, df.select(key).schema[0].dataType.simpleString(), hashes).groupBy("node").agg(low, F.max("print").alias("print")))
    first = saved(candidates(nodes, width, keys, FIRST[0]))
    paired = first.select(F.col("a").alias("__paired")).union(first.select("b")).distinct()
    cluster = components(candidates(nodes.join(paired, F.col("node") == F.col("__paired"), "left_semi"), width, keys, PRINT))
    asked = cluster.withColumnRenamed("node", "__node").join(nodes, F.col("__node") == F.col("node")).select("node", F.col("low.row").alias("__asked"))
    texts = rows.join(asked, F.col("__row") == F.col("__asked")).dropDuplicates(["__row"])
    star = cluster.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(links(star, saved(_sets(texts)), np.uint64, few=FEW)).withColumnRenamed("node", "__node").withColumnRenamed("root", "__root")
    named = nodes.join(found, F.col("node") == F.col("__node"), "left").select(F.coalesce("__root", "node").alias("__root"), "low")
    keep = named.groupBy("__root").agg(F.min("low").alias("low")).select(F.col("low.row").alias("__keep"))
    return renamed_back(df.withColumn("__row", row).join(keep, F.col("__row") == F.col("__keep"), "left_semi").dropDuplicates(["__row"]), names)
