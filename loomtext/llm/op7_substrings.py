"""Substring dedup: paragraph MinHash banding with exact verification, and exact passages inside paragraphs.

Paragraphs are the lines of a text (at least LINE words). Equal lines are one; the MinHash of a line's
five-word shingles is cut in BANDS bands of BAND_ROWS, tuned so that a Jaccard similarity of 0.8 collides in
some band with probability 1 - (1 - 0.8**3)**8 > 0.996. Colliding lines are compared by exact Jaccard of their
shingle sets (``banding``), and removals are clustered by connected components.

A passage set into different lines makes no similar lines. So texts are also cut in content-defined
paragraphs, at the local minima of a hash of two words, which fall alike wherever a passage stands (a run of equal
minima is cut at even steps); equal ones are repeats, and a run of them counts from RUN words on. A passage of over 50 words holds such a
run. (Similarity of such short pieces at 0.8 is equality, or nearly, so they need no banding.) Equality is of two
independent hashes, 96 bits in all.

In each cluster that is on several documents the document with the smallest key hash keeps its places; the
others lose theirs. Documents are known by ``__row``, a hash of key and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .banding import gathered, links
from .common import components, dealt_anew, numbered, saved, table

SHINGLE = 5
BANDS, BAND_ROWS = 8, 3
#: Lines of fewer words repeat in clean documents (headings, notices); what repeats of them in longer passages is found as a run.
LINE, REACH, RUN = 25, 5, 16
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_OTHER = np.uint64(0xD1342543DE82EF95)
_OTHER_INVERSE = np.uint64(pow(int(_OTHER), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A, _B = (np.random.default_rng(s).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (17, 19))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: bytes [start, end) in their text, hash (A-Z lower-cased), text number, line number."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, dtype=np.uint8)
        space = _SPACE[data]
        inside = np.concatenate([[False], ~space])
        change = np.nonzero(inside[1:] != inside[:-1])[0]
        start, end = change[0::2], change[1::2]
        powers = np.full(len(data), _BASE, dtype=np.uint64)
        back = np.full(len(data), _INVERSE, dtype=np.uint64)
        if len(data):
            powers[0] = back[0] = 1
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers))])
        self.hash = mix((sums[end] - sums[start]) * np.multiply.accumulate(back)[start] + (end - start).astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.text = np.searchsorted(first, start, side="right") - 1
        self.line = np.cumsum(data == 10)[start] if len(start) else np.zeros(0, dtype=np.int64)
        self.start, self.end = start - first[self.text], end - first[self.text]


def proofs(w: Words, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A second hash, of 32 bits, of the ``n`` words from each place ``a``."""
    if not len(a):
        return np.zeros(0, dtype=np.int32)
    h = mix(w.hash ^ _BASE)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(h) - 1, _OTHER, dtype=np.uint64)]))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers)])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(h) - 1, _OTHER_INVERSE, dtype=np.uint64)]))
    return (mix((sums[a + n] - sums[a]) * back[a]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word count and hash of every line of at least LINE words."""
    if not len(w.hash):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int64),)
    at = np.concatenate([[0], np.nonzero(w.line[1:] != w.line[:-1])[0] + 1])
    n = np.diff(np.append(at, len(w.hash)))
    place = (np.arange(len(w.hash)) - np.repeat(at, n)).astype(np.uint64)
    h = mix(np.add.reduceat(mix(w.hash + place * _BASE), at) + n.astype(np.uint64))
    long = n >= LINE
    return at[long], n[long], h[long].view(np.int64)


def shingles(w: Words, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of the lines, one line after another, and where each line's begin (and the end)."""
    weights = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(1, SHINGLE + 1)]
    size = len(w.hash) - SHINGLE + 1
    if size <= 0 or not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at) + 1, dtype=np.int64)
    every = w.hash[:size] * weights[0]
    for k in range(1, SHINGLE):
        every = every + w.hash[k : k + size] * weights[k]
    edges = np.concatenate([[0], np.cumsum(n - SHINGLE + 1)])
    index = np.repeat(at - edges[:-1], n - SHINGLE + 1) + np.arange(edges[-1])
    return mix(every[index]), edges


def bands(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(lines, BANDS) band hashes."""
    out = np.empty((len(edges) - 1, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(edges) - 1, b + 1, dtype=np.uint64)
        for r in range(BAND_ROWS):
            i = b * BAND_ROWS + r
            low = np.minimum.reduceat((hashes * _A[i] + _B[i]) >> np.uint64(16), edges[:-1])
            key = mix(key * _BASE + low)
        out[:, b] = key
    return out


def cuts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word count and hash of the content-defined paragraphs between two cuts of one text."""
    n = len(w.hash)
    empty = np.zeros(0, dtype=np.int64)
    if n < 2 * REACH + 2:
        return empty, empty, empty
    # Texts are REACH places apart, so that no window reaches from one into the next.
    place = np.arange(n - 1) + (w.text[:-1] + 1) * REACH
    most = np.iinfo(np.uint64).max
    g = np.where(w.text[1:] == w.text[:-1], mix(w.hash[:-1] * _BASE + w.hash[1:]), most)
    spread = np.full(n + (int(w.text[-1]) + 2) * REACH, most, dtype=np.uint64)
    spread[place] = g
    low = spread.copy()
    for d in range(1, REACH + 1):
        np.minimum(low[d:], spread[:-d], out=low[d:])
        np.minimum(low[:-d], spread[d:], out=low[:-d])
    at = np.nonzero((g == low[place]) & (g != most))[0]
    # Equal minima (words repeated over and over) are cut from the left at more than REACH words.
    keep, last, before = np.ones(len(at), dtype=bool), 0, -1
    for i in (np.nonzero((np.diff(at) <= REACH) & (w.text[at[1:]] == w.text[at[:-1]]))[0] + 1).tolist():
        last = last if i - 1 == before else at[i - 1]
        keep[i], before = at[i] - last > REACH, i
        last = at[i] if keep[i] else last
    at = at[keep]
    a, b = at[:-1], at[1:]
    same = (w.text[a] == w.text[b]) & (b - a > REACH)
    a, b = a[same], b[same]
    if not len(a):
        return empty, empty, empty
    h = w.hash * np.uint64(3)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, _BASE, dtype=np.uint64)])))])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, _INVERSE, dtype=np.uint64)]))
    return a, b - a, mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64)


def _scan(df: DataFrame, schema: str, one: Callable[[np.ndarray, Words], dict]) -> DataFrame:
    """``one`` over chunks of (__row, __text); it gets the row ids and the words and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            chunk: list[bytes] = []
            begin = size = 0
            for i in range(len(ids) + 1):
                if i == len(ids) or (size > CHUNK and chunk):
                    if chunk:
                        yield pa.RecordBatch.from_pydict(one(ids[begin:i], Words(chunk)))
                    chunk, begin, size = [], i, 0
                if i < len(ids):
                    chunk.append((texts[i].as_py() or "").encode())
                    size += len(chunk[-1])

    return df.select("__row", "__text").mapInArrow(run, schema)


def _packed(w: Words, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Start and end byte as one long."""
    return (w.start[a] << np.int64(32)) | w.end[a + n - 1]


def _counted(w: Words, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Number of the first word in its text and word count as one long."""
    return ((a - np.searchsorted(w.text, w.text[a])) << np.int64(32)) | n


def line_bands(rows: DataFrame) -> DataFrame:
    """(band, line): distinct within a chunk, so that a common line is shuffled but once per chunk."""

    def one(ids: np.ndarray, w: Words) -> dict:
        at, n, h = lines(w)
        _, own = np.unique(h, return_index=True)
        if not len(own):
            return {"band": pa.array([], pa.int64()), "line": pa.array([], pa.int64())}
        return {"band": bands(*shingles(w, at[own], n[own])).view(np.int64).ravel(), "line": np.repeat(h[own], BANDS)}

    return _scan(rows, "band long, line long", one)


def line_clusters(rows: DataFrame) -> DataFrame:
    """(line, cluster) of the lines that are similar to another line."""
    star = saved(gathered(line_bands(rows)))

    def one(ids: np.ndarray, w: Words) -> dict:
        at, n, h = lines(w)
        _, own = np.unique(h, return_index=True)
        values, edges = shingles(w, at[own], n[own])
        sets = [np.unique((values[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return {"node": h[own], "set": pa.array(sets, pa.binary())}

    asked = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    sets = saved(_scan(rows, "node long, set binary", one).join(asked, "node", "left_semi").dropDuplicates(["node"]))
    return components(links(star, sets, np.uint32)).select(F.col("node").alias("line"), F.col("root").alias("cluster"))


def _repeated(places: DataFrame) -> DataFrame:
    """(cluster, proof, __row, at, words, keeper) of the places whose cluster is in several documents.

    A common passage makes a hot cluster: its sum is formed before the exchange, and the join is one that can be split.
    """
    shared = places.groupBy("cluster", "proof").agg(F.min("__row").alias("keeper"), F.max("__row").alias("__last")).where("keeper <> __last")
    return places.join(shared.select(dealt_anew("cluster").alias("cluster"), "proof", "keeper"), ["cluster", "proof"])


def passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__row, start, end, n_words, cluster, keeper, removed): the repeated passages of all rows, in bytes of UTF-8.

    Neighbouring and overlapping places are one passage; a passage is removed where its document is not the
    keeper. Null and empty texts have none. Rows equal in key and text are one document, so neither repeats the
    other. Lines under LINE words and runs under RUN words are left alone.
    """
    rows = df.select(F.xxhash64(F.col(key), F.col(text)).alias("__row"), F.col(text).cast("string").alias("__text"))

    def line_places(ids: np.ndarray, w: Words) -> dict:
        at, n, h = lines(w)
        return {"__row": ids[w.text[at]], "at": _packed(w, at, n), "words": _counted(w, at, n), "cluster": h, "proof": proofs(w, at, n)}

    def cut_places(ids: np.ndarray, w: Words) -> dict:
        a, n, h = cuts(w)
        return {"__row": ids[w.text[a]], "at": _packed(w, a, n), "words": _counted(w, a, n), "cluster": h, "proof": proofs(w, a, n)}

    schema = "__row long, at long, words long, cluster long, proof int"
    near = line_clusters(rows).withColumnRenamed("line", "__line").withColumnRenamed("cluster", "__cluster")
    own = _scan(rows, schema, line_places)
    whole = own.join(near, F.col("cluster") == F.col("__line"), "left").select("__row", "at", "words", F.coalesce("__cluster", "cluster").alias("cluster"), F.when(F.col("__cluster").isNull(), F.col("proof")).otherwise(0).alias("proof"))
    inside = _scan(rows, schema, cut_places)
    found = _repeated(whole).withColumn("line", F.lit(True)).unionByName(_repeated(inside).withColumn("line", F.lit(False)))
    gone = F.col("keeper") != F.col("__row")
    per_row = found.groupBy("__row").agg(F.sort_array(F.collect_set(F.struct(F.col("at"), "words", "line", "cluster", "keeper", gone.alias("gone")))).alias("p"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("__row", "start", "end", "n_words", "cluster", "keeper", "removed")
        for batch in batches:
            out: list[tuple] = []
            for row, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for gone in (False, True):
                    now: list | None = None
                    for x in [x for x in p if x["gone"] == gone]:
                        a, b = x["at"] >> 32, x["at"] & 0xFFFFFFFF
                        first, n = x["words"] >> 32, x["words"] & 0xFFFFFFFF
                        if now and first <= now[7] + now[3]:
                            # Neighbours by word number, whatever white space is between; words of an overlap count once.
                            now[2], now[3], now[6] = max(now[2], b), max(now[3], first + n - now[7]), now[6] or x["line"]
                            continue
                        if now and (now[6] or now[3] >= RUN):
                            out.append((*now[:6], gone))
                        now = [row, a, b, n, x["cluster"], x["keeper"], x["line"], first]
                    if now and (now[6] or now[3] >= RUN):
                        out.append((*now[:6], gone))
            yield pa.RecordBatch.from_pydict({n: pa.array([o[i] for o in out], pa.bool_() if n == "removed" else pa.int64()) for i, n in enumerate(names)})

    return per_row.mapInArrow(merge, "__row long, start long, end long, n_words long, cluster long, keeper long, removed boolean")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without the removed passages, in their own columns; documents left without a word go.

    Rows that had no word before stay as they are. A cut takes the passage's bytes; the white space around it stays.
    """
    df, own_names = numbered(df)
    key, text = own_names[key], own_names[text]
    gone = passages(df, key, text).where("removed").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts")).withColumnRenamed("__row", "__cut_row")
    kept = [c for c in df.columns if c != text]
    joined = df.withColumn("__row", F.xxhash64(F.col(key), F.col(text))).join(gone, F.col("__row") == F.col("__cut_row"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if spans:
                    data, parts, at = t.encode(), [], 0
                    for s in spans:
                        parts.append(data[at : max(at, s["start"])])
                        at = max(at, s["end"])
                    t = b"".join([*parts, data[at:]]).decode()
                    t = t if t.split() else None
                    out.append((t, t is not None))
                else:
                    out.append((t, True))
            stay = pa.array([k for _, k in out], pa.bool_())
            columns = [pa.array([t for t, _ in out], pa.string()), *[batch.column(i) for i in range(2, batch.num_columns)]]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stay)

    names = [f"__c{i}" for i in range(len(kept) + 1)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{n} {'string' if i == 0 else kinds[kept[i - 1]]}" for i, n in enumerate(names))
    done = joined.select(F.col(text).cast("string"), "__cuts", *kept).mapInArrow(cut, schema)
    back = dict(zip([text, *kept], names, strict=True))
    return done.select(*[F.col(back[n]).alias(c) for c, n in own_names.items()])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage: its document, place (bytes of UTF-8), words, keeper and whether it is removed."""
    docs = table(spark, sf_dir, "documents")
    found = passages(docs)
    known = docs.select(F.xxhash64("doc_id", "text").alias("__row"), "doc_id").distinct()
    named = found.join(known, "__row").join(known.select(F.col("__row").alias("keeper"), F.col("doc_id").alias("keep_doc_id")), "keeper")
    return named.select("doc_id", "keep_doc_id", "start", "end", "n_words", "cluster", "removed")


QUERIES = {"op7_substrings": op7_substrings}
ORACLE: dict[str, str] = {}
