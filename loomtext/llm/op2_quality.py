"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Every word has a sparse random index vector, drawn from its hash. A word's context vector is the sum of
its neighbours' index vectors over the whole corpus; words share 2**13 hashed rows, so the table has a
fixed size at every corpus size. A document is pooled from the vectors of all its words. The network's
probabilities are calibrated by a temperature fitted on rows held back from its training.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_arrow, table
from .scoring import Memo, fold, labelled_sample

ROWS, DIM, NONZERO, REACH = 1 << 13, 24, 2, 1
#: At most so many labelled rows fit the network (drawn by hash).
SAMPLE = 8000
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 24, 60, 0.01, 1e-4, 256
_WORDS = re.compile(r"\w+|[^\w\s]+")


def _row(word: str) -> int:
    return xxh64_intdigest(word, 7) % ROWS


def index_table(seed: int = 11) -> np.ndarray:
    """The random index vectors: per row NONZERO places with +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM), dtype=np.int64)
    for r in range(ROWS):
        out[r, rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def _ids(text: str, memo: Memo) -> np.ndarray:
    found = _WORDS.findall(text)
    return np.fromiter(map(memo.__getitem__, found), dtype=np.int64, count=len(found))


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(ROWS, DIM) sums of the neighbours' index vectors over all documents; collected, its size is fixed."""

    def run(batches):
        import pyarrow as pa

        index, memo = index_table(), Memo(_row)
        places = np.nonzero(index)[1].reshape(ROWS, NONZERO)
        signs = np.take_along_axis(index, places, axis=1)
        sums = np.zeros(ROWS * DIM)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 64):
                own = [_ids(t or "", memo) for t in texts[i : i + 64]]
                ids = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
                doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
                for d in range(1, REACH + 1):
                    a, b = ids[:-d], ids[d:]
                    same = doc[:-d] == doc[d:]
                    a, b = a[same], b[same]
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            sums += np.bincount(x * DIM + places[y, k], weights=signs[y, k], minlength=ROWS * DIM)
        sums = sums.reshape(ROWS, DIM).astype(np.int64)
        used = np.nonzero(sums.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(sums[used, j]) for j in range(DIM)]], names=["r", *[f"v{j}" for j in range(DIM)]])

    schema = "r long, " + ", ".join(f"v{j} long" for j in range(DIM))
    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, schema)
    merged = parts.groupBy("r").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(DIM)]).toPandas()
    out = np.zeros((ROWS, DIM))
    if len(merged):
        out[merged["r"].to_numpy()] = merged[[f"v{j}" for j in range(DIM)]].to_numpy()
    return out


def word_table(context: np.ndarray) -> np.ndarray:
    """Word vectors: the index vector beside the context vector scaled to length 1."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return np.hstack([index_table(), context / np.where(norm > 0, norm, 1)]).astype(np.float32)


def pool(text: str, vectors: np.ndarray, memo: Memo) -> np.ndarray:
    """A document's inputs: the mean word vector, its two lengths, how alike neighbours are, and log length."""
    ids = _ids(text, memo)
    if not len(ids):
        return np.zeros(2 * DIM + 4)
    n = np.bincount(ids, minlength=0)
    used = np.nonzero(n)[0]
    mean = (n[used] @ vectors[used].astype(np.float64)) / len(ids)
    alike = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
    return np.concatenate([mean, [np.linalg.norm(mean[:DIM]), np.linalg.norm(mean[DIM:]), alike, np.log1p(len(ids)) / 10]])


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> dict:
    """Weights of the network and its temperature; a fifth of the rows is held back for the temperature.

    With rows of one class only (or none) the result is a constant score, the smoothed share of label 1.
    """
    if len(y) < 10 or y.min() == y.max():
        return {"constant": (y.sum() + 1) / (len(y) + 2)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    cut = len(y) // 5
    w = {"a": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    tx, ty = x[cut:], y[cut:]
    for _ in range(EPOCHS):
        p = rng.permutation(len(ty))
        for i in range(0, len(p), BATCH):
            bx, by = tx[p[i : i + BATCH]], ty[p[i : i + BATCH]]
            h = np.tanh(bx @ w["a"] + w["b"])
            e = (1 / (1 + np.exp(-np.clip(h @ w["c"] + w["d"], -40, 40))) - by) / len(by)
            gh = np.outer(e, w["c"]) * (1 - h * h)
            g = {"a": bx.T @ gh, "b": gh.sum(0), "c": h.T @ e, "d": np.array([e.sum()])}
            step += 1
            for k in w:
                gk = g[k] + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    z = np.tanh(x[:cut] @ w["a"] + w["b"]) @ w["c"] + w["d"]
    temperatures = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, np.where(y[:cut] == 1, -z, z) / t)) for t in temperatures]
    return w | {"mean": mean, "scale": scale, "t": temperatures[int(np.argmin(loss))]}


def probability(x: np.ndarray, w: dict) -> np.ndarray:
    """Calibrated probabilities of label 1."""
    if "constant" in w:
        return np.full(len(x), w["constant"])
    z = np.tanh((x - w["mean"]) / w["scale"] @ w["a"] + w["b"]) @ w["c"] + w["d"]
    return 1 / (1 + np.exp(-np.clip(z / w["t"], -40, 40)))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row; labels are learned from the folds other than ``held``.

    Word statistics cover all rows. Null text is empty; an empty text pools to zeros and is scored by the
    network; repeated rows are scored alike. Without usable labels every score is one constant.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_table(context_vectors(docs, text)))
    kind = docs.select(key).schema[0].dataType.simpleString()

    def inputs(texts, memo):
        return np.array([pool(t or "", vectors.value, memo) for t in texts.to_pylist()]).reshape(-1, 2 * DIM + 4)

    def features(texts, marks):
        yield {"x": inputs(texts, Memo(_row)).tolist(), "y": marks}

    sample = labelled_sample(docs, labels, label, fold(F.col("__key"), folds) != held, bound, key, text)
    rows = map_arrow(sample, ["__text", "__label"], "x array<double>, y int", features).toPandas()
    x, y = np.array(rows["x"].tolist()).reshape(-1, 2 * DIM + 4), rows["y"].to_numpy(dtype=np.int64)
    order = np.lexsort([y, *x.T]) if len(x) else []
    weights = spark.sparkContext.broadcast(train(x[order], y[order]))
    memo: Memo | None = None

    def score(keys, out, texts):
        nonlocal memo
        memo = memo if memo is not None else Memo(_row)
        p = probability(inputs(texts, memo), weights.value)
        yield {"__key": keys, "held_out": out, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    every = docs.select(F.col(key).alias("__key"), (fold(F.col(key), folds) == held).alias("__out"), F.col(text).cast("string").alias("__text"))
    return map_arrow(every, ["__key", "__out", "__text"], f"__key {kind}, held_out boolean, score double, predicted int", score).withColumnRenamed("__key", key)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
