"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon (whole words and word beginnings, weighed on labelled rows),
its proximity to second-person words, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, saved, table
from .scoring import Memo, fold, labelled_sample

#: At most so many labelled rows give the lexicon and fit the trees (drawn by hash).
SAMPLE = 8000
#: A term enters the lexicon if it is in this share of the toxic sample (and 5 rows) and this log-odds apart; the heaviest LEXICON do (part of the fit on the sample).
SUPPORT, APART, LEXICON = 0.02, 2.0, 4096
NEAR = 4
_WORDS = re.compile(r"\w+")
_INSIDE = re.compile(r"\w[*@$!#%|]+\w")
_SPREAD = re.compile(r"(?<!\w)\w(?:[\s.\-_*]\w){3,}(?!\w)")
_LONG = re.compile(r"(\w)\1{2,}")
_PUNCTUATION = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LEET = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(r"[^\W\d_]+[013457@$!]+\w*|\w*[013457@$!]+[^\W\d_]+")
YOU = frozenset("you your yours yourself u ur thou du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
FEATURES = 20


def terms(text: str) -> set[str]:
    """The distinct lower-cased words of a text and their beginnings of 4, 5 and 6 letters (marked with ``^``)."""
    words = set(_WORDS.findall(text.lower()))
    return words | {"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n}


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Term weights (log-odds of the toxic share), from a bounded sample of distinct texts; at most LEXICON terms are collected."""
    size = sample.agg(F.sum("__label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = size["p"] or 0, size["n"] - (size["p"] or 0)
    if not toxic or not clean:
        return {}

    def count(texts, marks):
        pos, neg = Counter(), Counter()
        for t, y in zip(texts.to_pylist(), marks.to_pylist(), strict=True):
            (pos if y else neg).update(terms(t))
        keys = list(pos | neg)
        yield {"term": keys, "p": [pos[k] for k in keys], "n": [neg[k] for k in keys]}

    sums = map_arrow(sample, ["__text", "__label"], "term string, p long, n long", count).groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    weight = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    kept = sums.withColumn("w", F.round(weight, 9)).where((F.col("p") >= max(5, SUPPORT * toxic)) & (F.col("w") >= APART))
    return {r["term"]: r["w"] for r in kept.orderBy(F.col("w").desc(), "term").limit(LEXICON).select("term", "w").collect()}


def word_weight(word: str, weights: dict[str, float]) -> tuple[float, float]:
    """A lower-cased word's own weight and that of its heaviest beginning (0: not in the lexicon)."""
    return weights.get(word, 0.0), max((weights.get("^" + word[:n], 0.0) for n in (4, 5, 6) if len(word) > n), default=0.0)


def features(text: str, memo: Memo) -> list[float]:
    """The dense features of a whole text; all zero for an empty one."""
    if not text:
        return [0.0] * FEATURES
    words = _WORDS.findall(text.lower())
    n, chars = max(1, len(words)), len(text)
    pairs = list(map(memo.__getitem__, words))
    whole = [i for i, p in enumerate(pairs) if p[0]]
    begun = [i for i, p in enumerate(pairs) if p[1]]
    hits = sorted({*whole, *begun})
    you = [i for i, w in enumerate(words) if w in YOU] if hits else []
    near = sum(any(abs(i - j) <= NEAR for j in you[max(0, k - 1) : k + 1]) for i in hits for k in [int(np.searchsorted(you, i))]) if you else 0
    masked = [w for w in _MIXED.findall(text.lower())] if re.search(r"[\d@$!]", text) else []
    veiled = sum(1 for w in masked if any(memo[w.translate(_LEET).strip("si") or w]) or any(memo[w.translate(_LEET)]))
    upper = len(_UPPER.findall(text))
    marks = len(_PUNCTUATION.findall(text))
    most = max((max(pairs[i]) for i in hits), default=0.0)
    return [
        math.log1p(len(words)), len(whole) / n, len(begun) / n, math.log1p(len(whole)), math.log1p(len(begun)),
        sum(pairs[i][0] for i in whole) / n, sum(pairs[i][1] for i in begun) / n, most, max((pairs[i][0] for i in whole), default=0.0), max((pairs[i][1] for i in begun), default=0.0),
        math.log1p(len({words[i] for i in whole})), math.log1p(len({words[i] for i in begun})), near / n, near / max(1, len(hits)),
        upper / chars, sum(1 for w in _WORDS.findall(text) if w.isupper() and len(w) > 2) / n, marks / chars, text.count("!") / chars,
        (len(_INSIDE.findall(text)) + len(_SPREAD.findall(text)) + len(_LONG.findall(text))) / n, veiled / n,
    ]


class Trees:
    """Boosted depth-3 trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 12, ridge: float = 1.0, edges: list[np.ndarray] | None = None, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None, base: float = 0.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.edges, self.trees, self.base = edges or [], trees or [], base

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="higher")) for j in range(x.shape[1])]
        b = self.binned(x)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        width = self.bins + 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q)
            node = np.zeros(len(y), dtype=np.int64)
            split, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, dtype=np.int64)
            for level in range(self.depth):
                for k in range(2**level):
                    at = 2**level - 1 + k
                    own = node == at
                    if own.sum() < 2 * self.least:
                        continue
                    gs, hs, best = g[own].sum(), h[own].sum(), 1e-6
                    for j in range(b.shape[1]):
                        bj = b[own, j]
                        gl, hl, n = (np.cumsum(np.bincount(bj, weights=w, minlength=width)) for w in (g[own], h[own], None))
                        gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                        gain[(n < self.least) | (own.sum() - n < self.least)] = -1
                        c = int(np.argmax(gain))
                        if gain[c] > best:
                            best, split[at], cut[at] = gain[c], j, c
                side = (split[node] >= 0) & (b[np.arange(len(y)), np.maximum(split[node], 0)] > cut[node])
                node = 2 * node + 1 + side
            leaf = node - (2**self.depth - 1)
            value = -np.bincount(leaf, weights=g, minlength=2**self.depth) / (np.bincount(leaf, weights=h, minlength=2**self.depth) + self.ridge) * self.rate
            self.trees.append((split, cut, value))
            f += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for split, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((split[node] >= 0) & (b[rows, np.maximum(split[node], 0)] > cut[node]))
            f += value[node - (2**self.depth - 1)]
        return f


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step fit of y on z (pool adjacent violators), with one row of each class added to every block."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(z[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    xs = np.array([v for s, n, lo, hi in blocks for v in (lo, hi)])
    ys = np.array([(s + 0.05) / (n + 0.1) for s, n, _, _ in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys)


def train(x: np.ndarray, y: np.ndarray, seed: int = 5, folds: int = 3) -> dict:
    """Trees fitted on all rows, and an isotonic calibration on what trees of the other folds give each row.

    With too few rows, or one class only in all or in some fold's training rows, the result is a constant score.
    """
    constant = {"constant": (y.sum() + 1) / (len(y) + 2)}
    if len(y) < 40 or y.min() == y.max():
        return constant
    order = np.random.default_rng(seed).permutation(len(y))
    x, y = x[order], y[order].astype(np.float64)
    fold, z = np.arange(len(y)) % folds, np.empty(len(y))
    for k in range(folds):
        out = fold == k
        if y[~out].min() == y[~out].max():
            return constant
        z[out] = Trees().fit(x[~out], y[~out]).raw(x[out])
    xs, ys = isotonic(z, y)
    return {"trees": vars(Trees().fit(x, y)), "xs": xs, "ys": ys}  # plain values only: a broadcast is unpickled without this package


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated probabilities of label 1."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return np.interp(Trees(**model["trees"]).raw(x), model["xs"], model["ys"])


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str], label: str, folds: int, held: int, bound: int, key: str, text: str) -> DataFrame:
    """``__key``, ``__held``, ``__score``, ``__toxic`` of every row, and the columns ``keep`` as ``__k0``, ``__k1``, ..."""
    spark = docs.sparkSession
    sample = saved(labelled_sample(docs, labels, label, fold(F.col("__key"), folds) != held, bound, key, text))
    weights = spark.sparkContext.broadcast(lexicon(sample))

    def look(word: str) -> tuple[float, float]:
        return word_weight(word, weights.value)

    def inputs(texts, memo):
        return np.array([features(t or "", memo) for t in texts.to_pylist()]).reshape(-1, FEATURES)

    def learn(texts, marks):
        yield {"x": inputs(texts, Memo(look)).tolist(), "y": marks}

    rows = map_arrow(sample, ["__text", "__label"], "x array<double>, y int", learn).toPandas()
    x, y = np.array(rows["x"].tolist()).reshape(-1, FEATURES), rows["y"].to_numpy(dtype=np.int64)
    order = np.lexsort([y, *x.T]) if len(x) else []
    model = spark.sparkContext.broadcast(train(x[order], y[order]))
    memo: Memo | None = None

    def score(keys, out, texts, *rest):
        nonlocal memo
        memo = memo if memo is not None else Memo(look)
        p = probability(inputs(texts, memo), model.value)
        yield {"__key": keys, "__held": out, "__score": p, "__toxic": (p >= 0.5).astype(np.int32), **{f"__k{i}": c for i, c in enumerate(rest)}}

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    every = docs.select(F.col(key).alias("__key"), (fold(F.col(key), folds) == held).alias("__out"), F.col(text).cast("string").alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"__key {kinds[key]}, __held boolean, __score double, __toxic int", *[f"__k{i} {kinds[c]}" for i, c in enumerate(keep)]])
    return map_arrow(every, every.columns, schema, score)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row; labels are learned from the folds other than ``held``.

    Null text is empty; an empty text has all features 0 and the score the trees give that; repeated rows are
    scored alike; a null key counts as an empty one for its fold. Without usable labels of both classes every score is one constant.
    """
    scored = _scored(docs, labels, [], label, folds, held, bound, key, text)
    return scored.select(F.col("__key").alias(key), F.col("__held").alias("held_out"), F.col("__score").alias("score"), F.col("__toxic").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in their own columns, whatever these are called.

    Rows are judged one by one: null and empty texts, null keys and repeated rows as ``score_toxicity`` has it.
    """
    scored = _scored(docs, labels, docs.columns, label, folds, held, bound, key, text)
    return scored.where("__toxic = 0").select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
