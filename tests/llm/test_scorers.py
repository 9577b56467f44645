"""Quality and toxicity: held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import op2_quality as o2, op3_toxicity as o3, scoring

from .helpers import DOCS, documents

LABELS = "doc_id long, quality int, toxic int"
CASES = [(o2.score_quality, "quality", 3, 1), (o3.score_toxicity, "toxic", 5, 0)]


def corpus(spark, n=600, key="doc_id"):
    r = np.random.default_rng(5)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.4)
        w = [*r.choice(good, 60), *(r.choice(bad, 12) if y else [])]
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1 - y, y))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize(("score", "label", "folds", "held"), CASES)
def test_held_out_rows_are_told_apart(spark, score, label, folds, held):
    docs, labels, truth = corpus(spark)
    got = score(docs, labels).collect()
    assert len(got) == 600 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % folds == held) for x in got)
    out = [x for x in got if x.held_out]
    at = 0 if label == "quality" else 1
    assert sum(x.predicted == truth[x.doc_id][at] for x in out) / len(out) >= 0.95


@pytest.mark.parametrize(("score", "label", "folds", "held"), CASES)
def test_held_out_labels_are_never_learned(spark, score, label, folds, held):
    docs, labels, _ = corpus(spark)
    inside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held
    turned = labels.withColumn(label, F.when(inside, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({x.doc_id: x.score for x in score(docs, t).collect()} for t in (labels, turned))
    assert a == b


@pytest.mark.parametrize(("score", "label", "folds", "held"), CASES)
def test_edges(spark, score, label, folds, held):
    docs, labels, _ = corpus(spark, 200)
    odd = documents(spark, [(900, None), (901, ""), (901, ""), (None, "g1 g2"), (902, "b1 " * 100_000), (903, "\U0001f600 <|x|>")])
    both = docs.unionByName(odd).withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(None).cast("string"))
    got = score(both, labels.unionByName(spark.createDataFrame([(None, 1, 1), (900, None, None)], LABELS))).collect()
    assert len(got) == 206 and all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.doc_id in (900, 901)}) == 1
    none = score(docs, labels.limit(0)).collect()
    assert len({x.score for x in none}) == 1 and len(none) == 200
    assert score(spark.createDataFrame([], DOCS), labels).count() == 0


def test_rejected_documents_go_and_clean_ones_stay_whole(spark):
    docs, labels, truth = corpus(spark)
    kept = o3.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    rows, before = {x.doc_id: x for x in kept.collect()}, {x.doc_id: x for x in docs.collect()}
    assert all(before[k] == x for k, x in rows.items())
    assert sum(truth[k][1] for k in rows) <= 0.05 * len(rows) and len(rows) >= 0.95 * sum(1 - t for _, t in truth.values())


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality", "quality", 0.95), ("op3_toxicity", "toxic", 0.9)])
def test_accuracy_on_the_tables(spark, sf, name, label, least):
    big = sf.replace("0.001", "0.01")
    score = {"op2_quality": o2, "op3_toxicity": o3}[name].QUERIES[name](spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    hit = score.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert hit >= least


def test_isotonic_rises():
    r = np.random.default_rng(1)
    z = r.normal(size=500)
    xs, ys = o3.isotonic(z, (r.random(500) < 1 / (1 + np.exp(-3 * z))).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys[0] < 0.2 < 0.8 < ys[-1] < 1


def test_columns_that_clash_stay_as_they_are(spark):
    docs, labels, _ = corpus(spark, 200)
    names = ("predicted", "score", "held_out", "__key", "__toxic", "__k0", "label")
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    kept = o3.without_toxic(wide, labels)
    assert kept.columns == wide.columns
    rows, before = {x.doc_id: x for x in kept.collect()}, {x.doc_id: x for x in wide.collect()}
    assert 0 < len(rows) < 200 and all(before[k] == x for k, x in rows.items())


def test_the_sample_is_bounded_by_rows_and_counts_equal_texts_once(spark):
    rows = [(i % 10, f"text {i % 10} {i % 40}") for i in range(400)] + [(100 + i, "the same text") for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in [*range(10), *range(100, 130)]], LABELS)
    docs = documents(spark, rows)
    for n in (7, 40, 1000):
        found = scoring.labelled_sample(docs.repartition(n % 5 + 1), labels, "toxic", F.lit(True), n).collect()
        assert len(found) == len({x["__text"] for x in found}) == min(n, 41)
    assert next(x["__label"] for x in found if x["__text"] == "the same text") == 1


def test_the_lexicon_does_not_depend_on_batches(spark):
    rows = [(f"bad{i % 3} word{i}" if i % 2 else f"fine word{i}", i % 2) for i in range(60)]
    a, b = (o3.lexicon(spark.createDataFrame(rows, "__text string, __label int").repartition(n)) for n in (1, 9))
    assert a == b and {"bad0", "bad1", "bad2"} <= set(a)


def test_context_vectors_and_pooling_by_brute_force(spark):
    r = np.random.default_rng(2)
    texts = [None, "", "one", *(" ".join(r.choice(["a", "b", "cc", "dd,", "e!"], r.integers(1, 30))) for _ in range(150))]
    got = o2.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    index, want = o2.index_table(), np.zeros((o2.ROWS, o2.DIM))
    for t in texts:
        ids = [o2._row(w) for w in o2._WORDS.findall(t or "")]
        for i in range(len(ids)):
            for j in range(max(0, i - o2.REACH), min(len(ids), i + o2.REACH + 1)):
                if j != i:
                    want[ids[i]] += index[ids[j]]
    assert (got == want).all()
    vectors, memo = o2.word_table(got), scoring.Memo(o2._row)
    for t in texts[:60]:
        ids = [o2._row(w) for w in o2._WORDS.findall(t or "")]
        mean = sum((vectors[i].astype(np.float64) for i in ids), np.zeros(2 * o2.DIM)) / max(1, len(ids))
        alike = sum(a == b for a, b in zip(ids, ids[1:], strict=False)) / max(1, len(ids) - 1)
        slow = [*mean, np.linalg.norm(mean[: o2.DIM]), np.linalg.norm(mean[o2.DIM :]), alike, np.log1p(len(ids)) / 10]
        assert np.allclose(o2.pool(t or "", vectors, memo), slow if ids else np.zeros(2 * o2.DIM + 4), atol=1e-6)


def slow_trees(x, y, model):
    """The raw scores of ``Trees.fit`` by trying every feature and edge at every node, row by row."""
    n, p = len(y), min(max(y.mean(), 1e-6), 1 - 1e-6)
    b = [[sum(v >= e for e in model.edges[j]) for j, v in enumerate(row)] for row in x]
    f = [float(np.log(p / (1 - p)))] * n
    for _ in range(model.rounds):
        q = [1 / (1 + np.exp(-v)) for v in f]

        def gain_of(rows, q=q):
            g, h = sum(q[i] - y[i] for i in rows), sum(q[i] * (1 - q[i]) for i in rows)
            return g**2 / (h + model.ridge), -g / (h + model.ridge) * model.rate

        def grow(rows, depth, gain_of=gain_of):
            best = None
            if depth < model.depth and len(rows) >= 2 * model.least:
                for j in range(len(x[0])):
                    for c in range(model.bins + 1):
                        left, right = [i for i in rows if b[i][j] <= c], [i for i in rows if b[i][j] > c]
                        if min(len(left), len(right)) >= model.least:
                            gain = gain_of(left)[0] + gain_of(right)[0] - gain_of(rows)[0]
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = gain, left, right
            if best:
                grow(best[1], depth + 1), grow(best[2], depth + 1)
            else:
                value = gain_of(rows)[1]
                for i in rows:
                    f[i] += value

        grow(list(range(n)), 0)
    return f


def test_trees_by_brute_force():
    r = np.random.default_rng(6)
    x = r.normal(size=(90, 3)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * r.normal(size=90) > 0.2).astype(np.float64)
    model = o3.Trees(rounds=4, depth=2, bins=6, least=8).fit(x, y)
    assert np.allclose(model.raw(x), slow_trees(x.tolist(), y, model), atol=1e-6)
