"""Joins, samples, ranking, vectors and terms on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import vectors
from loomtext.operators import profile as p, relational as r, similarity as s, terms


def test_null_codes_match_null_codes_and_repeats_fan_out(spark):
    links = spark.createDataFrame([(1, "a"), (1, None), (2, "x")], "job_id long, code string")
    names = spark.createDataFrame([("a", "A1"), ("a", "A2"), (None, "none")], "code string, name string")
    got = sorted((x.job_id, x.code, x.name) for x in r.map_codes(links, names, "code").where("code is not null or name is not null").collect() if x.code) + [x.name for x in r.map_codes(links, names, "code").where("code is null").collect()]
    assert got == [(1, "a", "A1"), (1, "a", "A2"), (2, "x", None), "none"]


def test_names_are_distinct_sorted_and_lower(spark):
    df = spark.createDataFrame([(1, "B"), (1, "a"), (1, "b"), (2, None), (None, "z")], "k long, name string")
    assert {x.k: x.names for x in r.distinct_names(df, "k", "name", "names").collect()} == {1: ["a", "b"], 2: []}


def test_sample_is_the_same_at_every_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a, b = ({x.k for x in r.seeded_sample(df.repartition(n), "k", 20).collect()} for n in (1, 7))
    assert a == b and len(a) == 20
    assert r.seeded_sample(df.limit(3), "k", 20).count() == 3


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(i, "a" if i < 80 else None) for i in range(100)], "k long, y string")
    got = r.stratified_split(df, "k", "y").groupBy("y", "split").count().collect()
    assert {(x.y, x.split): x["count"] for x in got} == {("a", "test"): 16, ("a", "train"): 64, (None, "test"): 4, (None, "train"): 16}


def test_top_n_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, None), (4, 2.0)], "k long, v double")
    assert [x.k for x in r.top_n(df, "v", "k", 9).collect()] == [4, 1, 3, 2]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(vectors.norm(F.col("a")).alias("n"), vectors.normalized(F.col("b")).alias("z"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalized(F.col("a")).alias("u")).first()
    assert (row.n, row.z, row.c) == (5.0, [0.0, 0.0], 0.0) and row.u == pytest.approx([0.6, 0.8])


def test_vector_search_ties_go_to_the_smaller_key_and_self_is_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = s.vector_top_n(df, df.where("k = 2"), "k", "v", 3).orderBy("rank").collect()
    assert [(x.k, x.sim_score) for x in got] == [(1, 1.0), (3, 1.0), (4, 0.0)]


def test_queries_in_blocks_give_what_one_block_gives(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.array(F.sin("id"), F.cos(F.col("id") * 2), F.lit(0.5)).alias("v"))
    one, many = (sorted(map(tuple, s.vector_top_n(df, df, "k", "v", 3, block=n).collect())) for n in (1000, 7))
    assert one == many and len(one) == 120


@pytest.mark.parametrize("n", [1, 2, 5, 7, 21, 333])
def test_quantiles_by_brute_force(spark, n):
    r = np.random.default_rng(n)
    rows = [(g, float(v)) for g in ("a", None) for v in r.choice(r.normal(size=max(1, n // 2)), n)] + [("none", None)]
    at = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {x.g: x.q for x in p.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"], at).collect()}
    assert set(got) == {"a", None}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([v for k, v in rows if k == g], at))
    if n == 333:  # a sketch too coarse for its bracket is wide enough still
        assert p.five_numbers(spark.createDataFrame(rows, "g string, v double"), "g", "v").count() == 3


def test_split_of_one_label_by_brute_force(spark):
    import hashlib

    df = spark.createDataFrame([(i, i % 3 or None) for i in range(500)], "k long, y int")
    got = {x.k for x in r.stratified_split(df, "k", "y", 0.13).where("split = 'test'").collect()}
    for y in range(3):
        own = sorted((k for k in range(500) if k % 3 == y), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
        assert {k for k in got if k % 3 == y} == set(own[: -(-len(own) * 13 // 100)])


def test_recommend_with_an_encoder_from_outside(spark):
    def load():
        return lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]

    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "k long, v array<float>")
    got = s.recommend("AAB!", items, "k", "v", s.encoder(load), 2).collect()
    assert [x.k for x in got] == [3, 1]
    assert got[0].sim_score == pytest.approx(3 / math.sqrt(10))


def test_tfidf_top_n_against_a_direct_computation(spark):
    docs = {1: "aa bb bb cc", 2: "aa cc cc", 3: "bb dd", 4: ""}
    items = spark.createDataFrame(list(docs.items()), "k long, t string")
    queries = spark.createDataFrame([(7, "bb aa zz"), (8, "zz")], "q long, t string")
    got = {(x.q, x.k): x.sim_score for x in s.tfidf_top_n(items, queries, "k", "q", "t", n=5).collect()}
    df = {w: sum(w in d.split() for d in docs.values()) for w in ("aa", "bb", "cc", "dd")}
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items() if n >= 2}

    def unit(text):
        v = {w: text.split().count(w) * idf[w] for w in set(text.split()) if w in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    q = unit("bb aa zz")
    want = {(7, k): round(sum(q.get(w, 0) * x for w, x in unit(t).items()), 6) for k, t in docs.items() if set(t.split()) & set(q)}
    assert got == pytest.approx(want)


def test_word_frequency_and_pairs(spark):
    df = spark.createDataFrame([("b a a",), (None,), ("b",)], "t string")
    assert [(x.Word, x.Frequency) for x in terms.word_frequency(df, "t").collect()] == [("a", 2), ("b", 2)]
    one = spark.createDataFrame([("aa x bb cc",)], "t string")
    assert [x.term for x in terms.terms_of(one, [], F.col("t")).collect()] == ["aa", "bb", "cc", "aa bb", "bb cc"]


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert p.describe(df).first().n == 0
    assert {x.column_name: x.n_missing for x in p.missingness(df).collect()} == {"k": 0, "v": 0}
    assert p.outliers(df, "v").count() == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert p.missingness(df).first().n_missing == 2


@pytest.mark.parametrize("cosine", [True, False])
def test_vector_search_is_the_column_expression_whatever_the_vectors(spark, cosine):
    r = np.random.default_rng(5)
    odd = [None, [], [math.nan] * 4, [None] * 4, [1.0] * 5, [math.inf] * 4, [0.0] * 4, [5e-7, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    rows = [(i, odd[i % 40] if i % 40 < len(odd) else [float(x) for x in r.choice([-1.0, 0.0, 0.5, 1.0], 4)]) for i in r.permutation(300).tolist()]
    df = spark.createDataFrame(rows, "k long, v array<float>").repartition(3).cache()
    got = sorted(map(repr, s.vector_top_n(df, df.where("k % 7 = 0"), "k", "v", 5, cosine, block=20).collect()))
    a, b = F.col("v"), F.col("q")
    scored = df.crossJoin(df.where("k % 7 = 0").select(F.col("k").alias("query_id"), F.col("v").alias("q"))).where("k <> query_id")
    scored = scored.withColumn("sim_score", F.round(vectors.cosine(a, b) if cosine else vectors.dot(a, b), 6))
    assert got == sorted(map(repr, s.ranked(scored, "query_id", "sim_score", "k", 5).select("query_id", "rank", "k", "sim_score").collect()))


def test_vector_search_scores_no_pair_by_an_expression_when_vectors_are_even(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.array(F.sin("id"), F.cos(F.col("id") * 2), F.lit(0.5)).alias("v"))
    plan = s.vector_top_n(df, df.where("k % 4 = 0"), "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_documents_are_dealt_by_the_bytes_of_their_texts(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART", 1000)
    df = spark.range(300).select(F.col("id").alias("k"), F.lit("ab " * 50).alias("t"))
    out = terms.tfidf(df, "k", "t")
    assert terms.dealt(df, "k", "t").rdd.getNumPartitions() == 45
    assert out.count() == 600 and out.rdd.getNumPartitions() == 45  # the engine does not join them again
    assert terms.dealt(df.limit(0), "k", "t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def zipf_texts(seed: int, n: int = 60) -> list[str]:
    r = np.random.default_rng(seed)
    return [" ".join(f"w{min(int(x), 40)}" for x in r.zipf(1.5, size=r.integers(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 5, 20, 30, 60, 500])
def test_vocabulary_with_pairs_by_brute_force(spark, size):
    from collections import Counter

    rows = [(i // 2, x) for i, x in enumerate(zipf_texts(size))] + [(None, "w1 w2 w1 w2"), (7, None)]
    df, cf = Counter(), Counter()
    for k in {k for k, _ in rows}:
        own = Counter()
        for _, x in (row for row in rows if row[0] == k and row[1]):
            ws = x.split()
            own.update(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
        df.update(own.keys())
        cf.update(own)
    want = sorted(((t, df[t], n) for t, n in cf.items() if df[t] >= 2), key=lambda x: (-x[2], x[0]))[:size]
    docs = spark.createDataFrame(rows, "k long, t string")
    assert list(map(tuple, terms.vocabulary(terms.dealt(docs, "k", "t"), "k", "t", size).collect())) == want


@pytest.mark.parametrize("n", [1, 3, 10, 200])
def test_clouds_with_pairs_by_brute_force(spark, n):
    from collections import Counter

    rows = [(g, x) for g in ("a", "b", None) for x in zipf_texts(n + ord(g or "c"))] + [("few", "w1 w1 w2"), ("none", "x")]
    want = set()
    for g in ("a", "b", "few", None):
        own = Counter()
        for _, x in (row for row in rows if row[0] == g):
            ws = [w for w in x.split() if len(w) > 1]
            own.update(t for t in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])] if t not in ("w1", "w1 w2"))
        best = sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n]
        want |= {(g, i + 1, t, c, c / best[0][1]) for i, (t, c) in enumerate(best)}
    got = terms.term_weights(spark.createDataFrame(rows, "g string, t string"), "g", "t", n, ("w1", "w1 w2"), longest=2).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_pairs_of_rare_words_are_not_counted(spark):
    df = spark.createDataFrame([(k, f"aa bb aa bb rare{k % 3} rarer{k % 5}") for k in range(30)], "k long, t string")
    few = spark.createDataFrame([("aa",), ("bb",)], "__word string")
    assert {x.term for x in terms.pairs_of(df, ["k"], F.col("t"), few, []).collect()} == {"aa bb", "bb aa"}
