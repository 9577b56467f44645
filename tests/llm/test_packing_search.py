"""Packing and neighbour search against exact answers."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import op5_packing as o5, op6_neighbours as o6

from .helpers import DOCS, documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(o5.vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer(tokenizer):
    r, encoder = random.Random(1), o5.Encoder(o5.vocabulary())
    some, low = "ab cD\t\n\x0b'sS're1 2,.;-éÉßK<|end>\xad\xa0ıŉǅ'll''¨½²ªºİȺ漢é", [chr(i) for i in range(0x300)]
    texts = ["", "<|endoftext|> x", "a" * 5000] + ["".join(r.choice(b) for _ in range(r.randrange(60))) for b in (some, low) for _ in range(1500)]
    for t in texts:
        assert encoder(t) == o5.packed(tokenizer.encode(t, add_special_tokens=False).ids), t


def checked(got, capacity):
    """No overlap, no gap, nothing above capacity; gives the number of sequences."""
    seats = defaultdict(list)
    for x in got:
        seats[x.sequence_id].append((x.offset, x.length))
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(seats)


def test_round_trip(spark, tokenizer):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of", "Zürich", "x1,", "漢字", "node.js"]) for _ in range(r.choice([0, 3, 50, 400, 3000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a b c"), (502, "a b c"), (None, "null key")]
    df = documents(spark, rows).withColumn("offset", F.lit("mine")).withColumn("length", F.lit(None).cast("string"))
    packed = o5.pack(df, o5.vocabulary(), with_ids=True)
    got = packed.collect()
    n = checked(got, o5.CAPACITY)
    assert n <= -(-sum(x.length for x in got) // o5.CAPACITY) + 1
    whole = defaultdict(list)
    for x in got:
        assert x.ids_crc32 == zlib.crc32(x.ids) and x.length == len(x.ids) // 4 and x.start == x.piece * o5.CAPACITY
        whole[x.doc_id].append(x)
    for k, t in {k: t for k, t in rows if k != 502}.items():
        data = b"".join(x.ids for x in sorted(whole[k], key=lambda x: x.piece))
        assert np.frombuffer(data, dtype="<u4").tolist() == ids_of(tokenizer, t)
        assert all(x.length == o5.CAPACITY for x in sorted(whole[k], key=lambda x: x.piece)[:-1])
    assert len(whole[502]) == 2 and len({(x.sequence_id, x.offset) for x in whole[502]}) == 2
    made = o5.sequences(packed).collect()
    assert len(made) == n and sum(len(x.ids) for x in made) == 4 * sum(x.length for x in got)


def test_packing_of_nothing(spark):
    assert o5.pack(spark.createDataFrame([], DOCS), o5.vocabulary()).count() == 0


def seats_of(histogram, runs):
    """Every (sequence, offset, length) that the runs give."""
    for length, n in histogram.items():
        own = runs[runs[:, 0] == length]
        for rank in range(n):
            r = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            k = rank - r[1]
            yield r[2] + k // r[3], r[4] + k % r[3] * length, length


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_near_the_bound(seed):
    r, cap = random.Random(seed), 100
    histogram = dict(Counter(min(cap, max(1, int(r.lognormvariate(3, 1)))) for _ in range(r.randrange(1, 3000))))
    bins = defaultdict(list)
    for s, offset, length in seats_of(histogram, o5.plan(histogram, cap)):
        bins[s].append((offset, length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= cap
    words, large = sum(k * n for k, n in histogram.items()), sum(n for k, n in histogram.items() if 2 * k > cap)
    assert sum(map(len, bins.values())) == sum(histogram.values()) and len(bins) <= 1.05 * max(-(-words // cap), large) + 1
    assert all(sum(3 * length > cap for _, length in b) <= 2 for b in bins.values())


def exact(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in asked:
        score = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_recall_and_scores_on_the_tables(spark, sf, table):
    path = sf.replace("sf0.001", table)
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = exact(rows, [k for k, _ in rows if k % 20 == 0], 20)
    got = defaultdict(list)
    for x in o6.op6_neighbours(spark, path).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    by = {k: np.array(v, dtype=np.float32).astype(np.float64) for k, v in rows}
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert found == [(i + 1, k, s) for i, (s, k) in enumerate(sorted(((s, k) for _, k, s in found), key=lambda x: (-x[0], x[1])))]
        assert all(abs(s - float(by[q] @ by[k])) < 1e-12 for _, k, s in found)
    recall = np.mean([len({k for _, k, _ in got[q]} & {k for k, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.95


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_over_several_units_splits_and_groups(spark, monkeypatch, clusters):
    monkeypatch.setattr(o6, "LEAST_ROWS", 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 32)) if not clusters else rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 2000)] + 0.3 * rng.normal(size=(2000, 32))
    x = (x * np.random.default_rng(2).uniform(0.5, 2, (2000, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = exact(rows, range(0, 2000, 20), 20), defaultdict(set)
    for r in o6.nearest(df, F.col("vec_id") % 20 == 0, unit=60, group=40).collect():
        got[r.query_id].add(r.vec_id)
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len(got[q] & {k for k, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_clustered_queries_are_routed_to_few_units(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 32))[rng.integers(0, 100, 4000)] + 0.2 * rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").withColumn("q", F.col("id") % 20 == 0).withColumn("d", F.lit(32))
    plan = o6._plans(df, o6.PIVOTS, o6.PREFIX, o6.SAMPLE, o6.SHARE, 20, o6.UNIT)
    o6._probed(df, plan, 20, o6.PROBES, o6.REACHED)
    assert plan[32]["visits"] <= plan[32]["units"] // 2


def test_footrule_from_the_files_is_the_footrule_of_the_prefixes():
    rng = np.random.default_rng(4)
    x, pivots, prefix = rng.normal(size=(30, 8)), o6.farthest_first(rng.normal(size=(40, 8)), 20), 6
    file, own = o6.files(x, pivots, prefix), o6.places(x, pivots, prefix)
    for order in own:
        near = o6.likeness(file, order, prefix)
        for j, other in enumerate(own):
            at, to = ({int(p): i for i, p in enumerate(o)} for o in (order, other))
            distance = sum(abs(at.get(p, prefix) - to.get(p, prefix)) for p in {*at, *to})
            assert distance == prefix * (prefix + 1) - 2 * near[j]


def test_lengths_are_searched_apart_and_one_odd_vector_takes_nothing_from_the_others(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(0, rows[0][1][:5]), *rows[1:]]
    monkeypatch.setattr(o6, "MOST_LENGTHS", 1)
    both = [*odd, *[(1000 + i, v[:3]) for i, (_, v) in enumerate(rows[:30])]]
    got = defaultdict(list)
    for r in o6.nearest(spark.createDataFrame(both, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5, share=1.0, reached=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert 0 not in got  # no other vector has its length
    assert set(got) == {*range(20, 300, 20), 1000, 1020}
    want = exact(rows[1:], range(20, 300, 20), 5) | exact([(k, v) for k, v in both if k >= 1000], (1000, 1020), 5)
    assert all(got[q] == [k for k, _ in want[q]] for q in got)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine")).withColumn("q", F.lit(1))
    got = defaultdict(list)
    for x in o6.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert got == {0: [(2, 2.0), (1, 1.0), (9, 1.0), (20, -1.0)], 20: [(0, -1.0), (1, -1.0), (9, -1.0), (2, -2.0)]}
    assert o6.nearest(df.limit(0), F.lit(True)).count() == 0
    assert o6.nearest(df.where("vec_id = 3"), F.lit(True)).count() == 0
