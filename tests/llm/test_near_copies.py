"""Near copies of whole documents by brute force."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from loomtext.llm import banding, near_copies as nc, op4_simhash as o4
from loomtext.llm.common import components

from .helpers import DOCS, documents, words


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def slow_kept(rows):
    """Smallest key of every component over pairs of Jaccard 0.8 or more."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = defaultdict(lambda: 10**9)
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], k)
    return sorted(low.values())


def edited_corpus():
    r, rows = random.Random(8), []
    for g in range(40):
        base = words(r.randrange(60, 400), g, 50_000)
        for c in range(4):
            w = list(base)
            for _ in range(r.choice((0, 1, 3, len(w) // 60, len(w) // 20))):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((1000 - 10 * g - c, " ".join(w)))
    return rows + [(2001, "short text"), (2002, "Short  text"), (2003, "other text"), (2004, ""), (2005, "  "), (2006, None)]


def test_the_stage_keeps_one_of_edited_copies_as_brute_force_does(spark):
    rows = edited_corpus()
    df = documents(spark, rows)
    out = corpus_pipeline.near_dedup(spark, df, "")
    want = slow_kept(rows)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == want and len(want) < 120


def test_links_of_a_star_are_those_of_all_its_pairs(spark):
    """Texts that are not like the head meet all others, in parts; near copies of the head are not compared further."""
    r, sets = random.Random(3), {0: set(range(100))}
    for i in range(1, 40):
        sets[i] = set(range(i % 4, 100 + i % 4)) if i < 20 else set(range(50 * (i // 4), 50 * (i // 4) + 60)) | {r.randrange(10**6) for _ in range(3)}
    want = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    star = spark.createDataFrame([(i, 0) for i in range(1, 40)], "a long, b long")
    listed = spark.createDataFrame([(i, bytearray(np.array(sorted(s), dtype=np.uint64).tobytes())) for i, s in sets.items()], "node long, set binary")
    many = {i for i in want if sum(x == want[i] for x in want.values()) > 1}
    for part in (3, 512):
        assert {x.node: x.root for x in components(banding.links(star, listed, np.uint64, part)).collect()} == {i: want[i] for i in many}


def test_rows_are_decided_one_by_one(spark):
    a, b, c = (" ".join(words(30, s)) for s in (1, 2, 3))
    rows = [(1, a), (1, b), (0, b), (None, c), (None, a), (None, a), (1, a)]
    assert sorted((str(x.doc_id), x.text) for x in nc.without_near_copies(documents(spark, rows)).collect()) == sorted([("1", a), ("0", b), ("None", c)])
    assert nc.without_near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_candidates_come_from_the_tiles_of_op4_only(spark, monkeypatch):
    """Without the tiled comparison only texts of the same words are one."""
    rows = edited_corpus()
    monkeypatch.setattr(nc, "compared", lambda rows, *_: spark.createDataFrame([], "a long, b long"), raising=False)
    low = {}
    for k, t in rows:
        same = " ".join((t or "").lower().split())
        low[same] = min(k, low.get(same, k))
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()) == sorted(low.values())


def test_filed_texts_are_kept_as_brute_force_does(spark):
    rows = edited_corpus()
    assert nc.key_plan(len(rows), 16) == (4, 16)
    assert sorted(x.doc_id for x in nc.without_near_copies(documents(spark, rows), filed=16).collect()) == slow_kept(rows)


def test_simhashes_are_sums_of_votes_of_distinct_shingles(spark):
    r = np.random.default_rng(5)
    sets = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 4, 84, 85, 86, 400)]
    sets[3] = np.concatenate([sets[3], sets[3][:7]])
    got = np.unpackbits(nc.simhashes(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 9), axis=1)
    for i, s in enumerate(sets):
        votes = []
        for j in range(9):
            h = [int(x) for x in nc.hashed(nc.mix(np.unique(s) >> np.uint64(20)), j)]
            votes += [sum(2 * (x >> 8 * field + 2 * shift & 3) - 3 for x in h) for shift in range(4) for field in range(8)]
        assert got[i].tolist() == [int(v > 0) for v in votes]


def test_pairs_just_at_the_similarity_differ_within_the_radius():
    r = np.random.default_rng(6)
    for both, a, b in ((4, 0, 1), (8, 1, 1), (80, 10, 10), (400, 50, 50)):
        x = [r.integers(0, 1 << 63, both + a + b, dtype=np.uint64) for _ in range(500)]
        sets = [s for v in x for s in (v[: both + a], np.concatenate([v[:both], v[both + a :]]))]
        prints = nc.simhashes(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 2 * nc.PRINT)
        bits = np.unpackbits(prints, axis=1)
        apart = (bits[::2] != bits[1::2]).mean(axis=1)
        assert apart.mean() < nc.APART + 0.003
        assert (bits[::2, : 64 * nc.PRINT] != bits[1::2, : 64 * nc.PRINT]).sum(axis=1).max() <= nc.RADIUS


def test_tiles_of_several_words_link_as_all_pairs_do():
    r = np.random.default_rng(7)
    f = np.repeat(r.integers(0, 1 << 63, (30, 3), dtype=np.uint64), 4, axis=0) ^ np.uint64(1) << r.integers(0, 40, (120, 3), dtype=np.uint64)
    root = np.arange(120)
    for _ in range(120):
        near = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2) <= 6
        root = np.where(near, root[None], 999).min(axis=1)
    got = o4.tile_links(f, 6, 16)
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(120) for j in range(120)) and len(set(root)) == 30


def test_hot_filings_are_compared_in_parts(spark):
    r = np.random.default_rng(8)
    base = r.integers(-(1 << 62), 1 << 62, (20, 3))
    rows = [(int(i), *[int(x) for x in base[i % 20] ^ (1 << r.integers(0, 60, 3))], 0, 7) for i in range(200)]

    def all_pairs(rows):
        found = list(o4.tile_pairs(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), 6, 16, first=(1, 2)))
        return tuple(rows[np.concatenate([f[k] for f in found]), 0] for k in (0, 1))

    df = spark.createDataFrame(rows, "node long, p0 long, p1 long, p2 long, c long, v long")
    for part in (16, 4096):
        found = components(o4.compared(df, ["node", "p0", "p1", "p2"], all_pairs, part)).collect()
        assert {x.node: x.root for x in found} == {i: i % 20 for i in range(200)}


def unlike_corpus():
    """One group in which all are within the radius of each other and most pairs are under 0.8, and a few texts besides."""
    r, rows, base = random.Random(12), [], words(150, 99, 50_000)
    for i in range(160):
        w = list(base)
        for _ in range(r.choice((1, 2, 4, 4, 5, 6))):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(500 + i, " ".join(words(50, i))) for i in range(20)]


def test_no_step_returns_the_pairs_of_a_group_that_prove_unlike(spark, monkeypatch):
    rows, made = unlike_corpus(), []
    told = nc.compared
    monkeypatch.setattr(nc, "compared", lambda *a: made.append(told(*a)) or made[-1])
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()) == slow_kept(rows)
    assert len(made) == 2 and all(len(set(df.collect())) == df.count() < 160 for df in made)


def test_a_cluster_is_dealt_over_few_parts_unless_they_are_too_large(spark, monkeypatch):
    r = random.Random(4)
    sets = {i: set(range(i % 5 * 30, i % 5 * 30 + 40)) | {r.randrange(10**6) for _ in range(i % 3)} for i in range(60)}
    star = spark.createDataFrame([(i, 0) for i in range(1, 60)], "a long, b long")
    listed = spark.createDataFrame([(i, bytearray(np.array(sorted(s), dtype=np.uint64).tobytes())) for i, s in sets.items()], "node long, set binary")
    for most, size in ((2048, 1 << 22), (4, 1 << 22), (2048, 1000)):
        monkeypatch.setattr(banding, "MOST", most)
        monkeypatch.setattr(banding, "BYTES", size)
        assert {x.node: x.root for x in components(banding.links(star, listed, np.uint64, 3, few=2)).collect()} == {i: i % 5 for i in range(60)}


def test_a_unit_links_what_all_its_pairs_do(monkeypatch):
    r = np.random.default_rng(9)
    sets = [np.unique(r.integers(0, 40, n)) for n in r.integers(0, 40, 150)] + [np.zeros(0, dtype=np.int64)] * 2
    root = np.arange(len(sets))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (both := len(np.intersect1d(x, y))) and both >= 0.8 * (len(x) + len(y) - both):
                root[root == root[i]] = root[j]
    for waiting in (0, 1 << 18):
        monkeypatch.setattr(banding, "WAITING", waiting)
        got = np.arange(len(sets)) + 1000
        for a, b in banding.similar(np.arange(len(sets)), sets):
            got[a] = b + 1000
        assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(len(sets)))
