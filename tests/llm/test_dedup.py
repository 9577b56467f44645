"""SimHash near-duplicates and substring dedup by brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import common, op4_simhash as o4, op7_substrings as o7

from .helpers import DOCS, documents, words


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_by_brute_force():
    r = random.Random(2)
    texts = [None, "", " \t ", "One", "one two", "A B C", "é É x", "\x1c a\x85b c"] + [" ".join(r.choice(["a", "B", "cc", "Dd", "ü"]) + " " * r.randrange(2) for _ in range(r.randrange(40))) for _ in range(200)]
    assert [o4.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def near_corpus():
    r = random.Random(7)
    rows = [(100, None), (101, ""), (102, " ")]
    for g in range(12):
        base = words(900, g)
        for c in range(6):
            w = list(base)
            for _ in range(c):
                w[r.randrange(len(w))] = "new"
            rows.append((1000 - 10 * g - c, " ".join(w)))
    return rows + [(5, rows[3][1]), (6, "short text"), (7, "other text"), (6, "short text")]


def test_components_by_brute_force(spark):
    rows = near_corpus()
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(fps)
    low = defaultdict(lambda: 10**9)
    for (k, _), r in zip(rows, roots, strict=True):
        low[r] = min(low[r], k)
    want = sorted((k, f, low[r]) for (k, _), f, r in zip(rows, fps, roots, strict=True))
    df = documents(spark, rows).withColumn("component_id", F.lit("mine")).withColumn("__n", F.lit(1))
    got = sorted((x.doc_id, x["__fp"] % 2**64, x.component_id) for x in o4.near_duplicates(df).collect())
    assert got == want
    kept = o4.deduplicated(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted({c for *_, c in want})


def test_links_of_a_filing_that_is_cut_in_parts(spark):
    r = np.random.default_rng(3)
    seeds = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = sorted({int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in r.integers(32, 64, (12, 2))})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "__fp long")
    whole, cut = (dict((x.node, x.root) for x in common.components(o4.links(df, part=p)).collect()) for p in (4096, 8))
    roots = slow_components(fps)
    size = defaultdict(int)
    for x in roots:
        size[x] += 1
    assert whole == cut and len(set(whole.values())) == sum(n > 1 for n in size.values()) and len(whole) == sum(n for n in size.values() if n > 1)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 4), (4, 3), (9, 8), (8, 3), (7, 6), (6, 7)]])
def test_components_of_graphs(spark, edges):
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    nodes = {x for e in real for x in e}
    want = {n: n for n in nodes}
    for _ in nodes:
        for a, b in real:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert o4.near_duplicates(empty).count() == 0 and o4.deduplicated(empty).count() == 0
    nulls = documents(spark, [(None, "a b c d"), (None, "a b c d"), (3, "q r s t u")])
    assert sorted(map(str, (x.doc_id for x in o4.deduplicated(nulls).collect()))) == ["3", "None"]


def planted():
    passage = words(60, 999)
    rows = []
    for i in range(40):
        w = words(300, i, 100_000)
        if i % 4 == 0:
            w[100:100] = passage
        rows.append((i, "\n".join(" ".join(w[j : j + 25]) for j in range(0, len(w), 25))))
    return rows, passage


def test_a_planted_passage_stays_in_one_document_and_others_are_left_alone(spark):
    rows, passage = planted()
    after = {x.doc_id: x.text for x in o7.without_repeats(documents(spark, rows)).collect()}
    assert set(after) == {k for k, _ in rows}
    hits = [k for k, t in after.items() if " ".join(passage[15:45]) in " ".join(t.split())]
    assert len(hits) == 1
    for k, t in rows:
        if k % 4 or k == hits[0]:
            assert after[k] == t
        else:
            left = after[k].split()
            assert set(words(300, k, 100_000)) - set(left) == set() or len(t.split()) - len(left) <= 60
            assert not any(left[i : i + 30] == passage[j : j + 30] for i in range(len(left)) for j in range(31))


def test_similar_lines_are_found_as_brute_force_finds_them(spark):
    r = random.Random(4)
    lines = []
    for g in range(60):
        base = words(r.randrange(25, 60), g)
        for _ in range(3):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            lines.append(" ".join(w))
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "__row long, __text string")
    found = {x.line: x.cluster for x in o7.line_clusters(rows).collect()}
    w = o7.Words([t.encode() for t in lines])
    keys = o7.lines(w)[2].tolist()
    want = {frozenset(keys[i] for i in range(len(lines)) if find(i) == r0) for r0 in map(find, range(len(lines)))}
    groups = defaultdict(set)
    for k, c in found.items():
        groups[c].add(k)
    assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1}


def test_words_repeated_over_and_over_are_cut_at_even_steps():
    a = o7.Words([("x y z " + "to " * 80).encode(), ("q r " + "to " * 70).encode()])
    first, n, h = o7.cuts(a)
    assert len(set(h[n == 6].tolist())) == 1 and (n == 6).sum() >= 20


def test_cuts_do_not_depend_on_the_other_texts():
    texts = [" ".join(words(200, i)).encode() for i in range(5)]
    together = o7.cuts(o7.Words(texts))
    alone = [h for t in texts for h in o7.cuts(o7.Words([t]))[2].tolist()]
    assert together[2].tolist() == alone


def test_substring_edges(spark):
    line = " ".join(words(30, 1))
    rows = [(1, None), (2, ""), (3, "short"), (4, line), (4, line), (5, line), (None, line), (6, line.upper() + "\né ü"), (7, "z " * 150_000)]
    df = documents(spark, rows).withColumn("start", F.lit("mine")).withColumn("cluster", F.lit(0))
    out = o7.without_repeats(df)
    assert out.columns == df.columns
    kept = out.collect()
    holders = {x.doc_id for x in kept if line in (x.text or "").lower()}
    assert len(holders) == 1  # both rows of doc 4 are one document
    assert {1, 2, 3, 7} <= {x.doc_id for x in kept}
    assert o7.passages(spark.createDataFrame([], DOCS)).count() == 0 and o7.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    spans = o7.passages(df).collect()
    assert all(x.start < x.end and x.n_words >= o7.LINE for x in spans)


@pytest.mark.parametrize("gap", [" ", "   ", "\r\n\r\n", "\n \t  "])
def test_pieces_are_joined_over_white_space_of_any_length(spark, gap):
    passage = words(60, 999, 10**6)
    rows = [(i, gap.join([*words(40, i, 10**6), *passage, *words(40, 50 + i, 10**6)])) for i in range(2)]
    found = o7.passages(documents(spark, rows)).collect()
    assert sorted(x.removed for x in found) == [False, True]
    for x in found:
        cut = [t.encode()[x.start : x.end].decode().split() for _, t in rows]
        assert any(len(c) == x.n_words >= 30 and " ".join(c) in " ".join(passage) for c in cut)


def slow_runs(texts, least):
    """Places (text, first word, end) of the maximal runs of ``least`` and more words whose windows are in another text too."""
    where = defaultdict(set)
    split = [t.lower().split() for t in texts]
    for i, w in enumerate(split):
        for j in range(len(w) - least + 1):
            where[tuple(w[j : j + least])].add(i)
    out = []
    for i, w in enumerate(split):
        on = [len(where[tuple(w[j : j + least])]) > 1 for j in range(len(w) - least + 1)]
        j = 0
        while j < len(on):
            if on[j]:
                k = j
                while k < len(on) and on[k]:
                    k += 1
                out.append((i, j, k - 1 + least))
                j = k
            j += 1
    return out


def test_passages_against_brute_force(spark):
    """Every repeat of over 50 words is met, no word that is in one text only is removed, and one copy of each stays."""
    r, texts = random.Random(12), []
    shared = [words(r.randrange(51, 120), 700 + i, 10**6) for i in range(12)]
    for i in range(50):
        w = words(r.randrange(60, 200), i, 10**6)
        for p in r.sample(shared, r.randrange(3)):
            at = r.randrange(len(w))
            w[at:at] = p
        gap = r.choice([" ", "\n", "  "])
        texts.append(gap.join(w))
    found = o7.passages(documents(spark, list(enumerate(texts))))
    ids = documents(spark, list(enumerate(texts))).select(F.xxhash64("doc_id", "text").alias("__row"), "doc_id")
    spans = [(x.doc_id, x.start, x.end, x.removed) for x in found.join(ids, "__row").collect()]
    covered = defaultdict(set)
    for k, a, b, _ in spans:
        data = texts[k].encode()
        first = len(data[:a].split())
        covered[k] |= set(range(first, first + len(data[a:b].split())))
    runs = slow_runs(texts, 51)
    assert runs and all(covered[k] & set(range(a, b)) for k, a, b in runs)
    repeated = defaultdict(set)
    for k, a, b in slow_runs(texts, 5):
        repeated[k] |= set(range(a, b))
    assert all(c <= repeated[k] for k, c in covered.items())
    # What one text loses, its keeper keeps.
    left = [x.text or "" for x in o7.without_repeats(documents(spark, list(enumerate(texts)))).collect()]
    assert {w for t in texts for w in t.split()} == {w for t in left for w in t.split()}
