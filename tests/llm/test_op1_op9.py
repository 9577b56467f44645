"""Mixing and licence scans: SQL, brute force and edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.llm import op1_mixing as o1, op9_licenses as o9

from ..compare import assert_same
from .helpers import DOCS, documents


@pytest.mark.parametrize("op", [o1, o9])
def test_against_sql(spark, sf, op):
    for name, f in op.QUERIES.items():
        assert_same(f(spark, sf), sf, op.ORACLE[name])


def test_taken_words_come_near_the_targets(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["x"] * r.randrange(400)), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    got = o1.mix(documents(spark, rows)).collect()
    assert len(got) == 3000 and all(0 <= x["__copies"] <= 3 for x in got)
    for s in ("a", "b", "c", "d", None):
        own = [x for x in got if x.source == s]
        taken = sum(x["__copies"] * x["__size"] for x in own)
        assert sum(x["__size"] for x in own) == own[0]["__source_size"]
        assert abs(taken - own[0]["__target"]) <= 0.01 * own[0]["__target"] + 400
    assert sum({x.source: x["__target"] for x in got}.values()) == pytest.approx(sum(x["__size"] for x in got))


def targets(sizes):
    """The contract's rule, step by step."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        share = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def test_targets_stop_at_three_times_and_the_excess_is_reshared(spark):
    for seed in range(6):
        r = random.Random(seed)
        sizes = {f"s{i}": r.choice([0, 1, 5, 40, 3000]) for i in range(r.randrange(1, 9))} | {None: r.randrange(50)}
        df = spark.createDataFrame(list(sizes.items()), "__src string, source_size long")
        got = {x["__src"]: x.target for x in o1.source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def test_mixing_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b", None), (None, "a b", None), (5, " \t\x0b "), (6, "x" * 300_000), (7, "é b c")]
    df = documents(spark, rows).withColumn("size", F.lit("mine")).withColumn("target", F.lit(1))
    got = o1.mix(df).collect()
    assert len(got) == 7 and got[0].size == "mine"
    assert sorted(x["__size"] for x in got) == [0, 0, 0, 1, 2, 2, 2]
    assert sorted(map(str, got)) == sorted(map(str, o1.mix(df.repartition(5)).collect()))
    mixed = o1.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x["__copies"] for x in got)
    empty = o1.mix(spark.createDataFrame([], DOCS))
    assert empty.count() == 0


BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licences_by_brute_force(spark):
    r = random.Random(3)
    bag = "cc by general public license all rights reserved CC-BY é x9 the. All RIGHTS 3 K İ".split()
    texts = [None, "", "cc", "by", "cc by", "cc\x00by", "CC_BY-cc  by"] + [" ".join(r.choice(bag) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += ["word " * 60_000 + "all rights reserved"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in o9.scan_licenses(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(t), t
        assert 0 <= x.score <= 1 and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))


def test_licences_with_words_put_in_and_repeated_rows(spark):
    mit = "Permission is hereby granted, free of charge, to any honest person obtaining a copy of this software"
    df = documents(spark, [(1, mit), (1, mit), (None, "nothing here"), (2, "permission is granted")]).withColumn("labels", F.lit(0))
    got = sorted((x.doc_id or 0, x.labels) for x in o9.scan_licenses(df).collect())
    assert got == [(0, ""), (1, "mit"), (1, "mit"), (2, "")]
    assert o9.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("op", "name"), [(o1, "op1_mixing"), (o9, "op9_licenses")])
def test_no_python_on_the_executors(spark, sf, op, name):
    plan = op.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)
