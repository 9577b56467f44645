"""The pipeline as a whole."""

import corpus_pipeline
import __spark_entry__
from loomtext import llm

from pyspark.sql import functions as F

from .helpers import documents, words
from .test_packing_search import checked


def test_stages_keep_the_columns_and_only_lose_what_they_may(spark, sf, tmp_path):
    sf = sf.replace("0.001", "0.01")  # with more than a few dozen labels
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    last = None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = str(tmp_path / f"{i}-{name}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before, after = {x.doc_id for x in docs.collect()}, {x.doc_id for x in out.select("doc_id").collect()}
        assert after <= before
        if i < 4:
            assert out.dtypes == docs.dtypes
        if name == "toxicity":
            known = [labels[k] for k in before - after if k in labels]
            assert known and sum(known) >= 0.95 * len(known) and len(before - after) < 0.2 * len(before)
        if name in ("near_dedup", "substring_dedup"):
            assert len(after) > 0.8 * len(before) and out.count() == len(after)
        docs, last = out, out
    assert checked(last.collect(), 4096) > 0


def test_run_gives_the_columns_of_packing(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert set(llm.queries()) | {"pipeline"} <= set(names)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def odd_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_nulls_empties_repeats_and_clashing_columns_go_through(spark, tmp_path):
    rows = [(i, " ".join(words(60, i)) + (" vile" * 9 if i % 5 == 0 else "")) for i in range(60)]
    rows += [(100, None), (101, ""), (101, ""), (None, "a text without an id"), (1, rows[1][1]), (1, rows[1][1]), (102, "x " * 60_000)]
    names = ("predicted", "score", "held_out", "size", "__row", "__key", "__text", "node", "line", "root", "cluster", "start", "offset", "piece", "length", "rank")
    docs = documents(spark, rows).select("*", *[F.lit(n).alias(n) for n in names])
    out = corpus_pipeline.run(spark, odd_tables(spark, tmp_path, docs))
    found = out.collect()
    assert out.columns[0] == "doc_id" and {x.doc_id for x in found} <= {k for k, _ in rows}
    assert checked(found, 4096) > 0 and len({x.doc_id for x in found}) > 30


def test_every_stage_keeps_clashing_columns(spark, tmp_path):
    rows = [(i, " ".join(words(60, i)) + (" vile" * 9 if i % 5 == 0 else "")) for i in range(60)]
    docs = documents(spark, rows).select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in ("predicted", "score", "size", "__row", "cluster", "node")])
    sf = odd_tables(spark, tmp_path, docs)
    before = {x.doc_id: x for x in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(before[x.doc_id] == x for x in out.collect())


def test_a_pipeline_over_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path, documents(spark, []))).count() == 0
