"""Recommendation: exact vector search and TF-IDF cosine as a join on terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import checkpointed, small_side
from .nearest import Best
from .terms import MIN_DF, SIZE, Clean, as_it_is, dealt, term_counts, vocabulary, weighed

#: Queries that are broadcast at a time.
QUERY_BLOCK = 4096
#: Items that a task of a vector search has at most, about.
ITEMS_PER_TASK = 50_000


def ranked(scored: DataFrame, query: str, score: str, key: str, n: int) -> DataFrame:
    """Per query the ``n`` best rows, nulls last, ties to the smaller key."""
    place = F.row_number().over(W.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), key))
    return scored.withColumn("rank", place).where(F.col("rank") <= n)


def vector_top_n(items: DataFrame, queries: DataFrame, key: str, vector: str, n: int = 5, cosine: bool = True, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, key, sim_score): exact search of every query in all other items.

    The queries go in blocks of about ``block``, dealt by hash; the items are dealt over all cores once and meet the blocks one
    after another, so that what is broadcast at a time is one block, whatever the number of queries. Every task keeps its best
    ``n`` of each query (``nearest``). Pairs with a vector that is null, holds null, NaN or huge components or is not as long
    as most are scored by the column expression instead.
    """
    asked = checkpointed(queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("__q")))
    items = items.where(F.col(key).isNotNull())
    kind = dict(items.dtypes)[key]
    width = asked.agg(F.coalesce(F.mode(F.size("__q")), F.lit(0))).first()[0]
    even = lambda v: F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 1e100)), F.lit(False))
    a, b = F.col(vector), F.col("__q")
    score = vectors.cosine(a, b) if cosine else vectors.dot(a, b)
    blocks = max(1, -(-asked.count() // block))
    parts = max(items.sparkSession.sparkContext.defaultParallelism, -(-items.count() // ITEMS_PER_TASK))
    own = items.where(even(a)).select(F.col(key).alias("k"), a.cast("array<double>").alias("v")).repartition(parts)
    if blocks > 1:
        own = checkpointed(own)
    odd_items, odd_asked = items.where(~even(a)), asked.where(~even(b))
    plain = [(odd_items, asked), (items.where(even(a)), odd_asked)]
    found = None
    for x, y in plain:
        if x.isEmpty() or y.isEmpty():
            continue
        own_score = x.crossJoin(y if y.count() > block else F.broadcast(y)).where(F.col(key) != F.col("query_id")).withColumn("sim_score", F.round(score, digits))
        part = ranked(own_score, "query_id", "sim_score", key, n).select("query_id", F.col(key).alias("k"), "sim_score")
        found = part if found is None else found.unionByName(part)
    for i in range(blocks):
        here = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).where(even(b)).select("query_id", b.cast("array<double>").alias("q")).toArrow()
        if here.num_rows:
            part = _best(own, here, kind, n, cosine, digits)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], f"query_id {kind}, k {kind}, sim_score double")
    return ranked(found.withColumnRenamed("k", key), "query_id", "sim_score", key, n).select("query_id", "rank", key, "sim_score")


def _best(own: DataFrame, asked: pa.Table, kind: str, n: int, cosine: bool, digits: int) -> DataFrame:
    """(query_id, k, sim_score): every task's ``n`` best rows of ``own`` (k, v) for each query of one block."""
    column = asked.column(1).combine_chunks()
    held = own.sparkSession.sparkContext.broadcast((asked.column(0).combine_chunks(), column.flatten().to_numpy().reshape(len(column), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = held.value
        best = Best(ids.to_numpy(zero_copy_only=False), queries, n, cosine, digits)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), pa.array(best.key, type=ids.type), pa.array(best.score)], names=["query_id", "k", "sim_score"])

    scored = own.mapInArrow(run, f"query_id {kind}, k {kind}, sim_score double")
    return scored.withColumn("sim_score", F.round("sim_score", digits))


def tfidf_top_n(items: DataFrame, queries: DataFrame, key: str, query_key: str, text: str, n: int = 5, size: int = SIZE, min_df: int = MIN_DF, longest: int = 1, digits: int = 6, clean: Clean = as_it_is) -> DataFrame:
    """(query_key, rank, key, sim_score): TF-IDF cosine of every query with all items that share a term.

    Vocabulary and idf come from the items. The weighed queries are written once and, if few enough, broadcast: the items'
    postings then stay where they are, products are summed there and only each partition's best go on.
    """
    own = dealt(items, key, text)
    vocab = checkpointed(vocabulary(own, key, text, size, min_df, longest, clean))
    docs = items.agg(F.count(F.lit(1)).alias("__docs"))
    ours = weighed(term_counts(own, key, text, vocab, longest, clean).crossJoin(F.broadcast(docs)), key, F.col("__docs"))
    theirs = weighed(term_counts(dealt(queries, query_key, text), query_key, text, vocab, longest, clean).crossJoin(F.broadcast(docs)), query_key, F.col("__docs"))
    asked = small_side(theirs.select(query_key, "term", F.col("tfidf").alias("__q")))
    scored = ours.join(asked, "term").groupBy(query_key, key).agg(F.round(F.sum(F.col("tfidf") * F.col("__q")), digits).alias("sim_score"))
    return ranked(scored, query_key, "sim_score", key, n).select(query_key, "rank", key, "sim_score")


def encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> Callable[[Column], Column]:
    """A text encoder from outside as a column function; ``load`` runs once a worker, texts go in batches."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            listed = [t or "" for t in texts]
            yield pd.Series([v for i in range(0, len(listed), batch) for v in model(listed[i : i + batch])], index=texts.index)

    return encode


def recommend(text: str, items: DataFrame, key: str, vector: str, encode: Callable[[Column], Column], n: int = 5) -> DataFrame:
    """The ``n`` items nearest to one text by cosine: all their columns and ``sim_score``."""
    from ..functions.text import clean

    query = items.sparkSession.createDataFrame([(text,)], "t string").select(encode(clean(F.col("t"))).alias("__q"))
    scored = items.crossJoin(F.broadcast(query)).withColumn("sim_score", vectors.cosine(F.col(vector), F.col("__q"))).drop("__q")
    return scored.orderBy(F.col("sim_score").desc_nulls_last(), key).limit(n)
