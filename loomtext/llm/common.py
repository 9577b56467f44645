"""Helpers shared by the training-data operators.

Conventions: operators take and return DataFrames; working columns start with ``__`` so that a
caller's extra columns cannot clash with them; lineage is cut with ``checkpoint()`` only, in the
folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

#: ASCII white space, as every word rule of this package means it.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later steps neither recompute nor lose it.

    The folder comes from the session's ``spark.checkpoint.dir``; only a session on one machine (unit tests) may go without.
    """
    return checkpointed(df)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., which no working column is, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def renamed_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of a ``numbered`` table under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]++")), F.lit(0)).cast("long")


def hash_bucket(key: Column, n: int) -> Column:
    """A bucket from 0 to n - 1 (n at most 65536) from an md5 prefix; null has a bucket of its own kind."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.coalesce(F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % F.lit(n), F.lit(0))


def ranks(df: DataFrame, keys: list[str], salt: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place (from 1) of each row among the rows with equal ``keys``, by ``salt`` and then ``order``.

    No task sees all rows of a key: rows are numbered within (keys, salt), and the starts come from
    prefix sums over the counts per salt, which are as few as there are salts. ``keys`` and ``salt`` are not null.
    """
    counts = df.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy(salt).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*keys, salt, F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy(*keys, salt).orderBy(*order))
    return df.withColumn("__own", own).join(starts, [*keys, salt]).withColumn(name, F.col("__own") + F.col("__start")).drop("__own", "__start")


def map_arrow(df: DataFrame, columns: list[str], schema: str, fn: Callable[..., Iterator[dict]]) -> DataFrame:
    """``fn`` over Arrow batches of ``columns``: gets one Python/Arrow column each, yields dicts of output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(*[batch.column(i) for i in range(batch.num_columns)]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in kind], schema=kind)

    return df.select(*columns).mapInArrow(run, schema)


def dealt_anew(key: str) -> Column:
    """The long ``key`` as a value that the planner does not know to be grouped by already.

    A join of rows with sums over the same key would else reuse the grouping's partitioning, and a join whose side is
    not a plain exchange is never split where a key is hot.
    """
    return F.bitwise_not(F.bitwise_not(F.col(key)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (``node``, ``root``) for every node that has an edge; root is the smallest node reached.

    ``edges`` has long columns ``a`` and ``b``. Alternating large-star and small-star rounds; each
    round is aggregated before it is shuffled and is checkpointed, nothing is collected but a count
    and a checksum. The sums of a node meet its edges through an exchange of their own, so that the engine can
    split the join where a node is hot. Self edges and repeats are harmless; an empty table gives an empty result.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen or now["n"] == 0:
            break
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = saved(small.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


class Forest:
    """Union-find over 0..n-1 for the links found inside one task."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def join_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """``join`` of the pairs (i, j), all at a time: roots are hooked to smaller ones until no pair has two."""
        while len(i):
            up = self.roots()
            a, b = up[i], up[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        while ((up := self.up[self.up]) != self.up).any():
            self.up = up
        return self.up
