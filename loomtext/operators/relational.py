"""Code mapping, list aggregation, enrichment, projection, sampling and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import small_side


def map_codes(links: DataFrame, mapping: DataFrame, code: str, mapped_code: str | None = None) -> DataFrame:
    """Left join of a link table to its mapping table; null codes match null codes, repeated codes fan out.

    No hint: a mapping under the session's broadcast threshold is broadcast, a larger one is shuffled.
    """
    right = mapping.withColumnRenamed(mapped_code or code, "__code")
    return links.join(right, F.col(code).eqNullSafe(F.col("__code")), "left").drop("__code")


def distinct_names(mapped: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Per non-null key the distinct lower-cased names, sorted; keys with null names only get an empty array."""
    return mapped.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(F.lower(name))).alias(out))


def enrich(entities: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Left join of entities to their (unique) lists; entities without one get null."""
    return entities.join(lists, key, "left")


def renamed_and_dropped(df: DataFrame, renames: dict[str, str], drops: list[str]) -> DataFrame:
    """Columns renamed and dropped."""
    return df.withColumnsRenamed(renames).drop(*drops)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) by the order of a keyed md5: the same at every partitioning."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return df.orderBy(order, key).limit(n)


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: 'test' for the first ceil(share * n) rows of each label in md5 order, else 'train'.

    Each label's last test row is found from counts per md5 prefix and a ranking of the one prefix it falls in, so rows are
    neither sorted by label nor moved: they are compared with their label's last test row. (Rows equal to it in label
    and key are test rows too.)
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marks = df.select(F.col(label).alias("__label"), order.alias("__m"), F.col(key).alias("__key")).withColumn("__b", F.substring("__m", 1, 3))
    cells = marks.groupBy("__label", "__b").agg(F.count(F.lit(1)).alias("__n"))
    own = W.partitionBy("__label").orderBy(F.col("__b").asc_nulls_first())
    upto = cells.withColumn("__upto", F.sum("__n").over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("__want", F.ceil(F.sum("__n").over(W.partitionBy("__label")) * share))
    cut = upto.where((F.col("__upto") >= F.col("__want")) & (F.col("__upto") - F.col("__n") < F.col("__want"))).select(F.col("__label").alias("__l"), F.col("__b").alias("__c"), (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__at"))
    inside = marks.join(small_side(cut), F.col("__label").eqNullSafe(F.col("__l")) & F.col("__b").eqNullSafe(F.col("__c")))
    place = F.row_number().over(W.partitionBy("__label").orderBy("__m", "__key"))
    last = inside.withColumn("__place", place).where(F.col("__place") == F.col("__at")).select("__l", F.struct(F.col("__m"), F.col("__key")).alias("__last"))
    tested = F.col("__last").isNotNull() & F.coalesce(F.struct(order.alias("__m"), F.col(key).alias("__key")) <= F.col("__last"), order.isNull())
    return df.join(small_side(last), F.col(label).eqNullSafe(F.col("__l")), "left").withColumn("split", F.when(tested, "test").otherwise("train")).drop("__l", "__last")


def bag_union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats included, columns matched by name."""
    return reduce(DataFrame.unionByName, parts)


def top_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the largest score, nulls last, ties to the smaller key."""
    return df.orderBy(F.col(score).desc_nulls_last(), key).limit(n)


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(key).limit(n)
