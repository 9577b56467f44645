"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document is expected ``target / source_size`` times. The expected copies are
prefix-summed over the documents in size order, one offset per source is added, and a document is
emitted once for each integer boundary its own stretch crosses. Going by size makes the taken words
follow the target closely. The order is (size class, salt, id): a class is an eighth of an octave of
sizes, so no task ever orders all documents of a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import hash_bucket, numbered, renamed_back, saved, table, word_count

SALTS = 64
MOST = 3
STEPS = 1 << 20


def size_class(size: Column) -> Column:
    """16 * bit length + the next three bits of ``size``: integers only, so every engine agrees."""
    top = F.length(F.bin(size)).cast("long")
    unit = F.expr("shiftleft(1L, length(bin(__size)) - 1)")
    # Never null, or else joins on it put the whole expression in a null filter below and count words twice.
    return F.coalesce(top * 16 + F.floor(size * 8 / unit).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``__src, source_size, target`` from per-source sizes: shares by weight, none above ``most`` times its size.

    Resharing the excess by weight until none is above ends at min(most * size, level * weight) for one
    level; it is found from prefix sums in the order of size / weight. One row per source is ordered here,
    never documents.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(W.orderBy(F.col("__src").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size") * most)
    order = W.orderBy(F.col("__cap") / F.col("__w"), F.col("__src").asc_nulls_last())
    sums = weighed.withColumn("__caps", F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__ws", F.coalesce(F.sum("__w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.col("__caps")) / (F.sum("__w").over(every) - F.col("__ws"))
    free = sums.withColumn("__level", level).withColumn("__free", F.col("__level") * F.col("__w") <= F.col("__cap"))
    lowest = F.min(F.when(F.col("__free"), F.struct(F.col("__caps"), F.col("__ws"), F.col("__level")))).over(every)
    at = free.withColumn("__at", lowest)
    return at.select("__src", "source_size", F.when(F.col("__at").isNull() | (F.col("__cap") < F.col("__at.__level") * F.col("__w")), F.col("__cap").cast("double")).otherwise(F.col("__at.__level") * F.col("__w")).alias("target"))


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """All columns of ``df`` plus ``__size``, ``__source_size``, ``__target`` and ``__copies`` (0 to 3).

    A null source is a source of its own, last in code-point order; null text has size 0; documents of size
    0 are copied like others of their source (they carry no words) and a source without words has target 0.
    Repeated rows are sampled one by one, rows that share an id in the order of size and then of a hash of the text. Equal inputs give equal results whatever the partitioning, as all
    choices come from keys.
    """
    docs = df.withColumn("__size", word_count(F.col(text))).withColumn("__src", F.col(source)).withColumn("__id", F.col(key)).withColumn("__salt", hash_bucket(F.col(key), SALTS)).withColumn("__class", size_class(F.col("__size"))).withColumn("__tie", F.xxhash64(text))
    # Written once: all targets and starts come from these counts, so the texts are read for them once only.
    cells = saved(docs.groupBy("__src", "__class", "__salt").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words")))
    per_class = cells.groupBy("__src", "__class").agg(F.sum("__n").alias("__cn"), F.sum("__words").alias("__cw"))
    targets = source_targets(per_class.groupBy("__src").agg(F.sum("__cw").alias("source_size")), weights)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__src"), F.lit("\0")))), 1, 5), 16, 10).cast("double") / STEPS
    targets = targets.withColumn("__u", offset).withColumn("__rate", F.coalesce(F.expr("try_divide(target, cast(source_size as double))"), F.lit(0.0)))
    in_class = F.sum("__n").over(W.partitionBy("__src", "__class").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))
    in_source = F.sum("__cn").over(W.partitionBy("__src").orderBy("__class").rowsBetween(W.unboundedPreceding, -1))
    heads = per_class.withColumn("__before", F.coalesce(in_source, F.lit(0))).select(F.col("__src").alias("__s2"), F.col("__class").alias("__c2"), "__before")
    starts = cells.withColumn("__within", F.coalesce(in_class, F.lit(0))).join(heads, F.col("__src").eqNullSafe(F.col("__s2")) & (F.col("__class") == F.col("__c2")))
    starts = starts.select(F.col("__src").alias("__s3"), F.col("__class").alias("__c3"), F.col("__salt").alias("__a3"), (F.col("__before") + F.col("__within")).alias("__start"))
    rated = targets.select(F.col("__src").alias("__s4"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__u", "__rate")
    starts = starts.join(rated, F.col("__s3").eqNullSafe(F.col("__s4")))
    own = F.row_number().over(W.partitionBy("__src", "__class", "__salt").orderBy("__size", "__id", "__tie"))
    placed = docs.withColumn("__own", own).join(starts, F.col("__src").eqNullSafe(F.col("__s3")) & (F.col("__class") == F.col("__c3")) & (F.col("__salt") == F.col("__a3")))
    place = F.col("__own") + F.col("__start")
    copies = F.floor(F.col("__rate") * place + F.col("__u")) - F.floor(F.col("__rate") * (place - 1) + F.col("__u"))
    return placed.withColumn("__copies", F.least(copies, F.lit(MOST)).cast("int")).select(*df.columns, "__size", "__source_size", "__target", "__copies")


def mixed_documents(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The mixture itself: every row of ``df`` as often as it was drawn, with its own columns only, whatever these are called."""
    plain, names = numbered(df)
    drawn = mix(plain, names[source], names[text], names[key], **options)
    return renamed_back(drawn.withColumn("__copy", F.explode(F.expr("slice(array(1, 2, 3), 1, __copies)"))), names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document."""
    drawn = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return drawn.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


ORACLE_OP1 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s
), p AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS weight
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, CAST(total - caps AS DOUBLE) / CAST(weight - ws AS DOUBLE) AS level FROM p
), f AS (
  SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY caps, ws ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM l
), t AS (
  SELECT source, source_size, CASE WHEN best IS NULL OR cap < best * w THEN CAST(cap AS DOUBLE) ELSE best * w END AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY
      length(bin(d.size)) * 16 + CAST(floor(d.size * 8 / (1::BIGINT << (length(bin(d.size)) - 1))) AS BIGINT),
      CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 4)) AS BIGINT) % 64, d.size, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(rate * k + u) - floor(rate * (k - 1) + u), 3) AS BIGINT) AS taken FROM r
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLE = {"op1_mixing": ORACLE_OP1}
