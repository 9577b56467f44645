"""License scans by diagonal voting, in DataFrame operations only.

Every rolling two-word gram of every document is joined by hash to the positions of the same gram in
the templates (a broadcast table of constant size). A hit votes for its diagonal, the document position
less the template position. Votes are added per diagonal; a diagonal with all of a template's grams is
an exact occurrence. Neighbouring diagonals are merged, so that a few words put in or left out still
make one span, and a span counts if the grams it covers are enough and mostly on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import table

BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: (label, phrase, whether it is a base phrase). At most 60 words each.
TEMPLATES: tuple[tuple[str, str, bool], ...] = (
    ("cc-by", "cc by", True),
    ("gpl", "general public license", True),
    ("reserved", "all rights reserved", True),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", False),
    ("mit", "the mit license", False),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", False),
    ("mpl-2.0", "mozilla public license version 2 0", False),
    ("lgpl", "gnu lesser general public license", False),
    ("agpl", "gnu affero general public license", False),
    ("cc", "creative commons attribution license", False),
    ("cc0", "public domain dedication cc0", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", False),
    ("no-warranty", "is provided as is without warranty of any kind express or implied", False),
    ("spdx", "spdx license identifier", False),
    ("proprietary", "proprietary and confidential unauthorized copying is prohibited", False),
)
#: Diagonals at most so far apart are one span; a span needs this share of the template's grams.
DRIFT, COVER = 3, 0.8


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased (null: none).

    ``lower`` makes ASCII letters of just two other characters, the Kelvin sign and the dotted capital I;
    both are replaced by another letter first.
    """
    plain = F.coalesce(text.cast("string"), F.lit(""))
    for odd in ("K", "İ"):
        plain = F.replace(plain, F.lit(odd), F.lit("é"))
    return F.array_remove(F.split(F.lower(plain), BREAKS), "")


def postings(spark: SparkSession) -> DataFrame:
    """One row per template gram (``h``: hash of two words), and one that every document hits by ``h`` = 0."""
    rows = ["(-1, '', false, 1, 0, CAST(NULL AS STRING), CAST(NULL AS STRING))"]
    for t, (label, phrase, base) in enumerate(TEMPLATES):
        w = phrase.split()
        rows += [f"({t}, '{label}', {str(base).lower()}, {len(w)}, {i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    listed = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS p(t, label, base, n, tpos, a, b)")
    return listed.select("t", "label", "base", "n", "tpos", F.when(F.col("a").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b")).alias("h"))


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0; texts of one word have no grams; repeated rows
    are scanned each by itself. The score is the largest share of a template's grams on merged diagonals.
    """
    split = df.select(F.col(key).alias("__key"), words(F.col(text)).alias("__w")).withColumn("__row", F.monotonically_increasing_id())
    grams = F.zip_with("__w", F.slice("__w", F.lit(2), F.size("__w")), lambda a, b: F.xxhash64(a, b))
    # The last gram pairs the last word with nothing; it is cut off, and the row's own 0 takes its place.
    hashed = split.select("__row", "__key", F.size("__w").cast("long").alias("n_words"), F.concat(F.slice(grams, 1, F.greatest(F.size("__w") - 1, F.lit(0))), F.array(F.lit(0).cast("long"))).alias("__g"))
    rolled = hashed.select("__row", "__key", "n_words", F.posexplode("__g").alias("pos", "h"))
    hits = rolled.join(F.broadcast(postings(df.sparkSession)), "h")
    votes = hits.groupBy("__row", "__key", "n_words", "t", "label", "base", "n", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.count(F.lit(1)).alias("votes"), F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"))
    along = W.partitionBy("__row", "t").orderBy("diag")
    island = F.sum(F.when(F.col("diag") - F.lag("diag").over(along) <= DRIFT, 0).otherwise(1)).over(along)
    whole = F.col("base") & (F.col("votes") == F.col("n") - 1)
    spans = (
        votes.withColumn("island", island)
        .groupBy("__row", "__key", "n_words", "t", "label", "base", "n", "island")
        .agg(F.bit_count(F.bit_or("mask")).alias("covered"), F.max("votes").alias("most"), F.count(F.when(whole, 1)).alias("places"), F.min(F.when(whole, F.col("diag"))).alias("lo"), F.max(F.when(whole, F.col("diag"))).alias("hi"))
    )
    share = F.when(F.col("t") < 0, F.lit(0.0)).otherwise(F.col("covered") / (F.col("n") - 1).cast("double"))
    own = (F.col("t") >= 0) & ~F.col("base") & (share >= COVER) & (F.col("most") * 2 >= F.col("n") - 1)
    based = F.col("places") > 0
    found = spans.groupBy("__row", "__key", "n_words").agg(
        F.sum("places").alias("n_base"), F.min("lo").cast("long").alias("first_word"), F.max("hi").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(based, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(based | own, F.col("label")))), ",").alias("labels"),
        F.max(share).alias("score"),
    )
    return found.select(F.col("__key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"({t}, '{label}', {base}, {len(phrase.split())}, {i}, '{a}', '{b}')" for t, (label, phrase, base) in enumerate(TEMPLATES) for i, (a, b) in enumerate(zip(phrase.split(), phrase.split()[1:], strict=False)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), g AS (
  SELECT r, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b, generate_subscripts(w, 1) - 1 AS pos FROM d
), p(t, label, base, n, tpos, a, b) AS (VALUES {rows}),
v AS (
  SELECT r, t, label, base, n, pos - tpos AS diag, count(*) AS votes, bit_or(1::BIGINT << tpos) AS mask FROM g JOIN p USING (a, b) GROUP BY ALL
), i AS (
  SELECT *, sum(CASE WHEN gap <= {DRIFT} THEN 0 ELSE 1 END) OVER (PARTITION BY r, t ORDER BY diag) AS island
  FROM (SELECT *, diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag) AS gap FROM v)
), s AS (
  SELECT r, t, label, base, n, island, bit_count(bit_or(mask)) / CAST(n - 1 AS DOUBLE) AS share, max(votes) AS most,
    count(*) FILTER (base AND votes = n - 1) AS places, min(diag) FILTER (base AND votes = n - 1) AS lo, max(diag) FILTER (base AND votes = n - 1) AS hi
  FROM i GROUP BY r, t, label, base, n, island
), x AS (
  SELECT r, sum(places) AS n_base, min(lo) AS lo, max(hi) AS hi,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR (NOT base AND share >= {COVER} AND most * 2 >= n - 1)) AS labels, max(share) AS score
  FROM s GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN x USING (r)
"""


QUERIES = {"op9_licenses": op9_licenses}
ORACLE = {"op9_licenses": _sql()}
