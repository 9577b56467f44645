"""Data-quality and distribution profiles."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import missing, words
from ..session import small_side

#: Rank error of the sketch that brackets a quantile: one in so many.
ACCURACY = 10_000
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def quantiles(df: DataFrame, groups: list[str], columns: list[str], at: tuple[float, ...]) -> DataFrame:
    """(groups, column_name, n, q): exact quantiles ``at`` of numeric columns, linearly interpolated, as an array in order.

    A mergeable sketch first brackets each quantile; the values outside its bracket are only counted, and those inside are
    counted by value and put in order, so no task holds more of a column than a bracket.
    """
    keys = [*groups, "column_name"]
    long = df.select(*groups, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v IS NOT NULL")
    edges = [F.greatest(F.lit(0.0), F.lit(q - 2 / ACCURACY)) for q in at] + [F.least(F.lit(1.0), F.lit(q + 2 / ACCURACY)) for q in at]
    sketch = long.groupBy(*keys).agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(*edges), ACCURACY).alias("e"), F.min("v").alias("low"), F.max("v").alias("high"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("at"), (F.col("low") if q <= 0 else F.col("e")[i]).alias("lo"), (F.col("high") if q >= 1 else F.col("e")[len(at) + i]).alias("hi")) for i, q in enumerate(at)])
    wanted = sketch.select(*keys, "n", F.inline(places))
    brackets = small_side(wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "i", "at", "lo", "hi"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    side = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0)
    tagged = long.join(brackets, same).withColumn("side", side)
    # A bracket may miss the place wanted by one, so of those below the largest is known and of those above the smallest.
    counted = tagged.groupBy(*keys, "i", "n", "at", "side", F.when(F.col("side") == 0, F.col("v")).alias("x")).agg(F.count(F.lit(1)).alias("c"), F.when(F.col("side") < 0, F.max("v")).otherwise(F.min("v")).alias("v"))
    upto = F.sum("c").over(W.partitionBy(*keys, "i").orderBy("side", "x").rowsBetween(W.unboundedPreceding, 0))
    ordered = counted.withColumn("upto", upto).withColumn("r", F.col("at") * (F.col("n") - 1))
    reached = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    ends = ordered.groupBy(*keys, "i", "n", "r").agg(reached(F.floor("r")).alias("a"), reached(F.ceil("r")).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - F.floor("r"))
    return ends.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("x")))), lambda s: s.x).alias("q"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation) and max of numeric columns, one row a column."""
    names = columns or [c for c, t in df.dtypes if t in NUMERIC]
    parts = []
    for c in names:
        v = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high")))
    one = df.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*").join(quantiles(df, [], names, (0.25, 0.5, 0.75)).drop("n"), "column_name", "left")
    return one.select("column_name", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "high")


def column_info(df: DataFrame) -> DataFrame:
    """Per column its type, the rows, and how many of them are neither null nor NaN; one pass."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("kind"), F.count(F.when(~missing(F.col(c), t), 1)).alias("non_null"), F.count(F.lit(1)).alias("n_rows")) for c, t in df.dtypes]
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def missingness(df: DataFrame) -> DataFrame:
    """Per column the missing rows and their share."""
    info = column_info(df)
    gone = F.col("n_rows") - F.col("non_null")
    return info.select("column_name", gone.alias("n_missing"), F.coalesce(F.try_divide(gone.cast("double"), F.col("n_rows").cast("double")), F.lit(0.0)).alias("share_missing"))


def duplicates(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Values of ``keys`` that several rows share, with the count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outliers(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows below the ``low`` or above the ``high`` percentile, with the two bounds (one row, broadcast)."""
    bounds = quantiles(df, [], [value], (low, high)).select(F.col("q")[0].alias("p_low"), F.col("q")[1].alias("p_high"))
    return df.crossJoin(F.broadcast(bounds)).where((F.col(value) < F.col("p_low")) | (F.col(value) > F.col("p_high")))


def five_numbers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group; groups without a value have nulls."""
    q = quantiles(df, [group], [value], (0.0, 0.25, 0.5, 0.75, 1.0)).select(F.col(group).alias("__g"), "q")
    names = ("low", "q25", "q50", "q75", "high")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("__rows")).join(q, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def balance(df: DataFrame, group: str, few: int = 50, very_few: int = 20) -> DataFrame:
    """Rows and share per group, and whether it has fewer than ``few`` or ``very_few`` rows."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return n.select(group, "n", (F.col("n").cast("double") / total.cast("double")).alias("share"), (F.col("n") < few).alias("is_few"), (F.col("n") < very_few).alias("is_very_few"))


def coverage(listed: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` per listed value, zero included, and whether there is a gap."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("is_gap"))


def bridge(df: DataFrame, group: str, domain: str) -> DataFrame:
    """Each group's most frequent domain (ties by name), its share, and how many domains the group has."""
    n = df.groupBy(group, domain).agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy(group)
    ranked = n.withColumn("r", F.row_number().over(own.orderBy(F.col("n").desc(), domain))).withColumn("total", F.sum("n").over(own)).withColumn("n_domains", F.count(F.lit(1)).over(own))
    return ranked.where("r = 1").select(group, F.col(domain).alias("main_domain"), (F.col("n").cast("double") / F.col("total").cast("double")).alias("main_share"), "n_domains", (F.col("n_domains") > 1).alias("is_multi"))


def share_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Share of each value on both sides, and the difference."""
    sides = []
    for name, df in (("left_share", left), ("right_share", right)):
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        sides.append(n.select(key, (F.col("n").cast("double") / F.sum("n").over(W.partitionBy()).cast("double")).alias(name)))
    both = sides[0].join(sides[1], key, "full")
    a, b = F.coalesce("left_share", F.lit(0.0)), F.coalesce("right_share", F.lit(0.0))
    return both.select(key, a.alias("left_share"), b.alias("right_share"), (a - b).alias("difference"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Rows per bin of ``width``."""
    return df.groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows and Pearson's correlation of two columns, to 6 places."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(a, b), 6).alias("r"))


def profile(df: DataFrame, group: str, length: str, diversity: str) -> DataFrame:
    """Rows, mean length and mean diversity per group, to 6 places."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(length), 6).alias("mean_length"), F.round(F.avg(diversity), 6).alias("mean_diversity"))


def text_flags(df: DataFrame, text: str, stored: str, tags: Column, short: int = 20) -> DataFrame:
    """``df`` and flags: empty text, under ``short`` words, stored length unlike the measured, tags without text."""
    n = F.array_size(words(F.col(text)))
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return df.withColumns({"is_empty": empty, "is_short": n < short, "length_differs": F.coalesce(F.col(stored) != F.char_length(text), F.lit(True)), "tags_without_text": (F.size(tags) > 0) & empty})


def supply_demand(supply: DataFrame, demand: DataFrame, tag: str) -> DataFrame:
    """Rows per tag on both sides and the gap (demand less supply); the inputs have an array column ``tag``."""
    sides = [df.select(F.explode(tag).alias(tag)).groupBy(tag).agg(F.count(F.lit(1)).alias(n)) for n, df in (("supply", supply), ("demand", demand))]
    both = sides[0].join(sides[1], tag, "full")
    a, b = F.coalesce("supply", F.lit(0)).cast("long"), F.coalesce("demand", F.lit(0)).cast("long")
    return both.select(tag, a.alias("supply"), b.alias("demand"), (b - a).alias("gap"))


def supply_demand_by(supply: DataFrame, demand: DataFrame, domain: str, tag: str) -> DataFrame:
    """``supply_demand`` per domain; both inputs have a column ``domain`` beside the array column ``tag``."""
    sides = [df.select(domain, F.explode(tag).alias(tag)).groupBy(domain, tag).agg(F.count(F.lit(1)).alias(n)) for n, df in (("supply", supply), ("demand", demand))]
    both = sides[0].join(sides[1], [domain, tag], "full")
    a, b = F.coalesce("supply", F.lit(0)).cast("long"), F.coalesce("demand", F.lit(0)).cast("long")
    return both.select(domain, tag, a.alias("supply"), b.alias("demand"), (b - a).alias("gap"))


def pruned(df: DataFrame, text: str, key: str, flags: tuple[str, ...] = ("is_empty", "is_short")) -> DataFrame:
    """The rows that none of the ``flags`` (boolean columns; null counts as false) marks, one of equal texts: that of the smallest key.

    Equal texts are known by SHA-256, so no text is shuffled. Rows with a null text are marked or kept like others.
    """
    good = df.where(~reduce(or_, [F.coalesce(F.col(f), F.lit(False)) for f in flags])).withColumn("__h", F.coalesce(F.sha2(text, 256), F.lit("")))
    first = good.groupBy("__h").agg(F.min(key).alias("__first")).withColumnRenamed("__h", "__g")
    return good.join(first, (F.col("__h") == F.col("__g")) & F.col(key).eqNullSafe(F.col("__first")), "left_semi").drop("__h")
