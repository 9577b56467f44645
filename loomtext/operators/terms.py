"""Term statistics, TF-IDF weights and vocabulary overlap.

For what is counted per document the texts are dealt by key once, before they are cleaned, to as many partitions as their
bytes need; all counts, norms and sums per document then stay in their partition, and postings are never shuffled but by term,
after they are summed. Pairs of words are counted only where both words are frequent enough for their pair to be wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import long_words, words
from ..session import MOST_BROADCAST, checkpointed, small_side

SIZE, MIN_DF = 5000, 2
#: Bytes of text that a partition of dealt documents has, about. The counts of its terms take some 80 times that.
PART = 4 << 20

Clean = Callable[[Column], Column]


def as_it_is(text: Column) -> Column:
    return text


def tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row a word: ``keys`` and ``term``."""
    return listed(df.select(*keys, words(F.col(text)).alias("__own")), keys)


def listed(own: DataFrame, keys: list[str]) -> DataFrame:
    """One row an entry of ``__own``, which holds no nulls.

    Outer, because for an inner one the optimizer adds a filter on the array's size, below the exchange: a text would be cleaned and split twice.
    """
    return own.select(*keys, F.explode_outer("__own").alias("term")).where("term IS NOT NULL")


def terms_of(df: DataFrame, keys: list[str], text: Column, longest: int = 2) -> DataFrame:
    """One row a term: ``keys`` and ``term``, the words of two and more characters and, with ``longest`` = 2, their neighbouring pairs.

    The words are a column of their own first, so that a text is split once.
    """
    own = df.select(*keys, long_words(text).alias("__own"))
    if longest < 2:
        return listed(own, keys)
    n = F.greatest(F.size("__own") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("__own", F.lit(1), n), F.slice("__own", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return listed(own.select(*keys, F.concat("__own", pairs).alias("__own")), keys)


def pairs_of(df: DataFrame, keys: list[str], text: Column, frequent: DataFrame, by: list[str]) -> DataFrame:
    """One row a pair of neighbouring words: ``keys`` and ``term``, if both words are in ``frequent`` (``by`` and ``__word``).

    A pair is no more frequent than either of its words, so those left out are known to be rarer than the words left out.
    Outer for the same reason as ``listed``.
    """
    own = df.select(*keys, long_words(text).alias("__own"))
    n = F.greatest(F.size("__own") - 1, F.lit(0))
    out = own.select(*keys, F.inline_outer(F.arrays_zip(F.slice("__own", F.lit(1), n).alias("__a"), F.slice("__own", F.lit(2), n).alias("__b"))))
    out = out.toDF(*keys, "__a", "__b")
    for side in ("__a", "__b"):
        same = F.col(side) == F.col("__word")
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"__by_{k}"))
        out = out.join(frequent.select(*[F.col(k).alias(f"__by_{k}") for k in by], "__word"), same, "left_semi")
    return out.select(*keys, F.concat_ws(" ", "__a", "__b").alias("term"))


def word_frequency(df: DataFrame, text: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent words, ties by word."""
    counts = tokens(df, [], text).groupBy("term").agg(F.count(F.lit(1)).alias("Frequency"))
    return counts.orderBy(F.col("Frequency").desc(), "term").limit(n).select(F.col("term").alias("Word"), "Frequency")


def term_weights(df: DataFrame, group: str, text: str, n: int = 20, stops: tuple[str, ...] = (), longest: int = 1, plurals: bool = False) -> DataFrame:
    """Per group the ``n`` most frequent terms and their counts relative to the first: what a word cloud draws.

    With ``plurals`` a term that ends in one s counts for the term without it, where the group has that too. Without, pairs are
    counted only of words that are, in the group, as frequent as its ``n``-th word: the others' pairs cannot be among the first ``n``.
    """
    def counted(terms: DataFrame) -> DataFrame:
        return terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))

    wanted = ~F.col("term").isin(*stops) if stops else F.lit(True)
    own = W.partitionBy(group).orderBy(F.col("n").desc(), "term")
    if longest < 2 or plurals:
        counts = counted(terms_of(df, [group], F.col(text), longest).where(wanted))
    else:
        every = checkpointed(counted(terms_of(df, [group], F.col(text), 1)))
        least = every.where(wanted).withColumn("r", F.row_number().over(own)).where(F.col("r") == n).select(F.col(group).alias("__g"), F.col("n").alias("__least"))
        frequent = every.join(least, F.col(group).eqNullSafe(F.col("__g")), "left").where(F.col("n") >= F.coalesce("__least", F.lit(0)))
        pairs = pairs_of(df, [group], F.col(text), small_side(frequent.select(group, F.col("term").alias("__word"))), [group])
        counts = every.where(wanted).unionByName(counted(pairs.where(wanted)))
    if plurals:
        bare = F.when(F.col("term").rlike("[^s]s$"), F.expr("left(term, char_length(term) - 1)"))
        one = counts.select(F.col(group).alias("__g"), F.col("term").alias("__one"))
        told = counts.withColumn("__bare", bare).join(one, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bare") == F.col("__one")), "left")
        counts = told.groupBy(group, F.coalesce("__one", "term").alias("term")).agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n)
    top = F.max("n").over(W.partitionBy(group))
    return ranked.select(group, "rank", "term", "n", (F.col("n").cast("double") / top.cast("double")).alias("weight"))


def signature_terms(df: DataFrame, group: str, text: str, n: int = 5, least: int = 20) -> DataFrame:
    """Per group the ``n`` terms of the largest lift P(term | group) / P(term), among terms with ``least`` uses there."""
    counts = tokens(df, [group], text).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    terms = counts.groupBy("term").agg(F.sum("n").alias("all_n"))
    groups = counts.groupBy(group).agg(F.sum("n").alias("group_n"))
    total = groups.agg(F.sum("group_n").alias("total"))
    lift = F.round(F.col("n").cast("double") * F.col("total") / (F.col("group_n").cast("double") * F.col("all_n")), 6)
    scored = counts.where(F.col("n") >= least).join(terms, "term").join(groups, group).crossJoin(F.broadcast(total)).withColumn("lift", lift)
    own = W.partitionBy(group).orderBy(F.col("lift").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n).select(group, "rank", "term", "n", "lift")


def dealt(df: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``text`` and ``carry``, partitioned by key: a partition for every ``PART`` bytes of text, and no fewer than cores.

    The number is given, because the engine would else join partitions until they are as large as it likes texts to be,
    and the counts of their terms are many times larger.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.select(key, text, *carry).repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART)), key)


def vocabulary(own: DataFrame, key: str, text: str, size: int = SIZE, min_df: int = MIN_DF, longest: int = 2, clean: Clean = as_it_is) -> DataFrame:
    """(term, df, cf) of the ``size`` most frequent terms in ``min_df`` or more documents, ties by term; ``own`` is ``dealt``.

    If there are ``size`` words, the least frequent of them bounds the vocabulary's terms from below, and so the words of its pairs.
    """

    def counted(every: DataFrame) -> DataFrame:
        per_doc = every.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)

    first = (F.col("cf").desc(), "term")
    text_of = clean(F.col(text))
    terms = counted(terms_of(own, [key], text_of, 1))
    if longest < 2:
        return terms.orderBy(*first).limit(size)
    terms = checkpointed(terms)
    least = terms.orderBy(*first).limit(size).agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
    frequent = terms.where(F.col("cf") >= (least["cf"] if least["n"] == size else 0)).select(F.col("term").alias("__word"))
    few = frequent.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    pairs = counted(pairs_of(own, [key], text_of, F.broadcast(frequent) if few else frequent, []))
    return terms.unionByName(pairs).orderBy(*first).limit(size)


def term_counts(own: DataFrame, key: str, text: str, vocab: DataFrame, longest: int = 2, clean: Clean = as_it_is, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, term, tf, df) over the vocabulary (at most its ``size`` rows, broadcast before the counts are made)."""
    if longest < 2:
        found = terms_of(own, [key, *carry], clean(F.col(text)), 1).join(F.broadcast(vocab.select("term", "df")), "term")
    else:  # words and pairs meet the vocabulary in two columns, so that no pair is put together that is not in it
        listed_words = own.select(key, *carry, long_words(clean(F.col(text))).alias("__own"))
        n = F.greatest(F.size("__own") - 1, F.lit(0))
        one = F.arrays_zip(F.col("__own").alias("__a"), F.slice("__own", F.lit(1), F.lit(0)).alias("__b"))
        two = F.arrays_zip(F.slice("__own", F.lit(1), n).alias("__a"), F.slice("__own", F.lit(2), n).alias("__b"))
        every = listed_words.select(key, *carry, F.inline_outer(F.concat(one, two))).toDF(key, *carry, "__a", "__b")
        parts = F.split("term", " ")
        known = vocab.select("term", "df", parts[0].alias("__va"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("__vb"))
        found = every.join(F.broadcast(known), (F.col("__a") == F.col("__va")) & (F.coalesce("__b", F.lit("")) == F.col("__vb")))
    return found.groupBy(key, *carry, "term", "df").agg(F.count(F.lit(1)).alias("tf"))


def weighed(counts: DataFrame, key: str, n_docs: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, term, tf, tfidf): raw tf times ln((1 + n) / (1 + df)) + 1, rows scaled to length 1."""
    raw = counts.withColumn("w", F.col("tf") * (F.log((n_docs + 1).cast("double") / (F.col("df") + 1).cast("double")) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, *carry, "term", "tf", (F.col("w") / length).alias("tfidf"))


def tfidf(df: DataFrame, key: str, text: str, size: int = SIZE, min_df: int = MIN_DF, longest: int = 2, clean: Clean = as_it_is, carry: tuple[str, ...] = ()) -> DataFrame:
    """TF-IDF postings of a corpus over its own vocabulary, with the columns ``carry`` of their documents."""
    n, own = df.agg(F.count(F.lit(1)).alias("__docs")), dealt(df, key, text, carry)
    vocab = vocabulary(own.select(key, text), key, text, size, min_df, longest, clean)
    counts = term_counts(own, key, text, vocab, longest, clean, carry)
    return weighed(counts.crossJoin(F.broadcast(n)), key, F.col("__docs"), carry)


def top_terms(df: DataFrame, text: str, n: int) -> DataFrame:
    """The ``n`` most frequent words, ties by word."""
    return tokens(df, [], text).groupBy("term").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "term").limit(n)


def jaccard_top(left: DataFrame, right: DataFrame, text: str, n: int = 5000) -> DataFrame:
    """Jaccard similarity of the two sides' ``n`` most frequent words."""
    a, b = top_terms(left, text, n).select("term"), top_terms(right, text, n).select("term")
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "term", "full")
    shared, every = F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)), F.count(F.lit(1))
    return both.agg(shared.alias("n_shared"), every.alias("n_all"), F.coalesce(F.try_divide(shared.cast("double"), every.cast("double")), F.lit(0.0)).alias("jaccard"))


def weighted_overlap(left: DataFrame, right: DataFrame, key: str, text: str, other_key: str, clean: Clean = as_it_is) -> DataFrame:
    """Sum over shared words of the smaller of the two sides' mean TF-IDF weights, to 6 places."""
    sides = []
    for df, k in ((left, key), (right, other_key)):
        n = df.agg(F.count(F.lit(1)).alias("__n"))
        sides.append(tfidf(df, k, text, longest=1, clean=clean).groupBy("term").agg(F.sum("tfidf").alias("s")).crossJoin(F.broadcast(n)).select("term", (F.col("s") / F.col("__n")).alias("w")))
    both = sides[0].join(sides[1].withColumnRenamed("w", "v"), "term")
    return both.agg(F.count(F.lit(1)).alias("n_shared"), F.round(F.sum(F.least("w", "v")), 6).alias("overlap"))


def jaccard_matrix(left: DataFrame, right: DataFrame, group: str, text: str) -> DataFrame:
    """Jaccard similarity of the vocabularies of every group on the left and every group on the right."""
    a = tokens(left, [group], text).distinct().withColumnRenamed(group, "left_group")
    b = tokens(right, [group], text).distinct().withColumnRenamed(group, "right_group")
    na, nb = a.groupBy("left_group").agg(F.count(F.lit(1)).alias("na")), b.groupBy("right_group").agg(F.count(F.lit(1)).alias("nb"))
    shared = a.join(b, "term").groupBy("left_group", "right_group").agg(F.count(F.lit(1)).alias("n_shared"))
    every = na.crossJoin(nb).join(shared, ["left_group", "right_group"], "left").na.fill(0, ["n_shared"])
    return every.select("left_group", "right_group", "n_shared", (F.col("n_shared").cast("double") / (F.col("na") + F.col("nb") - F.col("n_shared")).cast("double")).alias("jaccard"))


def group_cosine(df: DataFrame, key: str, group: str, text: str, clean: Clean = as_it_is) -> DataFrame:
    """Cosine of the mean TF-IDF vectors of every two groups, to 6 places.

    The documents' group goes with their postings; the means (a vocabulary a group) are written once and used three times.
    """
    mean = checkpointed(tfidf(df, key, text, longest=1, clean=clean, carry=(group,)).groupBy(group, "term").agg(F.sum("tfidf").alias("w")))
    lengths = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    a, b = mean.select(F.col(group).alias("left_group"), "term", F.col("w").alias("a")), mean.select(F.col(group).alias("right_group"), "term", F.col("w").alias("b"))
    dots = a.join(b, "term").groupBy("left_group", "right_group").agg(F.sum(F.col("a") * F.col("b")).alias("d"))
    la, lb = lengths.select(F.col(group).alias("left_group"), F.col("len").alias("la")), lengths.select(F.col(group).alias("right_group"), F.col("len").alias("lb"))
    return dots.join(la, "left_group").join(lb, "right_group").select("left_group", "right_group", F.round(F.col("d") / (F.col("la") * F.col("lb")), 6).alias("cosine"))
