"""Length and lexical features of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words


def text_length(tokens: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.array_size(tokens), F.lit(0)).cast("long")


def average_word_length(tokens: Column) -> Column:
    """Mean code points a word, from integers only (no words: 0)."""
    letters = F.char_length(F.array_join(tokens, ""))
    return F.coalesce(F.try_divide(letters.cast("double"), F.array_size(tokens).cast("double")), F.lit(0.0))


def unique_words(tokens: Column) -> Column:
    """Number of distinct words, by case."""
    return F.coalesce(F.array_size(F.array_distinct(tokens)), F.lit(0)).cast("long")


def lexical_diversity(unique: Column, total: Column) -> Column:
    """Distinct by all words (0/0: 0)."""
    return F.coalesce(F.try_divide(unique.cast("double"), total.cast("double")), F.lit(0.0))


def with_features(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` and its four feature columns; the words of a text are split once."""
    split = df.withColumn("__words", words(F.col(text)))
    out = split.withColumns({f"{prefix}text_length": text_length(F.col("__words")), f"{prefix}avg_word_length": average_word_length(F.col("__words")), f"{prefix}unique_word_count": unique_words(F.col("__words"))})
    return out.withColumn(f"{prefix}lexical_diversity", lexical_diversity(F.col(f"{prefix}unique_word_count"), F.col(f"{prefix}text_length"))).drop("__words")
