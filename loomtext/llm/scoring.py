"""What the two document scorers share: folds, a bounded sample of labelled rows, memoized words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Partitions that the sample is worked on in.
PARTS = 32


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``__text``, ``__label``) of at most ``bound`` distinct texts of the labelled documents that ``keep`` (on ``__key``) admits.

    At most ``bound`` labelled keys are drawn by hash (and broadcast), so the choice is the same at every partitioning; a key
    with several labels counts with its largest. Equal texts count once, with the largest of their labels; where a key is
    on many rows with different texts, ``bound`` of all texts are drawn, by hash again.
    """
    own = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(F.col("__key").isNotNull() & F.col("__label").isNotNull() & keep)
    drawn = own.groupBy("__key").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(bound)
    texts = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    once = texts.join(F.broadcast(drawn), "__key").groupBy("__text").agg(F.max("__label").alias("__label"))
    return once.orderBy(F.xxhash64("__text"), "__text").limit(bound).repartition(PARTS, "__text")  # a limit leaves one partition


class Memo(dict):
    """Word to value, computed once by ``of`` and forgotten when more than ``most`` words are known."""

    def __init__(self, of, most: int = 400_000) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        if len(self) > self.most:
            self.clear()
        out = self[word] = self.of(word)
        return out
