"""Best-fit packing of tokenized documents by large-item matching.

A plan is made from the histogram of piece lengths alone (at most ``capacity`` numbers, whatever the
corpus size): pieces above a third of the capacity, of which a sequence holds two at most, are matched
greedily, largest first, each into the tightest gap; smaller pieces then best-fit the remaining gaps. Equal
gaps are filled in bulk, so the plan is a list of runs (length, first rank, first sequence, copies per
sequence, offset). Every piece finds its place from its length and its rank among equal lengths.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bucket, map_arrow, ranks, saved, table

CAPACITY = 4096
END = 1
SALTS = 64
#: Words whose ids a worker remembers before it starts afresh.
MEMO = 400_000

_LOW = [chr(i) for i in range(0x300)]
#: The few whose lower case lies beyond.
_OUT = "".join(c for c in _LOW if max(map(ord, c.lower())) >= 0x300)
_L = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "N")
_PIECES = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\\s{_L}{_N}]+")
#: Texts with any of these characters, or with the beginning of a special token, go through the tokenizer whole.
_ODD = re.compile(f"[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xa0{_OUT}\\u0300-\\U0010ffff]")
_SPECIAL, _WORD_END = "<|", "</w>"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, word by word from a memory of words.

    The normalizer (NFC, white space, lower case) and the word split of the vocabulary file act alike on
    every text of characters below U+0300 (without controls and special tokens), so such a text's ids are
    those of its words in turn; any other text is encoded whole. The words of a text that are not yet known
    are encoded together, and their ids told apart by the vocabulary's word ends.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that are split and normalized already.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self.memo: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text) or _SPECIAL in text:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = _PIECES.findall(text.lower())
        try:
            return b"".join(map(self.memo.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.memo.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        """Puts the words in memory; if it holds too many, it is emptied first."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = list(set(words).difference(memo))
        ids = self.words.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(fresh) or stops[-1] != 4 * len(ids):
            raise ValueError("the vocabulary does not mark the ends of words")
        raw, start = packed(ids), 0
        for w, stop in zip(fresh, stops.tolist(), strict=True):
            memo[w] = raw[start:stop]
            start = stop


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 (and ``ids`` as bytes, if asked for).

    A document's ids are those of its whole text (null: empty) and then id 1; only more than ``capacity``
    ids are cut, every ``capacity`` ids.
    """

    def run(keys, texts):
        nonlocal encoder
        if encoder is None:
            encoder = Encoder(path)
        end = packed([END])
        rows: list[tuple] = []
        for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
            ids = encoder(t or "") + end
            for i in range(0, len(ids), 4 * capacity):
                part = ids[i : i + 4 * capacity]
                rows.append((k, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
        yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

    encoder: Encoder | None = None
    names = ["__key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"__key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")), ["__key", "__text"], schema, run).withColumnRenamed("__key", key)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank from 0, first sequence, copies per sequence, offset), sorted by length and rank."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    levels: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put_back(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                bisect.insort(levels, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    def place(length: int, count: int, most: int) -> None:
        nonlocal opened
        rank = 0
        while count:
            at = bisect.bisect_left(levels, length)
            if at < len(levels):
                gap = levels[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], levels[at]
            else:
                gap = capacity
                n = -(-count // min(most, capacity // length))
                first, opened = opened, opened + n
            k = min(most, gap // length)
            full = min(n, count // k)
            if full:
                runs.append((length, rank, first, k, capacity - gap))
                put_back(gap - k * length, first, full)
                rank, count = rank + full * k, count - full * k
            if full < n and count and count < k:
                runs.append((length, rank, first + full, count, capacity - gap))
                put_back(gap - count * length, first + full, 1)
                full, rank, count = full + 1, rank + count, 0
            put_back(gap, first + full, n - full)

    for length in sorted(histogram, reverse=True):
        place(length, histogram[length], 2 if 3 * length > capacity else capacity)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``pieces`` plus sequence_id and offset, packed into few sequences of at most ``capacity`` ids.

    Null and empty texts are one id each; repeated rows are packed each by itself; an empty table gives an
    empty result. Collected: the count per length, at most ``capacity`` rows.
    """
    spark = df.sparkSession
    cut = saved(pieces(df, path, key, text, capacity, with_ids))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(histogram, capacity))
    placed = ranks(cut.withColumn("__salt", hash_bucket(F.col(key), SALTS)), ["length"], "__salt", [key, "piece", "ids_crc32"], "__rank")

    def seat(length, rank, *rest):
        r = runs.value
        at, n = length.to_numpy(), rank.to_numpy() - 1
        i = np.searchsorted(r[:, 0] * (1 << 44) + r[:, 1], at * (1 << 44) + n, side="right") - 1
        own = n - r[i, 1]
        yield {"length": length, **dict(zip(others, rest, strict=True)), "sequence_id": r[i, 2] + own // r[i, 3], "offset": r[i, 4] + own % r[i, 3] * at}

    others = ["__key", "piece", "start", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"__key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return map_arrow(placed.withColumnRenamed(key, "__key"), ["length", "__rank", *others], schema, seat).withColumnRenamed("__key", key)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The sequences themselves, (sequence_id, ids bytes), from ``pack(..., with_ids=True)``; one holds ``capacity`` ids at most."""
    parts = packed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))


def vocabulary() -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
