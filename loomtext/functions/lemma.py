"""Tokens with lemmas: a dictionary and English endings by default, or any callable as a pandas UDF.

The dictionary lemmatizer is not equivalent to a trained language model: it looks words up (irregular forms), and of
others takes off regular plural and verb endings, knowing no parts of speech.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_TYPE = "struct<text:string,lemma:string,is_alpha:boolean,is_stop:boolean>"
DOC_TYPE = f"array<{TOKEN_TYPE}>"
COUNTED_TYPE = "struct<terms:string,lemmas:string,n_tokens:int>"
RESULT_TYPE = f"struct<terms:string,lemmas:string,tokens:{DOC_TYPE}>"
#: Irregular English forms by lemma.
IRREGULAR: Mapping[str, str] = {
    form: lemma
    for lemma, forms in {
        "be": "am is are was were been being", "have": "has had having", "do": "does did done doing", "go": "goes went gone", "make": "made making",
        "take": "took taken taking", "give": "gave given giving", "write": "wrote written writing", "lead": "led", "build": "built", "know": "knew known",
        "find": "found", "get": "got gotten getting", "see": "saw seen", "run": "ran running", "man": "men", "woman": "women", "child": "children", "person": "people", "foot": "feet", "datum": "data", "analysis": "analyses", "good": "better best",
    }.items()
    for form in forms.split()
}
#: Endings in the order they are tried: the first that fits a lower-cased word is replaced.
ENDINGS: tuple[tuple[str, str], ...] = (
    (r"(ss|us|is|ous)$", r"\1"),
    (r"([a-z]{2})ie[sd]$", r"\1y"),
    (r"(x|z|ch|sh|ss)es$", r"\1"),
    (r"([a-z]{2}[^s])s$", r"\1"),
    (r"([a-z][aeiouy][a-z]*?)(bb|dd|gg|ll|mm|nn|pp|rr|tt)(?:ing|ed)$", r"\1\2"),
    (r"([a-z]*[aeiouy][a-z]*[a-z])(?:ing|ed)$", r"\1"),
)
#: A lexicon goes to the workers with the function up to this many entries.
MOST_ENTRIES = 10_000
#: Words that a worker keeps with their lemmas; others are worked out whenever they occur.
MOST_KEPT = 500_000
#: Texts that are split at a time, so that the words of a whole batch are never held as objects.
ROWS = 256


def stop_words(spark: SparkSession) -> list[str]:
    """Spark's own English stop list."""
    del spark
    return StopWordsRemover.loadDefaultStopWords("english")


class Known(dict[str, tuple[str, bool, bool]]):
    """(lemma, is_alpha, is_stop) by word, worked out when a word is first asked for and kept for up to ``MOST_KEPT`` words."""

    def __init__(self, stops: Sequence[str], lexicon: Mapping[str, str], endings: Sequence[tuple[str, str]]) -> None:
        super().__init__()
        self.stops, self.lexicon = frozenset(stops), lexicon
        self.endings = [(re.compile(pattern), by) for pattern, by in endings]

    def __missing__(self, word: str) -> tuple[str, bool, bool]:
        lemma = self.lexicon.get(word)
        if lemma is None:
            lemma = next((pattern.sub(by, word) for pattern, by in self.endings if pattern.search(word)), word)
        found = (lemma, word.isalpha(), word in self.stops)
        if len(self) < MOST_KEPT:
            self[word] = found
        return found


def dictionary_lemmas(text: Column, stops: list[str], lexicon: Mapping[str, str] = IRREGULAR, endings: Sequence[tuple[str, str]] = ENDINGS, counted: bool = False) -> Column:
    """(terms, lemmas, tokens) of a text: each word looked up in ``lexicon``, else without the first of the ``endings`` that fits.

    A lemma depends on its word alone, so each worker works it out once a word. White space and letters are what ``words``
    and ``\\p{L}`` mean. With ``counted`` the tokens are only counted: (terms, lemmas, n_tokens).
    """
    if len(lexicon) > MOST_ENTRIES:
        raise ValueError(f"a lexicon of more than {MOST_ENTRIES} entries needs a lemmatizer UDF")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(stops, lexicon, endings)
        for texts in batches:
            terms, lemmas, last = [], [], []
            for at in range(0, max(1, len(texts)), ROWS):
                listed = [(x or "").split() for x in texts.slice(at, ROWS).to_pylist()]
                found = [[known[w] for w in ws] for ws in listed]
                terms += [" ".join([w for w, k in zip(ws, ks, strict=True) if k[1]]) for ws, ks in zip(listed, found, strict=True)]
                lemmas += [" ".join([k[0] for k in ks if k[1] and not k[2]]) for ks in found]
                last.append(pa.array([len(ws) for ws in listed], type=pa.int32()) if counted else token_lists(listed, found))
            yield pa.StructArray.from_arrays([pa.array(terms, type=pa.string()), pa.array(lemmas, type=pa.string()), pa.concat_arrays(last)], names=["terms", "lemmas", "n_tokens" if counted else "tokens"])

    return F.arrow_udf(run, COUNTED_TYPE if counted else RESULT_TYPE)(text)


def token_lists(listed: list[list[str]], found: list[list[tuple[str, bool, bool]]]) -> pa.ListArray:
    """Words and what is known of them as a list of token structs a text."""
    flat = [k for ks in found for k in ks]
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
    columns = [[w for ws in listed for w in ws], *([k[i] for k in flat] for i in range(3))]
    tokens = pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["text", "lemma", "is_alpha", "is_stop"])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(len(ws) for ws in listed)], type=pa.int32()), tokens)


def assembled(tokens: Column) -> Column:
    """The result struct of a token array: alphabetic texts, and lemmas of alphabetic words that are no stop words."""
    alpha = F.filter(tokens, lambda t: t.is_alpha)
    content = F.filter(tokens, lambda t: t.is_alpha & ~t.is_stop)
    return F.struct(F.array_join(F.transform(alpha, lambda t: t.text), " ").alias("terms"), F.array_join(F.transform(content, lambda t: t.lemma), " ").alias("lemmas"), tokens.alias("tokens"))


def udf_lemmas(load: Callable[[], Callable[[str], list[tuple[str, str, bool, bool]]]]) -> Callable[[Column], Column]:
    """A lemmatizer from outside: ``load`` runs once a worker and gives a function from text to token tuples."""

    @F.pandas_udf(DOC_TYPE)
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        names = ("text", "lemma", "is_alpha", "is_stop")
        for texts in batches:
            yield pd.Series([None if t is None else [dict(zip(names, x, strict=True)) for x in model(t)] for t in texts], index=texts.index)

    return lambda text: assembled(F.coalesce(tokens(text), F.array().cast(DOC_TYPE)))


def lemmatized(df: DataFrame, text: str, prefix: str, lemmas: Callable[[Column], Column]) -> DataFrame:
    """Adds ``{prefix}clean_lemmatized`` and ``{prefix}clean_tokens``, and sets ``{prefix}clean`` to the joined terms."""
    out = df.withColumn("__l", lemmas(F.col(text)))
    return out.withColumns({f"{prefix}clean": F.col("__l.terms"), f"{prefix}clean_lemmatized": F.col("__l.lemmas"), f"{prefix}clean_tokens": F.col("__l.tokens")}).drop("__l")
