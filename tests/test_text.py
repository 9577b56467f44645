"""Cleaning, tokens, tags and features on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import features, lemma, text as t
from loomtext.plans.pipeline import preprocess


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, ""),
        ("", ""),
        ("Hello,  World!", "hello world"),
        ("see http://a.b/c?d=1 now", "see now"),
        ("see www.site.org now", "see now"),
        ("mail me@site.org now", "mail now"),
        ("C++ and node.js 3", "c and node js"),
        ("café naïve", "caf na ve"),
        ("a b c", "a b c"),
        ("x" * 50_000, "x" * 50_000),
    ],
)
def test_clean(spark, given, want):
    assert one(spark, given, t.clean) == want


def test_words_split_at_any_white_space(spark):
    assert one(spark, " a\tb c d\n", t.words) == ["a", "b", "c", "d"]
    assert one(spark, None, t.words) == []


def test_skills_are_whole_tokens_unless_phrases_are_asked_for(spark):
    assert one(spark, "python javascripts sql power systems", t.skills) == ["python", "sql"]
    assert one(spark, "power systems and sql", lambda c: t.skills(c, phrases=True)) == ["sql", "power systems"]
    assert one(spark, None, t.skills) == []


def test_domains_come_from_words_and_from_skills(spark):
    def both(c):
        return t.domains(c, t.skills(c))

    assert one(spark, "aws in retail", both) == ["retail", "tech"]
    assert one(spark, "leadership", both) == ["business"]
    assert one(spark, None, both) == []
    assert one(spark, "aws in retail", t.domains) == ["retail"]


def test_categories_are_substrings_in_table_order(spark):
    df = spark.createDataFrame([("Seoul guide", "NLP work"), (None, None), ("Backend", "sales representative")], "a string, b string")
    rows = [r[0] for r in df.select(t.categories(F.col("a"), F.col("b"))).collect()]
    assert rows == [["data_science", "marketing"], ["other"], ["software_engineer", "sales"]]


@pytest.mark.parametrize(("given", "want"), [(None, (0, 0.0, 0, 0.0)), ("", (0, 0.0, 0, 0.0)), ("word", (1, 4.0, 1, 1.0)), ("a bb a", (3, 4 / 3, 2, 2 / 3)), ("hi \U0001f600", (2, 1.5, 2, 1.0))])
def test_features(spark, given, want):
    row = features.with_features(spark.createDataFrame([(given,)], "x string"), "x", "f_").first()
    assert (row.f_text_length, row.f_avg_word_length, row.f_unique_word_count, row.f_lexical_diversity) == pytest.approx(want)


def test_dictionary_lemmas(spark):
    def found(c):
        return lemma.dictionary_lemmas(c, ["the"], {"dogs": "dog"})

    got = one(spark, "the dogs r2d2", found)
    assert (got.terms, got.lemmas) == ("the dogs", "dog")
    assert [x.is_alpha for x in got.tokens] == [True, True, False]
    assert one(spark, None, found).tokens == []


def test_lemmatizer_from_outside(spark):
    def load():
        return lambda s: [(w, w.upper(), w.isalpha(), w == "the") for w in s.split()]

    got = one(spark, "the dog 7", lemma.udf_lemmas(load))
    assert (got.terms, got.lemmas) == ("the dog", "DOG")
    assert one(spark, None, lemma.udf_lemmas(load)).terms == ""


def test_preprocess_needs_a_cleaner_and_makes_what_is_asked(spark):
    df = spark.createDataFrame([("Python in Retail",)], "x string")
    with pytest.raises(ValueError, match="required"):
        preprocess(df, "x", regex=None)
    assert preprocess(df, "x", "p_", skills=None).columns == ["x", "p_clean", "p_domains"]
    row = preprocess(df, "x", "p_", lemmas=lambda c: lemma.dictionary_lemmas(c, ["in"], {})).first()
    assert (row.p_clean, row.p_clean_lemmatized, row.p_skills, row.p_domains) == ("python in retail", "python retail", ["python"], ["retail"])


def test_report_is_a_constant(spark):
    assert one(spark, None, t.report) == one(spark, "x", t.report) == "report not available"


def test_lemmas_are_those_of_the_column_expressions(spark):
    words = [*lemma.IRREGULAR, "glasses", "buses", "studies", "boxes", "cats", "running", "tried", "agreed", "sing", "ss", "x", "dog7", "é́", "ñandús", "naïve", "ⅷ", "ʰ", "二"]
    gaps = [" ", " ", "\x85", "\x1c", "\x0b", "　", "\t ", "\n"]
    text = "".join(w + gaps[i % len(gaps)] for i, w in enumerate(words))
    word = F.col("w")
    known = F.create_map(*[F.lit(x) for kv in lemma.IRREGULAR.items() for x in kv])
    plain = word
    for pattern, by in reversed(lemma.ENDINGS):
        plain = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, by.replace("\\", "$"))).otherwise(plain)
    df = spark.createDataFrame([(text,)], "x string")
    want = df.select(F.posexplode(t.words(F.col("x"))).alias("i", "w")).select("i", word, F.coalesce(F.try_element_at(known, word), plain).alias("l"), word.rlike(r"^\p{L}+$").alias("a"), word.isin("is", "cats").alias("s"))
    want = [tuple(x)[1:] for x in want.orderBy("i").collect()]
    got = one(spark, text, lambda c: lemma.dictionary_lemmas(c, ["is", "cats"]))
    assert [tuple(x) for x in got.tokens] == want
    counted = one(spark, text, lambda c: lemma.dictionary_lemmas(c, ["is", "cats"], counted=True))
    assert (counted.terms, counted.lemmas, counted.n_tokens) == (got.terms, got.lemmas, len(want))


def test_lemmas_of_many_words_are_right_when_few_are_kept(monkeypatch):
    monkeypatch.setattr(lemma, "MOST_KEPT", 2)
    known = lemma.Known(["is"], lemma.IRREGULAR, lemma.ENDINGS)
    assert [known[w] for w in ("cats", "is", "dogs", "went", "dogs")] == [("cat", True, False), ("be", True, True), ("dog", True, False), ("go", True, False), ("dog", True, False)]
    assert len(known) == 2


def test_lemmas_of_more_texts_than_are_split_at_a_time(spark):
    df = spark.range(700).repartition(1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("cats "), "id")).alias("x"))
    got = df.select("id", lemma.dictionary_lemmas(F.col("x"), []).alias("l")).collect()
    assert len(got) == 700
    for x in got:
        assert [k.text for k in x.l.tokens] == (["cats", str(x.id)] if x.id % 5 else []) and x.l.lemmas == ("cat" if x.id % 5 else "")
