"""Corpora, CSV files and streams."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions.lemma import DOC_TYPE, dictionary_lemmas, lemmatized
from loomtext.operators import classify
from loomtext.plans.pipeline import job_corpus, resume_corpus
from loomtext.plans.settings import Settings
from loomtext.sources import corpus as c, delimited as d
from loomtext.streaming import steps


def tokens(spark):
    df = spark.createDataFrame([(2, "the dogs"), (1, None)], "k long, x string")
    out = lemmatized(df, "x", "p_", lambda col: dictionary_lemmas(col, ["the"], {"dogs": "dog"}))
    return out.withColumn("p_clean_tokens", F.when(F.col("k") == 2, F.col("p_clean_tokens")))


def test_round_trip_keeps_types_nulls_order_and_columns(spark, tmp_path):
    df = c.with_positions(tokens(spark), "k")
    folder = c.save_corpus(df, str(tmp_path / "set.parquet"))
    assert folder == str(tmp_path / "set")
    got = c.load_corpus(spark, str(tmp_path / "set"))
    assert got.schema.simpleString() == df.schema.simpleString() and [x.k for x in got.collect()] == [1, 2]
    assert got.collect()[0].p_clean_tokens is None and got.collect()[1].p_clean_tokens[1].lemma == "dog"


def test_token_columns_are_found_by_type(spark):
    df = tokens(spark)
    assert c.token_columns(df) == ["p_clean_tokens"] and df.schema["p_clean_tokens"].dataType.simpleString() == DOC_TYPE


def test_errors(spark, tmp_path):
    df, path = tokens(spark), str(tmp_path / "x")
    with pytest.raises(FileNotFoundError):
        c.load_corpus(spark, path)
    with pytest.raises(KeyError):
        c.save_corpus(df, path, ["nope"])
    with pytest.raises(TypeError):
        c.save_corpus(df, path, ["x"])
    c.save_corpus(df, path, ["p_clean_tokens"])
    with pytest.raises(FileExistsError):
        c.save_corpus(df, path, overwrite=False)
    df.limit(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="rows"):
        c.load_corpus(spark, path)


def test_positions_number_all_rows(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7)
    got = c.with_positions(df, "k").collect()
    assert all(x.k == x[c.POSITION] for x in got) and len(got) == 1000
    assert c.with_positions(df.limit(0), "k").count() == 0


def csv(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_fields_may_span_lines_and_bad_numbers_are_null(spark, tmp_path):
    path = csv(tmp_path / "p.csv", 'x,title,job_id,description\n1,T,5,"two\nlines, ""quoted"""\n2,U,bad,\n')
    rows = d.read_csv(spark, path, d.POSTINGS).collect()
    assert [tuple(x) for x in rows] == [(5, "T", 'two\nlines, "quoted"'), (None, "U", None)]
    d.write_csv(d.read_csv(spark, path, d.POSTINGS), str(tmp_path / "out"))
    assert sorted(d.read_csv(spark, str(tmp_path / "out"), d.POSTINGS).collect(), key=str) == sorted(rows, key=str)
    assert d.read_processed(spark, path, d.POSTINGS, "title").where(F.col(c.POSITION) == 1).first().title == "U"


def test_csv_keeps_ends_of_texts_and_tells_empty_from_null(spark, tmp_path):
    odd = [None, "", " ", "\n", " a", "a ", "\ta", "a\n", "\r\na\r", "\x1fa", '"', '""', ' "a" ', "a,b", "\\", '\\"', "\\N", "null", "#a", "\ufeffa", "x" * 3000000 + '"\n']
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(odd)], "job_id long, title string, description string")
    d.write_csv(df, str(tmp_path / "odd"))
    assert sorted(map(tuple, d.read_csv(spark, str(tmp_path / "odd"), d.POSTINGS).collect())) == [(i, x, x) for i, x in enumerate(odd)]


def test_the_two_corpora(spark, tmp_path):
    postings = d.read_csv(spark, csv(tmp_path / "a.csv", "job_id,title,description\n1,Data Scientist!,Python at http://x.y\n2,Clerk,retail\n"), d.POSTINGS)
    links = d.read_csv(spark, csv(tmp_path / "b.csv", "job_id,skill_abr\n1,IT\n1,ENG\n"), d.SKILL_LINKS)
    industries = d.read_csv(spark, csv(tmp_path / "c.csv", "job_id,industry_id\n1,4\n"), d.INDUSTRY_LINKS)
    names = d.read_csv(spark, csv(tmp_path / "d.csv", "skill_abr,skill_name\nIT,Information Technology\nENG,Engineering\n"), d.SKILL_NAMES)
    kinds = d.read_csv(spark, csv(tmp_path / "e.csv", "industry_id,industry_name\n4,Software\n"), d.INDUSTRY_NAMES)
    jobs = job_corpus(postings, links, industries, names, kinds, lemmas=lambda col: dictionary_lemmas(col, [], {})).orderBy("job_id")
    assert jobs.columns == "job_id title title_clean skill_name industry_name description desc_clean desc_clean_lemmatized desc_clean_tokens desc_skills desc_domains desc_text_length desc_avg_word_length desc_unique_word_count desc_lexical_diversity".split()
    first, second = jobs.collect()
    assert (first.title_clean, first.skill_name, first.industry_name, first.desc_clean, first.desc_skills) == ("data scientist", ["engineering", "information technology"], ["software"], "python at", ["python"])
    assert second.skill_name is None and second.desc_domains == ["retail"]
    resumes = d.read_csv(spark, csv(tmp_path / "f.csv", "ID,Resume_str,Resume_html,Category\n9,SQL and Docker,<b>,IT\n"), d.RESUMES)
    row = resume_corpus(resumes).first()
    assert (row.ID, row.Category, row.resume_skills, row.resume_domains) == (9, "IT", ["sql", "docker"], ["tech"])


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "Python in retail"), (2, None)], "k long, x string")
    df.write.parquet(str(tmp_path / "in"))
    stream = steps.prepared(steps.read_stream(spark, str(tmp_path / "in"), "k long, x string"), "x", "p_")
    steps.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got, want = spark.read.parquet(str(tmp_path / "out")), steps.prepared(df, "x", "p_")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_model_is_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(i, ("red apple fruit" if i % 2 else "fast car engine") + f" x{i % 3}", "f" if i % 2 else "c") for i in range(60)], "k long, t string, y string")
    model, test = classify.train(df, "k", "t", "y", str(tmp_path / "m"))
    again = classify.predict(classify.load(str(tmp_path / "m")), test).collect()
    assert len(again) == 12 and all(x.predicted == x.y for x in again)
    assert sorted(map(str, classify.predict(model, test).collect())) == sorted(map(str, again))


def test_settings_make_folders_only_when_asked(tmp_path):
    s = Settings(root=str(tmp_path))
    assert not list(tmp_path.iterdir())
    assert all(x.is_dir() for x in s.init_dirs()) and s.folder("corpus/jobs").endswith("corpus/jobs")


def test_a_corpus_can_be_saved_over_the_folder_it_was_read_from(spark, tmp_path):
    path = str(tmp_path / "c")
    c.save_corpus(spark.range(5).selectExpr("id", "'x' AS t"), path)
    c.save_corpus(c.load_corpus(spark, path).selectExpr("id + 1 AS id", "t"), path)
    assert sorted(x.id for x in c.load_corpus(spark, path).collect()) == [1, 2, 3, 4, 5]
    assert [x.name for x in tmp_path.iterdir()] == ["c"]


def test_a_failed_save_leaves_the_old_corpus(spark, tmp_path):
    path = str(tmp_path / "c")
    c.save_corpus(spark.range(3).selectExpr("id"), path)
    with pytest.raises(Exception, match="nothing"):
        c.save_corpus(spark.range(3).selectExpr("raise_error('nothing') AS id"), path)
    assert c.load_corpus(spark, path).count() == 3
