"""Corpus pipelines: clean, lemmatize, tag, measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.features import with_features
from ..functions.lemma import lemmatized
from ..operators.relational import distinct_names, enrich, map_codes, seeded_sample


def preprocess(df: DataFrame, text: str, prefix: str = "", regex: Callable[[Column], Column] | None = t.clean, lemmas: Callable[[Column], Column] | None = None, skills: Callable[[Column], Column] | None = t.skills, domains: Callable[[Column, Column | None], Column] | None = t.domains) -> DataFrame:
    """Adds {prefix}clean, and as asked clean_lemmatized, clean_tokens, skills and domains.

    Every step is a function of columns and independent of the others and of the number of rows; ``regex`` is
    required. Null texts give an empty text and empty lists.
    """
    if regex is None:
        raise ValueError("a text cleaning function is required")
    out = df.withColumn(f"{prefix}clean", regex(F.col(text)))
    if lemmas is not None:
        out = lemmatized(out, f"{prefix}clean", prefix, lemmas)
    if skills is not None:
        out = out.withColumn(f"{prefix}skills", skills(F.col(f"{prefix}clean")))
    if domains is not None:
        out = out.withColumn(f"{prefix}domains", domains(F.col(f"{prefix}clean"), F.col(f"{prefix}skills") if skills is not None else None))
    return out


def job_corpus(postings: DataFrame, skill_links: DataFrame, industry_links: DataFrame, skill_names: DataFrame, industry_names: DataFrame, rows: int | None = 1000, seed: int = 42, **steps) -> DataFrame:
    """The job corpus: postings with their lists of skill and industry names, cleaned, tagged and measured."""
    skills = distinct_names(map_codes(skill_links, skill_names, "skill_abr"), "job_id", "skill_name", "skill_name")
    industries = distinct_names(map_codes(industry_links, industry_names, "industry_id"), "job_id", "industry_name", "industry_name")
    picked = postings if rows is None else seeded_sample(postings, "job_id", rows, seed)
    jobs = enrich(enrich(picked, skills, "job_id"), industries, "job_id").withColumn("title_clean", t.clean(F.col("title")))
    jobs = jobs.select("job_id", "title", "title_clean", "skill_name", "industry_name", "description")
    return with_features(preprocess(jobs, "description", "desc_", **steps), "desc_clean", "desc_")


def resume_corpus(resumes: DataFrame, rows: int | None = 1000, seed: int = 42, **steps) -> DataFrame:
    """The résumé corpus; the key ``ID`` is kept."""
    picked = resumes if rows is None else seeded_sample(resumes, "ID", rows, seed)
    own = picked.withColumnRenamed("Resume_str", "resume").drop("Resume_html")
    return with_features(preprocess(own, "resume", "resume_", **steps), "resume_clean", "resume_")
