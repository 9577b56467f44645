"""The corpus pipeline: from ``documents`` to packed training sequences, in five stages.

Each stage gets the rows that its predecessor kept, as written to Parquet, and its decisions take effect:
toxic documents go, one document of each near-duplicate group stays, repeated passages are cut, the mixture
copies or leaves out documents, and what is left is packed. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import table
from loomtext.llm.near_copies import without_near_copies
from loomtext.llm.op1_mixing import mixed_documents
from loomtext.llm.op3_toxicity import without_toxic
from loomtext.llm.op5_packing import pack, vocabulary
from loomtext.llm.op7_substrings import without_repeats
from loomtext.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; labels are those of the ``labels`` table."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of every group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every repeated passage left in one document only; those left without a word go."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to target weights: a row for every copy drawn."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again.

    A stage's folder is removed as soon as the next stage is written; that of the last but one stays, as the result
    reads it. Null and empty texts, null ids, repeated rows and extra columns go through all stages as each stage's
    operator has it; an empty table gives an empty result.
    """
    base, last = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{base}/{i}-{name}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            if last:
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
            last = path
    return docs
