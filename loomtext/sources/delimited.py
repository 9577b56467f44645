"""CSV sources with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = "job_id bigint, title string, description string"
RESUMES = "ID bigint, Resume_str string, Resume_html string, Category string"
SKILL_LINKS, INDUSTRY_LINKS = "job_id bigint, skill_abr string", "job_id bigint, industry_id bigint"
SKILL_NAMES, INDUSTRY_NAMES = "skill_abr string, skill_name string", "industry_id bigint, industry_name string"


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The named columns of a CSV with a header, found by name whatever their order; quoted fields may span lines.

    Other columns are not kept. Fields are read as text and cast, so a bad number is null. A field without quotes and without
    text is null, a quoted one is an empty text: no field can be the mark that stands for null while reading.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, nullValue=uuid.uuid4().hex, emptyValue="")
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(columns)
    return raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in wanted])


def read_processed(spark: SparkSession, path: str, columns: str, order: str) -> DataFrame:
    """A processed set saved as CSV, with ``_row_pos`` numbering its rows from 0 in the order of a column."""
    from ..sources.corpus import with_positions

    return with_positions(read_csv(spark, path, columns), order)


def write_csv(df: DataFrame, path: str) -> None:
    """A header, quotes doubled inside fields; arrays are joined with ``|``. White space at the ends of texts is kept,
    and null is not an empty text. U+0000 is written, but Spark's CSV reader leaves it out of quoted fields."""
    flat = [F.array_join(F.col(c), "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
