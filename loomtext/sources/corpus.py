"""Saving and loading a corpus: one folder with Parquet data and a manifest that is written last.

Token arrays are ordinary nested columns, so nulls and types need no side files. Paths may be in any store
that Spark reaches; the manifest is read and written through Spark too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.lemma import DOC_TYPE
from ..session import checkpointed

VERSION = 1
POSITION = "_row_pos"


def corpus_path(path: str) -> str:
    """The folder of a corpus: a suffix of the last part is dropped (``x.parquet`` means ``x``)."""
    head, slash, last = path.rstrip("/").rpartition("/")
    return head + slash + (last.rsplit(".", 1)[0] if "." in last[1:] else last)


def token_columns(df: DataFrame) -> list[str]:
    """The columns whose type is the token array."""
    wanted = StructType.fromDDL(f"x {DOC_TYPE}")[0].dataType.simpleString()
    return [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and f.dataType.simpleString() == wanted]


def with_positions(df: DataFrame, order: str) -> DataFrame:
    """``_row_pos`` from 0 by the order of a column; range-partitioned first, so that no task numbers all rows.

    The ranges are drawn by sampling, so the partitioned rows are checkpointed before they are counted.
    """
    cut = checkpointed(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["n"] for r in cut.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    if not starts:
        return df.withColumn(POSITION, F.lit(0).cast("long"))
    first = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    own = F.row_number().over(W.partitionBy("__part").orderBy(order))
    return cut.withColumn(POSITION, (own - 1 + first[F.col("__part")]).cast("long")).drop("__part")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot move {source} to {target}")


def save_corpus(df: DataFrame, path: str, token_cols: list[str] | None = None, overwrite: bool = True, **options: str) -> str:
    """Writes the corpus and gives its folder.

    All is written to a folder beside it first, which takes its place when it is whole: a job that fails leaves the old
    corpus as it was, and a corpus may be saved over the folder it was read from.
    FileExistsError if it is there and may not be overwritten; KeyError for a token column that ``df`` has not;
    TypeError for one of another type. ``options`` go to the Parquet writer.
    """
    spark, folder = df.sparkSession, corpus_path(path)
    fs, at = _fs(spark, folder)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(folder)
    found = token_columns(df)
    for c in token_cols or []:
        if c not in df.columns:
            raise KeyError(c)
        if c not in found:
            raise TypeError(f"{c} is not an array of tokens")
    mark = uuid.uuid4().hex
    new, old = f"{folder}.new-{mark}", f"{folder}.old-{mark}"
    df.write.options(**options).mode("errorifexists").parquet(f"{new}/data")
    count = spark.read.parquet(f"{new}/data").count()
    manifest = {"version": VERSION, "spark": spark.version, "row_count": count, "columns_order": df.columns, "doc_cols": token_cols if token_cols is not None else found, "schema": json.loads(df.schema.json())}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{new}/manifest")
    if fs.exists(at):
        _moved(fs, at, _fs(spark, old)[1])
    _moved(fs, _fs(spark, new)[1], at)
    fs.delete(_fs(spark, old)[1], True)
    return folder


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The saved corpus with its columns in order, in the order of ``_row_pos`` if it has one.

    FileNotFoundError if the manifest is missing, ValueError if the rows are not as many as it says.
    """
    folder = corpus_path(path)
    fs, at = _fs(spark, f"{folder}/manifest/_SUCCESS")
    if not fs.exists(at):
        raise FileNotFoundError(folder)
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    df = spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{folder}/data").select(*manifest["columns_order"])
    n = df.count()
    if n != manifest["row_count"]:
        raise ValueError(f"{n} rows, {manifest['row_count']} in the manifest")
    return df.orderBy(POSITION) if POSITION in df.columns else df
