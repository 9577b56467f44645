"""The stateless steps over a stream: the same column functions as in batch, nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.features import with_features
from ..plans.pipeline import preprocess


def read_stream(spark: SparkSession, path: str, columns: str, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def prepared(stream: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Cleaned, tagged and measured, row by row."""
    return with_features(preprocess(stream, text, prefix), f"{prefix}clean", prefix)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet until what is there now is done."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
