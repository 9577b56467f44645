"""Session helpers."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory}
    return SparkSession.builder.master(f"local[{cpus}]").appName("loomtext").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only a session on one machine may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or _temporary()


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="loomtext-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Inputs up to so many bytes are dealt over all cores; larger ones have splits enough of their own.
SMALL = 1 << 28
#: Tables of up to so many rows are broadcast after they were counted; larger ones are shuffled.
MOST_BROADCAST = 100_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is small: a file of few row groups is read by few tasks. Larger inputs are left as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def small_side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, written once and counted: marked for broadcast up to ``most`` rows, else left to a shuffled join."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= most else kept
