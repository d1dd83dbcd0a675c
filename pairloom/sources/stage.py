"""Written intermediate tables: they cut lineage, and survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast.
BROADCAST_ROWS = 500_000

#: Rows of a table for each task that works on what it gives.
TASK_ROWS = 250_000

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is named."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pairloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def staged(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """A number of tasks in proportion to the rows of ``df``, at least that of the cores: memory of one stays bounded."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only if its rows, counted up to the bound, stay within it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
