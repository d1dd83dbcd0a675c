"""Helpers shared by the operators: reading tables, materialising, connected components."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers up to which a side may be broadcast (about 90 bytes each as a hash table: 45 MB).
BROADCAST_ROWS = 500_000

_own_dir: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="pairloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder: it survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only if its counted rows stay within the bound."""
    return F.broadcast(df) if rows <= most else df


def sent(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast an object of this package with its class by value: workers need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(told: Broadcast) -> object:
    """What ``sent`` broadcast, to be read once for each task."""
    return pickle.loads(told.value)


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Every node hooks to its smallest neighbour, labels jump to their label's label until they rest, and
    edges shrink to those between different labels: a round leaves at most half of the nodes, a star
    is gone after one.  All aggregates combine before the shuffle; a hub's rows meet in no single
    task.  Every step is a written table.  Null ends are ignored.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(low, high).distinct(), f"{tag}-edges")
    known = None
    while known is None or not left.isEmpty():
        both = left.unionAll(left.select("b", "a"))
        labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("lab")), f"{tag}-hooks")
        while True:
            via = labels.select(F.col("node").alias("via"), F.col("lab").alias("far"))
            moved = materialize(labels.join(via, F.col("lab") == F.col("via")).select("node", F.col("far").alias("lab"), (F.col("far") != F.col("lab")).alias("new")), f"{tag}-jumps")
            labels = moved.select("node", "lab")
            if moved.where("new").isEmpty():
                break
        # labels of earlier rounds are nodes of this one, or rest
        step = labels.select(F.col("node").alias("via"), F.col("lab").alias("far"))
        known = labels if known is None else materialize(known.join(step, F.col("lab") == F.col("via"), "left").select("node", F.coalesce("far", "lab").alias("lab")), f"{tag}-known")
        ends = left.join(labels.select(F.col("node").alias("a"), F.col("lab").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("lab").alias("y")), "b")
        left = materialize(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{tag}-edges")
    return known.select("node", F.col("lab").alias("component"))
