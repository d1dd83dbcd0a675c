"""Resumable scoring: only pairs without a stored score are scored, and runs may stop anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.runs import Run
from ..operators.scoring import PairScorer, scored

SCORES = "a string, b string, p double"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Scores written so far; none if there are none."""
    try:
        return spark.read.schema(SCORES).parquet(path)
    except Exception as e:  # a missing path has its own error class
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCORES)


def resume(spark: SparkSession, pairs: DataFrame, model: PairScorer, path: str, identity: dict | None = None) -> DataFrame:
    """Score what is missing, append it (each append commits as a whole) and return all wanted scores.

    With an ``identity`` (model, version, settings, inputs) the scores at ``path`` belong to it, and
    going on with another one is an error."""
    if identity is not None:
        Run(spark, f"{path}.run", identity)
    missing = pairs.select("a", "b").distinct().join(stored(spark, path), ["a", "b"], "left_anti")
    scored(missing, model).write.mode("append").parquet(path)
    return pairs.select("a", "b").distinct().join(stored(spark, path).dropDuplicates(["a", "b"]), ["a", "b"])


def stream_scores(spark: SparkSession, source: str, model: PairScorer, path: str, checkpoint: str):
    """Score pairs from a folder of Parquet files as they come; each file is scored once.

    A batch is anti-joined with the stored scores, so a batch that runs again adds nothing."""
    pairs = spark.readStream.schema("a string, b string").parquet(source)

    def one(batch: DataFrame, _: int) -> None:
        missing = batch.distinct().join(stored(batch.sparkSession, path), ["a", "b"], "left_anti")
        scored(missing, model).write.mode("append").parquet(path)

    return pairs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
