"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontam, mixing, neardup, quality, sharding
from pairloom.llm.common import bounded_broadcast, materialize, read_table
from pairloom.llm.queries import MIXTURE, SHARDS

#: Documents below this probability of label 1 are rejected.
REJECT_BELOW = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject.  It is fitted on these documents and
    the table ``labels``; without labels nothing is rejected."""
    net = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, net, out="__score").where(F.col("__score") >= REJECT_BELOW).drop("__score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group (five words, 0.8).

    Documents without a doc_id stay.  Rows with equal doc_ids stay or go together.
    """
    groups = neardup.near_duplicates(docs, words=5, percent=80)
    gone = materialize(groups.where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(bounded_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text, whatever its id."""
    return decontam.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by calibrated probabilities of source, language and topic.  Null values are
    values of their own; columns of ``docs`` keep their names and values."""
    rows = docs.withColumns({"__topic": mixing.topic_of(F.col("text")), "__tokens": mixing.tokens_of(F.col("text"))})
    dims = {("__topic" if d == "topic" else d): told for d, told in MIXTURE.items()}
    return mixing.mix(rows, dims, tokens="__tokens", prefix="__mix_").where("__mix_sampled").select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, checksum, shard and slot of every document that is left."""
    return sharding.shard_table(docs, SHARDS)


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("source mixture", mixed_to_targets),
    ("shards", sharded),
]

#: A network, sketches and random draws have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
