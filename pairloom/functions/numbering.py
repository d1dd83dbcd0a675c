"""Global row numbers without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import staged


def range_numbered(rows: DataFrame, order: list[str | Column], out: str = "place") -> DataFrame:
    """Rows with ``out``: their place from 1 in a total order.

    Rows are range-partitioned and sorted, and written once with their partition and place in it;
    the counts of partitions, one row each, give every partition its start.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ids = F.monotonically_increasing_id()
    fixed = staged(ranged.withColumn("__part", F.shiftright(ids, 33)).withColumn("__in", ids.bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    counts = fixed.groupBy("__part").agg(F.count("*").alias("__c"))
    before = counts.select("__part", F.coalesce(F.sum("__c").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return fixed.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__in") + 1).drop("__part", "__in", "__before")
