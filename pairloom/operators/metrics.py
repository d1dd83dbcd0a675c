"""Ranking, agreement and roll-up metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import range_numbered

NAN = float("nan")


def roc_auc(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Rank-sum AUC of each group, ties count half; NaN for a single class.  Work is on distinct
    scores, combined before the shuffle."""
    g = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    w = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("before", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    agg = g.groupBy(*by).agg(F.sum(F.col("pos") * (2 * F.col("before") + F.col("neg"))).alias("twice"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(*by, F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(NAN)).otherwise(F.col("twice") / (2.0 * F.col("P") * F.col("N"))).alias("auc"), (F.col("P") + F.col("N")).alias("n"))


def average_precision(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    g = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("tp"), F.count("*").alias("n"))
    w = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    g = g.withColumn("ctp", F.sum("tp").over(w)).withColumn("cn", F.sum("n").over(w))
    agg = g.groupBy(*by).agg(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s"), F.sum("tp").alias("P"), F.sum("n").alias("n"))
    return agg.select(*by, F.when((F.col("P") == 0) | (F.col("P") == F.col("n")), F.lit(NAN)).otherwise(F.col("s") / F.col("P")).alias("ap"), "n")


def split_scores(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    pos, neg = F.col(label) == 1, F.col(label) == 0
    return rows.groupBy(*by).agg(
        F.avg(F.when(pos, F.col(score))).alias("mean_pos"), F.avg(F.when(neg, F.col(score))).alias("mean_neg"),
        F.sum(pos.cast("bigint")).alias("n_pos"), F.sum(neg.cast("bigint")).alias("n_neg"),
    )


def _seeds(seed: str, when: Column | None = None) -> Column:
    one = F.col(seed) if when is None else F.when(when, F.col(seed))
    return F.array_join(F.transform(F.array_sort(F.collect_set(one)), lambda s: s.cast("string")), ",")


def seed_rollup(rows: DataFrame, by: list[str], value: str = "value", seed: str = "seed") -> DataFrame:
    """Mean, sample deviation (0 for one), count and seeds of each group; NaN rows leave first."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    return good.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n_seeds"), _seeds(seed).alias("seeds"))


def seed_rollup_all(rows: DataFrame, by: list[str], value: str = "value", seed: str = "seed") -> DataFrame:
    """The same, but a group of NaN alone stays, with no mean, n_seeds 0 and all its seeds."""
    v = F.when(~F.isnan(value), F.col(value))
    n = F.count(v)
    return rows.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"), n.alias("n_seeds"),
        F.when(n > 0, _seeds(seed, v.isNotNull())).otherwise(_seeds(seed)).alias("seeds"),
    )


def cohen_kappa(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Agreement of two raters; NaN where chance agreement is complete."""
    by = by or []
    conf = rows.groupBy(*by, x, y).agg(F.count("*").alias("c"))
    long = conf.select(*by, F.explode(F.array(F.struct(F.lit("x").alias("s"), F.col(x).cast("string").alias("v")), F.struct(F.lit("y").alias("s"), F.col(y).cast("string").alias("v")))).alias("e"), "c")
    marg = long.groupBy(*by, "e.v").agg(F.sum(F.when(F.col("e.s") == "x", F.col("c")).otherwise(0)).alias("cx"), F.sum(F.when(F.col("e.s") == "y", F.col("c")).otherwise(0)).alias("cy"))
    chance = marg.groupBy(*by).agg(F.sum(F.col("cx") * F.col("cy")).alias("e"), F.sum("cx").alias("n"))
    seen = conf.groupBy(*by).agg(F.sum(F.when(F.col(x).cast("string") == F.col(y).cast("string"), F.col("c")).otherwise(0)).alias("o"))
    both = chance.join(seen, by) if by else chance.crossJoin(F.broadcast(seen))
    n, e = F.col("n").cast("double"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return both.select(*by, F.when(e == 1, F.lit(NAN)).otherwise((F.col("o") / n - e) / (1 - e)).alias("kappa"), F.col("n"))


def precision_recall(rows: DataFrame, truth: str, guess: str, positive, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of a positive class; divisions by zero give 0."""
    t, g = F.col(truth) == positive, F.col(guess) == positive
    c = lambda x: F.sum(x.cast("bigint"))
    a = rows.groupBy(*(by or [])).agg(c(t & g).alias("tp"), c(~t & g).alias("fp"), c(t & ~g).alias("fn"), c(F.col(truth) == F.col(guess)).alias("ok"), F.count("*").alias("n"))
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select(*(by or []), "n", ratio(F.col("ok"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def majority(rows: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group, the smallest on a tie."""
    n = rows.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("votes"))
    return n.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("votes"), label))).where("__r = 1").drop("__r")


def quadrants(rows: DataFrame, quadrant: str, agree: Column, names: list[str]) -> DataFrame:
    """n, agreements and their share for each named quadrant, null share for an empty one."""
    spark = rows.sparkSession
    dim = F.broadcast(spark.createDataFrame([(q,) for q in names], "quadrant string"))
    a = rows.groupBy(F.col(quadrant).alias("quadrant")).agg(F.count("*").alias("n"), F.sum(agree.cast("bigint")).alias("agree"))
    j = dim.join(a, "quadrant", "left")
    return j.select("quadrant", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("agree", F.lit(0)).alias("agree"), F.when(F.col("n") > 0, 100.0 * F.col("agree") / F.col("n")).alias("pct"))


def percentile_edges(rows: DataFrame, value: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """``edges``: exact percentiles by linear interpolation, the last one raised by 1e-9.  Fewer than
    two values have no edges.  Without ``by`` the order statistics are picked by their places in a
    range-partitioned order: no task holds all values."""
    if not by:
        return _global_edges(rows, value, bins)
    at = [i / bins for i in range(bins + 1)]
    raw = F.percentile(F.col(value), F.array(*map(F.lit, at)))
    last = F.transform(raw, lambda e, i: F.when(i == bins, e + 1e-9).otherwise(e))
    return rows.groupBy(*by).agg(F.when(F.count(value) >= 2, last).otherwise(F.expr("cast(array() as array<double>)")).alias("edges"))


def _global_edges(rows: DataFrame, value: str, bins: int) -> DataFrame:
    placed = range_numbered(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), ["v"])
    n = placed.count()
    edges: list[float] = []
    if n >= 2:
        at = [(n - 1) * i / bins for i in range(bins + 1)]
        got = {r["place"]: r["v"] for r in placed.where(F.col("place").isin(sorted({int(p) + 1 for p in at} | {int(-(-p // 1)) + 1 for p in at}))).collect()}
        for p in at:
            low, high = int(p), int(-(-p // 1))
            edges.append(got[low + 1] if low == high else (high - p) * got[low + 1] + (p - low) * got[high + 1])
        edges[-1] += 1e-9
    return rows.sparkSession.createDataFrame([(edges,)], "edges array<double>")
