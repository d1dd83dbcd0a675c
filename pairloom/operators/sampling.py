"""Seeded sampling.  Every choice is a keyed hash: equal seeds give equal samples anywhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log1p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import range_numbered
from ..functions.scalars import hash32, hash_order, pair_hi, pair_lo, unit
from ..sources.stage import BROADCAST_ROWS, TASK_ROWS, bounded_broadcast, staged
from .folds import NEGATIVE_OFFSETS, TRAIN_NEGATIVE_OFFSET, numbered


#: Rows up to which a sample is merged in one task.
SMALL = 10_000


def capacity(n_a: int, n_b: int, same: bool) -> int:
    """Unordered pairs between two pools, or inside one."""
    return n_a * (n_a - 1) // 2 if same else n_a * n_b


def draw_tagged(spark: SparkSession, wanted: dict, pools: DataFrame, known: DataFrame) -> DataFrame:
    """(tag, a, b): exactly n distinct unordered pairs that are not in ``known`` for each tag.

    ``wanted``: tag -> (n, seed, pool of one side, pool of the other).  ``pools``: (pool, idx, node),
    idx from 0.  Draw i of a tag takes hash(seed:x:i) modulo the pool on each side; self pairs go, a
    pair keeps its first draw, known pairs are anti-joined, and the first n stay, which blocks of draws and their
    counts tell without a sort.  All tags share one plan, whose work is in proportion to the n wanted, whatever the size of pool x pool.  A tag that
    falls short is drawn further, which changes no earlier draw; more pairs than there are, or 50
    draws a pair without enough, is an error.
    """
    sizes = {r["pool"]: r["n"] for r in pools.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    for tag, (n, _, p, q) in wanted.items():
        if n > capacity(sizes.get(p, 0), sizes.get(q, 0), p == q):
            raise ValueError(f"{tag}: {n} pairs are more than the pools hold")
    most = {tag: max(50 * w[0], 1000) for tag, w in wanted.items()}
    large = [tag for tag, w in wanted.items() if w[0] > SMALL]
    held = known.count() if large else 0
    tries = {tag: min(3 * w[0] + 1000, most[tag]) for tag, w in wanted.items()}
    for tag in large:
        n, _, p, q = wanted[tag]
        tries[tag] = min(tries[tag], likely_draws(n, sizes[p], sizes[q], p == q, held))
    tags, codes, kind = list(wanted), {pool: c for c, pool in enumerate(sizes)}, "int" if all(isinstance(t, int) for t in wanted) else "string"
    code = reduce(lambda rest, kv: F.when(F.col("pool") == kv[0], kv[1]).otherwise(rest), codes.items(), F.lit(None).cast("int"))
    fit = F.broadcast if sum(sizes.values()) <= BROADCAST_ROWS else lambda df: df.hint("shuffle_hash")
    side = lambda s, x, u: fit(pools.select(code.alias(f"p{s}"), F.col("idx").alias(x), F.col("node").alias(u)))
    taken = known.select(pair_lo("a", "b").alias("a"), pair_hi("a", "b").alias("b"))
    block = F.shiftright("i", 12)
    while True:
        draws = None
        for t, tag in enumerate(tags):
            _, seed, p, q = wanted[tag]
            x, y = (F.pmod(hash32(str(seed), s, F.col("id")), F.lit(max(sizes.get(pool, 0), 1))) for s, pool in (("a", p), ("b", q)))
            one = spark.range(tries[tag]).select(F.lit(t).alias("t"), F.lit(codes.get(p, -1)).alias("pa"), F.lit(codes.get(q, -1)).alias("pb"), F.col("id").alias("i"), x.alias("x"), y.alias("y"))
            draws = one if draws is None else draws.unionAll(one)
        named = draws.join(side("a", "x", "u"), ["pa", "x"]).join(side("b", "y", "v"), ["pb", "y"])
        # pairs move once: they are made distinct and meet the known ones in the same place
        pairs = named.where("u <> v").select("t", pair_lo("u", "v").alias("a"), pair_hi("u", "v").alias("b"), "i")
        tasks = max(spark.sparkContext.defaultParallelism, -(-sum(tries.values()) // TASK_ROWS))
        pairs = pairs.repartition(tasks, "a", "b").groupBy("t", "a", "b").agg(F.min("i").alias("i"))
        found = staged(pairs.join(taken.repartition(tasks, "a", "b"), ["a", "b"], "left_anti"), "draws")
        # the block of draws in which the last one wanted lies, and its place there
        asked = F.broadcast(spark.createDataFrame([(t, wanted[tag][0]) for t, tag in enumerate(tags)], "t int, asked long"))
        blocks = found.groupBy("t", block.alias("block")).agg(F.count("*").alias("c"))
        blocks = blocks.withColumn("upto", F.sum("c").over(W.partitionBy("t").orderBy("block"))).join(asked, "t")
        last = F.min(F.when((F.col("asked") > 0) & (F.col("upto") >= F.col("asked")), F.struct("block", (F.col("asked") - F.col("upto") + F.col("c")).alias("place"))))
        got = {tags[r["t"]]: r for r in blocks.groupBy("t").agg(F.sum("c").alias("n"), last.alias("last")).collect()}
        short = [tag for tag, w in wanted.items() if w[0] > (got[tag]["n"] if tag in got else 0)]
        if not short:
            break
        for tag in short:
            if tries[tag] >= most[tag]:
                raise ValueError(f"{tag}: too few pairs after {tries[tag]} draws")
            tries[tag] = min(4 * tries[tag], most[tag])
    cuts = [(t, got[tag]["last"]["block"], got[tag]["last"]["place"]) for t, tag in enumerate(tags) if wanted[tag][0]]
    at = found.join(F.broadcast(spark.createDataFrame(cuts, "t int, block long, place long")), "t").where(block == F.col("block"))
    ends = at.withColumn("r", F.row_number().over(W.partitionBy("t").orderBy("i"))).where("r = place").select("t", "i").collect()
    ends = F.broadcast(spark.createDataFrame([(r["t"], tags[r["t"]], r["i"]) for r in ends], f"t int, tag {kind}, __end long"))
    return found.join(ends, "t").where(F.col("i") <= F.col("__end")).select("tag", "a", "b")


def likely_draws(n: int, n_a: int, n_b: int, same: bool, held: int) -> int:
    """Draws that very likely give n new pairs, if all ``held`` known ones lie between the pools: those expected, and a
    fiftieth and 1,000 more.  More than this are drawn if they fall short, so the sample does not depend on it."""
    whole = capacity(n_a, n_b, same)
    free = whole - min(held, whole)
    if n >= free:
        return 3 * n + 1000
    kept = (n_a - 1) / n_a if same else 1.0
    return int(1.02 * -log1p(-n / free) * whole / kept) + 1000


def draw_pairs(spark: SparkSession, pool_a: DataFrame, pool_b: DataFrame, known: DataFrame, n: int, seed: int) -> DataFrame:
    """(a, b): exactly ``n`` pairs between two pools of (idx, node), or inside one; see :func:`draw_tagged`."""
    pools = pool_a.select(F.lit("a").alias("pool"), "idx", "node")
    if pool_b is not pool_a:
        pools = pools.unionAll(pool_b.select(F.lit("b").alias("pool"), "idx", "node"))
    return draw_tagged(spark, {"pairs": (n, seed, "a", "a" if pool_b is pool_a else "b")}, pools, known).select("a", "b")


def indexed_pool(nodes: DataFrame, node: str = "node") -> DataFrame:
    """(idx, node): nodes numbered from 0 in their own order."""
    ids = nodes.select(F.col(node).alias("node")).distinct()
    return range_numbered(ids, ["node"], "idx").select((F.col("idx") - 1).alias("idx"), "node")


def static_negatives(spark: SparkSession, folds: DataFrame, groups: DataFrame, seed: int, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """(split, a, b): as many negatives as positives for each of the six evaluation folds, from the
    pools of the fold's class, never a positive of any fold."""
    folds, groups = staged(folds.select("split", a, b), "folds"), staged(groups, "groups")
    sizes = {r["split"]: r["n"] for r in folds.groupBy("split").agg(F.count("*").alias("n")).collect()}
    g1, g2 = (indexed_pool(groups.where(F.col("grp") == g), node).withColumn("pool", F.lit(g)) for g in ("G1", "G2"))
    sides = {"s0": ("G1", "G1"), "s1": ("G1", "G2"), "s2": ("G2", "G2")}
    wanted = {split: (sizes.get(split, 0), seed + shift, *sides[split[-2:]]) for split, shift in NEGATIVE_OFFSETS.items()}
    known = folds.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return draw_tagged(spark, wanted, staged(g1.unionByName(g2), "pools"), known).withColumnRenamed("tag", "split")


def epoch_negatives(spark: SparkSession, train: DataFrame, pool: DataFrame, known: DataFrame, seed: int, epochs: int) -> DataFrame:
    """(epoch, a, b): fresh training negatives for every epoch."""
    n = train.count()
    pools = staged(pool.select(F.lit("all").alias("pool"), "idx", "node"), "pool")
    wanted = {e: (n, seed + TRAIN_NEGATIVE_OFFSET + e, "all", "all") for e in range(epochs)}
    return draw_tagged(spark, wanted, pools, staged(known.select("a", "b"), "known")).withColumnRenamed("tag", "epoch")


def write_epochs(spark: SparkSession, train: DataFrame, pool: DataFrame, known: DataFrame, seed: int, epochs: int, folder: str) -> None:
    """Training negatives of each epoch as ``epoch_<n>.parquet``, one after the other; epochs that are
    there already are left as they are, so a run that stopped goes on where it was."""
    from ..sources.tables import has_table

    n = train.count()
    pools, known = staged(pool.select(F.lit("all").alias("pool"), "idx", "node"), "pool"), staged(known.select("a", "b"), "known")
    for e in range(epochs):
        if not has_table(spark, f"{folder}/epoch_{e}.parquet"):
            drawn = draw_tagged(spark, {e: (n, seed + TRAIN_NEGATIVE_OFFSET + e, "all", "all")}, pools, known)
            drawn.select("a", "b").write.mode("overwrite").parquet(f"{folder}/epoch_{e}.parquet")


def hash_top(rows: DataFrame, n: int, seed: int, tag: str, key: str) -> DataFrame:
    """n rows by the least hash of their key: a sample without replacement.  A small n is the first rows of
    every task, merged; else places are numbered by ranges, so that a large n is no single task either."""
    order = hash_order(str(seed), tag, F.col(key))
    if n <= SMALL:
        return rows.withColumn("__o", order).orderBy("__o", key).limit(n).drop("__o")
    return range_numbered(rows.withColumn("__o", order), ["__o", key], "__place").where(F.col("__place") <= n).drop("__o", "__place")


def induced_subset(nodes: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], n: int, seed: int, node: str = "node", a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """(sampled nodes, edges between them).  The sample is written, so that a small one is known to be small.
    ``edges``: a table, or a function that makes it from the sample, without edges that lie outside."""
    keep = staged(hash_top(nodes.select(node).distinct(), n, seed, "subset", node), "subset")
    k = bounded_broadcast(keep.select(F.col(node).alias("__k")))
    edges = edges(keep) if callable(edges) else edges
    return keep, edges.join(k, F.col(a) == F.col("__k"), "left_semi").join(k, F.col(b) == F.col("__k"), "left_semi")


def stratified(rows: DataFrame, by: str, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each stratum in hash order, with their place."""
    w = W.partitionBy(by).orderBy(hash_order(str(seed), "stratum", F.col(key)), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def balanced_cap(rows: DataFrame, label: str, key: list[str], cap: int) -> DataFrame:
    """The first half of ``cap`` of each label in the order of the key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(label).orderBy(*key))).where(F.col("__r") <= cap // 2).drop("__r")


def neighbour_sample(neighbours: DataFrame, k: int, seed: int, node: str = "node", other: str = "other") -> DataFrame:
    """(node, i, other): exactly k neighbours of each node; without replacement if it has k, else
    with.  Other nodes come in sorted lists, so the pick is defined."""
    lists = neighbours.groupBy(node).agg(F.array_sort(F.collect_set(other)).alias("all"))
    shuffled = F.transform(F.array_sort(F.transform("all", lambda x: F.struct(hash_order(str(seed), F.col(node), x).alias("h"), x.alias("v")))), lambda s: s["v"])
    rows = lists.withColumn("order", shuffled).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    again = F.pmod(hash32(str(seed), F.col(node), F.col("i")), F.size("all")).cast("int")
    return rows.select(node, "i", F.when(F.size("all") >= k, F.element_at("order", F.col("i") + 1)).otherwise(F.element_at("all", again + 1)).alias(other))


def shuffled(rows: DataFrame, key: str, seed: int, tag: str = "shuffle") -> DataFrame:
    """Rows with their place in a keyed order."""
    return numbered(rows.withColumn("__all", F.lit(1)), ["__all"], hash_order(str(seed), tag, F.col(key)), [key]).drop("__all")


def padded_examples(pool: DataFrame, missing: Column, seed: int) -> Column:
    """Index into a pool for the i-th padded example of a query."""
    return F.pmod(hash32(str(seed), "pad", missing), F.lit(max(pool.count(), 1)))
