"""Cold-start folds: node groups by a keyed hash, then edge folds by place in a keyed order.

Places are ``row_number`` over a hash order inside the three edge classes (both ends in G1, one,
none), so a fold never depends on partitioning.  Fold sizes follow the published floor and ceiling
rules.  A class's rows are numbered by hash bucket and bucket offsets, so that no task sorts a
whole class (see :func:`numbered`); where only a cut is wanted, the buckets tell it (:func:`parts_of`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import bounded_broadcast, staged
from ..functions.scalars import hash_order, pair_hi, pair_lo

# Shares of the two protocols, and seed offsets of the negatives of each fold.
FAIR = {"g1": 0.8, "train": 0.9, "val": 0.5}
LEGACY = {"drug_ratio": 1.5, "train": 0.8, "val": 0.1, "offset_s0": 17, "offset_s1": 29, "offset_s2": 31}
NEGATIVE_OFFSETS = {"test_s0": 100, "val_s0": 200, "test_s1": 300, "val_s1": 400, "test_s2": 500, "val_s2": 600}
TRAIN_NEGATIVE_OFFSET = 1000
FOLDS = ("train", "val_s0", "test_s0", "val_s1", "test_s1", "val_s2", "test_s2")


def resolve_protocol(protocol: str | None = None, g1_ratio: float | None = None, drug_ratio: float | None = None) -> dict:
    """Settings of a protocol (``fair`` unless told); a knob of the other protocol is an error."""
    p = protocol or ("legacy" if drug_ratio is not None and g1_ratio is None else "fair")
    if p not in ("fair", "legacy"):
        raise ValueError(f"unknown protocol {p!r}")
    if p == "fair" and drug_ratio is not None:
        raise ValueError("drug_ratio belongs to the legacy protocol")
    if p == "legacy" and g1_ratio is not None:
        raise ValueError("g1_ratio belongs to the fair protocol")
    if p == "fair":
        g = FAIR["g1"] if g1_ratio is None else g1_ratio
        if not 0 < g < 1:
            raise ValueError("g1_ratio lies between 0 and 1")
        return {"protocol": p, "g1_ratio": g}
    return {"protocol": p, "drug_ratio": LEGACY["drug_ratio"] if drug_ratio is None else drug_ratio}


def numbered(rows: DataFrame, by: list[str], order: Column, ties: list[str], out: str = "place", buckets: int = 256) -> DataFrame:
    """``out``: the place (from 1) in a hexadecimal hash order within each group.

    The first two digits of the order cut each group into buckets; a bucket is sorted alone and
    starts behind the buckets before it, whose counts are a small table.
    """
    cut = rows.withColumn("__o", order).withColumn("__k", F.substring("__o", 1, 2))
    sizes = cut.groupBy(*by, "__k").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(W.partitionBy(*by).orderBy("__k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    rank = F.row_number().over(W.partitionBy(*by, "__k").orderBy("__o", *ties))
    return cut.withColumn("__r", rank).join(bounded_broadcast(before), [*by, "__k"]).withColumn(out, F.col("__before") + F.col("__r")).drop("__o", "__k", "__r", "__before")


def parts_of(rows: DataFrame, by: list[str], order: Column, ties: list[str], marks: Callable[[Column], list[Column]], out: str = "part") -> DataFrame:
    """``out``: how many of the ``marks`` (columns of the group's size, not falling) lie below the row's place in a
    hexadecimal hash order within its group; equal to numbering all rows, but only few are sorted.

    The first three digits of the order cut each group into 4,096 buckets.  Their counts tell the part of all rows of
    a bucket, except where a mark falls inside: only these buckets' rows are numbered.  The rows are written once,
    with their bucket, and no shuffle moves them.
    """
    fixed = staged(rows.withColumn("__k", F.conv(F.substring(order, 1, 3), 16, 10).cast("int")), "parts")
    sizes = fixed.groupBy(*by, "__k").agg(F.count("*").alias("__c"))
    group = W.partitionBy(*by)
    upto = F.sum("__c").over(group.orderBy("__k").rowsBetween(W.unboundedPreceding, W.currentRow))
    below = lambda place: reduce(lambda x, m: x + (m < place).cast("int"), marks(F.col("__n")), F.lit(0))
    told = sizes.withColumn("__n", F.sum("__c").over(group)).withColumn("__before", upto - F.col("__c"))
    told = told.withColumns({"__first": below(F.col("__before") + 1), "__last": below(F.col("__before") + F.col("__c"))})
    told = bounded_broadcast(staged(told.drop("__c"), "buckets"))
    known = fixed.join(told, [*by, "__k"])
    whole = known.where("__first = __last").withColumn(out, F.col("__first"))
    rank = F.row_number().over(W.partitionBy(*by, "__k").orderBy(order, *ties))
    cut = known.where("__first < __last").withColumn("__r", rank).withColumn(out, below(F.col("__before") + F.col("__r"))).drop("__r")
    return whole.unionByName(cut).drop("__k", "__n", "__before", "__first", "__last")


def node_groups(nodes: DataFrame, seed: int, node: str = "node", protocol: dict | None = None) -> DataFrame:
    """(node, grp): the first part of the hash order is G1, never empty, and G2 keeps one node."""
    p = protocol or resolve_protocol()
    ids = nodes.select(node).distinct().withColumn("__all", F.lit(1))

    def cut(n: Column) -> list[Column]:
        share = F.floor(n * p["g1_ratio"]) if p["protocol"] == "fair" else F.floor(F.floor(n / p["drug_ratio"]))
        return [F.least(F.greatest(F.lit(1), share), F.greatest(n - 1, F.lit(1)))]

    parts = parts_of(ids, ["__all"], hash_order(F.lit(str(seed)), F.lit("group"), F.col(node)), [node], cut)
    return parts.select(node, F.when(F.col("part") == 0, "G1").otherwise("G2").alias("grp"))


def edge_class(edges: DataFrame, groups: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Edges with ``n_g2``: how many of their ends are in G2."""
    g = lambda s: groups.select(F.col(node).alias(s), F.col("grp").alias(f"__g{s}"))
    groups = bounded_broadcast(groups)
    both = edges.join(g(a), a).join(g(b), b)
    return both.withColumn("n_g2", (F.col(f"__g{a}") == "G2").cast("int") + (F.col(f"__g{b}") == "G2").cast("int")).drop(f"__g{a}", f"__g{b}")


def fair_folds(edges: DataFrame, groups: DataFrame, seed: int, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Edges with ``split``.  S0: train is floor(.9 n), the rest goes to test (ceiling of half) and
    val; one edge alone trains, one held-out edge tests.  S1, S2: test is the ceiling of half."""
    return class_folds(edge_class(edges, groups, a, b, node), seed, a, b)


def class_folds(classed: DataFrame, seed: int, a: str = "a", b: str = "b") -> DataFrame:
    """``fair_folds`` of edges that have their ``n_g2``; some classes alone have the folds that they have among all."""
    order = hash_order(F.lit(str(seed)), F.lit("edge"), pair_lo(a, b), pair_hi(a, b))

    def marks(n: Column) -> list[Column]:
        """The last place of train, and of test; S1 and S2 have no train."""
        inner = F.col("n_g2") == 0
        train = F.when(n == 1, 1).otherwise(F.floor(n * FAIR["train"]))
        return [F.when(inner, train).otherwise(0), F.when(inner, train + F.ceil((n - train) * FAIR["val"])).otherwise(F.ceil(n * FAIR["val"]))]

    parts = parts_of(classed, ["n_g2"], order, [a, b], marks, "__part")
    kind = F.when(F.col("__part") == 0, "train").otherwise(F.concat(F.when(F.col("__part") == 1, "test_s").otherwise("val_s"), F.col("n_g2").cast("string")))
    return parts.withColumn("split", kind).drop("__part")


def coverage_anchors(edges: DataFrame, seed: int, a: str = "a", b: str = "b") -> DataFrame:
    """Edges that cover every node, for the legacy protocol: what a greedy pass in a keyed order keeps.

    The pass keeps an edge if one of its ends is unseen.  All edges before it at that end would have
    been kept for it and made it seen, so the edge is the end's first; and a node's first edge is always
    kept.  So the anchors are the first edges of the nodes, and one aggregate finds them."""
    order = hash_order(F.lit(str(seed)), F.lit("anchor"), pair_lo(a, b), pair_hi(a, b))
    # the first 60 bits of the order as a number: an edge that is first by the order is first, or equal, by these
    keyed = staged(edges.withColumn("__h", F.conv(F.substring(order, 1, 15), 16, 10).cast("long")), "anchor-edges")
    ends = keyed.select(F.explode(F.array(a, b)).alias("__n"), "__h").groupBy("__n").agg(F.min("__h").alias("__h")).select("__h").distinct()
    some = staged(keyed.join(ends, "__h", "left_semi").drop("__h").withColumn("__o", order), "anchor-some")
    firsts = some.select(F.explode(F.array(a, b)).alias("__n"), "__o").groupBy("__n").agg(F.min("__o").alias("__o")).select("__o").distinct()
    return some.join(firsts, "__o", "left_semi").drop("__o")


def legacy_folds(edges: DataFrame, groups: DataFrame, seed: int, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Legacy sizes: S0 trains on anchors and on others up to 80 %, val is a tenth of the rest; S1
    and S2 give a tenth to val."""
    classed = staged(edge_class(edges, groups, a, b, node), "legacy-edges")
    inner = classed.where("n_g2 = 0")
    anchors = coverage_anchors(inner, seed, a, b).select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    known = classed.join(anchors, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left").withColumn("__anchor", F.col("__a").isNotNull().cast("int")).drop("__a", "__b")
    known = staged(known, "legacy-known")
    shift = F.when(F.col("n_g2") == 0, LEGACY["offset_s0"]).when(F.col("n_g2") == 1, LEGACY["offset_s1"]).otherwise(LEGACY["offset_s2"])
    order = hash_order((F.lit(seed) + shift).cast("string"), F.lit("edge"), pair_lo(a, b), pair_hi(a, b))
    sizes = known.groupBy("n_g2").agg(F.count("*").alias("__n"), F.sum("__anchor").alias("__k"))
    # anchors come first; both are numbered alone, so that the buckets are those of the hash
    placed = numbered(known, ["n_g2", "__anchor"], order, [a, b]).join(F.broadcast(sizes), "n_g2")
    n, p = F.col("__n"), F.when(F.col("__anchor") == 1, F.col("place")).otherwise(F.col("__k") + F.col("place"))
    train = F.greatest(F.col("__k"), F.floor(n * LEGACY["train"]))
    s0 = F.when(p <= train, "train").when(p <= train + F.floor((n - train) * LEGACY["val"]), "val_s0").otherwise("test_s0")
    later = lambda s: F.when(p <= F.floor(n * LEGACY["val"]), f"val_{s}").otherwise(f"test_{s}")
    return placed.withColumn("split", F.when(F.col("n_g2") == 0, s0).when(F.col("n_g2") == 1, later("s1")).otherwise(later("s2"))).drop("place", "__n", "__k", "__anchor")
