"""Folds by the published generators: the same members as those of the published seeds.

A shuffle of n places is a list of swaps, drawn from the last place to the first.  Each draw takes 32-bit numbers,
masked to the bits of its place, until one is not beyond it; so a draw's numbers depend on all before, and the swaps
are drawn by one task, in chunks of bounded memory (the numbers alone: no row passes through it).  What the swaps
do is worked out by all tasks: place i ends with what stood at place j of its swap, and that came there by the next
later-placed swap with the same j, or was there from the start.  These pointers lead from smaller to larger
places; they are followed by doubling, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import range_numbered
from ..sources.stage import staged
from .folds import FAIR, LEGACY, edge_class, resolve_protocol

#: Rows of one batch of swaps.
BATCH = 1 << 16


class Stream:
    """32-bit numbers of the newer generator (``pcg64``; the low half of each number first) or the older (``mt19937``)."""

    def __init__(self, kind: str, seed: int):
        self.kind = kind
        if kind == "pcg64":
            self.bits = np.random.PCG64(seed)
        else:
            self.bits = np.random.MT19937()
            self.bits._legacy_seeding(seed)
        self.left = np.zeros(0, np.int64)

    def take(self, n: int) -> np.ndarray:
        """The next ``n`` numbers, which stay until ``drop``."""
        short = n - len(self.left)
        if short > 0:
            raw = self.bits.random_raw(short if self.kind != "pcg64" else -(-short // 2))
            if self.kind == "pcg64":
                raw = np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], axis=1).ravel()
            self.left = np.concatenate([self.left, raw.astype(np.int64)])
        return self.left[:n]

    def drop(self, n: int) -> None:
        self.left = self.left[n:]


def swaps(kind: str, seed: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in chunks, for i from n - 1 to 1; n is below 2^32."""
    stream, i = Stream(kind, seed), n - 1
    while i > 0:
        low = 1 << (i.bit_length() - 1)  # places from here on have the mask of i
        size = max(16, min(BATCH, i // 16))
        v = stream.take(size) & (2 * low - 1)
        # taken are numbers up to the place, which falls by one with each taken before
        taken = v <= i - size
        while True:
            before = np.cumsum(taken) - taken
            now = v <= i - before
            if (now == taken).all():
                break
            taken = now
        at = np.flatnonzero(taken & (i - before >= low))
        whole = i - low + 1 <= int(taken.sum())
        used = int(at[-1]) + 1 if whole else size  # the numbers after the last place of this mask are masked anew
        stream.drop(used)
        yield i - np.arange(len(at)), v[at]
        i -= len(at)


def permutation(spark: SparkSession, n: int, seed: int, kind: str = "pcg64") -> DataFrame:
    """(place, item), both from 0: where the shuffle of 0 to n - 1 with this seed puts each item."""

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            i, j = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["i", "j"])

        for _ in parts:
            held, size = [(np.zeros(1, np.int64), np.zeros(1, np.int64))], 1
            for i, j in swaps(kind, seed, n):
                held.append((i, j))
                size += len(i)
                if size >= BATCH:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    if n <= 0:
        return spark.createDataFrame([], "place long, item long")
    # written by its one task as it goes, and dealt out from there: sorted for a shuffle they would all stay in its memory
    drawn = staged(spark.range(1).repartition(1).mapInArrow(told, "i long, j long"), "drawn")
    linked = staged(drawn.withColumn("next", F.lead("i").over(W.partitionBy("j").orderBy("i"))), "swaps")
    # what stands at a place when its turn comes: came by the first later swap that has it as j
    up = staged(linked.where("i <> j").groupBy(F.col("j").alias("p")).agg(F.min("i").alias("up")), "climb")
    moved = True
    while moved:
        far = up.select(F.col("p").alias("up"), F.col("up").alias("far"))
        step = staged(up.join(far, "up", "left").select("p", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), "climb")
        moved, up = not step.where("moved").isEmpty(), step.select("p", "up")
    came = up.select(F.col("p").alias("next"), F.col("up").alias("from"))
    item = F.when(F.col("next").isNull(), F.col("j")).otherwise(F.coalesce("from", "next"))
    return linked.join(came, "next", "left").select(F.col("i").alias("place"), item.alias("item"))


def shuffled_places(rows: DataFrame, order: list[str], seed: int, kind: str, out: str = "place") -> tuple[DataFrame, int]:
    """``rows`` with their place, from 0, after the shuffle of their order, and how many they are."""
    numbered = range_numbered(rows, order, "__item").withColumn("__item", F.col("__item") - 1)
    n = numbered.count()
    places = permutation(rows.sparkSession, n, seed, kind).select(F.col("item").alias("__item"), F.col("place").alias(out))
    return numbered.join(places, "__item").drop("__item"), n


def published_groups(nodes: DataFrame, seed: int, node: str = "node", protocol: dict | None = None) -> DataFrame:
    """(node, grp): distinct nodes in the order of their texts, shuffled, and cut; G1 is never empty, and by the fair
    protocol G2 keeps one of several nodes."""
    p = protocol or resolve_protocol()
    ids = nodes.where(F.col(node).isNotNull()).select(node).distinct().withColumn("__text", F.col(node).cast("string"))
    placed, n = shuffled_places(ids, ["__text"], seed, "pcg64")
    cut = max(1, int(n * p["g1_ratio"])) if p["protocol"] == "fair" else max(1, int(n // p["drug_ratio"]))
    cut = min(cut, n - 1) if n > 1 and p["protocol"] == "fair" else cut
    return placed.select(node, F.when(F.col("place") < cut, "G1").otherwise("G2").alias("grp"))


def _halves(rows: DataFrame, order: list[str], seed: int, name: str) -> DataFrame:
    """The ceiling of half of the rows to test, the rest to val; a row alone to test."""
    placed, n = shuffled_places(rows, order, seed, "mt19937")
    test = math.ceil(n * FAIR["val"]) if n > 1 else n
    return placed.withColumn("split", F.when(F.col("place") < test, f"test_{name}").otherwise(f"val_{name}")).drop("place")


def published_fair_folds(edges: DataFrame, groups: DataFrame, seed: int, order: list[str], a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Edges with ``n_g2`` and ``split``, in members equal to those that the published seeds give edges in this order.

    ``order``: columns that order the edges totally, as the published table does.  Edges with an end in no group, or null,
    are left out.
    """
    classed = staged(edge_class(edges, groups, a, b, node), "published-edges")
    placed, n = shuffled_places(classed.where("n_g2 = 0"), order, seed, "mt19937", "__first")
    placed = staged(placed, "published-s0")
    held = n - math.floor(n * FAIR["train"]) if n > 1 else 0
    train = placed.where(F.col("__first") >= held).drop("__first").withColumn("split", F.lit("train"))
    rest = _halves(placed.where(F.col("__first") < held), ["__first"], seed, "s0")
    return train.unionByName(rest.select(*train.columns)).unionByName(
        _halves(classed.where("n_g2 = 1"), order, seed, "s1").select(*train.columns)
    ).unionByName(_halves(classed.where("n_g2 = 2"), order, seed, "s2").select(*train.columns))


def published_legacy_folds(edges: DataFrame, groups: DataFrame, seed: int, order: list[str], a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Edges with ``n_g2`` and ``split`` by the legacy protocol, in members as published.

    Of the edges within G1, those that come first at one of their ends in a shuffled order train, and as many others as make
    up 80 %; a tenth of the rest is val.  Of the other classes a tenth is val.
    """
    classed = staged(edge_class(edges, groups, a, b, node), "published-edges")
    placed, n = shuffled_places(classed.where("n_g2 = 0"), order, seed, "pcg64", "__first")
    placed = staged(placed, "published-s0")
    firsts = placed.select(F.explode(F.array(a, b)).alias("n"), "__first").groupBy("n").agg(F.min("__first").alias("__first")).select("__first").distinct()
    anchors = staged(placed.join(firsts, "__first", "left_semi"), "published-anchors")
    others = placed.join(anchors.select("__first"), "__first", "left_anti").drop("__first")
    extra = max(0, int(LEGACY["train"] * n) - anchors.count())
    shuffled, m = shuffled_places(others, order, seed + LEGACY["offset_s0"], "pcg64")
    val = int(max(0, m - extra) * LEGACY["val"])
    split = F.when(F.col("place") < extra, "train").when(F.col("place") < extra + val, "val_s0").otherwise("test_s0")
    out = anchors.drop("__first").withColumn("split", F.lit("train")).unionByName(shuffled.withColumn("split", split).drop("place"))
    for k in (1, 2):
        later, m = shuffled_places(classed.where(F.col("n_g2") == k), order, seed + LEGACY[f"offset_s{k}"], "pcg64")
        split = F.when(F.col("place") < int(m * LEGACY["val"]), f"val_s{k}").otherwise(f"test_s{k}")
        out = out.unionByName(later.withColumn("split", split).drop("place").select(*out.columns))
    return out
