"""Second-order random walks and capped k-hop subgraphs, without an array of a hub's neighbours.

Each node has alias tables over its edges, as rows.  A table has at most ``block`` rows; the tables of a
larger node are the leaves of a tree, whose upper tables draw among blocks by their weights.  Edges of equal
weight need neither: one draw among all places of the node.  A step draws
a neighbour by weight in a fixed number of equi joins on (node, place), which spread a hub's walkers, and
accepts it by its second-order weight; whether it is also a neighbour of the node before is an equi join on
edges.  Several tries are drawn at once and the first accepted one counts.  Walkers whose tries are all
rejected, rare unless p and q are far from 1, draw exactly: the least of exponential times over their edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import range_numbered
from ..functions.scalars import hash_order, unit
from ..sources.stage import staged

#: Rows of one alias table, tries drawn at once (twice as many in each further round), and rounds before the exact draw.
BLOCK, TRIES, ROUNDS = 4096, 6, 5


def both_ways(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(src, dst, w): each edge in both directions, a loop once; parallel edges add their weights, or count as one
    if there is no weight.  Edges with a null end, and weights that are null or not above 0, are no edges."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    one = edges.select("src", "dst", w.alias("w")).where("src IS NOT NULL AND dst IS NOT NULL AND w > 0")
    two = one.unionByName(one.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return two.groupBy("src", "dst").agg((F.max("w") if weight is None else F.sum("w")).alias("w"))


def vose(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keep, other): slot i stands for itself with probability keep[i], else for slot other[i]."""
    n = len(weights)
    share = weights * (n / weights.sum())
    keep, other = np.ones(n), np.arange(n)
    if n and (share != share[0]).any():
        small, large = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
        while small and large:
            s, g = small.pop(), large.pop()
            keep[s], other[s] = share[s], g
            share[g] -= 1 - share[s]
            (small if share[g] < 1 else large).append(g)
    return keep, other


def _aliased(items: DataFrame, block: int) -> DataFrame:
    """(node, place, keep, other): alias tables of the items (node, place, w), ``block`` places in each."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(node: np.ndarray, place: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            table = place // block
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (table[1:] != table[:-1])) + 1
            keep, other = np.ones(len(node)), place.copy()
            for low, high in zip([0, *cuts], [*cuts, len(node)]):
                if high - low > 1:
                    keep[low:high], at = vose(w[low:high])
                    other[low:high] = place[low:high][at]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(place), pa.array(keep), pa.array(other)], names=["node", "place", "keep", "other"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            node, place, w = (np.concatenate([h, x]) for h, x in zip(held, new)) if held else new
            if not len(node):
                continue
            last = np.flatnonzero((node != node[-1]) | (place // block != place[-1] // block))
            whole = last[-1] + 1 if len(last) else 0  # the last table may go on
            if whole:
                yield out(node[:whole], place[:whole], w[:whole])
            held = [node[whole:], place[whole:], w[whole:]]
        if held and len(held[0]):
            yield out(*held)

    ordered = items.withColumn("t", F.floor(F.col("place") / block)).repartition("node", "t").sortWithinPartitions("node", "place")
    return ordered.select(F.col("node").cast("long"), F.col("place").cast("long"), "w").mapInArrow(tables, "node long, place long, keep double, other long")


class AliasGraph:
    """Written tables: edges (src, dst, w), leaves (node, place, keep, own, own_deg, alt, alt_deg), and the
    upper tables (node, place, keep, other), the lowest first.  ``even``: all weights are equal, every place keeps
    itself, and a node's places are drawn from at once however many there are."""

    def __init__(self, edges: DataFrame, block: int = BLOCK, even: bool = False):
        self.block = 1 << 62 if even else block
        placed = staged(range_numbered(edges, ["src", "dst"], "g"), "walk-edges")
        self.edges = placed.select("src", "dst", "w")
        degrees = staged(placed.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"), F.min("g").alias("first")), "walk-degrees")
        self.degrees = degrees.select("node", "deg")
        items = placed.join(degrees, F.col("src") == F.col("node")).select("node", "dst", "w", (F.col("g") - F.col("first")).alias("place"))
        items = staged(items.join(self.degrees.select(F.col("node").alias("dst"), F.col("deg").alias("dst_deg")), "dst"), "walk-items")
        if even:
            self.upper, one = [], F.lit(1.0).alias("keep")
            self.leaves = items.select("node", "place", one, F.col("dst").alias("own"), F.col("dst_deg").alias("own_deg"), F.col("dst").alias("alt"), F.col("dst_deg").alias("alt_deg"))
            return
        drawn = _aliased(items.select("node", "place", "w"), block)
        own = items.select("node", "place", F.col("dst").alias("own"), F.col("dst_deg").alias("own_deg"))
        alt = items.select("node", F.col("place").alias("other"), F.col("dst").alias("alt"), F.col("dst_deg").alias("alt_deg"))
        self.leaves = staged(drawn.join(own, ["node", "place"]).join(alt, ["node", "other"]).drop("other"), "walk-leaves")
        most = degrees.agg(F.coalesce(F.max("deg"), F.lit(0))).first()[0]
        self.upper: list[DataFrame] = []
        level = items.select("node", "place", "w")
        while most > block:
            level = staged(level.groupBy("node", F.floor(F.col("place") / block).alias("place")).agg(F.sum("w").alias("w")), "walk-blocks")
            self.upper.append(staged(_aliased(level, block), "walk-upper"))
            most = -(-most // block)


def _draw(graph: AliasGraph, walkers: DataFrame, chance) -> DataFrame:
    """``walkers`` (node, deg, ...) with own candidate (next, next_deg); chance(what, level) is uniform in [0, 1)."""
    levels = len(graph.upper)
    rows = walkers.withColumn("at", F.lit(0).cast("long"))
    for level in range(levels, -1, -1):
        # so many places has the node on this level, and so many of them lie in the table below ``at``
        places = F.ceil(F.col("deg") / F.lit(float(graph.block) ** level))
        n = F.least(F.lit(graph.block).cast("long"), places - F.col("at") * graph.block)
        rows = rows.withColumn("place", F.col("at") * graph.block + F.floor(chance("slot", level) * n)).drop("at")
        keeps = chance("keep", level) < F.col("keep")
        if level:
            rows = rows.join(graph.upper[level - 1], ["node", "place"]).withColumn("at", F.when(keeps, F.col("place")).otherwise(F.col("other"))).drop("place", "keep", "other")
        else:
            rows = rows.join(graph.leaves, ["node", "place"]).withColumns(
                {"next": F.when(keeps, F.col("own")).otherwise(F.col("alt")), "next_deg": F.when(keeps, F.col("own_deg")).otherwise(F.col("alt_deg"))}
            ).drop("place", "keep", "own", "own_deg", "alt", "alt_deg")
    return rows


def _bias(p: float, q: float, near: Column, to: str) -> Column:
    return F.when(F.col("prev").isNull(), F.lit(max(1 / p, 1.0, 1 / q))).when(F.col(to) == F.col("prev"), F.lit(1 / p)).when(near, F.lit(1.0)).otherwise(F.lit(1 / q))


def _near(graph: AliasGraph, rows: DataFrame, to: str) -> DataFrame:
    """``rows`` with ``near``: whether ``to`` is a neighbour of the node before."""
    pairs = graph.edges.select(F.col("src").alias("prev"), F.col("dst").alias(to), F.lit(True).alias("near"))
    return rows.join(pairs, ["prev", to], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def second_order_walks(
    edges: DataFrame, sources: DataFrame, steps: int, seed: int, p: float = 1.0, q: float = 1.0, walks: int = 1, weight: str | None = None, block: int = BLOCK
) -> DataFrame:
    """(start, walk, step, node): ``walks`` walks from each distinct source ``n``, step 0 included.

    From the second step on, an edge back counts 1/p, one to a neighbour of the node before 1, any other 1/q,
    each times its weight.  Edges go both ways (``both_ways``).  Walks end at nodes without an edge.  Draws are
    keyed hashes of seed, start, walk, step and try: equal for equal graphs under any partitioning.
    """
    if not (p > 0 and q > 0):
        raise ValueError("p and q are above 0")
    graph, most = AliasGraph(both_ways(edges, weight), block, weight is None), max(1 / p, 1.0, 1 / q)
    begin = sources.select(F.col("n").cast("long").alias("start")).where("start IS NOT NULL").distinct()
    begin = begin.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))) if walks > 1 else begin.withColumn("walk", F.lit(0))
    out = begin.select("start", "walk", F.lit(0).alias("step"), F.col("start").alias("node"))
    at = begin.withColumns({"node": F.col("start"), "prev": F.lit(None).cast("long")}).join(graph.degrees, "node")
    at = staged(at.select("start", "walk", "node", "prev", "deg"), "walkers")
    for step in range(1, steps + 1):
        done, left = [], at
        for k in range(ROUNDS):
            low, high = TRIES * (2**k - 1), TRIES * (2 ** (k + 1) - 1)
            tries = left.withColumn("try", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))

            def chance(what: str, level: int = 0) -> Column:
                return unit(str(seed), what, F.col("start"), F.col("walk"), str(step), F.col("try"), str(level))  # noqa: B023

            drawn = _near(graph, _draw(graph, tries, chance), "next")
            taken = chance("take") * F.lit(most) < _bias(p, q, F.col("near"), "next")
            first = F.min(F.when(taken, F.struct("try", "next", "next_deg"))).alias("first")
            met = staged(drawn.groupBy("start", "walk", "node", F.col("prev").alias("before"), "deg").agg(first), "walk-tries")
            done.append(met.where("first IS NOT NULL").select("start", "walk", F.col("first.next").alias("next"), F.col("node").alias("prev"), F.col("first.next_deg").alias("deg")))
            left = met.where("first IS NULL").select("start", "walk", "node", F.col("before").alias("prev"), "deg")
            if left.isEmpty():
                break
        else:
            done.append(_exact(graph, left, p, q, seed, step))
        at = done[0]
        for more in done[1:]:
            at = at.unionByName(more)
        at = staged(at.withColumnRenamed("next", "node"), "walkers") if len(done) > 1 else at.withColumnRenamed("next", "node")
        out = out.unionByName(at.select("start", "walk", F.lit(step).alias("step"), "node"))
    return out


def _exact(graph: AliasGraph, left: DataFrame, p: float, q: float, seed: int, step: int) -> DataFrame:
    """The least of exponential times with the rates of the edges, each pair of walker and edge once."""
    rows = _near(graph, left.join(graph.edges.select(F.col("src").alias("node"), "dst", "w"), "node"), "dst")
    rate = F.col("w") * _bias(p, q, F.col("near"), "dst")
    time = -F.log(1 - unit(str(seed), "race", F.col("start"), F.col("walk"), str(step), F.col("dst"))) / rate
    best = rows.groupBy("start", "walk", F.col("node").alias("prev")).agg(F.min(F.struct(time.alias("t"), F.col("dst").alias("next"))).alias("b"))
    told = best.select("start", "walk", F.col("b.next").alias("next"), "prev")
    return told.join(graph.degrees.select(F.col("node").alias("next"), "deg"), "next").select("start", "walk", "next", "prev", "deg")


# k hops ----------------------------------------------------------------------------------------------
def k_hop_nodes(edges: DataFrame, sources: DataFrame, hops: int, most: int | None, seed: int) -> DataFrame:
    """(source, node, n, is_source): nodes met against the direction of edges (src, dst, rel) from each source,
    numbered from 0 by node within the source.

    A hop takes the edges that lead into the frontier; of these the ``most`` with the smallest keyed hash of hop
    and edge stay for each source, whatever node they lead to.  The least of a frontier are among the least of its
    nodes, so each node keeps ``most`` edges, and a hub is never met whole.  None: all of them.
    """
    distinct = staged(edges.select("src", "dst", "rel").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "hop-edges")
    front = staged(sources.select(F.col("n").alias("source"), F.col("n").alias("node")).where("source IS NOT NULL").distinct(), "hop-0")
    seen = front
    for hop in range(1, hops + 1):
        keyed = distinct.withColumn("h", hash_order(str(seed), "hop", str(hop), F.col("src"), F.col("dst"), F.coalesce(F.col("rel").cast("string"), F.lit("")))) if most is not None else distinct
        if most is not None:
            keyed = keyed.withColumn("r", F.row_number().over(W.partitionBy("dst").orderBy("h", "src", "rel"))).where(F.col("r") <= most).drop("r")
        met = front.join(keyed.withColumnRenamed("dst", "node"), "node")
        if most is not None:
            met = met.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("h", "src", "node", "rel"))).where(F.col("r") <= most)
        front = staged(met.select("source", F.col("src").alias("node")).distinct(), f"hop-{hop}")
        seen = seen.unionByName(front)
    nodes = range_numbered(seen.distinct(), ["source", "node"], "g")
    first = nodes.groupBy("source").agg(F.min("g").alias("f"))
    return staged(nodes.join(first, "source").select("source", "node", (F.col("g") - F.col("f")).cast("int").alias("n"), (F.col("source") == F.col("node")).alias("is_source")), "hop-nodes")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, src, dst, rel, from_source, to_source): edges with both ends among a source's ``nodes``, ends by
    their numbers; parallel edges stay.

    Every edge is looked up from its end of smaller degree, so that a hub in many subgraphs costs its small
    neighbours there, not all its edges.
    """
    numbered = staged(edges.select("src", "dst", "rel").where("src IS NOT NULL AND dst IS NOT NULL"), "induced-edges")
    degree = numbered.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    turned = numbered.join(degree.select(F.col("node").alias("src"), F.col("deg").alias("sd")), "src").join(degree.select(F.col("node").alias("dst"), F.col("deg").alias("dd")), "dst")
    low = F.col("sd") <= F.col("dd")
    turned = turned.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("high"), "rel", low.alias("out"))
    one = nodes.select("source", F.col("node").alias("low"), F.col("n").alias("ln"), F.col("is_source").alias("ls"))
    two = nodes.select("source", F.col("node").alias("high"), F.col("n").alias("hn"), F.col("is_source").alias("hs"))
    both = one.join(turned, "low").join(two, ["source", "high"])

    def end(out: str, a: str, b: str) -> Column:
        return (F.when(F.col("out"), F.col(a)).otherwise(F.col(b))).alias(out)

    return both.select("source", end("src", "ln", "hn"), end("dst", "hn", "ln"), "rel", end("from_source", "ls", "hs"), end("to_source", "hs", "ls"))
