"""Graph builders and bounded graph iterations, by joins on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import range_numbered
from ..functions.scalars import hash32
from ..sources.stage import bounded_broadcast, staged


def triple_index(triples: DataFrame, nodes: DataFrame, head: str = "head", tail: str = "tail", rel: str = "rel") -> DataFrame:
    """Distinct (h, r, t) with dense numbers: nodes first, then other entities, both in id order."""
    own = nodes.select(F.col(nodes.columns[0]).cast("string").alias("v")).distinct().withColumn("is_node", F.lit(0))
    others = triples.select(F.col(tail).cast("string").alias("v")).distinct().join(own.select("v"), "v", "left_anti").withColumn("is_node", F.lit(1))
    vocab = range_numbered(own.unionByName(others), ["is_node", "v"], "n").withColumn("n", (F.col("n") - 1).cast("int"))
    d = triples.select(F.col(head).cast("string").alias("h"), rel, F.col(tail).cast("string").alias("t")).distinct()
    return d.join(vocab.select(F.col("v").alias("h"), F.col("n").alias("src")), "h").join(vocab.select(F.col("v").alias("t"), F.col("n").alias("dst")), "t").select("src", rel, "dst")


def bidirectional(edges: DataFrame, relations: int, nodes: DataFrame) -> DataFrame:
    """(src, dst, rel): forward edges shifted by ``relations``, reverse ones unshifted, self loops 2R."""
    fwd = edges.select("src", "dst", (F.col("rel") + relations).alias("rel"))
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel")
    loops = nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(2 * relations).alias("rel"))
    return fwd.unionByName(rev).unionByName(loops)


def coalesced(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Weights of equal (src, dst, rel) added up."""
    return edges.groupBy("src", "dst", "rel").agg(F.sum(weight).alias(weight))


def isolated_loops(nodes: DataFrame, edges: DataFrame, loop: int = 0) -> DataFrame:
    """Edges plus a self loop on every node without any."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    alone = nodes.select("n").join(ends, "n", "left_anti")
    return edges.select("src", "dst", "rel").unionByName(alone.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(loop).alias("rel")))


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(src, node, dist) of everything reachable in up to ``most`` steps, or in any number if None; a
    source reaches itself in 0.

    One join and one anti join for each step; only the frontier, a written table, is joined with the
    edges, until it is empty.
    """
    both = staged(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "paths-edges")
    before, front = None, staged(sources.select(F.col("n").alias("src"), F.col("n").alias("node"), F.lit(0).alias("dist")).distinct(), "paths-0")
    seen, d = front, 0
    while d != most and not front.isEmpty():
        d += 1
        step = front.select("src", F.col("node").alias("via")).join(both.select(F.col("src").alias("via"), "dst"), "via").select("src", F.col("dst").alias("node")).distinct()
        # edges go both ways, so a step leads one frontier back, nowhere or one ahead
        known = front if before is None else front.unionByName(before)
        before, front = front, staged(step.join(known.select("src", "node"), ["src", "node"], "left_anti").withColumn("dist", F.lit(d)), f"paths-{d}")
        seen = seen.unionByName(front)
    return seen


def k_hop(edges: DataFrame, sources: DataFrame, hops: int, fixed: int, seed: int) -> DataFrame:
    """(src, node): nodes within ``hops``, at most ``fixed`` new neighbours by hash for each node and hop."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    order = W.partitionBy("src").orderBy(hash32(str(seed), F.col("src"), F.col("dst")), "dst")
    few = staged(both.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= fixed).drop("__r"), "hop-edges")
    front = sources.select(F.col("n").alias("src"), F.col("n").alias("node"))
    seen = front
    for _ in range(hops):
        front = front.select("src", F.col("node").alias("via")).join(few.select(F.col("src").alias("via"), F.col("dst").alias("node")), "via").select("src", "node").distinct()
        front = staged(front, "hop")
        seen = seen.union(front)
    return seen.distinct()


def random_walk(edges: DataFrame, sources: DataFrame, steps: int, seed: int) -> DataFrame:
    """(start, step, node): one uniform walk from each source; the pick is a keyed hash over sorted
    neighbours.  A walk ends at a node without neighbours."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    lists = staged(both.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("nb")), "walk-lists")
    at = sources.select(F.col("n").alias("start"), F.lit(0).alias("step"), F.col("n").alias("node"))
    out = at
    for k in range(1, steps + 1):
        pick = F.pmod(hash32(str(seed), F.col("start"), str(k)), F.size("nb")).cast("int")
        at = at.join(lists, "node").select("start", F.lit(k).alias("step"), F.element_at("nb", pick + 1).alias("node"))
        at = staged(at, "walk")
        out = out.unionByName(at)
    return out


def biased_walk(edges: DataFrame, sources: DataFrame, steps: int, seed: int, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(start, step, node) of a second-order walk: weight 1/p back, 1 to common neighbours, 1/q else,
    drawn by the place of a keyed uniform among cumulated weights."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    lists = staged(both.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("nb")), "walk-lists")
    prior = lists.select(F.col("node").alias("prev"), F.col("nb").alias("prev_nb"))
    at = sources.select(F.col("n").alias("start"), F.lit(0).alias("step"), F.col("n").alias("node"), F.lit(None).cast("bigint").alias("prev"))
    out = at.select("start", "step", "node")
    for k in range(1, steps + 1):
        j = at.join(lists, "node").join(prior, "prev", "left")
        weight = F.transform("nb", lambda x: F.when(F.col("prev").isNull(), 1.0).when(x == F.col("prev"), 1 / p).when(F.array_contains("prev_nb", x), 1.0).otherwise(1 / q))
        j = j.withColumn("w", weight).withColumn("u", hash32(str(seed), F.col("start"), str(k)) / 4294967296.0 * F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
        walk = F.aggregate("w", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.when(a["sum"] + x <= F.col("u"), a["i"] + 1).otherwise(a["i"]).alias("i")))
        at = j.select("start", F.lit(k).alias("step"), F.element_at("nb", F.least(walk["i"] + 1, F.size("nb"))).alias("next"), F.col("node").alias("prev")).withColumnRenamed("next", "node")
        at = staged(at, "walk")
        out = out.unionByName(at.select("start", "step", "node"))
    return out


def google_rows(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85) -> DataFrame:
    """(src, dst, p) where there is an edge: alpha / out-degree + (1 - alpha) / N.  Nodes without
    edges out are given as one row with a null dst and p = 1 / N for every target."""
    n = nodes.select("n").distinct()
    total = n.count()
    out = edges.select("src", "dst").distinct()
    deg = out.groupBy("src").agg(F.count("*").alias("deg"))
    rows = out.join(deg, "src").select("src", "dst", (F.lit(alpha) / F.col("deg") + F.lit((1 - alpha) / max(total, 1))).alias("p"))
    bare = n.select(F.col("n").alias("src")).join(deg, "src", "left_anti").select("src", F.lit(None).cast("bigint").alias("dst"), F.lit(1 / max(total, 1)).alias("p"))
    return rows.unionByName(bare)


def message_step(edges: DataFrame, state: DataFrame, gates: DataFrame) -> DataFrame:
    """(node, h): the gated sum of neighbours' states over one step."""
    m = edges.join(state.select(F.col("node").alias("src"), "h"), "src").join(bounded_broadcast(gates), "rel")
    return m.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("h") * F.col("gate")).alias("h"))


def message_passing(edges: DataFrame, starts: DataFrame, gates: DataFrame, steps: int, mix: list[list[list[float]]] | None = None, relu: bool = True) -> DataFrame:
    """(query, node, h): states after ``steps`` rounds along edges (src, dst, rel); nodes not reached have no row.

    ``starts`` (query, node, h): all other states begin as zeros.  In round k each edge carries its source's state times
    the gate of its relation, place by place, and a node's new state is the sum of what it gets, mixed by the matrix
    ``mix[k - 1]`` (columns to places; None: as it is) and cut at zero by ``relu``.  ``gates`` (step, rel, gate): vectors,
    normalised over the relations of a round and place to sum to 1; relations without a gate carry nothing.  Parallel
    edges carry each.  States of equal query and node in ``starts`` are added.

    A round joins the states that are not zero with the edges and sums with partial sums; it ends in a written table.
    """
    first = starts.select(F.size("h")).first()
    width = first[0] if first else 0
    add = lambda c: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(width)])
    total = gates.groupBy("step").agg(add(F.col("gate")).alias("total"))
    gates = gates.join(F.broadcast(total), "step").select("step", "rel", F.zip_with("gate", "total", lambda g, t: g / t).alias("gate"))
    links = staged(edges.select("src", "dst", "rel").where("src IS NOT NULL AND dst IS NOT NULL"), "message-edges")
    state = staged(starts.groupBy("query", "node").agg(add(F.col("h")).alias("h")), "states")
    for k in range(1, steps + 1):
        mine = bounded_broadcast(gates.where(F.col("step") == k).select("rel", "gate"))
        sent = state.where(F.exists("h", lambda x: x != 0)).withColumnRenamed("node", "src").join(links, "src").join(mine, "rel")
        got = sent.groupBy("query", F.col("dst").alias("node")).agg(add(F.zip_with("h", "gate", lambda x, g: x * g)).alias("h"))
        if mix is not None:
            rows = [sum((F.get("h", F.lit(i)) * F.lit(float(mix[k - 1][i][j])) for i in range(width)), F.lit(0.0)) for j in range(width)]
            got = got.withColumn("h", F.array(*rows))
        if relu:
            got = got.withColumn("h", F.transform("h", lambda x: F.greatest(x, F.lit(0.0))))
        state = staged(got, f"states-{k}")
    return state


def induced_relations(paths: DataFrame, keep: DataFrame, relations: int) -> DataFrame:
    """(src, node, rel): relations that stand for distances among kept nodes, numbered behind the others."""
    k = keep.select(F.col("n").alias("src"))
    return paths.join(k, "src", "left_semi").join(k.withColumnRenamed("src", "node"), "node", "left_semi").select("src", "node", (F.col("dist") + relations).alias("rel"))
