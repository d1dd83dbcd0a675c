"""The whole check of a built dataset: folds, negatives, epochs of training negatives, and stored counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pair_hi, pair_lo
from .validate import Invalid

# Nodes, pairs and types of the known releases.
PROFILES = {"toy": (86, 1383, 24), "full": (1900, 565731, 215)}


def _keys(rows: DataFrame, *more: str) -> DataFrame:
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    return rows.select(*more, pair_lo(a, b).alias("lo"), pair_hi(a, b).alias("hi"))


def _told(problem: str, rows: DataFrame, where: str | None = None) -> DataFrame:
    """(problem, place, n) of the rows, none if there are none."""
    place = F.col(where).cast("string") if where else F.lit("")
    return rows.groupBy(place.alias("place")).agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "place", "n")


def dataset_problems(
    edges: DataFrame, folds: DataFrame, groups: DataFrame, negatives: DataFrame | None = None, epochs: DataFrame | None = None, counts: DataFrame | None = None,
    nodes: DataFrame | None = None, profile: str | None = None,
) -> DataFrame:
    """(problem, place, n): what is wrong with a dataset, no row if nothing is.

    ``edges`` (a, b, ddi_type), ``folds`` (a, b, split), ``groups`` (node, grp), ``negatives`` (a, b, split), ``epochs``
    (epoch, a, b) of training negatives, ``counts`` (step, n_drugs, n_edges, n_types), whose last step counts, ``nodes``
    (node) for the counts.  Pairs are compared in either direction, as texts; each is one of

    - ``not in a fold``, ``not an edge``: pairs of one side that the other lacks;
    - ``not one to one`` at a split: how far the number of negatives is from that of its pairs;
    - ``epoch size`` at an epoch: how far the number of distinct pairs is from that of ``train``;
    - ``epoch has an edge``, ``epoch outside G1`` at an epoch;
    - ``stored count`` at a column: how far it is from the table, also from a profile's.
    """
    wanted, known = _keys(edges).distinct(), _keys(folds).distinct()
    out = _told("not in a fold", wanted.join(known, ["lo", "hi"], "left_anti")).unionByName(_told("not an edge", known.join(wanted, ["lo", "hi"], "left_anti")))
    sizes = folds.groupBy("split").agg(F.count("*").alias("p"))
    if negatives is not None:
        both = sizes.join(negatives.groupBy("split").agg(F.count("*").alias("q")), "split", "full")
        off = F.abs(F.coalesce("p", F.lit(0)) - F.coalesce("q", F.lit(0)))
        out = out.unionByName(both.select(F.lit("not one to one").alias("problem"), F.col("split").alias("place"), off.alias("n")).where("n > 0"))
    if epochs is not None:
        pairs = _keys(epochs, "epoch").distinct()
        train = sizes.where("split = 'train'").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
        each = pairs.groupBy("epoch").agg(F.count("*").alias("q")).crossJoin(F.broadcast(train))  # one row
        size = each.select(F.lit("epoch size").alias("problem"), F.col("epoch").cast("string").alias("place"), F.abs(F.col("q") - F.col("p")).alias("n"))
        g1 = groups.where("grp = 'G1'").select(F.col("node").cast("string").alias("node"))
        for end in ("lo", "hi"):
            pairs = pairs.join(g1.select(F.col("node").alias(end), F.lit(True).alias(f"in_{end}")), end, "left")
        outside = pairs.where("in_lo IS NULL OR in_hi IS NULL")
        out = out.unionByName(size.where("n > 0")).unionByName(_told("epoch has an edge", pairs.join(wanted, ["lo", "hi"], "left_semi"), "epoch"))
        out = out.unionByName(_told("epoch outside G1", outside, "epoch"))
    if counts is not None or profile is not None:
        there = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("ddi_type").alias("n_types"))
        if nodes is not None:
            there = there.crossJoin(F.broadcast(nodes.agg(F.countDistinct("node").alias("n_drugs"))))  # one row each
        names = [c for c in ("n_drugs", "n_edges", "n_types") if c in there.columns]
        for told in [counts.orderBy(F.desc("step")).limit(1)] if counts is not None else []:
            out = out.unionByName(_apart(there, told.select(*[F.col(c).alias(f"told_{c}") for c in names]), names))
        if profile is not None:
            stored = dict(zip(("n_drugs", "n_edges", "n_types"), PROFILES[profile]))
            one = edges.sparkSession.range(1).select(*[F.lit(stored[c]).alias(f"told_{c}") for c in names])
            out = out.unionByName(_apart(there, one, names))
    return out


def _apart(there: DataFrame, told: DataFrame, names: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("place"), F.abs(F.col(c) - F.coalesce(F.col(f"told_{c}"), F.lit(0))).alias("n")) for c in names])
    return there.crossJoin(F.broadcast(told)).select(F.lit("stored count").alias("problem"), F.explode(rows).alias("x")).select("problem", "x.place", "x.n").where("n > 0")


def check_dataset(**tables) -> None:
    """An error that names the first problems, if there are any."""
    found = dataset_problems(**tables).orderBy("problem", "place").limit(10).collect()
    if found:
        raise Invalid("; ".join(f"{r['problem']} {r['place']}: {r['n']}".replace(" :", ":") for r in found))
