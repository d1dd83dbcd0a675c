"""Typed bindings of nodes to entities, as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import range_numbered
from ..schemas import EDGE_TYPES
from ..sources.stage import bounded_broadcast, staged


def long_view(tables: dict[str, DataFrame], node: str = "drugbank_id") -> DataFrame:
    """Union of the relation tables; absent organism and action are empty."""
    unknown = set(tables) - set(EDGE_TYPES)
    if unknown:
        raise ValueError(f"unknown edge types: {sorted(unknown)}")
    out = None
    for kind in EDGE_TYPES:
        if kind not in tables:
            continue
        t = tables[kind]
        extra = lambda c, t=t: F.coalesce(F.col(c), F.lit("")) if c in t.columns else F.lit("")
        one = t.select(
            node, F.lit(kind).alias("edge_type"), F.col(f"{kind}_id").alias("entity_id"), F.col(f"{kind}_name").alias("entity_name"),
            extra("organism").alias("organism"), extra("action").alias("action"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def neighbours(kg: DataFrame, node: str | None = None, kinds: list[str] | None = None, column: str = "drugbank_id") -> DataFrame:
    for k in kinds or []:
        if k not in EDGE_TYPES:
            raise ValueError(f"unknown edge type {k!r}")
    out = kg if node is None else kg.where(F.col(column) == node)
    return out.where(F.col("edge_type").isin(*kinds)) if kinds else out


def human_only(kg: DataFrame) -> DataFrame:
    return kg.where("organism = 'Humans'") if "organism" in kg.columns else kg


def numbered_entities(kg: DataFrame, *more: str) -> DataFrame:
    """Distinct (edge_type, entity_id, ...) with ``code``, a dense int from 1 in their order; null types and ids are none."""
    rows = kg.select("edge_type", "entity_id", *more).where("edge_type IS NOT NULL AND entity_id IS NOT NULL").distinct()
    return staged(range_numbered(rows, ["edge_type", "entity_id", *more], "code").withColumn("code", F.col("code").cast("int")), "entities")


def shared_neighbours(kg: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """(a, b, edge_type, entity_id, entity_name of a): distinct shared entities of each pair.

    A pair carries the codes of a's entities as one array to those of b, so it is shuffled as one row, not as
    one for each entity of a."""
    told = numbered_entities(kg, "entity_name")
    near = bounded_broadcast(told)
    same = lambda x: [x[c].eqNullSafe(near[c]) for c in ("edge_type", "entity_id", "entity_name")]
    bound = kg.select(F.col(node).alias("__n"), "edge_type", "entity_id", "entity_name")
    own = bound.join(near, same(bound)).groupBy(F.col("__n").alias(a)).agg(F.collect_set("code").alias("__ca"))
    # b's entities under each of their names
    other = bound.select("__n", "edge_type", "entity_id").join(near.drop("entity_name"), ["edge_type", "entity_id"]).groupBy(F.col("__n").alias(b)).agg(F.collect_set("code").alias("__cb"))
    met = pairs.select(a, b).distinct().join(own, a).join(other, b).select(a, b, F.explode(F.array_intersect("__ca", "__cb")).alias("code"))
    return met.join(near, "code").select(a, b, "edge_type", "entity_id", "entity_name")


def nodes_of(kg: DataFrame, node: str = "drugbank_id") -> DataFrame:
    return kg.select(node).distinct()


def ordered_names(kg: DataFrame, order: str, node: str = "node", kind: str = "edge_type", name: str = "entity_name") -> DataFrame:
    """(node, kind, names): names in table order, duplicates kept."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))))
    return kg.groupBy(node, kind).agg(F.transform(rows, lambda x: x["n"]).alias("names"))


def name_sets(kg: DataFrame, node: str = "node", kind: str = "edge_type", name: str = "entity_name") -> DataFrame:
    """Distinct (node, name, kind); blank names and the text ``nan`` do not count."""
    return kg.where((F.trim(F.col(name)) != "") & (F.lower(F.col(name)) != "nan")).select(node, name, kind).distinct()


def from_name_map(names: DataFrame, node: str = "node") -> DataFrame:
    """A long view from (node, edge_type, entity_name) alone: ids, organisms and actions are empty."""
    return names.select(node, "edge_type", F.lit("").alias("entity_id"), "entity_name", F.lit("").alias("organism"), F.lit("").alias("action"))
