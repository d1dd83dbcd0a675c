"""The counted seven-step cleaning of a pair graph.

Drugs: (drugbank_id, name, type, smiles, groups).  Edges: (drug_a_id, drug_b_id, description, ord).
Membership is always a semi join; keep sets are small beside edges, and the optimiser broadcasts
them when their size allows.  Floors are single passes, not fixed points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import range_numbered
from ..functions.scalars import normalize_text, pair_hi, pair_lo
from ..sources.stage import staged
from .structures import graph_of

TYPE_FLOOR, DEGREE_FLOOR = 10, 10
# Element symbols that count as metals (technetium and thallium do not).
METALS = (
    "Li", "Na", "K", "Rb", "Cs", "Be", "Mg", "Ca", "Sr", "Ba", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Y", "Zr", "Nb",
    "Mo", "Ru", "Rh", "Pd", "Ag", "Cd", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Al", "Ga", "In", "Sn", "Pb", "Bi",
)


def of_type(drugs: DataFrame, wanted: str = "small molecule", column: str = "type") -> DataFrame:
    return drugs.where(F.col(column) == wanted)


def has_token(text: Column, token: str) -> Column:
    """Whole-word match; an underscore is a letter here.  Null text matches nothing."""
    return F.coalesce(text, F.lit("")).rlike(rf"\b{token}\b")


def valid_structure(smiles: Column) -> Column:
    """Whether the text is a structure by the grammar of the line notation; valences are not judged."""
    return graph_of(smiles)["valid"]


def atoms(smiles: Column) -> Column:
    """Element symbols, bracketed ones without isotope, hydrogens and charge; aromatic ones raised."""
    raw = F.regexp_extract_all(smiles, F.lit(r"\[\d*([A-Z][a-z]?|[a-z][a-z]?)[^\]]*\]|(Cl|Br|[BCNOPSFI]|[bcnops])"), F.lit(0))
    symbol = lambda x: F.initcap(F.regexp_extract(x, r"^\[?\d*(Cl|Br|[A-Z][a-z]?|[a-z][a-z]?)", 1))
    return F.transform(raw, symbol)


def organic_without_metal(smiles: Column) -> Column:
    found = atoms(smiles)
    return F.coalesce(F.array_contains(found, "C") & ~F.arrays_overlap(found, F.array(*map(F.lit, METALS))), F.lit(False))


def pair_columns(rows: DataFrame, a: str = "drug_a_id", b: str = "drug_b_id") -> DataFrame:
    """The pair columns alone if both are there, else the rows as they are."""
    return rows.select(a, b) if {a, b} <= set(rows.columns) else rows


def both_ends_in(edges: DataFrame, keep: DataFrame, node: str, a: str = "drug_a_id", b: str = "drug_b_id") -> DataFrame:
    """Edges with both ends in ``keep``: two semi joins, never one join with OR."""
    k = keep.select(F.col(node).alias("__node"))
    return edges.join(k, F.col(a) == F.col("__node"), "left_semi").join(k, F.col(b) == F.col("__node"), "left_semi")


def ends_of(edges: DataFrame, out: str, a: str = "drug_a_id", b: str = "drug_b_id") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias(out))


def type_floor(edges: DataFrame, column: str = "ddi_type", floor: int = TYPE_FLOOR) -> DataFrame:
    """Edges whose type has at least ``floor`` of them."""
    keep = edges.groupBy(F.col(column).alias("__type")).count().where(F.col("count") >= floor)
    return edges.join(keep, F.col(column) == F.col("__type"), "left_semi")


def degrees(edges: DataFrame, out: str = "node", a: str = "drug_a_id", b: str = "drug_b_id") -> DataFrame:
    return ends_of(edges, out, a, b).groupBy(out).agg(F.count("*").alias("degree"))


def degree_floor(edges: DataFrame, floor: int = DEGREE_FLOOR, a: str = "drug_a_id", b: str = "drug_b_id") -> DataFrame:
    """Edges whose ends both have ``floor`` edges, counted once (not a k-core)."""
    keep = degrees(edges, "__n", a, b).where(F.col("degree") >= floor)
    return both_ends_in(edges, keep, "__n", a, b)


def degree_order(edges: DataFrame, a: str = "drug_a_id", b: str = "drug_b_id") -> DataFrame:
    """Nodes by falling degree with their place recorded, ties by id."""
    return range_numbered(degrees(edges, "node", a, b), [F.desc("degree"), F.col("node")]).withColumn("place", F.col("place").cast("int"))


def first_seen_pairs(edges: DataFrame, order: list[str], a: str = "drug_a_id", b: str = "drug_b_id") -> DataFrame:
    """The first row of each unordered pair, in its own orientation."""
    w = W.partitionBy(pair_lo(a, b), pair_hi(a, b)).orderBy(*order)
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order (dropDuplicates has none)."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def first_description(edges: DataFrame, order: str = "ord", by: str = "ddi_type", text: str = "description") -> DataFrame:
    return edges.where(F.col(text).isNotNull()).groupBy(by).agg(F.min_by(text, order).alias(text))


@dataclass
class Cleaned:
    """Tables after the last step, the type-to-text map and the step counts."""

    drugs: DataFrame
    edges: DataFrame
    aux: dict[str, DataFrame]
    type_text: DataFrame
    stats: DataFrame


def clean(
    drugs: DataFrame, edges: DataFrame, aux: dict[str, DataFrame] | None = None, order: str = "ord",
    structure: Callable[[Column], Column] = valid_structure, organic: Callable[[Column], Column] = organic_without_metal,
    type_min: int = TYPE_FLOOR, degree_min: int = DEGREE_FLOOR,
) -> Cleaned:
    """All seven steps: small molecules, valid structures, approved, typed texts, frequent types,
    organic without metals (types counted again), then the degree floor.  Auxiliary tables are
    pruned once, to the last drug set.  The graph is written after the approved, the frequent and the
    organic step; counts of each step are lazily part of ``stats``."""
    key = "drugbank_id"
    counts: list[DataFrame] = []

    def note(step: int, name: str, d: DataFrame, e: DataFrame, typed: bool) -> None:
        types = e.agg(F.countDistinct("ddi_type").alias("n_types")) if typed else None
        row = d.agg(F.count("*").alias("n_drugs")).withColumn("__j", F.lit(1)).join(e.agg(F.count("*").alias("n_edges")).withColumn("__j", F.lit(1)), "__j")
        row = row.join(types.withColumn("__j", F.lit(1)), "__j") if typed else row.withColumn("n_types", F.lit(None).cast("bigint"))
        counts.append(row.select(F.lit(step).alias("step"), F.lit(name).alias("name"), "n_drugs", "n_edges", "n_types"))

    d, e = drugs, edges
    note(0, "raw", d, e, False)
    for step, name, test in ((1, "small molecule", F.col("type") == "small molecule"), (2, "valid structure", structure(F.col("smiles"))), (3, "approved", has_token(F.col("groups"), "approved"))):
        d = d.where(test)
        e = both_ends_in(e, d, key)
        if step == 3:  # written tables: later steps and the counts do not repeat what is before
            d, e = staged(d, "approved-nodes"), staged(e, "approved-edges")
        note(step, name, d, e, False)
    names = d.select(F.col(key).alias("__id"), F.col("name").alias("__name"))
    e = e.join(names.withColumnsRenamed({"__id": "drug_a_id", "__name": "__na"}), "drug_a_id").join(names.withColumnsRenamed({"__id": "drug_b_id", "__name": "__nb"}), "drug_b_id")
    e = e.withColumn("ddi_type", normalize_text(F.col("description"), F.col("__na"), F.col("__nb"))).drop("__na", "__nb")
    note(4, "typed", d, e, True)
    e = type_floor(e, floor=type_min)
    d = d.join(ends_of(e, key).distinct(), key, "left_semi")
    d, e = staged(d, "frequent-nodes"), staged(e, "frequent-edges")
    note(5, "frequent types", d, e, True)
    d = d.where(organic(F.col("smiles")))
    e = type_floor(both_ends_in(e, d, key), floor=type_min)
    d = d.join(ends_of(e, key).distinct(), key, "left_semi")
    d, e = staged(d, "organic-nodes"), staged(e, "organic-edges")
    note(6, "organic", d, e, True)
    keep = degrees(e, key).where(F.col("degree") >= degree_min)
    d = d.join(keep, key, "left_semi")
    e = both_ends_in(e, d, key)
    note(7, "degree floor", d, e, True)
    stats = counts[0]
    for c in counts[1:]:
        stats = stats.unionByName(c)
    pruned = {k: t.join(d.select(key), key, "left_semi") for k, t in (aux or {}).items()}
    return Cleaned(d, e, pruned, first_description(e, order), stats)


def write_bundle(done: Cleaned, folder: str) -> None:
    """The cleaned tables as CSV, and three small JSON files: step counts, the text of each type, and the
    smallest drugs' ids by degree that a subset may start from."""
    from ..sources.tables import write_json_rows, write_tables

    write_tables({"drugs": done.drugs, "ddi_edges": done.edges.drop("ord"), **done.aux}, folder, "csv")
    write_json_rows(done.stats.orderBy("step"), f"{folder}/stats")
    write_json_rows(done.type_text.orderBy("ddi_type"), f"{folder}/type_to_text")
    write_json_rows(degrees(done.edges).orderBy(F.desc("degree"), "node").limit(100), f"{folder}/subset_candidates")
