"""Explicit schemas of every stored table; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "boolean": BooleanType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType()}


def _of(columns: str) -> StructType:
    """A schema from ``name type, ...``; unlike Spark's own parser it needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


DRUGS = _of("drugbank_id string, name string, type string, smiles string, groups string")
RAW_EDGES = _of("drug_a_id string, drug_b_id string, drug_a_name string, description string")
EDGES = _of("drug_a_id string, drug_b_id string, description string, ddi_type string")
ENTITY_KINDS = ("enzyme", "target", "transporter", "carrier")
EDGE_TYPES = (*ENTITY_KINDS, "pathway")
ENTITIES = {k: _of(f"drugbank_id string, {k}_id string, {k}_name string, organism string, action string") for k in ENTITY_KINDS}
PATHWAYS = _of("drugbank_id string, pathway_id string, pathway_name string")
KG = _of("drugbank_id string, edge_type string, entity_id string, entity_name string, organism string, action string")
PKPD = _of("ddi_type string, pk_pd_label string, matched_pk_keywords string, matched_pd_keywords string")
AB_PAIRS = _of(
    "drug_a_id string, drug_b_id string, ddi_type string, pk_pd_label string, key_entity_id string, key_entity_name string, key_entity_type string, "
    "action_drug_a string, action_drug_b string, match_pattern string, mechanism_chain string, chain_type string, confidence string, "
    "has_key_entity boolean, key_entity_candidates string"
)
AB_TYPES = _of("ddi_type string, pk_pd_label string, n_pairs bigint, n_with_key_entity bigint, coverage_pct double, top3_key_entities string")
PREDICTIONS = _of("drug_a_id string, drug_b_id string, true_label int, predicted_prob double, predicted_label int")
LLM_PREDICTIONS = _of("drug_a_id string, drug_b_id string, p_no double, p_yes double, pred int, prompt string")
INDICATORS = _of("indicator string, bucket string, value double, std double, n bigint")
STEP_STATS = _of("step int, name string, n_drugs bigint, n_edges bigint, n_types bigint")

RAW_TABLES = {
    "drugs": DRUGS, "ddi_edges": RAW_EDGES, "drug_enzymes": ENTITIES["enzyme"], "drug_targets": ENTITIES["target"],
    "drug_transporters": ENTITIES["transporter"], "drug_carriers": ENTITIES["carrier"], "drug_pathways": PATHWAYS,
}
