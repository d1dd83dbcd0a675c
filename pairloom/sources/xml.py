"""XML of nested records to seven tables, by Spark's own XML source (one task for each split)."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import first_seen_pairs, keep_first
from ..schemas import ENTITY_KINDS

_ENTITY = "array<struct<id:string,name:string,organism:string,actions:struct<action:array<string>>>>"
RECORD = (
    "_type string, `drugbank-id` array<struct<_VALUE:string,_primary:string>>, name string, groups struct<`group`:array<string>>, "
    "`calculated-properties` struct<property:array<struct<kind:string,value:string>>>, "
    "`drug-interactions` struct<`drug-interaction`:array<struct<`drugbank-id`:string,name:string,description:string>>>, "
    + ", ".join(f"{k}s struct<{k}:{_ENTITY}>" for k in ENTITY_KINDS)
    + ", pathways struct<pathway:array<struct<`smpdb-id`:string,name:string>>>"
)


@dataclass
class RawTables:
    drugs: DataFrame
    edges: DataFrame
    enzymes: DataFrame
    targets: DataFrame
    transporters: DataFrame
    carriers: DataFrame
    pathways: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def primary_id(ids: Column) -> Column:
    return F.nullif(F.trim(F.get(F.filter(ids, lambda x: x["_primary"] == "true"), F.lit(0))["_VALUE"]), F.lit(""))


def clean(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def read_records(spark: SparkSession, path: str, row: str = "drug") -> DataFrame:
    """Records with a primary id, numbered in document order (``doc_ord``)."""
    raw = spark.read.format("xml").option("rowTag", row).option("attributePrefix", "_").schema(RECORD).load(path)
    return raw.withColumn("doc_ord", F.monotonically_increasing_id()).withColumn("drugbank_id", primary_id(F.col("drugbank-id"))).where("drugbank_id IS NOT NULL")


def parse(spark: SparkSession, path: str, row: str = "drug") -> RawTables:
    """The seven tables.  Records without a primary id are skipped; the first record of an id and the
    first direction of a pair stay; an entity has a row for each action, or one with none."""
    r = read_records(spark, path, row)
    smiles = F.get(F.filter("calculated-properties.property", lambda p: p["kind"] == "SMILES"), F.lit(0))["value"]
    groups = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("groups.group", F.array()), lambda g: F.trim(g)), lambda g: g != ""))), ";")
    drugs = keep_first(r.select("drugbank_id", clean(F.col("name")).alias("name"), clean(F.col("_type")).alias("type"), F.nullif(F.trim(smiles), F.lit("")).alias("smiles"), groups.alias("groups"), "doc_ord"), ["drugbank_id"], ["doc_ord"]).drop("doc_ord")
    inter = r.select("drugbank_id", clean(F.col("name")).alias("drug_a_name"), "doc_ord", F.posexplode("drug-interactions.drug-interaction").alias("pos", "x"))
    inter = inter.select(F.col("drugbank_id").alias("drug_a_id"), clean(F.col("x.drugbank-id")).alias("drug_b_id"), "drug_a_name", clean(F.col("x.description")).alias("description"), "doc_ord", "pos")
    edges = first_seen_pairs(inter.where("drug_b_id <> '' AND description <> ''"), ["doc_ord", "pos"])

    def entity(kind: str) -> DataFrame:
        e = r.select("drugbank_id", "doc_ord", F.posexplode(f"{kind}s.{kind}").alias("item_pos", "x"))
        acts = F.filter(F.transform(F.coalesce("x.actions.action", F.array()), lambda a: F.trim(a)), lambda a: a != "")
        e = e.select("*", F.posexplode_outer(acts).alias("action_pos", "act"))
        return e.select(
            "drugbank_id", clean(F.col("x.id")).alias(f"{kind}_id"), clean(F.col("x.name")).alias(f"{kind}_name"), clean(F.col("x.organism")).alias("organism"),
            F.coalesce("act", F.lit("")).alias("action"), "doc_ord", "item_pos", F.coalesce("action_pos", F.lit(0)).alias("action_pos"),
        )

    p = r.select("drugbank_id", "doc_ord", F.posexplode("pathways.pathway").alias("item_pos", "x"))
    pathways = p.select("drugbank_id", clean(F.col("x.smpdb-id")).alias("pathway_id"), clean(F.col("x.name")).alias("pathway_name"), "doc_ord", "item_pos").where("pathway_id <> '' OR pathway_name <> ''")
    return RawTables(drugs, edges, *[entity(k) for k in ENTITY_KINDS], pathways)


def write_subset(spark: SparkSession, path: str, keep: DataFrame, out: str, row: str = "drug", root: str = "drugbank", compression: str = "none", indent: str = "    ") -> None:
    """An XML with the kept records, whose interactions lead to kept partners alone."""
    r = read_records(spark, path, row).join(keep.select("drugbank_id").distinct(), "drugbank_id", "left_semi")
    pairs = r.select("drugbank_id", F.posexplode("drug-interactions.drug-interaction").alias("pos", "x"))
    kept = pairs.withColumn("partner", F.trim(F.col("x.drugbank-id"))).join(keep.select(F.col("drugbank_id").alias("partner")).distinct(), "partner", "left_semi")
    lists = kept.groupBy("drugbank_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("list"))
    j = r.join(lists, "drugbank_id", "left").withColumn("drug-interactions", F.struct(F.col("list").alias("drug-interaction")))
    j.drop("list", "doc_ord", "drugbank_id").write.format("xml").option("rowTag", row).option("rootTag", root).option("attributePrefix", "_").option("compression", compression).option("indent", indent).mode("overwrite").save(out)
