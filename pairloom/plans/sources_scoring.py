"""Queries that write the input tables in a source's format, read them back and compare; and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning as CL
from ..operators import dataset as DS
from ..operators import diagnostics as DG
from ..operators import render as R
from ..operators import runs as RU
from ..operators import sampling as X
from ..operators import scoring as SC
from ..operators import validate as V
from ..schemas import EDGE_TYPES
from ..sources import sheets as SH
from ..sources import tables as T
from ..sources import xml as XM
from ..sources.stage import shared_dir, staged
from ..streaming import resume as RS
from .registry import SEED, Tables, query, with_parts


def fresh(t: Tables, tag: str) -> str:
    """A folder of its own for one run, in the shared place."""
    return f"{shared_dir(t.spark)}/{tag}-{uuid.uuid4().hex}"


def _id(x):
    return F.concat(F.lit("P"), x)


def records(t: Tables) -> DataFrame:
    """Every part as a nested record: two ids, repeated groups, properties, interactions (one
    direction of each pair), entities with zero or more actions, and a pathway beside a blank one."""
    ids = F.array(F.struct(_id("p_partkey").alias("_VALUE"), F.lit("true").alias("_primary")), F.struct(F.lit("alt").alias("_VALUE"), F.lit(None).cast("string").alias("_primary")))
    props = F.array(F.struct(F.lit("logP").alias("kind"), F.lit("1").alias("value")), F.struct(F.lit("SMILES").alias("kind"), F.concat(F.lit("C"), F.col("p_size")).alias("value")))
    p = t.part.select(
        F.col("p_partkey").alias("k"), F.when(F.pmod("p_size", F.lit(2)) == 0, "small molecule").otherwise("biotech").alias("_type"), ids.alias("drugbank-id"), F.col("p_name").alias("name"),
        F.struct(F.array(F.lit("withdrawn"), F.lower("p_brand"), F.lit("approved"), F.lower("p_brand")).alias("group")).alias("groups"), F.struct(props.alias("property")).alias("calculated-properties"),
        F.struct(F.array(F.struct(F.concat(F.lit("W"), "p_size").alias("smpdb-id"), F.col("p_type").alias("name")), F.struct(F.lit(None).cast("string").alias("smpdb-id"), F.lit(" ").alias("name"))).alias("pathway")).alias("pathways"),
    )
    inter = F.array_sort(F.transform("bs", lambda b: F.struct(_id(b).alias("drugbank-id"), F.concat(F.lit("meets "), b).alias("description"))))
    e = t.edge_lists().withColumnRenamed("a", "k")  # keys alone are moved; their texts are made beside the record
    acts = t.lineitem.where("l_suppkey % 4 = 0").groupBy(F.col("l_partkey").alias("k"), "l_suppkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))).alias("action"))
    item = F.struct(F.concat(F.lit("S"), "l_suppkey").alias("id"), F.concat(F.lit("Supplier "), "l_suppkey").alias("name"), F.lit("Humans").alias("organism"), F.struct("action").alias("actions"))
    z = acts.groupBy("k").agg(F.struct(F.array_sort(F.collect_list(item)).alias("enzyme")).alias("enzymes"))
    met = F.when(F.col("bs").isNotNull(), F.struct(inter.alias("drug-interaction"))).alias("drug-interactions")
    return p.join(e, "k", "left").join(z, "k", "left").select(*p.drop("k").columns, met, "enzymes")


def as_xml(t: Tables) -> str:
    """The records as compressed XML without indents, a file for each task; plain, its marks outweigh what they hold many times,
    and blanks would only be packed and read again."""
    path = fresh(t, "xml")
    records(t).write.format("xml").option("compression", "gzip").option("indent", "").option("rowTag", "drug").option("rootTag", "drugbank").option("attributePrefix", "_").save(path)
    return path


DRUGS_SQL = "SELECT 'P' || p_partkey AS drugbank_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'small molecule' ELSE 'biotech' END AS type, 'C' || p_size AS smiles, array_to_string(list_sort(['withdrawn', lower(p_brand), 'approved']), ';') AS groups FROM part"


@query("s01_xml_drugs", DRUGS_SQL)
def s01(t: Tables):
    return XM.parse(t.spark, as_xml(t)).drugs


@query("s05_xml_interactions", with_parts("edges") + " SELECT 'P' || a AS drug_a_id, 'P' || b AS drug_b_id, p_name AS drug_a_name, 'meets ' || b AS description FROM edges JOIN part ON p_partkey = a")
def s05(t: Tables):
    return XM.parse(t.spark, as_xml(t)).edges.select("drug_a_id", "drug_b_id", "drug_a_name", "description")


@query("s06_xml_entities", "SELECT 'P' || l_partkey AS drugbank_id, 'S' || l_suppkey AS enzyme_id, 'Supplier ' || l_suppkey AS enzyme_name, 'Humans' AS organism, unnest(CASE WHEN count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') = 0 THEN [''] ELSE list(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') END) AS action FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY l_partkey, l_suppkey")
def s06(t: Tables):
    return XM.parse(t.spark, as_xml(t)).enzymes.select("drugbank_id", "enzyme_id", "enzyme_name", "organism", "action")


@query("s07_xml_pathways", "SELECT 'P' || p_partkey AS drugbank_id, 'W' || p_size AS pathway_id, p_type AS pathway_name FROM part")
def s07(t: Tables):
    return XM.parse(t.spark, as_xml(t)).pathways.select("drugbank_id", "pathway_id", "pathway_name")


@query("s17_xml_subset", with_parts("edges") + " SELECT 'P' || a AS drug_a_id, 'P' || b AS drug_b_id FROM edges JOIN part x ON x.p_partkey = a AND x.p_size % 3 = 0 JOIN part y ON y.p_partkey = b AND y.p_size % 3 = 0")
def s17(t: Tables):
    out = fresh(t, "subset")
    XM.write_subset(t.spark, as_xml(t), t.part.where("p_size % 3 = 0").select(_id("p_partkey").alias("drugbank_id")), out, compression="gzip", indent="")
    return XM.parse(t.spark, out).edges.select("drug_a_id", "drug_b_id")


@query("s08_csv_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s08(t: Tables):
    folder, rows = fresh(t, "csv"), t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    T.write_tables({"supplier": rows}, folder, "csv")
    return T.read_table(t.spark, folder, "supplier", rows.schema)


def binding_tables(t: Tables) -> dict[str, DataFrame]:
    """The stand-in graph as five relation tables; pathways have no action."""
    kg, out = t.kg(), {}
    for k in EDGE_TYPES[:-1]:
        out[f"drug_{k}s"] = kg.where(F.col("edge_type") == k).select(
            F.col("node").cast("string").alias("drugbank_id"), F.col("entity_id").alias(f"{k}_id"), F.col("entity_name").alias(f"{k}_name"), F.lit("Humans").alias("organism"), "action")
    out["drug_pathways"] = t.part.select(F.col("p_partkey").cast("string").alias("drugbank_id"), F.concat(F.lit("W"), "p_size").alias("pathway_id"), F.col("p_type").alias("pathway_name"))
    return out


KG_SQL = with_parts("kg") + " SELECT CAST(node AS VARCHAR) AS drugbank_id, edge_type, entity_id, entity_name, 'Humans' AS organism, action FROM kg UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'pathway', 'W' || p_size, p_type, '', '' FROM part"


@query("s10_kg_loader", KG_SQL)
def s10(t: Tables):
    """Some tables as CSV; targets as Parquet beside a CSV without rows, which must not be read."""
    folder, tables = fresh(t, "kg"), binding_tables(t)
    parquet = {"drug_targets", "drug_pathways"}
    T.write_tables({n: d for n, d in tables.items() if n not in parquet} | {"drug_targets": tables["drug_targets"].limit(0)}, folder, "csv")
    T.write_tables({n: tables[n] for n in parquet}, folder, "parquet")
    return T.load_kg(t.spark, folder)


@query("s11_kg_writer", KG_SQL)
def s11(t: Tables):
    folder = fresh(t, "kg")
    T.write_tables(binding_tables(t), folder, "parquet")
    return T.load_kg(t.spark, folder)


@query("s12_fold_bundle", with_parts("folds") + f" SELECT a, b, split, 'legacy' AS protocol, {SEED} AS seed FROM folds")
def s12(t: Tables):
    folder = fresh(t, "folds")
    T.write_folds(t.folds().select("a", "b", "split"), t.groups(), {"seed": SEED}, folder)
    folds, _, manifest = T.read_folds(t.spark, folder)
    return folds.select("a", "b", F.col("split").cast("string").alias("split"), F.lit(manifest["protocol"]).alias("protocol"), F.lit(manifest["seed"]).alias("seed"))


@query("s13_cached_negatives", "SELECT split, count(*) AS n FROM (SELECT 'epoch_0' AS split FROM part UNION ALL SELECT 'epoch_1' FROM part) GROUP BY 1")
def s13(t: Tables):
    """Five of six static folds and a gap after two epochs: no static fold counts, and two epochs do."""
    folder, pairs = fresh(t, "cache"), t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    for name in ("val_s0", "test_s0", "val_s1", "test_s1", "val_s2", "epoch_0", "epoch_1", "epoch_3"):
        pairs.write.parquet(f"{folder}/{name}.parquet")
    static, epochs = T.cached_negatives(t.spark, folder)
    out = static
    for e, rows in enumerate(epochs):
        one = rows.withColumn("split", F.lit(f"epoch_{e}"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("split").agg(F.count("*").alias("n"))


@query("s16_release_tables", "SELECT p_partkey, p_name, 'parquet' AS fmt FROM part UNION ALL SELECT p_partkey, p_name, 'csv' FROM part")
def s16(t: Tables):
    folder, rows = fresh(t, "release"), t.part.select("p_partkey", "p_name")
    T.dump_release({"parts": rows}, folder, "sample", also_csv=True)
    return T.read_any(t.spark, f"{folder}/parts_sample.parquet").withColumn("fmt", F.lit("parquet")).unionByName(
        T.read_any(t.spark, f"{folder}/parts_sample.csv", rows.schema).withColumn("fmt", F.lit("csv")))


@query("s18_read_by_suffix", "SELECT n_nationkey, n_name FROM nation")
def s18(t: Tables):
    folder, rows = fresh(t, "suffix"), t.nation.select("n_nationkey", "n_name")
    T.write_tables({"nation": rows}, folder, "csv")
    return T.read_any(t.spark, T.find_one(t.spark, [f"{folder}/nation.parquet", f"{folder}/nation.csv"]), rows.schema)


@query("s20_text_map", "SELECT CAST(n_nationkey AS VARCHAR) AS drug_id, n_name AS text FROM nation")
def s20(t: Tables):
    path = fresh(t, "map")
    one = t.nation.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))))).alias("value"))
    one.coalesce(1).write.text(path)
    return T.load_text_map(t.spark, path)


@query("s21_runs_tree", "SELECT lower(substr(o_orderpriority, 1, 1)) AS method, CAST(o_orderkey % 3 AS INTEGER) AS seed, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1, 2")
def s21(t: Tables):
    root = fresh(t, "runs")
    for seed in range(3):
        rows = t.orders.where(F.pmod("o_orderkey", F.lit(3)) == seed)
        for method in "12345":
            rows.where(F.col("o_orderpriority").startswith(method)).select("o_custkey").write.option("header", True).csv(f"{root}/{method}/seed{seed}/out")
    runs = T.load_runs(t.spark, root, "o_custkey long")
    return runs.groupBy("method", "seed").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("s22_json_manifest", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s22(t: Tables):
    """Counts through the atomic JSON writer, written twice: the second file replaces the first."""
    counts = {r[0]: r[1] for r in t.orders.groupBy("o_orderstatus").count().collect()}
    path = f"{fresh(t, 'json')}/counts.json"
    T.write_json({}, path, t.spark)
    T.write_json(counts, path, t.spark)
    return t.spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("o_orderstatus", "n"))


@query("s09_filter_bundle", with_parts("typed") + ", tt AS (SELECT DISTINCT ddi_type FROM typed) SELECT 'edges' AS part, CAST(count(*) AS VARCHAR) AS said FROM typed UNION ALL SELECT 'type', ddi_type FROM tt UNION ALL SELECT 'step 1', CAST(count(*) AS VARCHAR) FROM part")
def s09(t: Tables):
    """The bundle of a cleaned graph, read back."""
    folder, e = fresh(t, "bundle"), staged(t.typed_edges(), "typed")  # written once: the bundle reads it three times
    edges = e.select(F.col("a").alias("drug_a_id"), F.col("b").alias("drug_b_id"), "ddi_type", F.col("ddi_type").alias("description"), F.col("a").alias("ord"))
    drugs = t.part.select(F.col("p_partkey").alias("drugbank_id"), F.col("p_name").alias("name"))
    stats = drugs.agg(F.lit(1).alias("step"), F.count("*").alias("n_drugs"))
    CL.write_bundle(CL.Cleaned(drugs, edges, {}, CL.first_description(edges), stats), folder)
    back = T.read_any(t.spark, f"{folder}/ddi_edges.csv").agg(F.lit("edges").alias("part"), F.count("*").cast("string").alias("said"))
    types = t.spark.read.json(f"{folder}/type_to_text").where("ddi_type = description").select(F.lit("type").alias("part"), F.col("ddi_type").alias("said"))
    steps = t.spark.read.json(f"{folder}/stats").select(F.concat(F.lit("step "), "step").alias("part"), F.col("n_drugs").cast("string").alias("said"))
    return back.unionByName(types).unionByName(steps)


@query(
    "s24_spreadsheet",
    """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS BIGINT) AS row_number, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_nationkey % 2 = 0 AS even,
  CAST(DATE '2019-12-31' + CAST(n_nationkey * 30 AS INTEGER) AS TIMESTAMP) AS day, n_nationkey / 8.0::DOUBLE AS eighth, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS note FROM nation""",
)
def s24(t: Tables):
    """The nations as one of two sheets of a workbook, read back with their types."""
    key = F.col("n_nationkey")
    day = F.date_add(F.lit("2019-12-31").cast("date"), (key * 30).cast("int")).alias("day")
    rows = t.nation.orderBy(key).select(
        key.alias("id"), F.col("n_name").alias("name"), (key % 2 == 0).alias("even"), day, (key / 8).alias("eighth"), F.when(key % 3 != 0, F.col("n_name")).alias("note")
    )
    path = f"{fresh(t, 'book')}.xlsx"
    SH.write_workbook(t.spark, {"Nations": rows, "Regions": t.region}, path)
    return SH.read_sheet(t.spark, path, "Nations")


@query("s25_delimited_links", "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS src, CAST(s_suppkey % 7 AS VARCHAR) AS dst, 'r' AS rel FROM supplier")
def s25(t: Tables):
    path = fresh(t, "links")
    t.supplier.select(F.concat_ws(" ", "s_nationkey", F.pmod("s_suppkey", F.lit(7)), F.lit("r"))).write.text(path)
    return T.read_links(t.spark, path)


def text_pairs(t: Tables) -> DataFrame:
    return t.edges().select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


SCORES_SQL = with_parts("edges") + " SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, unit('None:' || a || ':' || b) AS p FROM edges"


@query("m02_pair_scorer", SCORES_SQL)
def m02(t: Tables):
    return SC.scored(text_pairs(t), SC.scorer("hash_baseline"))


@query("m03_masked_scorer", with_parts("edges") + " SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, unit('kg:' || a || ':' || b) AS p FROM edges")
def m03(t: Tables):
    return SC.scored(text_pairs(t), SC.scorer("hash_baseline"), mask="kg")


class HalfKnown:
    """Knows the pairs whose first end is even."""

    modality = "mol"

    def score(self, pairs, mask=None):
        return (pairs["a"].astype("int64") % 2 == 0).map({True: 0.25, False: None}).astype("float64")


@query("m03_unknown_default", with_parts("edges") + " SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CASE WHEN a % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS p FROM edges")
def m03u(t: Tables):
    return SC.scored(text_pairs(t), HalfKnown())


@query("s23_resumable_scores", SCORES_SQL)
def s23(t: Tables):
    """A first run stops after the even pairs; the second scores the others alone."""
    path, pairs, model = fresh(t, "scores"), staged(text_pairs(t), "pairs"), SC.scorer("hash_baseline")
    RS.resume(t.spark, pairs.where("CAST(a AS BIGINT) % 2 = 0"), model, path)
    return RS.resume(t.spark, pairs, model, path)


@query("t03_stream_scores", SCORES_SQL)
def t03(t: Tables):
    source, path = fresh(t, "arriving"), fresh(t, "scores")
    text_pairs(t).write.parquet(source)
    RS.stream_scores(t.spark, source, SC.scorer("hash_baseline"), path, fresh(t, "progress")).awaitTermination()
    return RS.stored(t.spark, path)


@query("q07_annotation_audit", with_parts("edges") + ", an AS (SELECT * FROM edges WHERE (a + b) % 9 <> 0) SELECT count(*) AS n, CAST(count(*) FILTER (a % 5 = 0) AS BIGINT) AS n_no_flag, CAST(count(*) FILTER (b % 4 = 0) AS BIGINT) AS n_bad_label, CAST(count(*) FILTER (a % 5 = 1 AND b % 3 = 0) AS BIGINT) AS n_nameless, (SELECT count(*) FROM edges) - count(*) AS n_missing FROM an")
def q07(t: Tables):
    e = t.edges().select(F.col("a").alias("drug_a_id"), F.col("b").alias("drug_b_id"))
    a, b = F.col("drug_a_id"), F.col("drug_b_id")
    an = e.where(F.pmod(a + b, F.lit(9)) != 0).select(
        "*", F.when(F.pmod(a, F.lit(5)) != 0, F.pmod(a, F.lit(5)) == 1).alias("has_key_entity"), F.when(F.pmod(b, F.lit(4)) == 0, "other").otherwise("PK").alias("pk_pd_label"),
        F.when(F.pmod(b, F.lit(3)) == 0, " ").otherwise("name").alias("key_entity_name"), F.lit("enzyme").alias("key_entity_type"))
    return V.annotation_audit(e, an)


@query("q09_file_manifest", "SELECT 'gone.txt' AS path, 'missing' AS problem UNION ALL SELECT '../up.txt', 'unsafe'")
def q09(t: Tables):
    """A manifest of every written file, with one file that is not there and one unsafe path."""
    folder = fresh(t, "files")
    t.part.select("p_name").write.text(folder)
    found = staged(V.file_digests(t.spark, folder, "part-*"), "digests")
    told = found.select("path", "md5").unionByName(t.spark.createDataFrame([("gone.txt", "0"), ("../up.txt", "0")], "path string, md5 string"))
    return V.verify_digests(found, told)


@query("m01_saved_scorer", SCORES_SQL)
def m01(t: Tables):
    """A scorer by its manifest: the class is found by name and made from its settings."""
    folder = fresh(t, "scorer")
    SC.save_scorer(t.spark, "hash-baseline", {}, folder)
    return SC.scored(text_pairs(t), SC.load_scorer(t.spark, folder))


@query("d10_scored_conditions", with_parts("edges") + " SELECT c AS cond, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CASE WHEN c = 'R0' THEN unit('None:' || a || ':' || b) ELSE (a % 8) / 8.0::DOUBLE END AS p FROM edges, (VALUES ('R0'), ('R1')) v(c)")
def d10(t: Tables):
    """A scorer and a stored table side by side, as indicators take them."""
    pairs = text_pairs(t)
    kept = pairs.withColumn("p", F.pmod(F.col("a").cast("bigint"), F.lit(8)) / 8.0)
    return DG.scored_conditions(pairs, {"R0": SC.scorer("hash_baseline"), "R1": kept})


@query("q01_required_columns", "SELECT * FROM (VALUES ('l_orderkey', true), ('l_partkey', true), ('no_such_column', false)) v(name, present)")
def q01(t: Tables):
    return V.column_audit(t.lineitem, ["l_orderkey", "l_partkey", "no_such_column"])


@query("q10_stage_inputs", "SELECT 'label' AS stage, 'clean/edges.parquet' AS file, 'clean' AS producer")
def q10(t: Tables):
    """Of two skipped producers one has written its files."""
    out = fresh(t, "stages")
    T.write_tables({"drugs": t.nation, "edges": t.region}, f"{out}/raw", "parquet")
    lost = RU.missing_inputs(t.spark, out, ("extract", "clean", "label"), ("extract", "clean"))
    return t.spark.createDataFrame(lost + RU.missing_inputs(t.spark, out, ("extract", "clean", "label"), ("extract",)), "stage string, file string, producer string")


METHODS_NOW = ("zero_shot", "DESC_ONLY", "few_shot_2hop")
METHODS_THEN = ("Zero_Shot", "desc_only", "Zero_Shot_Sequence", "few_shot_2hop")
MODELS_THEN, MODELS_NOW = ("Llama-3.2-1B", "Qwen2.5-3B", "other"), ("Llama-3", "gemma-2b")


def _nth(values, by: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _listed(values, by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + {by} % {len(values)}]"


@query(
    "q11_prompt_contract",
    f"""WITH r AS (SELECT p_partkey AS key, {_listed([R.method_name(m) for m in METHODS_THEN], "p_size")} AS m1, {_listed([m.lower() for m in METHODS_NOW], "p_partkey")} AS m2,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'interaction' END AS t1, CASE WHEN p_size % 5 = 0 THEN 'severity' ELSE 'interaction' END AS t2,
  {_listed([R.model_family(m) for m in MODELS_THEN], "p_size")} AS f1, {_listed([R.model_family(m) for m in MODELS_NOW], "p_partkey")} AS f2 FROM part)
SELECT key, 'method' AS field, m1 AS trained, m2 AS now FROM r WHERE m1 <> m2 UNION ALL SELECT key, 'task_name', t1, t2 FROM r WHERE t1 <> t2
UNION ALL SELECT key, 'model_name', f1, f2 FROM r WHERE f1 <> f2""",
)
def q11(t: Tables):
    """Settings of two runs for each part; some tasks were not told."""
    size = lambda n: F.pmod("p_size", F.lit(n)) == 0
    then = F.struct(_nth(METHODS_THEN, "p_size").alias("method"), F.when(~size(7), "interaction").alias("task_name"), _nth(MODELS_THEN, "p_size").alias("model_name"))
    now = F.struct(_nth(METHODS_NOW, "p_partkey").alias("method"), F.when(size(5), "severity").otherwise("interaction").alias("task_name"), _nth(MODELS_NOW, "p_partkey").alias("model_name"))
    return RU.prompt_audit(t.part.select(F.col("p_partkey").alias("key"), then.alias("trained"), now.alias("now")))


@query(
    "q01_required_values",
    """SELECT 'doc_id' AS name, true AS present, count(*) FILTER (doc_id IS NULL) AS n_missing FROM documents
UNION ALL SELECT 'lang', true, count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'no_such_column', false, count(*) FROM documents""",
)
def q01_values(t: Tables):
    return V.required_values(t.documents, ["doc_id", "lang", "no_such_column"])


@query(
    "q08_dataset_check",
    with_parts("folds", "typed") + """, kept AS (SELECT * FROM folds WHERE (a + b) % 97 <> 0), ng AS (SELECT split FROM kept WHERE (a * 3 + b) % 50 <> 0),
nt AS (SELECT count(*) AS n FROM kept WHERE split = 'train'), ep AS (SELECT a % 2 AS epoch, a, b FROM folds WHERE split <> 'val_s0' AND (a + b) % 5 = 0),
pr(problem, place, n) AS (
  SELECT 'not in a fold', '', count(*) FROM folds WHERE (a + b) % 97 = 0
  UNION ALL SELECT 'not one to one', split, count(*) FILTER ((a * 3 + b) % 50 = 0) FROM kept GROUP BY split
  UNION ALL SELECT 'epoch size', CAST(epoch AS VARCHAR), abs(count(*) - (SELECT n FROM nt)) FROM ep GROUP BY epoch
  UNION ALL SELECT 'epoch has an edge', CAST(epoch AS VARCHAR), count(*) FROM ep GROUP BY epoch
  UNION ALL SELECT 'epoch outside G1', CAST(epoch AS VARCHAR), count(*) FROM ep JOIN groups x ON x.node = a JOIN groups y ON y.node = b WHERE x.grp <> 'G1' OR y.grp <> 'G1' GROUP BY epoch
  UNION ALL SELECT 'stored count', 'n_drugs', abs((SELECT count(DISTINCT p_partkey) FROM part) - 1900)
  UNION ALL SELECT 'stored count', 'n_edges', abs((SELECT count(*) FROM typed) - 565731)
  UNION ALL SELECT 'stored count', 'n_types', abs((SELECT count(DISTINCT ddi_type) FROM typed) - 215)
) SELECT problem, place, CAST(n AS BIGINT) AS n FROM pr WHERE n > 0""",
)
def q08_dataset(t: Tables):
    """A dataset that lacks some pairs, some negatives and has edges among its training negatives."""
    folds = staged(t.folds().select("a", "b", "split"), "dataset-folds")
    kept = folds.where("(a + b) % 97 <> 0")
    negatives = kept.where("(a * 3 + b) % 50 <> 0")
    epochs = folds.where("split <> 'val_s0' AND (a + b) % 5 = 0").select((F.col("a") % 2).alias("epoch"), "a", "b")
    nodes = t.part.select(F.col("p_partkey").alias("node"))
    return DS.dataset_problems(staged(t.typed_edges(), "dataset-edges"), kept, t.groups(), negatives, epochs, None, nodes, "full")


@query("q12_run_identity", "SELECT 'changed' AS problem UNION ALL SELECT 'another run'")
def q12(t: Tables):
    """A finished table of one part that is written again, and a run of another identity."""
    folder = fresh(t, "run")
    run = RU.Run(t.spark, folder, {"model": "m", "seed": 1})
    t.nation.select("n_name").coalesce(1).write.text(f"{folder}/names")
    run.finish("names")
    run.check()
    name = t.spark.read.format("binaryFile").load(f"{folder}/names/part-*").select("path").first()[0]
    T.write_json({"other": 1}, name, t.spark)
    odd = RU.Run(t.spark, folder, {"model": "m", "seed": 1}).problems().select("problem")
    try:
        RU.Run(t.spark, folder, {"model": "m", "seed": 2})
        said = "none"
    except V.Invalid:
        said = "another run"
    return odd.unionByName(t.spark.createDataFrame([(said,)], "problem string"))


@query("t02_epochs_one_by_one", "WITH e(epoch) AS (VALUES (0), (1), (2)) SELECT CAST(epoch AS INTEGER) AS epoch, (SELECT count(*) FROM nation) AS n FROM e")
def t02(t: Tables):
    """Epochs written one after the other; a second call goes on behind those that are there."""
    folder = fresh(t, "epochs")
    nodes, known = X.indexed_pool(t.part.select(F.col("p_partkey").alias("node"))), t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    for epochs in (1, 3):
        X.write_epochs(t.spark, t.nation, nodes, known, SEED, epochs, folder)
    out = None
    for e, df in enumerate(T.cached_negatives(t.spark, folder)[1]):
        one = df.distinct().agg(F.lit(e).alias("epoch"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
