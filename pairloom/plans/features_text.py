"""Queries of predicates, small functions, samples, feature tables and the rest of retrieval and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import annotate as A
from ..operators import audit as AU
from ..operators import cleaning as C
from ..operators import diagnostics as D
from ..operators import features as FE
from ..operators import graph as G
from ..operators import kg as K
from ..operators import mentions as MN
from ..operators import render as R
from ..operators import retrieval as RT
from ..operators import sampling as X
from ..operators.scoring import MASKS, mask_conditions
from . import diag_metrics as DM
from . import graph_render as GR
from .registry import SEED, Tables, query, with_parts

SMILES = ("CC(=O)Oc1ccccc1", "C1CC", "C(C", "[Na+].CC", "O=S=O", "[2H]C([2H])Cl")
SMILES_SQL = "[" + ", ".join(f"'{s}'" for s in SMILES) + f"][1 + p_size % {len(SMILES)}]"


def structures(t: Tables):
    texts = F.array(*map(F.lit, SMILES))
    return t.part.select("p_partkey", F.element_at(texts, (F.pmod("p_size", F.lit(len(SMILES))) + 1).cast("int")).alias("smiles"))


@query("p02_valid_structure", f"SELECT p_partkey, {SMILES_SQL} AS smiles FROM part WHERE p_size % {len(SMILES)} NOT IN (1, 2)")
def p02(t: Tables):
    return structures(t).where(C.valid_structure(F.col("smiles")))


@query("p06_organic_without_metal", f"SELECT p_partkey, {SMILES_SQL} AS smiles FROM part WHERE p_size % {len(SMILES)} NOT IN (3, 4)")
def p06(t: Tables):
    return structures(t).where(C.organic_without_metal(F.col("smiles")))


@query("p07_human_rows", "SELECT l_partkey AS node, l_suppkey AS entity FROM lineitem WHERE l_linestatus = 'O'")
def p07(t: Tables):
    rows = t.lineitem.select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("entity"), F.when(F.col("l_linestatus") == "O", "Humans").otherwise("Mouse").alias("organism"))
    return K.human_only(rows).select("node", "entity")


@query("p11_narrow_pairs", with_parts("typed") + " SELECT a, b FROM typed")
def p11(t: Tables):
    return C.pair_columns(t.typed_edges(), "a", "b")


@query("p16_value_substitution", "SELECT event_id, CASE WHEN x = 'view' THEN 'click' ELSE x END AS label FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN 'view' ELSE event_type END AS x FROM events)")
def p16(t: Tables):
    """'?' takes the other annotator's label, then one value stands for another."""
    own = F.when(F.pmod("event_id", F.lit(4)) == 0, "?").when(F.pmod("event_id", F.lit(3)) == 0, "view").otherwise(F.col("event_type"))
    return t.events.select("event_id", S.substituted(own, F.col("event_type"), {"view": "click"}).alias("label"))


@query("a08_name_sets", with_parts("kg") + " SELECT DISTINCT node, CASE WHEN CAST(entity_id AS BIGINT) % 10 = 0 THEN ' ' WHEN CAST(entity_id AS BIGINT) % 10 = 1 THEN 'NaN' ELSE entity_name END AS entity_name, edge_type FROM kg WHERE CAST(entity_id AS BIGINT) % 10 > 1")
def a08(t: Tables):
    k = F.pmod(F.col("entity_id").cast("bigint"), F.lit(10))
    return K.name_sets(t.kg().withColumn("entity_name", F.when(k == 0, " ").when(k == 1, "NaN").otherwise(F.col("entity_name"))))


@query("a11_bucket_summary", "WITH dl AS (SELECT 'value' AS indicator, ['PK-A', 'PK-B', 'PD-A', 'PD-B', 'Other'][1 + user_id % 5] AS bucket, CAST(event_id % 2 AS INTEGER) AS label, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS delta FROM events) " + DM.SUMMARY)
def a11(t: Tables):
    """One delta in thirteen is NaN: it counts, without a part in the mean."""
    names = F.array(*map(F.lit, (*D.PRIMARY, "Other")))
    rows = t.events.select(
        F.lit("value").alias("indicator"), F.element_at(names, (F.pmod("user_id", F.lit(5)) + 1).cast("int")).alias("bucket"), F.pmod("event_id", F.lit(2)).cast("int").alias("label"),
        F.when(F.pmod("event_id", F.lit(13)) == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("delta"))
    return DM.rounded(D.summarise(rows))


@query("a25_principal_components")
def a25(t: Tables):
    """Fitted on one part of the rows alone; signs are arbitrary, so there is no SQL."""
    prints = GR.bits(t)
    ref = prints.where("node < 8").select(F.col("node").alias("pos"), "bits")
    return FE.principal_components(FE.reference_profiles(prints, ref), prints.where("pmod(node, 5) <> 0").select("node"), 3)


@query("a27_audit_summary", "SELECT count(*) AS description_count, CAST(count(*) FILTER (mask_count > 0) AS BIGINT) AS descriptions_with_masks, CAST(sum(mask_count) AS BIGINT) AS mask_count, CAST(count(*) FILTER (hit) AS BIGINT) AS descriptions_with_candidate_mentions FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS mask_count, p_size % 4 = 0 OR p_size % 5 = 0 AS hit FROM part)")
def a27(t: Tables):
    return AU.audit_summary(AU.audit_descriptions(descriptions(t), "p_partkey"))


def descriptions(t: Tables):
    """Part names with two masks (size a multiple of 3), an entity (of 4) and the part's own brand (of 5)."""
    by = lambda n, text: F.when(F.pmod("p_size", F.lit(n)) == 0, text).otherwise(F.lit(""))
    mask = F.lit(f" {AU.MASK} and {AU.MASK}")
    text = F.concat(F.lit("plain words"), by(3, mask), by(4, F.lit(" by CYP3A4, EGFR")), by(5, F.concat(F.lit(" like "), F.lower("p_brand"), F.lit("."))))
    return t.part.select("p_partkey", text.alias("text"), F.array("p_brand").alias("own"))


@query("r14_masked_descriptions", f"SELECT p_partkey, 'plain words' || CASE WHEN p_size % 3 = 0 THEN ' {AU.MASK} and {AU.MASK}' ELSE '' END || CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 3 = 0 THEN ' by {AU.MASK}' ELSE ' by {AU.MASK}' END ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' like {AU.MASK}.' ELSE '' END AS masked, CAST(CASE WHEN p_size % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_replaced FROM part")
def r14(t: Tables):
    return AU.mask_descriptions(descriptions(t), "p_partkey")


@query("n08_mentions_with_offsets", "SELECT p_partkey, 'short_form' AS category, unnest(['CYP3A4', 'EGFR']) AS text, unnest([15, 23]) + CASE WHEN p_size % 3 = 0 THEN 36 ELSE 0 END AS s FROM part WHERE p_size % 4 = 0")
def n08(t: Tables):
    m = AU.audit_descriptions(descriptions(t), "p_partkey").select("p_partkey", F.explode("mentions").alias("m")).where("m.category = 'short_form'")
    return m.select("p_partkey", "m.category", "m.text", F.col("m.start").alias("s"))


OTHERS_SQL = r"""nm AS (SELECT CAST(item_id AS VARCHAR) AS other, regexp_extract(text, '(\p{L}+ \p{L}+)', 1) AS name FROM benchmark),
ht AS (SELECT d.doc_id, d.text, o.other, length(o.name) AS n, string_split(lower(d.text), lower(o.name)) AS ps
  FROM documents d JOIN nm o ON length(o.name) >= 4 AND contains(lower(d.text), lower(o.name)) AND CAST(d.doc_id AS VARCHAR) <> o.other
  LEFT JOIN nm own ON own.other = CAST(d.doc_id AS VARCHAR) WHERE lower(own.name) IS DISTINCT FROM lower(o.name)),
pl AS (SELECT doc_id, text, other, n, list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * n AS s
  FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM ht)),
mn AS (SELECT doc_id, other, substr(text, CAST(s + 1 AS BIGINT), n) AS mention, CAST(s AS INTEGER) AS s, CAST(s + n AS INTEGER) AS e FROM pl
  WHERE NOT regexp_matches(CASE WHEN s = 0 THEN '' ELSE substr(text, CAST(s AS BIGINT), 1) END, '[\p{L}\p{N}_]')
    AND NOT regexp_matches(substr(text, CAST(s + n + 1 AS BIGINT), 1), '[\p{L}\p{N}_]'))"""


def name_list(t: Tables):
    """The first two words of each benchmark item, as the name of an entity of that id."""
    return t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.regexp_extract("text", r"(\p{L}+ \p{L}+)", 1).alias("name"))


@query("n08_other_mentions", f"WITH {OTHERS_SQL} SELECT * FROM mn")
def n08_others(t: Tables):
    found = MN.with_mentions(t.documents.select("doc_id", "text"), name_list(t), "doc_id", name_key="id")
    m = found.select("doc_id", F.explode("others").alias("m"))
    return m.select("doc_id", "m.other", F.col("m.text").alias("mention"), F.col("m.start").alias("s"), F.col("m.end").alias("e"))


ANY_RULE = "(?i)" + "|".join([rf"\b(?:{p})\b" for p in AU.ENTITY_PATTERNS] + list(AU.PHRASE_PATTERNS)).replace("'", "''")


@query(
    "a27_audit_with_names",
    f"""WITH {OTHERS_SQL}, d AS (SELECT doc_id, text, (length(text) - length(replace(text, '{AU.MASK}', ''))) // {len(AU.MASK)} AS k FROM documents)
SELECT count(*) AS description_count, count(*) FILTER (k > 0) AS descriptions_with_masks, CAST(sum(k) AS BIGINT) AS mask_count,
  count(*) FILTER (regexp_matches(text, '{ANY_RULE}') OR doc_id IN (SELECT doc_id FROM mn)) AS descriptions_with_candidate_mentions FROM d""",
)
def a27_names(t: Tables):
    own = F.expr("cast(array() as array<string>)").alias("own")
    return AU.audit_summary(AU.audit_descriptions(t.documents.select("doc_id", "text", own), "doc_id", names=name_list(t), name_key="id"))


@query("w11_winner", "SELECT split, step, auc FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY auc DESC, step) AS r FROM (SELECT o_orderpriority AS split, o_orderkey AS step, round(o_totalprice / 50000) AS auc FROM orders WHERE o_orderkey % 7 <> 0)) WHERE r = 1")
def w11(t: Tables):
    auc = F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.lit(float("nan"))).otherwise(F.round(F.col("o_totalprice") / 50000))
    return D.winner(t.orders.select(F.col("o_orderpriority").alias("split"), F.col("o_orderkey").alias("step"), auc.alias("auc"))).select("split", "step", "auc")


@query("o01_sorted_types", with_parts("typed") + " SELECT ddi_type, CAST(row_number() OVER (ORDER BY ddi_type) AS BIGINT) AS place FROM (SELECT DISTINCT ddi_type FROM typed)")
def o01(t: Tables):
    from ..functions.numbering import range_numbered

    return range_numbered(t.typed_edges().select("ddi_type").distinct(), ["ddi_type"])


@query("n02_keyword_hits", with_parts("typed") + " SELECT DISTINCT ddi_type, array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in S.PD_KEYWORDS) + "], lambda w: contains(lower(ddi_type), w)), ';') AS hits FROM typed")
def n02(t: Tables):
    return t.typed_edges().select("ddi_type").distinct().select("ddi_type", F.array_join(S.keyword_hits(F.col("ddi_type"), S.PD_KEYWORDS), ";").alias("hits"))


@query("n03_role_pattern", "SELECT l_returnflag, l_linestatus, CASE WHEN x IN ('inhibitor', 'inducer') AND y = 'substrate' THEN x || '-substrate' WHEN y IN ('inhibitor', 'inducer') AND x = 'substrate' THEN y || '-substrate' ELSE x || '-' || y END AS pattern FROM (SELECT DISTINCT l_returnflag, l_linestatus, CASE l_returnflag WHEN 'R' THEN 'inhibitor' WHEN 'A' THEN 'substrate' ELSE 'inducer' END AS x, CASE l_linestatus WHEN 'O' THEN 'substrate' ELSE 'inhibitor' END AS y FROM lineitem)")
def n03(t: Tables):
    x = F.when(F.col("l_returnflag") == "R", "inhibitor").when(F.col("l_returnflag") == "A", "substrate").otherwise("inducer")
    y = F.when(F.col("l_linestatus") == "O", "substrate").otherwise("inhibitor")
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct().select("l_returnflag", "l_linestatus", A.role_pattern(x, y).alias("pattern"))


@query("n04_mechanism_chain", """WITH k AS (SELECT DISTINCT 'P' || l_partkey AS a, 'Q' || l_linenumber AS b, 'S' || l_suppkey AS e, CASE l_suppkey % 2 WHEN 0 THEN 'transports' ELSE 'metabolizes' END AS verb,
CASE l_returnflag WHEN 'R' THEN 'inhibitor' WHEN 'A' THEN 'substrate' ELSE 'inducer' END AS x, CASE l_linestatus WHEN 'O' THEN 'substrate' ELSE 'inhibitor' END AS y FROM lineitem)
SELECT CASE WHEN x <> 'substrate' AND y = 'substrate' THEN a || ' --[' || x || ']--> ' || e || ' --[substrate: ' || verb || ']--> ' || b WHEN y <> 'substrate' AND x = 'substrate' THEN b || ' --[' || y || ']--> ' || e || ' --[substrate: ' || verb || ']--> ' || a
ELSE a || ' --[' || x || ']--> ' || e || ' <--[' || y || ']-- ' || b END AS chain FROM k""")
def n04(t: Tables):
    x = F.when(F.col("l_returnflag") == "R", "inhibitor").when(F.col("l_returnflag") == "A", "substrate").otherwise("inducer")
    y = F.when(F.col("l_linestatus") == "O", "substrate").otherwise("inhibitor")
    rows = t.lineitem.select(
        F.concat(F.lit("P"), "l_partkey").alias("a"), F.concat(F.lit("Q"), "l_linenumber").alias("b"), F.concat(F.lit("S"), "l_suppkey").alias("e"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "transporter").otherwise("enzyme").alias("kind"), x.alias("x"), y.alias("y")).distinct()
    return rows.select(A.mechanism_chain(*map(F.col, ("a", "x", "b", "y", "e", "kind"))).alias("chain"))


@query("n06_canonical_pair", "SELECT DISTINCT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem")
def n06(t: Tables):
    return t.lineitem.select(S.pair_lo("l_partkey", "l_suppkey").alias("lo"), S.pair_hi("l_partkey", "l_suppkey").alias("hi")).distinct()


FAMILY_SQL = "CASE WHEN contains(n, 'qwen') THEN 'qwen' WHEN contains(n, 'llama') THEN 'llama' WHEN contains(n, 'gemma') THEN 'gemma' WHEN contains(n, 'mistral') THEN 'mistral' ELSE 'qwen' END"
MODELS = ("Org/Llama-3", "Qwen2.5", "gemma-7b", "Mistral-v0.3", "other")


@query("n13_model_family", f"SELECT n_nationkey, {FAMILY_SQL} AS family FROM (SELECT n_nationkey, lower([" + ", ".join(f"'{m}'" for m in MODELS) + "][1 + n_nationkey % 5]) AS n FROM nation)")
def n13(t: Tables):
    names = F.element_at(F.array(*map(F.lit, MODELS)), (F.pmod("n_nationkey", F.lit(len(MODELS))) + 1).cast("int"))
    return t.nation.select("n_nationkey", R.family_of(names).alias("family"))


@query("n16_interaction_term", "SELECT event_id, abs(unit('1:' || event_id) - unit('3:' || event_id)) - abs(unit('0:' || event_id) - unit('2:' || event_id)) AS delta FROM events")
def n16(t: Tables):
    u = lambda c: S.unit(c, F.col("event_id"))
    return t.events.select("event_id", (F.abs(u("1") - u("3")) - F.abs(u("0") - u("2"))).alias("delta"))


@query("n23_row_normalised", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0 AS has_mass, round(abs(embedding[1]::DOUBLE) / list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 9) AS first FROM embeddings")
def n23(t: Tables):
    xs = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return t.embeddings.select("vec_id", (F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) > 0).alias("has_mass"), F.round(S.row_normalised(xs)[0], 9).alias("first"))


@query("n25_json_round_trip", "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def n25(t: Tables):
    packed = t.nation.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("j"))
    return packed.select("n_nationkey", F.from_json("j", "name string, region int").alias("x")).select("n_nationkey", "x.name", "x.region")


@query("n27_half_even", "SELECT p_size, CAST(round_even(p_size / 8.0::DOUBLE, 1) AS DOUBLE) AS share FROM (SELECT DISTINCT p_size FROM part)")
def n27(t: Tables):
    return t.part.select("p_size").distinct().select("p_size", F.bround(F.col("p_size") / 8, 1).alias("share"))


@query("x14_type_sample", f"SELECT p_type FROM (SELECT DISTINCT p_type FROM part) ORDER BY md5('{SEED}:types:' || p_type), p_type LIMIT 20")
def x14(t: Tables):
    return X.hash_top(t.part.select("p_type").distinct(), 20, SEED, "types", "p_type")


@query("x18_pool_cap", with_parts("edges") + f" SELECT a, b FROM edges ORDER BY md5('{SEED}:pool:' || a || ':' || b), a || ':' || b LIMIT 5000")
def x18(t: Tables):
    e = t.edges().withColumn("k", F.concat_ws(":", "a", "b"))
    return X.hash_top(e, 5000, SEED, "pool", "k").select("a", "b")


@query("x19_example_order", f"SELECT n_regionkey, list(n_name ORDER BY md5('{SEED}:' || n_regionkey || ':' || n_nationkey)) AS names FROM nation GROUP BY 1")
def x19(t: Tables):
    rows = F.array_sort(F.collect_list(F.struct(S.hash_order(str(SEED), F.col("n_regionkey"), F.col("n_nationkey")).alias("h"), "n_name")))
    return t.nation.groupBy("n_regionkey").agg(F.transform(rows, lambda x: x["n_name"]).alias("names"))


@query("x21_epoch_shuffle", f"SELECT k, label, row_number() OVER (ORDER BY md5('{SEED}:epoch:' || k), k) AS place FROM (SELECT doc_id || ':' || quality AS k, CAST(quality AS INTEGER) AS label FROM labels)")
def x21(t: Tables):
    rows = t.labels.select(F.concat_ws(":", "doc_id", "quality").alias("k"), F.col("quality").cast("int").alias("label"))
    return X.shuffled(rows, "k", SEED, "epoch")


@query("x17_padded_examples", "WITH q AS (SELECT n_nationkey AS qa, n_nationkey + 1 AS qb FROM nation), pl AS (SELECT s_nationkey AS ra, s_suppkey + 100 AS rb, row_number() OVER (ORDER BY md5('" + str(SEED) + """:' || s_nationkey || ':' || (s_suppkey + 100)), s_nationkey, s_suppkey + 100) AS idx FROM (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier)),
tr AS (SELECT qa, qb, place, k, h32('""" + str(SEED) + """:' || qa || ':' || qb || ':' || place || ':' || k) % (SELECT count(*) FROM pl) + 1 AS idx FROM q, range(1, 4) p(place), range(8) r(k)),
g AS (SELECT tr.*, ra, rb, CASE WHEN ra IN (qa, qb) OR rb IN (qa, qb) THEN 1 ELSE 0 END AS leak FROM tr JOIN pl USING (idx))
SELECT qa, qb, CAST(place AS INTEGER) AS place, ra, rb, CASE WHEN leak = 1 THEN 'padding_leaking_unavoidable' ELSE 'padding' END AS note FROM (SELECT *, row_number() OVER (PARTITION BY qa, qb, place ORDER BY leak, k) AS r FROM g) WHERE r = 1""")
def x17(t: Tables):
    q = t.nation.select(F.col("n_nationkey").cast("bigint").alias("qa"), (F.col("n_nationkey") + 1).cast("bigint").alias("qb"))
    pool = t.supplier.select(F.col("s_nationkey").cast("bigint").alias("ra"), (F.col("s_suppkey") + 100).alias("rb"))
    none = q.limit(0).select("qa", "qb", F.lit(1).alias("place"), F.col("qa").alias("ra"), F.col("qb").alias("rb"), F.lit(0.0).alias("score"))
    return RT.padded(none, q, pool, 3, SEED).select("qa", "qb", "place", "ra", "rb", "note")


@query("g01_neighbours", with_parts("kg") + " SELECT edge_type, entity_id, CAST(pos AS INTEGER) AS pos FROM kg WHERE node = 7 AND edge_type IN ('target', 'enzyme')")
def g01(t: Tables):
    return K.neighbours(t.kg(), 7, ["target", "enzyme"], "node").select("edge_type", "entity_id", "pos")


@query("g07_name_graph", with_parts("kg") + " SELECT DISTINCT node, edge_type, '' AS entity_id, entity_name, '' AS organism, '' AS action FROM kg")
def g07(t: Tables):
    return K.from_name_map(t.kg().select("node", "edge_type", "entity_name").distinct())


@query("g08_biomedical_edges", with_parts("edges", "groups", "kg") + """, one AS (SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst, 1 AS rel FROM edges WHERE a NOT IN (SELECT node FROM groups WHERE grp = 'G2') AND b NOT IN (SELECT node FROM groups WHERE grp = 'G2')
 UNION ALL SELECT DISTINCT CAST(node AS VARCHAR), 'entity:' || entity_id, CASE edge_type WHEN 'target' THEN 2 ELSE 3 END FROM kg WHERE edge_type IN ('target', 'enzyme')) SELECT src, dst, rel FROM one UNION ALL SELECT dst, src, rel FROM one""")
def g08(t: Tables):
    return FE.biomedical_edges(t.edges(), t.groups(), t.kg(), ("target", "enzyme"))


@query("g09_print_edges", f"WITH {GR.BITS_SQL}, f AS (SELECT node, CASE WHEN node % 50 = 0 THEN [] ELSE bits END AS bits FROM bits) SELECT node, CAST(unnest(CASE WHEN len(bits) = 0 THEN [-1] ELSE bits END) AS INTEGER) AS bit FROM f")
def g09(t: Tables):
    b = GR.bits(t).withColumn("bits", F.when(F.pmod("node", F.lit(50)) == 0, F.array().cast("array<int>")).otherwise(F.col("bits")))
    return FE.print_edges(b)


@query("g10_interaction_edges", with_parts("folds") + ", both_ways AS (SELECT a AS src, b AS dst FROM folds WHERE split = 'train' UNION SELECT b, a FROM folds WHERE split = 'train') SELECT src, dst FROM both_ways UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey NOT IN (SELECT src FROM both_ways)")
def g10(t: Tables):
    return FE.interaction_edges(t.folds().where("split = 'train'").select("a", "b"), t.part.select(F.col("p_partkey").alias("node")))


@query("g11_property_bins", "WITH e AS (SELECT list_transform(range(0, 11), lambda i: 0.1 * i) AS qs), x AS (SELECT quantile_cont(p_retailprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS ed FROM part) SELECT p_partkey AS node, 'p_retailprice' AS prop, CAST(least(len(list_filter(ed[2:], lambda v: v < p_retailprice)), 9) AS INTEGER) AS bin FROM part, x")
def g11(t: Tables):
    return FE.property_bins(t.part.withColumn("node", F.col("p_partkey")), ["p_retailprice"])


@query("g17_distance_relations", GR.PATHS_SQL + " SELECT src, node, CAST(dist + 7 AS INTEGER) AS rel FROM r")
def g17(t: Tables):
    nodes = GR.nodes(t)
    return G.induced_relations(G.shortest_paths(GR.small(t), nodes), nodes, 7)


CTX_PAIR = ", ".join(f"array_to_string(x.{k}, '|') || '/' || array_to_string(y.{k}, '|') AS {k}" for k in GR.KINDS)


@query("r02_pair_context", with_parts("edges", "kg") + f", {GR.CTX_SQL} SELECT a, b, {CTX_PAIR} FROM edges JOIN cx x ON x.node = a JOIN cx y ON y.node = b")
def r02(t: Tables):
    p = RT.pair_context(t.meetings(), GR.context(t), GR.KINDS, distinct=True)
    side = lambda i, s: F.array_join(F.col("ctx")[i][s], "|")
    return p.select("a", "b", *[F.concat(side(i, "A"), F.lit("/"), side(i, "B")).alias(k) for i, k in enumerate(GR.KINDS)])


@query("r04_shared_evidence", "WITH nm AS (SELECT s_nationkey AS n, list_sort(list(DISTINCT 'e' || s_suppkey % 17)) AS es FROM supplier GROUP BY 1), x AS (SELECT a.n_nationkey AS qa, b.n_nationkey AS qb, c.n_nationkey AS ra, d.n_nationkey AS rb FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 JOIN nation c ON c.n_nationkey = a.n_nationkey + 2 JOIN nation d ON d.n_nationkey = a.n_nationkey + 3) SELECT qa, qb, " + ", ".join(
    f"array_to_string(list_sort(list_intersect(coalesce({q}.es, []), coalesce({r}.es, []))), ',') AS shared_{q.upper()}_{n}" for q in ("qa", "qb") for n, r in (("CA", "ra"), ("CB", "rb"))) + " FROM x LEFT JOIN nm qa ON qa.n = x.qa LEFT JOIN nm qb ON qb.n = x.qb LEFT JOIN nm ra ON ra.n = x.ra LEFT JOIN nm rb ON rb.n = x.rb")
def r04(t: Tables):
    n = t.nation.select("n_nationkey")
    last = t.nation.agg(F.max("n_nationkey")).first()[0]
    x = n.where(F.col("n_nationkey") + 3 <= last).select(*[(F.col("n_nationkey") + i).alias(c) for i, c in enumerate(("qa", "qb", "ra", "rb"))])
    names = t.supplier.select(F.col("s_nationkey").alias("node"), F.concat(F.lit("e"), F.pmod("s_suppkey", F.lit(17))).alias("entity")).distinct()
    out = RT.shared_evidence(x, names)
    return out.select("qa", "qb", *[F.array_join(c, ",").alias(c) for c in out.columns if c.startswith("shared_")])


@query("r05_samples", with_parts("edges") + " SELECT a, b, coalesce(x.p_name, CAST(a AS VARCHAR)) AS name_a, coalesce(y.p_name, CAST(b AS VARCHAR)) AS name_b FROM edges LEFT JOIN (FROM part WHERE p_size % 3 <> 0) x ON x.p_partkey = a LEFT JOIN (FROM part WHERE p_size % 3 <> 0) y ON y.p_partkey = b")
def r05(t: Tables):
    return FE.samples(t.edges(), t.part.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")))


_tail = "'In the above context, we can predict that the drug-drug interactions between ' || na || ' and ' || nb || ' is that: '"


@query("r13_described_pair", f"""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS na, p_brand AS nb, CASE WHEN p_size % 2 = 0 THEN p_type || '!' ELSE '' END AS a, CASE WHEN p_size % 3 = 0 THEN p_type || '.' ELSE '' END AS b FROM part)
SELECT p_partkey, CASE WHEN na IS NULL THEN NULL WHEN a = '' AND b = '' THEN na || ' ' || nb || ' ' || {_tail} ELSE na || ': ' || a || ' ' || nb || ': ' || b || ' ' || {_tail} END AS text FROM s""")
def r13(t: Tables):
    name = F.when(F.pmod("p_size", F.lit(7)) != 0, F.col("p_name"))
    a, b = F.when(F.pmod("p_size", F.lit(2)) == 0, F.concat("p_type", F.lit("!"))), F.when(F.pmod("p_size", F.lit(3)) == 0, F.col("p_type"))
    return t.part.select("p_partkey", R.described_pair(name, a, F.col("p_brand"), b).alias("text"))


@query("d08_masked_panel", DM.TRIPLES + DM.BUCKETS + DM.PREDS + DM.BASE + """, sw AS (SELECT 'KPS-F' AS indicator, bucket, label, abs(x.r0 - y.r0) AS delta FROM tb JOIN pr x ON x.a = least(qa, qb) AND x.b = greatest(qa, qb) JOIN pr y ON y.a = least(qa_prime, qb) AND y.b = greatest(qa_prime, qb)),
dl AS (SELECT * FROM sw UNION ALL SELECT 'KPS-mol', bucket, label, abs(r0 - r1) FROM sc UNION ALL SELECT 'KPS-KG', bucket, label, abs(r0 - r2) FROM sc) """ + DM.SUMMARY)
def d08(t: Tables):
    src, pool = DM.swap_sources(t)
    keys = DM.swapped(t, src, pool)
    names = F.when(F.col("cond") == "R0", "base").when(F.col("cond") == "R1", "mask_mol").otherwise("mask_kg")
    p = DM.preds(keys, ("R0", "R1", "R2")).withColumn("cond", names)
    return DM.rounded(D.masked_panel(DM.bucketed(keys), p, D.swap_sensitivity(src, pool, t.groups(), p, DM.pair_bucket, "base")))


MODALITY = "['mol', 'text', 'mol+kg-fused', 'kg', 'mol+kg'][1 + event_id % 5]"


@query(
    "d11_mask_channels",
    f"""SELECT event_id, unnest(CASE {MODALITY} WHEN 'kg' THEN ['none', 'kg'] WHEN 'mol+kg' THEN ['none', 'mol', 'kg'] ELSE ['none'] END) AS mask FROM events""",
)
def d11(t: Tables):
    """The conditions under which each row's model is to be scored: unmasked, and each channel that its modality can mask."""
    modality = F.element_at(F.array(*map(F.lit, MASKS)), (F.pmod("event_id", F.lit(len(MASKS))) + 1).cast("int"))
    return t.events.select("event_id", F.explode(mask_conditions(modality)).alias("mask"))

