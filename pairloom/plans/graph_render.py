"""Queries of similarity, graphs and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import kg as K
from ..operators import render as R
from ..operators import retrieval as RT
from .registry import SEED, Tables, query, with_parts

BITS_SQL = "bits AS (SELECT vec_id AS node, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings)"


def bits(t: Tables):
    on = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return t.embeddings.select(F.col("vec_id").alias("node"), on.alias("bits"))


TOP_SQL = f"""WITH {BITS_SQL}, s AS (SELECT x.node AS u, y.node AS v, len(list_intersect(x.bits, y.bits)) / (len(x.bits) + len(y.bits) - len(list_intersect(x.bits, y.bits)))::DOUBLE AS sim FROM bits x JOIN bits y ON x.node <> y.node),
tp AS (SELECT u, place, v, sim FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS INTEGER) AS place FROM s WHERE sim > 0) WHERE place <= 5)"""


@query("n18_tanimoto_topk", TOP_SQL + " SELECT u, place, v, sim FROM tp")
def n18(t: Tables):
    b = bits(t)
    return RT.top_similar_nodes(b, b, 5)


NATION_BITS = "nb AS (SELECT s_nationkey AS node, list_sort(list(DISTINCT s_suppkey % 32)) AS bits FROM supplier GROUP BY 1), sim AS (SELECT x.node AS u, y.node AS v, len(list_intersect(x.bits, y.bits)) / len(list_distinct(list_concat(x.bits, y.bits)))::DOUBLE AS sim FROM nb x, nb y)"


def nation_prints(t: Tables):
    return t.supplier.groupBy(F.col("s_nationkey").alias("node")).agg(F.array_sort(F.collect_set(F.pmod("s_suppkey", F.lit(32)))).alias("bits"))


@query("j15_reference_matrix", f"WITH {NATION_BITS} SELECT u, v, sim FROM sim")
def j15(t: Tables):
    nb = nation_prints(t)
    return RT.node_similarity(nb, nb, nb)


PAIRS_SQL = ", q AS (SELECT DISTINCT n_regionkey AS qa, n_nationkey AS qb FROM nation WHERE n_regionkey <> n_nationkey), po AS (SELECT x.n_nationkey AS ra, y.n_nationkey AS rb FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)"


def query_pairs(t: Tables):
    q = t.nation.where("n_regionkey <> n_nationkey").select(F.col("n_regionkey").cast("bigint").alias("qa"), F.col("n_nationkey").cast("bigint").alias("qb")).distinct()
    x, y = t.nation.select("n_regionkey", F.col("n_nationkey").cast("bigint").alias("ra")), t.nation.select("n_regionkey", F.col("n_nationkey").cast("bigint").alias("rb"))
    return q, x.join(y, "n_regionkey").where("ra < rb").select("ra", "rb")


@query("n19_pair_similarity_topk", f"WITH {NATION_BITS}" + PAIRS_SQL + """, c AS (SELECT * FROM q, po WHERE ra <> qa AND ra <> qb AND rb <> qa AND rb <> qb),
s AS (SELECT qa, qb, ra, rb, greatest((x.sim + y.sim) / 2, (z.sim + w.sim) / 2) AS score FROM c JOIN sim x ON x.u = qa AND x.v = ra JOIN sim y ON y.u = qb AND y.v = rb JOIN sim z ON z.u = qa AND z.v = rb JOIN sim w ON w.u = qb AND w.v = ra)
SELECT qa, qb, CAST(place AS INTEGER) AS place, ra, rb, score FROM (SELECT *, row_number() OVER (PARTITION BY qa, qb ORDER BY score DESC, ra, rb) AS place FROM s) WHERE place <= 3""")
def n19(t: Tables):
    q, po = query_pairs(t)
    return RT.top_pair_examples(q, po, nation_prints(t).select(F.col("node").cast("bigint").alias("node"), "bits"), 3)


@query("j13_shared_entity_candidates", "WITH nm AS (SELECT DISTINCT s_nationkey AS n, 'e' || s_suppkey % 17 AS entity FROM supplier)" + PAIRS_SQL + """,
x AS (SELECT DISTINCT qa, qb, entity FROM q JOIN nm ON n = qa OR n = qb), y AS (SELECT DISTINCT ra, rb, entity FROM po JOIN nm ON n = ra OR n = rb)
SELECT DISTINCT qa, qb, ra, rb FROM x JOIN y USING (entity) WHERE ra <> qa AND ra <> qb AND rb <> qa AND rb <> qb""")
def j13(t: Tables):
    q, po = query_pairs(t)
    names = t.supplier.select(F.col("s_nationkey").cast("bigint").alias("node"), F.concat(F.lit("e"), F.pmod("s_suppkey", F.lit(17))).alias("entity")).distinct()
    return RT.shared_entity_candidates(q, po, names)


@query("g02_shared_neighbors", with_parts("edges", "kg") + " SELECT DISTINCT e.a, e.b, x.edge_type, x.entity_id, x.entity_name FROM edges e JOIN (SELECT DISTINCT node, edge_type, entity_id, entity_name FROM kg) x ON x.node = e.a JOIN (SELECT DISTINCT node, edge_type, entity_id FROM kg) y ON y.node = e.b AND y.edge_type = x.edge_type AND y.entity_id = x.entity_id")
def g02(t: Tables):
    return K.shared_neighbours(t.kg(), t.edges())


@query("g03_node_universe", with_parts("kg") + " SELECT DISTINCT node FROM kg")
def g03(t: Tables):
    return K.nodes_of(t.kg(), "node")


@query("p09_edge_type_filter", with_parts("kg") + " SELECT node, edge_type, entity_id, action, CAST(pos AS INTEGER) AS pos FROM kg WHERE edge_type IN ('enzyme', 'carrier')")
def p09(t: Tables):
    return K.neighbours(t.kg(), None, ["enzyme", "carrier"]).select("node", "edge_type", "entity_id", "action", "pos")


TRIPLE_SQL = """v AS (SELECT v, row_number() OVER (ORDER BY is_node, v) - 1 AS n FROM (SELECT 'P' || p_partkey AS v, 0 AS is_node FROM part UNION SELECT 'S' || l_suppkey, 1 FROM lineitem)),
d AS (SELECT DISTINCT 'P' || l_partkey AS h, CAST(l_suppkey % 4 AS INTEGER) AS rel, 'S' || l_suppkey AS t FROM lineitem), tr AS (SELECT CAST(x.n AS INTEGER) AS src, rel, CAST(y.n AS INTEGER) AS dst FROM d JOIN v x ON x.v = h JOIN v y ON y.v = t)"""


def triple_table(t: Tables):
    tr = t.lineitem.select(F.concat(F.lit("P"), "l_partkey").alias("head"), F.pmod("l_suppkey", F.lit(4)).cast("int").alias("rel"), F.concat(F.lit("S"), "l_suppkey").alias("tail"))
    return G.triple_index(tr, t.part.select(F.concat(F.lit("P"), "p_partkey").alias("v")))


@query("g04_triples_dense_index", f"WITH {TRIPLE_SQL} SELECT src, rel, dst FROM tr")
def g04(t: Tables):
    return triple_table(t)


@query("g05_bidirectional_selfloops", f"WITH {TRIPLE_SQL} SELECT src, dst, rel + 4 AS rel FROM tr UNION ALL SELECT dst, src, rel FROM tr UNION ALL SELECT DISTINCT src, src, 8 FROM tr")
def g05(t: Tables):
    tr = triple_table(t)
    return G.bidirectional(tr, 4, tr.select(F.col("src").alias("n")).distinct())


SMALL = "sm AS (SELECT DISTINCT s_nationkey AS src, CAST(s_suppkey % 40 AS INTEGER) + 25 AS dst FROM supplier)"


def small(t: Tables):
    return t.supplier.select(F.col("s_nationkey").cast("bigint").alias("src"), (F.pmod("s_suppkey", F.lit(40)).cast("int") + 25).cast("bigint").alias("dst")).distinct()


#: Every node of the stand-in graph, nations without edges too, and the lengths of all paths among them.
NODES_SQL = "al AS (SELECT src AS n FROM sm UNION SELECT dst FROM sm UNION SELECT n_nationkey FROM nation)"
PATHS_SQL = f"""WITH RECURSIVE {SMALL}, {NODES_SQL}, bo AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM sm UNION SELECT dst, src FROM sm),
r(src, node, dist) USING KEY (src, node) AS (SELECT n::BIGINT, n::BIGINT, 0 FROM al UNION SELECT r.src, bo.dst, r.dist + 1 FROM r JOIN bo ON bo.src = r.node LEFT JOIN recurring.r s ON s.src = r.src AND s.node = bo.dst WHERE s.src IS NULL)"""


def nodes(t: Tables):
    return small(t).select(F.explode(F.array("src", "dst")).alias("n")).union(t.nation.select(F.col("n_nationkey").cast("bigint"))).distinct()


@query("g06_isolated_selfloops", f"WITH {SMALL}, un AS (SELECT n_nationkey AS n FROM nation UNION SELECT p_size + 25 FROM part) SELECT src, dst, 1 AS rel FROM sm UNION ALL SELECT n, n, 0 FROM un WHERE n NOT IN (SELECT src FROM sm UNION SELECT dst FROM sm)")
def g06(t: Tables):
    sizes = t.part.select((F.col("p_size") + 25).cast("bigint").alias("n"))
    return G.isolated_loops(t.nation.select(F.col("n_nationkey").cast("bigint").alias("n")).union(sizes).distinct(), small(t).withColumn("rel", F.lit(1)))


@query("g12_shortest_paths", PATHS_SQL + " SELECT src, node, CAST(dist AS INTEGER) AS dist FROM r")
def g12(t: Tables):
    return G.shortest_paths(small(t), nodes(t))


@query("g13_khop", f"""WITH RECURSIVE {SMALL}, bo AS (SELECT src, dst FROM sm UNION SELECT dst, src FROM sm), fw AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h32('{SEED}:' || src || ':' || dst), dst) AS r FROM bo) WHERE r <= 3),
r AS (SELECT n_nationkey::BIGINT AS src, n_nationkey::BIGINT AS node, 0 AS d FROM nation UNION SELECT r.src, fw.dst, d + 1 FROM r JOIN fw ON fw.src = r.node WHERE d < 2) SELECT DISTINCT src, node FROM r""")
def g13(t: Tables):
    return G.k_hop(small(t), t.nation.select(F.col("n_nationkey").cast("bigint").alias("n")), 2, 3, SEED)


@query("g14_random_walk", f"""WITH RECURSIVE {SMALL}, bo AS (SELECT src, dst FROM sm UNION SELECT dst, src FROM sm), li AS (SELECT src AS node, list_sort(list(dst)) AS nb FROM bo GROUP BY 1),
r AS (SELECT n_nationkey::BIGINT AS start, 0 AS step, n_nationkey::BIGINT AS node FROM nation UNION ALL SELECT r.start, r.step + 1, nb[1 + h32('{SEED}:' || r.start || ':' || (r.step + 1)) % len(nb)] FROM r JOIN li ON li.node = r.node WHERE r.step < 6) SELECT start, step, node FROM r""")
def g14(t: Tables):
    return G.random_walk(small(t), t.nation.select(F.col("n_nationkey").cast("bigint").alias("n")), 6, SEED)


@query("g15_biased_walk")
def g15(t: Tables):
    return G.biased_walk(small(t), t.nation.select(F.col("n_nationkey").cast("bigint").alias("n")), 6, SEED, 0.5, 2.0)


@query("g16_google_row", f"WITH {SMALL}, n AS (SELECT src AS n FROM sm UNION SELECT dst FROM sm), k AS (SELECT count(*) AS total FROM n), dg AS (SELECT src, count(*) AS deg FROM sm GROUP BY 1) SELECT sm.src, sm.dst::BIGINT AS dst, 0.85::DOUBLE / deg + (1 - 0.85::DOUBLE) / total AS p FROM sm JOIN dg ON dg.src = sm.src, k UNION ALL SELECT z.n, NULL, 1 / k.total::DOUBLE FROM n z, k WHERE z.n NOT IN (SELECT src FROM dg)")
def g16(t: Tables):
    e = small(t)
    return G.google_rows(e, e.select(F.explode(F.array("src", "dst")).alias("n")))


@query("g18_message_step", f"WITH {TRIPLE_SQL} SELECT dst AS node, CAST(sum((src % 10) * (rel + 1)) AS BIGINT) AS h FROM tr GROUP BY 1")
def g18(t: Tables):
    tr = triple_table(t)
    state = tr.select(F.col("src").alias("node"), F.pmod("src", F.lit(10)).cast("bigint").alias("h")).distinct()
    gates = t.spark.createDataFrame([(i, i + 1) for i in range(4)], "rel int, gate bigint")
    return G.message_step(tr, state, gates)


NAMES_SQL = "nm AS (SELECT node, edge_type, list(entity_name ORDER BY pos) AS names FROM kg GROUP BY 1, 2)"
CTX_SQL = NAMES_SQL + ", cx AS (SELECT p_partkey AS node" + "".join(f", coalesce((SELECT names[1:3] FROM nm WHERE nm.node = p_partkey AND edge_type = '{k}'), ['unknown']) AS {k}" for k in ("transporter", "target", "enzyme", "carrier")) + " FROM part)"
KINDS = ("transporter", "target", "enzyme", "carrier")


def context(t: Tables):
    return RT.context_map(K.ordered_names(t.kg(by_node=True), "pos"), t.part.select(F.col("p_partkey").alias("node")), KINDS, 3)


@query("a07_ordered_lists", with_parts("kg") + f", {NAMES_SQL} SELECT node, edge_type, names FROM nm")
def a07(t: Tables):
    return K.ordered_names(t.kg(), "pos")


@query("r01_context_map", with_parts("kg") + f", {CTX_SQL} SELECT node, transporter, target, enzyme, carrier FROM cx")
def r01(t: Tables):
    return context(t)


LINE = lambda k: f"CASE WHEN array_to_string({k}, ', ') = 'unknown' THEN 'whose {k[:-1]} is unknown' ELSE 'whose {k} are ' || array_to_string({k}, ', ') END"
SENT = lambda cols: "'Drug A: P' || node || chr(10) || " + " || chr(10) || ".join(LINE(c) for c in cols) + " || '.'"


def one_side(t: Tables):
    ctx = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("A"), F.col(k).alias("B")) for k in KINDS])
    return context(t).withColumn("ctx", ctx).withColumn("name", F.concat(F.lit("P"), "node"))


@query("r07_context_sentence", with_parts("kg") + f", {CTX_SQL} SELECT node, {SENT(KINDS)} AS line FROM cx")
def r07(t: Tables):
    return one_side(t).select("node", R.context_sentence("Drug A: ", F.col("name"), F.col("ctx"), "A").alias("line"))


@query("r08_entity_mask", with_parts("kg") + f", {CTX_SQL} SELECT node, " + ", ".join(
    f"CASE WHEN node % 2 = 0 THEN list_transform({k}, lambda x: CASE WHEN x = 'S' || (node % 50) THEN '[ENTITY]' ELSE x END) ELSE list_transform({k}, lambda x, i: CASE WHEN i = list_position(list_transform({k}, lambda z: z <> 'unknown'), true) THEN '[ENTITY]' ELSE x END) END AS {k}" for k in KINDS) + " FROM cx")
def r08(t: Tables):
    masked = R.mask_entities(F.col("ctx"), F.pmod("node", F.lit(2)) == 0, F.concat(F.lit("S"), F.pmod("node", F.lit(50))))
    return one_side(t).withColumn("m", masked).select("node", *[F.element_at("m", i + 1)["A"].alias(k) for i, k in enumerate(KINDS)])


@query("r06_pair_block", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, '### [Prediction]:' || chr(10) || 'Drug A: P' || l_partkey || chr(10) || 'Drug B: S' || l_suppkey || chr(10) || '### Answer: ' AS block FROM lineitem")
def r06(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", R.pair_block("Zero_Shot", F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")).alias("block"))


_q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("r10_prompt", "SELECT n_nationkey, " + _q("<|im_start|>system\n" + (R.TASK + R.INSTRUCTION).strip() + "<|im_end|>\n\n<|im_start|>user\n" + R.NOTES["zero_shot"] + R.CONSTRAINT + "### [Prediction]:\nDrug A: ") + " || n_name || chr(10) || 'Drug B: R' || n_regionkey || " + _q("\n### Answer:<|im_end|>\n\n<|im_start|>assistant Yes") + " AS prompt FROM nation")
def r10(t: Tables):
    block = R.pair_block("zero_shot", F.col("n_name"), F.concat(F.lit("R"), "n_regionkey"))
    return t.nation.select("n_nationkey", R.prompt("zero_shot", "Qwen2", block, answer=R.answer_of(F.lit(1))).alias("prompt"))


@query("r09_fewshot_block", "WITH x AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS ns FROM nation GROUP BY 1) SELECT n_regionkey, '### Reference Examples (Structural Analogs):' || chr(10) || chr(10) || array_to_string(list_transform(ns, lambda n, i: '### [Example ' || i || ']' || chr(10) || 'Drug A: ' || n || ', SMILES: C' || chr(10) || 'Drug B: ' || lower(n) || ', SMILES: N' || chr(10) || '### Answer: Yes' || chr(10)), chr(10)) || chr(10) AS block FROM x")
def r09(t: Tables):
    e = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name_a"), F.lit("C").alias("smiles_a"), F.lower("n_name").alias("name_b"), F.lit("N").alias("smiles_b"), F.lit("1").alias("label"))
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(e)).alias("e")).select("n_regionkey", R.structure_examples(F.col("e")).alias("block"))


def _chat(template: str) -> str:
    parts = R.CHAT[template]
    arms = " ".join(f"WHEN '{r}' THEN {_q(x)} || coalesce(text, '') || {_q(y)}" for r, (x, y) in parts.items())
    return f"SELECT conv_id, string_agg(CASE role {arms} ELSE '' END, '' ORDER BY turn, role, coalesce(text, '')) AS text FROM conversations GROUP BY 1"


@query("r11_chat_format", _chat("llama"))
def r11(t: Tables):
    return R.format_conversations(t.conversations, "llama")


@query("r11_chat_format_baichuan", _chat("baichuan"))
def r11b(t: Tables):
    return R.format_conversations(t.conversations, "baichuan")


@query("r12_description_priority", "SELECT p_partkey AS node, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand) AS description FROM part")
def r12(t: Tables):
    p = t.part.withColumn("node", F.col("p_partkey"))
    return RT.described(p.select("node"), [p.where("pmod(p_size, 3) = 0").select("node", F.col("p_name").alias("description")), p.where("pmod(p_size, 2) = 0").select("node", F.col("p_type").alias("description")), p.select("node", F.col("p_brand").alias("description"))])


@query("n07_masking_chain", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || ' ' || p_type || ', ' || p_brand, '(?i)\bstandard\b', '[M]', 'g'), '(?i)\b[a-z]+ed\b', '[M]', 'g'), '(\[M\])(\s+\[M\])+', '[M]', 'g'), '(\[M\])(?:\s*[,;]\s*\[M\])+', '[M]', 'g') AS masked FROM part""")
def n07(t: Tables):
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit(", "), "p_brand")
    return t.part.select("p_partkey", S.mask_chain(text, ["standard", "[a-z]+ed"], "[M]").alias("masked"))


@query("n09_occurrence_count", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n FROM documents")
def n09(t: Tables):
    return t.documents.select("doc_id", S.occurrences(F.col("text"), "the").alias("n"))


@query("r04_few_shot_map")
def r04_map(t: Tables):
    """Queries are pairs of a region key and a nation key; some ends have no print, some no entity."""
    q, pool = query_pairs(t)
    own = t.supplier.select(F.col("s_nationkey").cast("bigint").alias("node"), "s_suppkey")
    names = own.select("node", F.concat(F.lit("e"), F.pmod("s_suppkey", F.lit(17))).alias("entity")).distinct()
    return RT.few_shot_map(q, pool, names, nation_prints(t).select(F.col("node").cast("bigint").alias("node"), "bits"), 3, SEED)
