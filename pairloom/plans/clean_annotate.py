"""Queries of cleaning and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import annotate as A
from ..operators import cleaning as C
from ..sources.stage import bounded_broadcast
from .registry import Tables, query, with_parts

POLISHED = "STANDARD POLISHED TIN"
PK_LIST = "[" + ", ".join(f"'{w}'" for w in S.PK_KEYWORDS) + "]"
PD_LIST = "[" + ", ".join(f"'{w}'" for w in S.PD_KEYWORDS) + "]"


@query("p01_type_filter", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def p01(t: Tables):
    least = t.part.agg(F.min("p_type").alias("m"))
    return t.part.join(F.broadcast(least), F.col("p_type") == F.col("m"), "left_semi").select("p_partkey", "p_name", "p_type")


@query("p03_token_regex_filter", r"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(coalesce(text, ''), '(^|[^0-9A-Za-z_])the([^0-9A-Za-z_]|$)')")
def p03(t: Tables):
    return t.documents.where(C.has_token(F.col("text"), "the")).select("doc_id", "n_chars")


@query("p04_endpoint_semi_join", with_parts("edges") + " SELECT a, b FROM edges WHERE a IN (SELECT p_partkey FROM part WHERE p_size >= 10) AND b IN (SELECT p_partkey FROM part WHERE p_size >= 10)")
def p04(t: Tables):
    return C.both_ends_in(t.edges(), t.part.where("p_size >= 10"), "p_partkey", "a", "b")


@query("p12_prune_aux", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey")
def p12(t: Tables):
    return t.lineitem.join(t.part.where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("a01_having_type_floor", "SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 10)")
def a01(t: Tables):
    return C.type_floor(t.part.select("p_partkey", "p_type"), "p_type", 10)


@query("a02_degree_floor_single_pass", with_parts("edges") + """, d AS (SELECT n, count(*) AS c FROM (SELECT a AS n FROM edges UNION ALL SELECT b FROM edges) GROUP BY n HAVING count(*) >= 100)
SELECT a, b FROM edges WHERE a IN (SELECT n FROM d) AND b IN (SELECT n FROM d)""")
def a02(t: Tables):
    return C.degree_floor(t.edges(), 100, "a", "b")


@query("o03_degree_order", with_parts("edges") + """, d AS (SELECT n AS node, count(*) AS degree FROM (SELECT a AS n FROM edges UNION ALL SELECT b FROM edges) GROUP BY n)
SELECT node, degree, CAST(row_number() OVER (ORDER BY degree DESC, node) AS INTEGER) AS place FROM d""")
def o03(t: Tables):
    return C.degree_order(t.edges(), "a", "b")


@query("a03_step_stats", with_parts("typed") + """, k AS (SELECT p_partkey AS n FROM part WHERE p_size >= 10), e1 AS (SELECT * FROM typed WHERE a IN (SELECT n FROM k) AND b IN (SELECT n FROM k))
SELECT 0 AS step, (SELECT count(*) FROM part) AS n_drugs, count(*) AS n_edges, count(DISTINCT ddi_type) AS n_types FROM typed
UNION ALL SELECT 1, (SELECT count(*) FROM k), count(*), count(DISTINCT ddi_type) FROM e1""")
def a03(t: Tables):
    out = None
    for step, keep in ((0, t.part), (1, t.part.where("p_size >= 10"))):
        e = C.both_ends_in(t.typed_edges(), keep, "p_partkey", "a", "b") if step else t.typed_edges()
        n = keep.agg(F.count("*").alias("n_drugs")).withColumn("j", F.lit(1))
        one = e.agg(F.count("*").alias("n_edges"), F.countDistinct("ddi_type").alias("n_types")).withColumn("j", F.lit(1)).join(n, "j").select(F.lit(step).alias("step"), "n_drugs", "n_edges", "n_types")
        out = one if out is None else out.unionAll(one)
    return out


@query("a04_first_description", "SELECT p_type, arg_min(p_name, p_partkey) AS description FROM part WHERE p_name IS NOT NULL GROUP BY p_type")
def a04(t: Tables):
    return C.first_description(t.part.select("p_type", F.col("p_name").alias("description"), "p_partkey"), "p_partkey", "p_type")


@query("w05_first_seen_pair", """SELECT u, e, ts, event_id FROM (SELECT user_id AS u, hash_node AS e, ts, event_id, row_number() OVER (PARTITION BY least(user_id, hash_node), greatest(user_id, hash_node) ORDER BY ts, event_id) AS r
FROM (SELECT *, (event_id * 7 + user_id * 3) % 1000 AS hash_node FROM events)) WHERE r = 1""")
def w05(t: Tables):
    e = t.events.select(F.col("user_id").alias("u"), F.pmod(F.col("event_id") * 7 + F.col("user_id") * 3, F.lit(1000)).alias("e"), "ts", "event_id")
    return C.first_seen_pairs(e, ["ts", "event_id"], "u", "e")


@query("w06_keep_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def w06(t: Tables):
    return C.keep_first(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("n01_normalize_text", r"""SELECT p_partkey, regexp_replace(trim(replace(replace(lower('The ' || p_name || ' of ' || p_brand || ', and ' || p_name || '.'), lower(p_name), ''), lower(p_brand), ''), ' ,;:.'), '\s+', ' ', 'g') AS norm FROM part""")
def n01(t: Tables):
    text = F.concat(F.lit("The "), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(", and "), F.col("p_name"), F.lit("."))
    return t.part.select("p_partkey", F.lower(S.normalize_text(text, F.col("p_name"), F.col("p_brand"))).alias("norm"))


@query("p13_keyword_label", with_parts("typed") + f""", h AS (SELECT DISTINCT ddi_type, list_filter({PK_LIST}, lambda k: contains(lower(ddi_type), k)) AS pk, list_filter({PD_LIST}, lambda k: contains(lower(ddi_type), k)) AS pd FROM typed)
SELECT ddi_type, CASE WHEN len(pk) > 0 AND len(pd) > 0 THEN 'Mixed' WHEN len(pk) > 0 THEN 'PK' WHEN len(pd) > 0 THEN 'PD' ELSE 'Unknown' END AS pk_pd_label,
array_to_string(pk, '; ') AS matched_pk_keywords, array_to_string(pd, '; ') AS matched_pd_keywords FROM h""")
def p13(t: Tables):
    return A.label_types(t.typed_edges())


LABELS_SQL = f"""lab AS (SELECT DISTINCT ddi_type, CASE WHEN len(list_filter({PK_LIST}, lambda k: contains(lower(ddi_type), k))) > 0 THEN CASE WHEN len(list_filter({PD_LIST}, lambda k: contains(lower(ddi_type), k))) > 0
THEN 'Mixed' ELSE 'PK' END WHEN len(list_filter({PD_LIST}, lambda k: contains(lower(ddi_type), k))) > 0 THEN 'PD' ELSE 'Unknown' END AS pk_pd_label FROM typed)"""


@query("j01_label_left_join", with_parts("typed") + f", {LABELS_SQL} SELECT a, b, t.ddi_type, pk_pd_label FROM typed t LEFT JOIN lab USING (ddi_type)")
def j01(t: Tables):
    e = t.typed_edges()
    return e.join(bounded_broadcast(A.label_types(e).select("ddi_type", "pk_pd_label")), "ddi_type", "left").select("a", "b", "ddi_type", "pk_pd_label")


PK_SQL = with_parts("typed", "kg") + """, ty AS (SELECT a, b, ddi_type, CASE WHEN contains(lower(ddi_type), 'metabolism') THEN ['enzyme'] WHEN contains(lower(ddi_type), 'serum concentration') THEN ['enzyme', 'transporter']
  WHEN contains(lower(ddi_type), 'bioavailability') THEN ['enzyme', 'transporter'] WHEN contains(lower(ddi_type), 'excretion') THEN ['transporter'] WHEN contains(lower(ddi_type), 'absorption') THEN ['transporter']
  WHEN contains(lower(ddi_type), 'protein binding') THEN ['carrier'] ELSE ['enzyme', 'transporter'] END AS types FROM typed),
one AS (SELECT a, b, ddi_type, unnest(types) AS edge_type, generate_subscripts(types, 1) AS prio FROM ty),
c AS (SELECT o.a, o.b, o.ddi_type, o.prio, o.edge_type, x.entity_id, x.entity_name AS name_a, x.action AS act_a, y.action AS act_b, x.pos AS pos_a, y.pos AS pos_b
  FROM one o JOIN kg x ON x.node = o.a AND x.edge_type = o.edge_type JOIN kg y ON y.node = o.b AND y.edge_type = o.edge_type AND y.entity_id = x.entity_id
  WHERE (x.action, y.action) IN (('inhibitor', 'substrate'), ('inducer', 'substrate'), ('substrate', 'inhibitor'), ('substrate', 'inducer'), ('inhibitor', 'inhibitor'))),
f AS (SELECT * FROM (SELECT *, min(prio) OVER (PARTITION BY a, b) AS mp FROM c) WHERE prio = mp),
r AS (SELECT node, edge_type, entity_id, min(pos) AS rank FROM kg GROUP BY ALL),
s AS (SELECT f.*, x.rank + y.rank AS rank_sum FROM f JOIN r x ON x.node = f.a AND x.edge_type = f.edge_type AND x.entity_id = f.entity_id JOIN r y ON y.node = f.b AND y.edge_type = f.edge_type AND y.entity_id = f.entity_id),
"""


@query("j10_pk_mediator", PK_SQL + """b AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank_sum, name_a, entity_id, pos_a, pos_b) AS rn, count(*) OVER (PARTITION BY a, b) - 1 AS n_candidates FROM s)
SELECT a, b, ddi_type, entity_id AS key_entity_id, name_a AS key_entity_name, edge_type AS key_entity_type, act_a AS action_a, act_b AS action_b,
CASE WHEN act_b = 'substrate' THEN act_a || '-substrate' WHEN act_a = 'substrate' THEN act_b || '-substrate' ELSE act_a || '-' || act_b END AS match_pattern, CAST(rank_sum AS INTEGER) AS rank_sum, n_candidates FROM b WHERE rn = 1""")
def j10(t: Tables):
    return A.pk_mediators(t.meetings(), t.kg(), made=t.type_text(), distinct=True)


@query("w03_priority_short_circuit", PK_SQL + "z AS (SELECT 1) SELECT a, b, min(edge_type) AS edge_type, count(*) AS n FROM s GROUP BY a, b")
def w03(t: Tables):
    m = A.pk_mediators(t.meetings(), t.kg(), made=t.type_text(), distinct=True)
    return m.select("a", "b", F.col("key_entity_type").alias("edge_type"), (F.col("n_candidates") + 1).alias("n"))


PD_ACTIONS = ("inhibitor", "antagonist", "modulator")
_rel = "CASE " + " ".join(
    f"WHEN contains(lower(ddi_type), '{d}') AND contains(lower(first_name), '{w}') THEN {i}" for d, ws in A.PD_TARGET_WORDS for i, w in enumerate(ws)
) + f" ELSE {A.NO_RELEVANCE} END"
_pairs = lambda ps: "(" + ", ".join(f"('{x}', '{y}')" for x, y in ps) + ")"


@query("j11_pd_mediator", with_parts("typed", "kg", actions=PD_ACTIONS) + f""", k AS (SELECT * FROM kg WHERE edge_type = 'target'),
c AS (SELECT e.a, e.b, e.ddi_type, x.entity_id, x.action AS act_a, y.action AS act_b, x.pos AS pos_a, y.pos AS pos_b,
  CASE WHEN (x.action, y.action) IN {_pairs(A.PD_HIGH)} THEN 'high' WHEN (x.action, y.action) IN {_pairs(A.PD_LOW)} THEN 'low' END AS confidence
  FROM typed e JOIN k x ON x.node = e.a JOIN k y ON y.node = e.b AND y.entity_id = x.entity_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b, entity_id ORDER BY confidence <> 'high', pos_a, pos_b) AS e FROM c WHERE confidence IS NOT NULL) WHERE e = 1),
r AS (SELECT node, entity_id, min(pos) AS rank, arg_min(entity_name, pos) AS first_name FROM k GROUP BY ALL),
s AS (SELECT p.*, x.rank + y.rank AS rank_sum, x.first_name FROM p JOIN r x ON x.node = a AND x.entity_id = p.entity_id JOIN r y ON y.node = b AND y.entity_id = p.entity_id),
v AS (SELECT *, {_rel} AS relevance FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY confidence <> 'high', relevance, rank_sum, first_name, entity_id) AS rn, count(*) OVER (PARTITION BY a, b) - 1 AS n_candidates FROM v)
SELECT a, b, ddi_type, entity_id AS key_entity_id, first_name AS key_entity_name, 'target' AS key_entity_type, act_a AS action_a, act_b AS action_b, confidence,
CASE WHEN act_a = act_b OR confidence = 'high' THEN 'convergent' ELSE 'opposing' END AS chain_type, relevance, CAST(rank_sum AS INTEGER) AS rank_sum, n_candidates FROM b WHERE rn = 1""")
def j11(t: Tables):
    return A.pd_mediators(t.meetings(), t.kg(PD_ACTIONS), made=t.type_text(), distinct=True)


@query("w04_first_occurrence_rank", with_parts("kg") + " SELECT node, edge_type, entity_id, CAST(min(pos) AS INTEGER) AS rank FROM kg GROUP BY ALL")
def w04(t: Tables):
    return A.entity_ranks(t.kg())


@query("w13_ordered_keyword_rank", "WITH v AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'risk of bleeding' WHEN 'click' THEN 'hypotension and sedation' ELSE 'tachycardia' END AS ddi_type, "
       f"CASE WHEN event_id % 3 = 0 THEN 'Platelet factor' WHEN event_id % 3 = 1 THEN 'GABA receptor alpha' ELSE 'Thyroid' END AS first_name FROM events) SELECT event_id, {_rel} AS relevance FROM v")
def w13(t: Tables):
    kind = F.when(F.col("event_type") == "view", "risk of bleeding").when(F.col("event_type") == "click", "hypotension and sedation").otherwise("tachycardia")
    third = F.pmod("event_id", F.lit(3))
    name = F.when(third == 0, "Platelet factor").when(third == 1, "GABA receptor alpha").otherwise("Thyroid")
    return t.events.select("event_id", A.pd_relevance(kind, name).alias("relevance"))


@query("a05_type_coverage", "SELECT p_type, arg_min(p_brand, p_partkey) AS pk_pd_label, count(*) AS n_pairs, CAST(sum(CAST(p_size > 25 AS BIGINT)) AS BIGINT) AS n_with_key_entity, round_even(100.0::DOUBLE * sum(CAST(p_size > 25 AS BIGINT)) / count(*), 1) AS coverage_pct FROM part GROUP BY p_type")
def a05(t: Tables):
    p = t.part.select("p_type", F.col("p_brand").alias("pk_pd_label"), (F.col("p_size") > 25).alias("has_key_entity"), F.col("p_partkey").alias("ord"))
    return A.type_coverage(p, "p_type")


@query("a06_top3_list", """SELECT p_type, string_agg(p_brand || '(' || n || ')', '; ' ORDER BY r) AS top3_key_entities FROM (SELECT p_type, p_brand, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE r <= 3 GROUP BY p_type""")
def a06(t: Tables):
    return A.top_names(t.part, "p_type", "p_brand")


@query("p08_type_a_projection", "SELECT l_orderkey AS drug_a_id, l_partkey AS drug_b_id, l_linestatus AS pk_pd_label, l_suppkey AS entity_id, 'S' || l_suppkey AS entity_name, l_returnflag AS entity_type FROM lineitem WHERE l_returnflag = 'R'")
def p08(t: Tables):
    flag = F.col("l_returnflag")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("drug_a_id"), F.col("l_partkey").alias("drug_b_id"), F.col("l_linestatus").alias("pk_pd_label"), F.col("l_suppkey").alias("key_entity_id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("key_entity_name"), flag.alias("key_entity_type"), (flag == "R").alias("has_key_entity"),
        *[F.lit("").alias(c) for c in ("action_drug_a", "action_drug_b", "match_pattern", "mechanism_chain", "chain_type", "confidence")],
    )
    return A.type_a_tables(rows)[0]


@query("p10_threshold", "SELECT l_orderkey, l_linenumber, l_suppkey, l_discount AS predicted_prob, CAST(l_discount >= 0.05 AS INTEGER) AS predicted_label FROM lineitem")
def p10(t: Tables):
    from ..operators.scoring import predictions

    return predictions(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_discount").alias("predicted_prob")), 0.05)


@query("p14_pk_first_label", f"WITH h AS (SELECT event_id, replace(event_type || ' metabolism', 'view metabolism', 'risk') AS x FROM events) SELECT event_id, CASE WHEN len(list_filter({PK_LIST}, lambda k: contains(lower(x), k))) > 0 THEN 'PK' WHEN len(list_filter({PD_LIST}, lambda k: contains(lower(x), k))) > 0 THEN 'PD' ELSE 'Unknown' END AS label FROM h")
def p14(t: Tables):
    x = F.replace(F.concat("event_type", F.lit(" metabolism")), F.lit("view metabolism"), F.lit("risk"))
    return t.events.select("event_id", S.pk_first_label(S.keyword_hits(x, S.PK_KEYWORDS), S.keyword_hits(x, S.PD_KEYWORDS)).alias("label"))


@query("p15_ab_from_name", "SELECT event_id, CASE WHEN trim(CASE WHEN event_id % 4 = 0 THEN '  ' ELSE event_type END) = '' THEN 'B' ELSE 'A' END AS ab FROM events")
def p15(t: Tables):
    name = F.when(F.pmod("event_id", F.lit(4)) == 0, "  ").otherwise(F.col("event_type"))
    return t.events.select("event_id", S.ab_from_name(name).alias("ab"))


@query("n15_full_stop", r"SELECT doc_id, CASE WHEN trim(text) = '' THEN '' WHEN right(trim(text), 1) IN ('.', '!', '?') THEN md5(trim(text)) ELSE md5(trim(text) || '.') END AS h FROM documents")
def n15(t: Tables):
    x = S.with_full_stop(F.col("text"))
    return t.documents.select("doc_id", F.when(x == "", "").otherwise(F.md5(x.cast("binary"))).alias("h"))


@query("n10_slug", "SELECT page_id, lower(replace(replace(url, '/', '__'), '.', '-')) AS slug FROM pages")
def n10(t: Tables):
    return t.pages.select("page_id", S.slug(F.col("url")).alias("slug"))


@query("n11_short_slug", r"SELECT page_id, right(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), 60) AS slug FROM pages")
def n11(t: Tables):
    return t.pages.select("page_id", S.short_slug(F.col("url")).alias("slug"))


@query("n12_capture", r"SELECT page_id, regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) AS captured FROM pages")
def n12(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("url", "/([a-z]+)/([0-9]+)", 2).alias("captured"))


@query("n17_text_to_bool", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE NULL END AS flag FROM events")
def n17(t: Tables):
    k = F.pmod("event_id", F.lit(5))
    text = F.when(k == 0, "True").when(k == 1, " FALSE ").when(k == 2, "1").when(k == 3, "")
    return t.events.select("event_id", S.text_to_bool(text).alias("flag"))
