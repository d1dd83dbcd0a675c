"""Queries of folds, samples, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import diagnostics as D
from ..operators import folds as FO
from ..operators import kg as K
from ..operators import published as PU
from ..operators import sampling as X
from ..operators import validate as V
from .registry import SEED, Tables, query, with_parts


@query("x01_group_partition", with_parts("groups") + " SELECT node, grp FROM groups")
def x01(t: Tables):
    return t.groups()


@query("x02_legacy_partition", f"WITH ids AS (SELECT DISTINCT p_partkey AS node FROM part) SELECT node, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:group:' || node), node) <= (SELECT greatest(1, floor(floor(count(*) / 1.5))) FROM ids) THEN 'G1' ELSE 'G2' END AS grp FROM ids")
def x02(t: Tables):
    return FO.node_groups(t.part.select(F.col("p_partkey").alias("node")), SEED, protocol=FO.resolve_protocol("legacy"))


@query("x03_fold_assignment_s0", with_parts("folds") + " SELECT a, b, split FROM folds WHERE n_g2 = 0")
def x03(t: Tables):
    return t.folds().where("n_g2 = 0").select("a", "b", "split")


@query("x04_fold_assignment_s1_s2", with_parts("folds") + " SELECT a, b, split FROM folds WHERE n_g2 > 0")
def x04(t: Tables):
    return t.folds().where("n_g2 > 0").select("a", "b", "split")


@query("x01_published_groups")
def x01_published(t: Tables):
    return PU.published_groups(t.part.select(F.col("p_partkey").alias("node")), SEED)


@query("x03_published_folds")
def x03_published(t: Tables):
    groups = PU.published_groups(t.part.select(F.col("p_partkey").alias("node")), SEED)
    return PU.published_fair_folds(t.edges(), groups, SEED, ["a", "b"]).select("a", "b", "n_g2", "split")


@query("p05_endpoint_classes", with_parts("folds") + " SELECT n_g2, count(*) AS n FROM folds GROUP BY n_g2")
def p05(t: Tables):
    return FO.edge_class(t.edges(), t.groups()).groupBy("n_g2").agg(F.count("*").alias("n"))


ANCHORS = with_parts("edges", "groups") + f""", classed AS (SELECT a, b, CAST(x.grp = 'G2' AS INTEGER) + CAST(y.grp = 'G2' AS INTEGER) AS n_g2 FROM edges JOIN groups x ON x.node = a JOIN groups y ON y.node = b),
keyed AS (SELECT a, b, md5('{SEED}:anchor:' || a || ':' || b) AS o FROM classed WHERE n_g2 = 0),
firsts AS (SELECT min(o) AS o FROM (SELECT a AS n, o FROM keyed UNION ALL SELECT b, o FROM keyed) GROUP BY n),
anch AS (SELECT a, b FROM keyed WHERE o IN (SELECT o FROM firsts))"""


@query("x05_coverage_anchors", ANCHORS + " SELECT a, b FROM anch")
def x05(t: Tables):
    return FO.coverage_anchors(FO.edge_class(t.edges(), t.groups()).where("n_g2 = 0"), SEED).select("a", "b")


@query("x06_legacy_folds", ANCHORS + f""", k AS (SELECT c.a, c.b, c.n_g2, CASE WHEN x.a IS NOT NULL THEN 1 ELSE 0 END AS anchor FROM classed c LEFT JOIN anch x ON x.a = c.a AND x.b = c.b),
p AS (SELECT *, row_number() OVER (PARTITION BY n_g2 ORDER BY 1 - anchor, md5(({SEED} + CASE n_g2 WHEN 0 THEN 17 WHEN 1 THEN 29 ELSE 31 END) || ':edge:' || a || ':' || b), a, b) AS place, count(*) OVER (PARTITION BY n_g2) AS n, sum(anchor) OVER (PARTITION BY n_g2) AS ka FROM k),
q AS (SELECT *, greatest(ka, floor(n * 0.8)) AS tr FROM p)
SELECT a, b, CASE WHEN n_g2 = 0 THEN CASE WHEN place <= tr THEN 'train' WHEN place <= tr + floor((n - tr) * 0.1) THEN 'val_s0' ELSE 'test_s0' END ELSE CASE WHEN place <= floor(n * 0.1) THEN 'val_s' ELSE 'test_s' END || n_g2 END AS split FROM q""")
def x06(t: Tables):
    return FO.legacy_folds(t.edges(), t.groups(), SEED).select("a", "b", "split")


def _draws(pool_a: str, pool_b: str, n: str, seed: str, extra: str = "") -> str:
    """SQL of the pair sampler; pools are (idx, node) views."""
    return f"""(SELECT a, b FROM (SELECT least(u.node, v.node) AS a, greatest(u.node, v.node) AS b, min(i) AS i FROM
 (SELECT i, h32({seed} || ':a:' || i) % (SELECT count(*) FROM {pool_a}) AS x, h32({seed} || ':b:' || i) % (SELECT count(*) FROM {pool_b}) AS y FROM range(3 * ({n}) + 1000) r(i)) d
 JOIN {pool_a} u ON u.idx = x JOIN {pool_b} v ON v.idx = y WHERE u.node <> v.node GROUP BY 1, 2) f WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = f.a AND e.b = f.b) ORDER BY i LIMIT ({n}))"""


POOLS = ", g1 AS (SELECT row_number() OVER (ORDER BY node) - 1 AS idx, node FROM groups WHERE grp = 'G1'), g2 AS (SELECT row_number() OVER (ORDER BY node) - 1 AS idx, node FROM groups WHERE grp = 'G2'), ga AS (SELECT row_number() OVER (ORDER BY node) - 1 AS idx, node FROM groups)"


@query("x08_negative_sample", with_parts("edges", "groups") + POOLS + f" SELECT a, b FROM {_draws('ga', 'ga', '1000', repr(str(SEED)))}")
def x08(t: Tables):
    pool = X.indexed_pool(t.part.select(F.col("p_partkey").alias("node")))
    return X.draw_pairs(t.spark, pool, pool, t.edges(), 1000, SEED)


_static = " UNION ALL ".join(
    f"SELECT '{s}' AS split, a, b FROM {_draws(p, q, f'SELECT count(*) FROM folds WHERE split = ' + repr(s), repr(str(SEED + FO.NEGATIVE_OFFSETS[s])))}"
    for s, (p, q) in {"test_s0": ("g1", "g1"), "val_s0": ("g1", "g1"), "test_s1": ("g1", "g2"), "val_s1": ("g1", "g2"), "test_s2": ("g2", "g2"), "val_s2": ("g2", "g2")}.items()
)


@query("x09_static_negatives", with_parts("folds") + POOLS + " " + _static)
def x09(t: Tables):
    return X.static_negatives(t.spark, t.folds(), t.groups(), SEED)


@query("x10_epoch_negatives", with_parts("edges", "groups") + POOLS + " " + " UNION ALL ".join(f"SELECT {e} AS epoch, a, b FROM {_draws('ga', 'ga', '(SELECT count(*) FROM customer)', repr(str(SEED + 1000 + e)))}" for e in range(2)))
def x10(t: Tables):
    pool = X.indexed_pool(t.part.select(F.col("p_partkey").alias("node")))
    return X.epoch_negatives(t.spark, t.customer, pool, t.edges(), SEED, 2)


@query("x12_induced_subset", with_parts("edges") + f", k AS (SELECT node FROM (SELECT DISTINCT p_partkey AS node FROM part) ORDER BY md5('{SEED}:subset:' || node), node LIMIT 200) SELECT a, b FROM edges WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
def x12(t: Tables):
    return X.induced_subset(t.part.select(F.col("p_partkey").alias("node")), t.edges, 200, SEED)[1]


@query("x13_stratified_sample", f"SELECT p_partkey, p_type, CAST(place AS INTEGER) AS place FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5('{SEED}:stratum:' || p_partkey), p_partkey) AS place FROM part) WHERE place <= 10")
def x13(t: Tables):
    return X.stratified(t.part.select("p_partkey", "p_type"), "p_type", "p_partkey", 10, SEED)


@query("x15_full_shuffle", f"SELECT p_partkey, row_number() OVER (ORDER BY md5('{SEED}:shuffle:' || p_partkey), p_partkey) AS place FROM part")
def x15(t: Tables):
    return X.shuffled(t.part.select("p_partkey"), "p_partkey", SEED)


NB = "nb AS (SELECT l_partkey AS node, list_sort(list(DISTINCT l_suppkey)) AS al FROM lineitem GROUP BY 1)"


@query("x16_neighbor_sample", f"""WITH {NB}, o AS (SELECT node, al, list_transform(list_sort(list_transform(al, lambda v: {{'h': md5('{SEED}:' || node || ':' || v), 'v': v}})), lambda s: s.v) AS ord FROM nb)
SELECT node, CAST(i AS INTEGER) AS i, CASE WHEN len(al) >= 5 THEN ord[i + 1] ELSE al[1 + h32('{SEED}:' || node || ':' || i) % len(al)] END AS other FROM o, range(5) r(i)""")
def x16(t: Tables):
    return X.neighbour_sample(t.lineitem.select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("other")), 5, SEED)


@query("w09_balanced_cap", "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) WHERE r <= 50")
def w09(t: Tables):
    return X.balanced_cap(t.labels.select("doc_id", "quality"), "quality", ["doc_id"], 100)


@query("u01_long_kg_union", "SELECT 'enzyme' AS edge_type, l_partkey AS drugbank_id, l_suppkey AS entity_id, l_returnflag AS entity_name, '' AS organism, l_linestatus AS action FROM lineitem UNION ALL SELECT 'pathway', o_orderkey, o_custkey, o_orderpriority, '', '' FROM orders")
def u01(t: Tables):
    enz = t.lineitem.select(F.col("l_partkey").alias("drugbank_id"), F.col("l_suppkey").alias("enzyme_id"), F.col("l_returnflag").alias("enzyme_name"), F.col("l_linestatus").alias("action"))
    path = t.orders.select(F.col("o_orderkey").alias("drugbank_id"), F.col("o_custkey").alias("pathway_id"), F.col("o_orderpriority").alias("pathway_name"))
    return K.long_view({"enzyme": enz, "pathway": path})


@query("u02_label_union", "SELECT doc_id, 1 AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE quality = 0")
def u02(t: Tables):
    return t.labels.where("quality = 1").select("doc_id", F.lit(1).alias("label")).unionByName(t.labels.where("quality = 0").select("doc_id", F.lit(0).alias("label")))


@query("u03_priority_union", "SELECT a, b, max(label) AS label FROM (SELECT l_partkey AS a, l_suppkey AS b, 1 AS label FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_suppkey, 0 FROM lineitem WHERE l_returnflag <> 'R') GROUP BY a, b")
def u03(t: Tables):
    p = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    return D.priority_union(p.where("l_returnflag = 'R'"), p.where("l_returnflag <> 'R'"))


@query("u05_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u05(t: Tables):
    k = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return k("R").intersect(k("A"))


@query("u06_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def u06(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.customer.where("c_nationkey < 10").select("c_custkey"))


@query("u07_symmetric_closure", with_parts("edges") + " SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges")
def u07(t: Tables):
    e = t.edges()
    return e.union(e.select("b", "a"))


@query("u08_cover_check", with_parts("folds") + " SELECT (SELECT count(*) FROM (SELECT a, b FROM edges EXCEPT SELECT a, b FROM folds)) AS missing, (SELECT count(*) FROM (SELECT a, b FROM folds EXCEPT SELECT a, b FROM edges)) AS extra")
def u08(t: Tables):
    e, f = t.edges(), t.folds().select("a", "b")
    one = lambda x, y, n: x.subtract(y).agg(F.count("*").alias(n)).withColumn("j", F.lit(1))
    return one(e, f, "missing").join(one(f, e, "extra"), "j").drop("j")


@query("j03_full_outer_counts", "SELECT coalesce(x.k, y.k) AS k, coalesce(nx, 0) AS n_orders, coalesce(ny, 0) AS n_customers FROM (SELECT o_custkey AS k, count(*) AS nx FROM orders GROUP BY 1) x FULL JOIN (SELECT c_custkey AS k, count(*) AS ny FROM customer GROUP BY 1) y ON x.k = y.k")
def j03(t: Tables):
    x = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("nx"))
    y = t.customer.groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("ny"))
    return x.join(y, "k", "full").select("k", F.coalesce("nx", F.lit(0)).alias("n_orders"), F.coalesce("ny", F.lit(0)).alias("n_customers"))


@query("j04_validated_left_join", "SELECT l.doc_id, l.quality, d.n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def j04(t: Tables):
    return t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "n_chars"), "doc_id", "left")


@query("j06_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j06(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("j07_reverse_fallback", with_parts("edges") + """, pr AS (SELECT CASE WHEN (a + b) % 2 = 0 THEN a ELSE b END AS a, CASE WHEN (a + b) % 2 = 0 THEN b ELSE a END AS b, unit('R0:' || a || ':' || b) AS p FROM edges WHERE (a * 3 + b) % 10 <> 0)
SELECT e.a, e.b, coalesce(x.p, y.p) AS s, x.p IS NOT NULL OR y.p IS NOT NULL AS s_found FROM edges e LEFT JOIN pr x ON x.a = e.a AND x.b = e.b LEFT JOIN pr y ON y.a = e.b AND y.b = e.a""")
def j07(t: Tables):
    e = t.edges()
    even = F.pmod(F.col("a") + F.col("b"), F.lit(2)) == 0
    pr = e.where("pmod(a * 3 + b, 10) <> 0").select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("b"), S.unit("R0", F.col("a"), F.col("b")).alias("p"))
    return D.with_score(e, pr, "s")


@query("j08_orientation_swap", with_parts("edges") + ", o AS (SELECT l_partkey AS pa, l_suppkey AS pb, min(l_returnflag) AS fa, min(l_linestatus) AS fb FROM lineitem GROUP BY 1, 2) SELECT e.a, e.b, CASE WHEN o.pa = e.a THEN fa ELSE fb END AS act_a, CASE WHEN o.pa = e.a THEN fb ELSE fa END AS act_b FROM edges e JOIN o ON least(o.pa, o.pb) = e.a AND greatest(o.pa, o.pb) = e.b")
def j08(t: Tables):
    o = t.lineitem.groupBy(F.col("l_partkey").alias("pa"), F.col("l_suppkey").alias("pb")).agg(F.min("l_returnflag").alias("fa"), F.min("l_linestatus").alias("fb"))
    o = o.withColumn("a", F.least("pa", "pb")).withColumn("b", F.greatest("pa", "pb"))
    own = F.col("pa") == F.col("a")
    return t.edges().join(o, ["a", "b"]).select("a", "b", F.when(own, F.col("fa")).otherwise(F.col("fb")).alias("act_a"), F.when(own, F.col("fb")).otherwise(F.col("fa")).alias("act_b"))


@query("j09_ci_name_join", "WITH n AS (SELECT lower(p_brand) AS k, arg_max(p_partkey, p_partkey) AS id FROM part GROUP BY 1) SELECT p_partkey, id FROM part JOIN n ON k = lower(upper(p_brand))")
def j09(t: Tables):
    n = t.part.groupBy(F.lower("p_brand").alias("k")).agg(F.max_by("p_partkey", "p_partkey").alias("id"))
    return t.part.withColumn("k", F.lower(F.upper("p_brand"))).join(n, "k").select("p_partkey", "id")


@query("j17_dimension_lookup", "SELECT s_suppkey, coalesce(n_name, '') AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j17(t: Tables):
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("j18_complete_bipartite", "SELECT r_regionkey AS src, n_nationkey AS dst FROM region, nation")
def j18(t: Tables):
    left, right = t.region.agg(F.collect_set("r_regionkey").alias("x")).withColumn("j", F.lit(1)), t.nation.agg(F.collect_set("n_nationkey").alias("y")).withColumn("j", F.lit(1))
    return left.join(right, "j").select(F.explode("x").alias("src"), "y").select("src", F.explode("y").alias("dst"))


@query("q02_pair_key_audit", "SELECT count(*) AS n, 0::BIGINT AS n_null, 0::BIGINT AS n_blank, 0::BIGINT AS n_untrimmed, CAST(count(*) FILTER (l_partkey = l_suppkey) AS BIGINT) AS n_self, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT least(l_partkey::VARCHAR, l_suppkey::VARCHAR), greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR) FROM lineitem)) AS BIGINT) AS n_duplicate FROM lineitem")
def q02(t: Tables):
    return V.pair_key_audit(t.lineitem, "l_partkey", "l_suppkey")


@query("q03_partition_audit", with_parts("folds") + " SELECT split, count(*) AS n, CAST(count(*) FILTER (n_g2 = 0) AS BIGINT) AS n_g2_0, CAST(count(*) FILTER (n_g2 = 1) AS BIGINT) AS n_g2_1, CAST(count(*) FILTER (n_g2 = 2) AS BIGINT) AS n_g2_2 FROM folds GROUP BY split")
def q03(t: Tables):
    return V.partition_audit(t.folds().select("a", "b", "split"), t.groups())


@query("q04_fold_overlap", "WITH p AS (SELECT DISTINCT 'f' || l_linenumber AS split, l_partkey AS lo, l_suppkey + 100000000 AS hi FROM lineitem) SELECT x.split AS split_x, y.split AS split_y, count(*) AS n FROM p x JOIN p y ON x.lo = y.lo AND x.hi = y.hi AND x.split < y.split GROUP BY 1, 2")
def q04(t: Tables):
    return V.fold_overlap(t.lineitem.select(F.concat(F.lit("f"), F.col("l_linenumber")).alias("split"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100000000).alias("b")))


@query("q05_prediction_coverage", with_parts("edges") + ", pr AS (SELECT a, b, CASE WHEN (a + b) % 7 = 0 THEN 1.5 ELSE 0.5 END AS p FROM edges WHERE (a * 3 + b) % 10 <> 0) SELECT count(*) AS n_wanted, count(*) FILTER (x.p IS NULL) AS n_missing, 0::BIGINT AS n_unexpected, 0::BIGINT AS n_duplicate, 0::BIGINT AS n_not_finite, count(*) FILTER (x.p > 1) AS n_out_of_range FROM edges e LEFT JOIN pr x ON x.a = e.a AND x.b = e.b")
def q05(t: Tables):
    e = t.edges()
    pr = e.where("pmod(a * 3 + b, 10) <> 0").select("a", "b", F.when(F.pmod(F.col("a") + F.col("b"), F.lit(7)) == 0, 1.5).otherwise(0.5).alias("p"))
    return V.prediction_audit(e, pr)


@query("q06_kg_audit", "SELECT count(*) AS n, 0::BIGINT AS n_null, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) AS n_unknown FROM orders")
def q06(t: Tables):
    return V.kg_audit(t.orders, t.customer.where("c_nationkey < 20"), "o_custkey", "c_custkey")


@query("n26_fingerprint", "SELECT o_orderstatus, CAST(sum(h32(o_orderkey || '|' || o_custkey || '|' || o_orderpriority)) AS BIGINT) AS digest, count(*) AS n FROM orders GROUP BY 1")
def n26(t: Tables):
    return V.fingerprint(t.orders, ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderstatus"])
