"""Queries of diagnostics and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.numbering import range_numbered
from ..operators import diagnostics as D
from ..operators import metrics as M
from ..sources.stage import staged
from .registry import Tables, query, with_parts

R9 = lambda c: F.round(c, 9)

TRIPLES = with_parts("labelled") + """, base AS (SELECT a, b, arg_min(label, prio) AS label FROM (SELECT a, b, label, 0 AS prio FROM labelled WHERE split = 'test_s2' UNION ALL SELECT b, a, label, 1 FROM labelled WHERE split = 'test_s2') GROUP BY 1, 2),
pl AS (SELECT a, b, label FROM labelled WHERE split IN ('test_s1', 'test_s2')), po AS (SELECT DISTINCT up, b, label AS lup FROM (SELECT a AS up, b, label FROM pl UNION ALL SELECT b, a, label FROM pl)),
tri AS (SELECT DISTINCT base.a AS qa, base.b AS qb, up AS qa_prime, base.label AS label_uv FROM base JOIN po ON po.b = base.b JOIN groups x ON x.node = base.a JOIN groups y ON y.node = up AND x.grp = y.grp WHERE label <> lup AND up <> base.a AND up <> base.b)"""
BUCKETS = """, tb AS (SELECT qa, qb, qa_prime, label_uv AS label, ['PK-A', 'PK-B', 'PD-A', 'PD-B', 'Other'][1 + (qa + qb) % 5] AS bucket FROM tri)"""
#: universe keys directed as (low, high); one key in eleven has no prediction
PREDS = """, uni AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT qa AS a, qb AS b FROM tri UNION ALL SELECT qa_prime, qb FROM tri)),
pr AS (SELECT a, b, unit('R0:' || a || ':' || b) AS r0, unit('R1:' || a || ':' || b) AS r1, unit('R2:' || a || ':' || b) AS r2, unit('R3:' || a || ':' || b) AS r3 FROM uni WHERE (a * 5 + b) % 11 <> 0)"""
BASE = """, bp AS (SELECT qa AS a, qb AS b, min(bucket) AS bucket, min(label) AS label FROM tb GROUP BY 1, 2), sc AS (SELECT bp.*, r0, r1, r2, r3 FROM bp JOIN pr ON pr.a = least(bp.a, bp.b) AND pr.b = greatest(bp.a, bp.b))"""
SUMMARY = """SELECT indicator, bucket, round(avg(delta), 9) AS value, round(coalesce(stddev_samp(delta), 0), 9) AS std, count(*) AS n FROM
 (SELECT indicator, bucket, delta FROM dl WHERE bucket <> 'Other' UNION ALL SELECT indicator, 'ALL', delta FROM dl WHERE label = 1) GROUP BY 1, 2"""
CHANNELS = ", dl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS indicator, bucket, label, abs({x.lower()} - {y.lower()}) AS delta FROM sc" for n, x, y in D.CHANNELS) + ")"


def swap_sources(t: Tables):
    """Source and pool of the swaps.  Both ends of a test_s2 pair are in G2, and so is whatever replaces one and meets the
    other; so no pair of test_s1, which the pool also holds, makes a triple, and pairs within G2 alone are made."""
    lab = staged(t.labelled(2).where("split = 'test_s2'").select("a", "b", "label", F.lit(0).alias("prio")), "labelled")
    return lab, lab


def pair_bucket(a, b):
    names = F.array(*map(F.lit, (*D.PRIMARY, "Other")))
    return F.element_at(names, (F.pmod(a + b, F.lit(5)) + 1).cast("int"))


def triples(t: Tables):
    return D.swap_triples(*swap_sources(t), t.groups())


def swapped(t: Tables, src, pool):
    """Keys that have a part in triples, written once; no triple is made."""
    return staged(D.swap_numbers(D.swap_ends(src, pool, t.groups())).where("n > 0"), "swapped")


def bucketed(keys):
    """Base pairs with a bucket: each stands for all of its triples."""
    return keys.where("replaced").select(F.col("node").alias("qa"), F.col("b").alias("qb"), "label", pair_bucket(F.col("node"), F.col("b")).alias("bucket"))


def preds(keys, conds=("R0", "R1", "R2", "R3")):
    uni = keys.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    kept = uni.where("pmod(a * 5 + b, 11) <> 0")
    return kept.withColumn("cond", F.explode(F.array(*map(F.lit, conds)))).withColumn("p", S.unit(F.col("cond"), F.col("a"), F.col("b")))


def rounded(df):
    return df.select("indicator", "bucket", R9("value").alias("value"), R9("std").alias("std"), "n")


@query("j12_swap_triples", TRIPLES + " SELECT qa, qb, qa_prime, label_uv FROM tri")
def j12(t: Tables):
    return triples(t)


@query("d01_buckets", "SELECT event_id, CASE WHEN event_type IN ('PK', 'PD') THEN event_type || CASE WHEN value > 50 THEN '-A' ELSE '-B' END ELSE 'Other' END AS bucket FROM (SELECT event_id, value, CASE event_type WHEN 'view' THEN 'PK' WHEN 'click' THEN 'PD' ELSE 'Mixed' END AS event_type FROM events)")
def d01(t: Tables):
    label = F.when(F.col("event_type") == "view", "PK").when(F.col("event_type") == "click", "PD").otherwise("Mixed")
    return t.events.select("event_id", D.bucket_of(label, F.col("value") > 50).alias("bucket"))


@query("d03_kps_f", TRIPLES + BUCKETS + PREDS + """, dl AS (SELECT 'KPS-F' AS indicator, bucket, label, abs(x.r0 - y.r0) AS delta FROM tb JOIN pr x ON x.a = least(qa, qb) AND x.b = greatest(qa, qb) JOIN pr y ON y.a = least(qa_prime, qb) AND y.b = greatest(qa_prime, qb)) """ + SUMMARY)
def d03(t: Tables):
    src, pool = swap_sources(t)
    pairs = src.unionByName(pool).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().where("pmod(a * 5 + b, 11) <> 0")
    scores = pairs.withColumn("cond", F.lit("R0")).withColumn("p", S.unit(F.col("cond"), F.col("a"), F.col("b")))
    return rounded(D.swap_sensitivity(src, pool, t.groups(), scores, pair_bucket))


@query("d04_channel_deltas", TRIPLES + BUCKETS + PREDS + BASE + CHANNELS + " " + SUMMARY)
def d04(t: Tables):
    keys = swapped(t, *swap_sources(t))
    return rounded(D.channel_deltas(bucketed(keys), preds(keys)))


@query("d05_ksai", TRIPLES + BUCKETS + PREDS + BASE + ", dl AS (SELECT 'KSAI' AS indicator, bucket, label, abs(r1 - r3) - abs(r0 - r2) AS delta FROM sc) " + SUMMARY)
def d05(t: Tables):
    keys = swapped(t, *swap_sources(t))
    return rounded(D.ksai(bucketed(keys), preds(keys)))


@query("d06_missing_condition_rows", TRIPLES + BUCKETS + PREDS + BASE + ", dl AS (SELECT 'KPS-KG' AS indicator, bucket, label, abs(r0 - r2) AS delta FROM sc) " + SUMMARY + " UNION ALL SELECT 'KPS-Name', b, 'NaN'::DOUBLE, 'NaN'::DOUBLE, 0 FROM (VALUES ('PK-A'), ('PK-B'), ('PD-A'), ('PD-B'), ('ALL')) v(b)")
def d06(t: Tables):
    keys = swapped(t, *swap_sources(t))
    return rounded(D.channel_deltas(bucketed(keys), preds(keys, ("R0", "R2")), (("KPS-Name", "R0", "R1"), ("KPS-KG", "R0", "R2"))))


@query("d07_coverage", TRIPLES + PREDS + ", k AS (SELECT count(*) AS kept FROM tri JOIN pr x ON x.a = least(qa, qb) AND x.b = greatest(qa, qb) JOIN pr y ON y.a = least(qa_prime, qb) AND y.b = greatest(qa_prime, qb)) SELECT kept, (SELECT count(*) FROM tri) - kept AS skipped, (SELECT count(*) FROM tri) AS total FROM k")
def d07(t: Tables):
    ends = staged(D.swap_ends(*swap_sources(t), t.groups()), "ends")
    keys = D.swap_numbers(ends).where("n > 0")
    return D.swap_coverage(ends, preds(keys, ("R0",)))


@query("d09_ab_gap", TRIPLES + BUCKETS + PREDS + BASE + CHANNELS + f", sm AS ({SUMMARY}) SELECT indicator, round((max(value) FILTER (bucket = 'PK-A') + max(value) FILTER (bucket = 'PD-A')) / 2 - (max(value) FILTER (bucket = 'PK-B') + max(value) FILTER (bucket = 'PD-B')) / 2, 8) AS ab_gap FROM sm GROUP BY 1")
def d09(t: Tables):
    keys = swapped(t, *swap_sources(t))
    return D.ab_gap(rounded(D.channel_deltas(bucketed(keys), preds(keys)))).select("indicator", F.round("ab_gap", 8).alias("ab_gap"))


@query("u04_scored_universe", TRIPLES + " SELECT a, b FROM labelled WHERE split LIKE 'test%' UNION SELECT qa, qb FROM tri UNION SELECT qa_prime, qb FROM tri")
def u04(t: Tables):
    test = staged(t.labelled().where("split LIKE 'test%'").select("a", "b", "split", "label"), "test")
    src = test.where("split = 'test_s2'").withColumn("prio", F.lit(0))  # no pair of test_s1 makes a triple: see swap_sources
    return D.scored_universe(test, swapped(t, src, src))


@query("a12_bucket_coverage", with_parts("edges") + ", lk AS (SELECT a, b, ['PK-A', 'PK-B', 'PD-A'][1 + (a + b) % 3] AS bucket FROM edges WHERE (a + 3 * b) % 7 <> 0), f AS (SELECT coalesce(lk.bucket, 'Other') AS bucket, count(*) AS n FROM edges e LEFT JOIN lk USING (a, b) GROUP BY 1) SELECT v.bucket, coalesce(n, 0) AS n FROM (VALUES ('PK-A'), ('PK-B'), ('PD-A'), ('PD-B'), ('Other')) v(bucket) LEFT JOIN f ON f.bucket = v.bucket")
def a12(t: Tables):
    e = t.edges()
    three = F.array(*map(F.lit, D.PRIMARY[:3]))
    lk = e.where("pmod(a + 3 * b, 7) <> 0").withColumn("bucket", F.element_at(three, (F.pmod(F.col("a") + F.col("b"), F.lit(3)) + 1).cast("int")))
    return D.bucket_coverage(e, lk)


RUNS = "runs AS (SELECT o_orderpriority AS method, CAST(o_orderkey % 3 AS INTEGER) AS seed, o_orderkey, CAST(o_totalprice > 200000 AS INTEGER) AS label, unit('s:' || o_custkey) AS score FROM orders)"


def runs(t: Tables):
    return t.orders.select(F.col("o_orderpriority").alias("method"), F.pmod("o_orderkey", F.lit(3)).cast("int").alias("seed"), "o_orderkey", (F.col("o_totalprice") > 200000).cast("int").alias("label"), S.unit("s", F.col("o_custkey")).alias("score"))


AUC_SQL = """g AS (SELECT {by}, score, sum(label) AS pos, sum(1 - label) AS neg FROM runs GROUP BY ALL), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM g)
SELECT {by}, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 'NaN'::DOUBLE ELSE CAST(sum(pos * (2 * bf + neg)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc, CAST(sum(pos) + sum(neg) AS BIGINT) AS n FROM w GROUP BY {by}"""


@query("a16_roc_auc", f"WITH {RUNS}, " + AUC_SQL.format(by="method"))
def a16(t: Tables):
    return M.roc_auc(runs(t), ["method"])


@query("a18_stratified_auc", f"WITH {RUNS}, " + AUC_SQL.format(by="method, seed"))
def a18(t: Tables):
    return M.roc_auc(runs(t), ["method", "seed"])


@query("a17_average_precision", f"""WITH {RUNS}, g AS (SELECT method, score, sum(label) AS tp, count(*) AS n FROM runs GROUP BY ALL),
w AS (SELECT *, sum(tp) OVER (PARTITION BY method ORDER BY score DESC) AS ctp, sum(n) OVER (PARTITION BY method ORDER BY score DESC) AS cn FROM g)
SELECT method, round(sum(tp * CAST(ctp AS DOUBLE) / cn) / sum(tp), 9) AS ap, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1""")
def a17(t: Tables):
    return M.average_precision(runs(t), ["method"]).select("method", F.round("ap", 9).alias("ap"), "n")


@query("a13_split_scores", f"WITH {RUNS} SELECT method, round(avg(score) FILTER (label = 1), 9) AS mean_pos, round(avg(score) FILTER (label = 0), 9) AS mean_neg, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM runs GROUP BY 1")
def a13(t: Tables):
    return M.split_scores(runs(t), ["method"]).select("method", R9("mean_pos").alias("mean_pos"), R9("mean_neg").alias("mean_neg"), "n_pos", "n_neg")


VALUES = "vals AS (SELECT o_orderpriority AS method, CAST(o_orderkey % 3 AS INTEGER) AS seed, o_custkey % 50 AS grp, CASE WHEN o_custkey % 50 < 5 OR o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS value FROM orders)"


def vals(t: Tables):
    nan = (F.pmod("o_custkey", F.lit(50)) < 5) | (F.pmod("o_orderkey", F.lit(7)) == 0)
    return t.orders.select(F.col("o_orderpriority").alias("method"), F.pmod("o_orderkey", F.lit(3)).cast("int").alias("seed"), F.pmod("o_custkey", F.lit(50)).alias("grp"), F.when(nan, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("value"))


ROLL = lambda df: df.select("method", "grp", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "n_seeds", "seeds")


@query("a14_seed_rollup", f"WITH {VALUES} SELECT method, grp, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, count(*) AS n_seeds, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds FROM vals WHERE NOT isnan(value) GROUP BY 1, 2")
def a14(t: Tables):
    return ROLL(M.seed_rollup(vals(t), ["method", "grp"]))


@query("a15_seed_rollup_keep_nan", f"""WITH {VALUES} SELECT method, grp, round(avg(value) FILTER (NOT isnan(value)), 6) AS mean, CASE WHEN count(*) FILTER (NOT isnan(value)) > 0 THEN round(coalesce(stddev_samp(value) FILTER (NOT isnan(value)), 0), 4) END AS std, count(*) FILTER (NOT isnan(value)) AS n_seeds,
coalesce(string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) FILTER (NOT isnan(value)), string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR))) AS seeds FROM vals GROUP BY 1, 2""")
def a15(t: Tables):
    return ROLL(M.seed_rollup_all(vals(t), ["method", "grp"]))


RATERS = "raters AS (SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS x, CAST(CAST(d.n_chars > 500 AS INTEGER) AS VARCHAR) AS y, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def raters(t: Tables):
    d = t.documents.select("doc_id", "n_chars", "lang")
    return t.labels.select("doc_id", "quality").join(d, "doc_id").select("doc_id", F.col("quality").cast("string").alias("x"), (F.col("n_chars") > 500).cast("int").cast("string").alias("y"), "lang")


@query("a19_kappa", f"""WITH {RATERS}, n AS (SELECT lang, count(*) AS n, sum(CAST(x = y AS INTEGER)) AS o FROM raters GROUP BY 1), m AS (SELECT lang, v, sum(cx) AS cx, sum(cy) AS cy FROM (SELECT lang, x AS v, 1 AS cx, 0 AS cy FROM raters UNION ALL SELECT lang, y, 0, 1 FROM raters) GROUP BY 1, 2),
e AS (SELECT lang, sum(cx * cy) AS e FROM m GROUP BY 1) SELECT n.lang, round((o / n.n::DOUBLE - e.e / (n.n::DOUBLE * n.n)) / (1 - e.e / (n.n::DOUBLE * n.n)), 9) AS kappa, n.n FROM n JOIN e ON e.lang = n.lang""")
def a19(t: Tables):
    return M.cohen_kappa(raters(t), "x", "y", ["lang"]).select("lang", F.round("kappa", 9).alias("kappa"), "n")


@query("a20_prf", f"""WITH {RATERS}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (x = y) AS ok, count(*) FILTER (x = '1' AND y = '1') AS tp, count(*) FILTER (x <> '1' AND y = '1') AS fp, count(*) FILTER (x = '1' AND y <> '1') AS fn FROM raters GROUP BY 1)
SELECT lang, n, ok / n::DOUBLE AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS "precision", CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM c""")
def a20(t: Tables):
    return M.precision_recall(raters(t), "x", "y", "1", ["lang"])


@query("a09_majority_vote", "SELECT p_type, p_brand, votes FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY votes DESC, p_brand) AS r FROM (SELECT p_type, p_brand, count(*) AS votes FROM part WHERE p_brand IS NOT NULL GROUP BY 1, 2)) WHERE r = 1")
def a09(t: Tables):
    return M.majority(t.part, "p_type", "p_brand")


@query("a10_value_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def a10(t: Tables):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("a21_quadrants", f"WITH {RATERS}, q AS (SELECT lang AS quadrant, count(*) AS n, count(*) FILTER (x = y) AS agree FROM raters GROUP BY 1) SELECT v.quadrant, coalesce(n, 0) AS n, coalesce(agree, 0) AS agree, CASE WHEN n > 0 THEN 100.0::DOUBLE * agree / n END AS pct FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')) v(quadrant) LEFT JOIN q ON q.quadrant = v.quadrant")
def a21(t: Tables):
    return M.quadrants(raters(t), "lang", F.col("x") == F.col("y"), ["en", "de", "fr", "es", "xx"])


@query("j16_annotator_alignment", f"WITH {RATERS} SELECT doc_id, x, y FROM raters")
def j16(t: Tables):
    return raters(t).select("doc_id", "x", "y")


@query("a22_fold_counts", with_parts("folds") + ", tr AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT split, count(*) AS n, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM tr WHERE least(tr.a, tr.b) = folds.a AND greatest(tr.a, tr.b) = folds.b)) AS BIGINT) AS n_in_train FROM folds GROUP BY 1")
def a22(t: Tables):
    from ..operators.validate import negative_overlap

    return negative_overlap(t.folds().select("split", "a", "b"), t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


@query("a23_percentile_bins", """WITH e AS (SELECT quantile_cont(p_retailprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM part)
SELECT p_partkey, CAST(least(len(list_filter(q[2:10], lambda x: x < p_retailprice)) + CAST(q[11] + 1e-9 < p_retailprice AS INTEGER), 9) AS INTEGER) AS bin FROM part, e""")
def a23(t: Tables):
    e = F.broadcast(M.percentile_edges(t.part, "p_retailprice").withColumn("j", F.lit(1)))
    return t.part.withColumn("j", F.lit(1)).join(e, "j").select("p_partkey", S.bin_index(F.col("p_retailprice"), F.col("edges")).alias("bin"))


@query("a24_coalesce_edges", "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS rel, CAST(sum(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2, 3")
def a24(t: Tables):
    from ..operators.graph import coalesced

    return coalesced(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("rel"), F.col("l_linenumber").alias("w")))


@query("w10_checkpoint_rank", "SELECT method, step, loss, CAST(place AS INTEGER) AS place FROM (SELECT o_orderpriority AS method, o_orderkey AS step, o_totalprice AS loss, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS place FROM orders) WHERE place <= 5")
def w10(t: Tables):
    rows = t.orders.select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))
    return D.rank_first(rows, ["method"], [F.col("loss"), F.col("step")], 5)


@query("w12_sequential_ids", "SELECT printf('P%04d', row_number() OVER (ORDER BY s_suppkey)) AS pair_id, s_suppkey FROM supplier")
def w12(t: Tables):
    return range_numbered(t.supplier.select("s_suppkey"), ["s_suppkey"], "n").select(F.format_string("P%04d", "n").alias("pair_id"), "s_suppkey")


@query("n20_softmax", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(1 / (1 + exp(l_tax - l_discount)), 12) AS p_yes FROM lineitem")
def n20(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(S.softmax_yes(F.col("l_tax"), F.col("l_discount")), 12).alias("p_yes"))


@query("n24_min_max", "SELECT p_partkey, (p_size - min(p_size) OVER (PARTITION BY p_type)) / nullif((max(p_size) OVER (PARTITION BY p_type) - min(p_size) OVER (PARTITION BY p_type))::DOUBLE, 0) AS scaled FROM part")
def n24(t: Tables):
    from pyspark.sql import Window as W

    w = W.partitionBy("p_type")
    low, high = F.min("p_size").over(w), F.max("p_size").over(w)
    return t.part.select("p_partkey", F.when(high > low, (F.col("p_size") - low) / (high - low)).alias("scaled"))


@query("n22_one_hot", "SELECT o_orderkey, list_transform(['1-URGENT', '2-HIGH', 'other'], lambda v: CAST(v = CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'other' END AS DOUBLE)) AS v FROM orders")
def n22(t: Tables):
    return t.orders.select("o_orderkey", S.one_hot(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "other"]).alias("v"))
