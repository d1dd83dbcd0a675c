"""The swap indicator from sorted scores against the one over all triples."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import diagnostics as D


def bucket(a, b):
    return F.element_at(F.array(*map(F.lit, (*D.PRIMARY, "Other"))), (F.pmod(a * 3 + b, F.lit(5)) + 1).cast("int"))


@pytest.mark.parametrize("seed, grouped", [(1, True), (2, False), (3, True)])
def test_equals_the_indicator_over_triples(spark, seed, grouped):
    g = random.Random(seed)
    pairs = lambda n: [(g.randrange(14), g.randrange(14), g.randint(0, 1), g.randint(0, 1)) for _ in range(n)]
    schema = "a long, b long, label int, prio int"
    src = spark.createDataFrame(list({p[:2]: p for p in pairs(40)}.values()), schema)
    pool = spark.createDataFrame(pairs(120) + [(0, k, k % 2, 0) for k in range(1, 14)], schema)  # a hub, and keys with both labels
    score = lambda: g.choice([None, float("nan"), 0.5, g.random(), g.random(), g.random()])
    keys = {(g.randrange(14), g.randrange(14)) for _ in range(150)}
    preds = spark.createDataFrame([("R0", a, b, score()) for a, b in keys] + [("R1", 1, 2, 0.5)], "cond string, a long, b long, p double")
    groups = spark.createDataFrame([(k, "G1" if k % 3 else "G2") for k in range(13)], "node long, grp string") if grouped else None
    tri = D.swap_triples(src, pool, groups).select("qa", "qb", "qa_prime", F.col("label_uv").alias("label"), bucket(F.col("qa"), F.col("qb")).alias("bucket"))
    want = {r["bucket"]: (r["value"], r["std"], r["n"]) for r in D.kps_f(tri, preds).collect()}
    got = {r["bucket"]: (r["value"], r["std"], r["n"]) for r in D.swap_sensitivity(src, pool, groups, preds, bucket).collect()}
    assert set(got) == set(want) and len(want) >= 4
    for k, (value, std, n) in want.items():
        assert got[k][2] == n and got[k][0] == pytest.approx(value) and got[k][1] == pytest.approx(std, abs=1e-9)


def test_no_pair_gives_no_row(spark):
    none = spark.createDataFrame([], "a long, b long, label int, prio int")
    preds = spark.createDataFrame([("R0", 1, 2, 0.5)], "cond string, a long, b long, p double")
    assert D.swap_sensitivity(none, none, None, preds, bucket).collect() == []


def swap_case(spark, seed, grouped):
    g = random.Random(seed)
    pairs = lambda n: [(g.randrange(12), g.randrange(12), g.choice(["x", "y", "z", None]), g.randint(0, 1)) for _ in range(n)]
    schema = "a long, b long, label string, prio int"
    src = spark.createDataFrame(list({frozenset(p[:2]): p for p in pairs(50)}.values()) + [(None, 1, "x", 0), (1, None, "x", 0)], schema)
    pool = spark.createDataFrame(pairs(150) + [(0, k, "xy"[k % 2], 0) for k in range(1, 12)] + [(None, 1, "y", 0), (2, None, "y", 0)], schema)
    groups = spark.createDataFrame([(k, ("G1", "G2", None)[k % 3]) for k in range(11)], "node long, grp string") if grouped else None
    return src, pool, groups


@pytest.mark.parametrize("seed, grouped", [(1, True), (2, False), (3, False)])
def test_numbers_are_those_of_the_triples(spark, seed, grouped):
    src, pool, groups = swap_case(spark, seed, grouped)
    tri = [tuple(r) for r in D.swap_triples(src, pool, groups).collect()]
    want = Counter((qa, qb, label, True) for qa, qb, _, label in tri) + Counter((up, qb, None, False) for _, qb, up, _ in tri)
    got = D.swap_numbers(D.swap_ends(src, pool, groups)).where("n <> 0").collect()
    assert Counter({(r["node"], r["b"], r["label"] if r["replaced"] else None, r["replaced"]): r["n"] for r in got}) == want and len(want) > 10


def scored_case(spark, conds):
    g = random.Random(7)
    src = spark.createDataFrame(list({p[:2]: p for p in [(g.randrange(14), g.randrange(14), g.randint(0, 1), 0) for _ in range(60)]}.values()), "a long, b long, label int, prio int")
    pool = spark.createDataFrame([(g.randrange(14), g.randrange(14), g.randint(0, 1), 0) for _ in range(120)], src.schema)
    keys = sorted({(g.randrange(14), g.randrange(14)) for _ in range(160)})
    preds = spark.createDataFrame([(c, a, b, g.choice([None, g.random(), g.random()])) for c in conds for a, b in keys if g.random() < 0.9], "cond string, a long, b long, p double")
    tri = D.swap_triples(src, pool).select("qa", "qb", "qa_prime", F.col("label_uv").alias("label"), bucket(F.col("qa"), F.col("qb")).alias("bucket"))
    pairs = D.swap_numbers(D.swap_ends(src, pool)).where("replaced AND n > 0").select(F.col("node").alias("qa"), F.col("b").alias("qb"), "label", bucket(F.col("node"), F.col("b")).alias("bucket"))
    rounded = lambda df: sorted(((r["indicator"], r["bucket"], round(r["value"] or 0, 9), round(r["std"], 8), r["n"]) for r in df.collect()), key=str)
    return src, pool, preds, tri, pairs, rounded


def test_panel_without_triples(spark):
    src, pool, preds, tri, pairs, rounded = scored_case(spark, ("base", "mask_mol", "mask_kg"))
    swaps = D.swap_sensitivity(src, pool, None, preds, bucket, "base")
    assert rounded(D.masked_panel(pairs, preds, swaps)) == rounded(D.masked_panel(tri, preds))


def test_coverage_without_triples(spark):
    src, pool, preds, tri, _, _ = scored_case(spark, ("R0", "R1"))
    got = D.swap_coverage(D.swap_ends(src, pool), preds).first()
    assert tuple(got) == tuple(D.coverage(tri, preds).first()) and 0 < got["kept"] < got["total"]


def test_channels_from_base_pairs(spark):
    _, _, preds, tri, pairs, rounded = scored_case(spark, ("R0", "R1", "R2", "R3"))
    assert pairs.count() < tri.count()
    assert rounded(D.channel_deltas(pairs, preds)) == rounded(D.channel_deltas(tri, preds))
    assert rounded(D.ksai(pairs, preds)) == rounded(D.ksai(tri, preds))
