"""Centroid clustering against plain integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import centroids as cc

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def plain(rows, clusters, rounds, dim, scale=1024, seed="3"):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) of every kept row, by Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cent))

    for _ in range(rounds):
        mine = [[v for _, v in kept if nearest(v)[1] == k] for k in range(len(cent))]
        cent = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, cent)]
    got = [(i, *nearest(v)) for i, v in kept]
    per = {k: sum(d for _, d, c in got if c == k) for k in range(len(cent))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted((i, c, d, per[c], sum(per.values()), sha[c]) for i, d, c in got)


def clustered(spark, rows, **how):
    return sorted(tuple(r) for r in cc.cluster(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA), **how).collect())


def test_against_plain_integers(spark):
    g = np.random.default_rng(1)
    rows = [(i, (g.normal(size=6) * (1 + i % 3)).tolist()) for i in range(150)]
    rows += [(900 + i, rows[i][1]) for i in range(20)] + [rows[3], rows[3]]  # copies and repeated rows
    assert clustered(spark, rows, dim=6, rounds=4, clusters=5) == plain(rows, 5, 4, 6)


def test_ties_go_to_the_lowest_number(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]  # many vectors lie exactly between centroids
    assert clustered(spark, rows, dim=2, rounds=3, clusters=4, scale=2) == plain(rows, 4, 3, 2, scale=2)


def test_large_components_use_exact_integers(spark):
    rows = [(i, [1e6 + i, -3e5 * (i % 4)]) for i in range(10)] + [(50, [1e30, 0.0])]  # the last fits no long and stays out
    assert clustered(spark, rows, dim=2, rounds=2, clusters=3) == plain(rows[:-1], 3, 2, 2)


def test_distances_beyond_a_long_are_null(spark):
    rows = [(1, [4e15, 0.0]), (2, [-4e15, 0.0]), (3, [-4e15, 1.0])]
    got = clustered(spark, rows, dim=2, rounds=1, clusters=1)
    assert [r[0] for r in got] == [1, 2, 3] and all(r[2] is None and r[4] is None for r in got)


@pytest.mark.parametrize("size", [1.0, 300.0, 2.0**23])
def test_intervals_hold_the_exact_value_and_are_narrow(size):
    g = np.random.default_rng(2)
    v, c = (np.floor(g.normal(size=(n, 64)) * size).clip(-(2**24), 2**24).astype(np.int64) for n in (200, 8))
    low, high = cc.Screen(c).intervals(v)
    for i in range(len(v)):
        for k in range(len(c)):
            x = sum(int(b) * int(b) - 2 * int(a) * int(b) for a, b in zip(v[i], c[k]))
            assert Fraction(low[i, k]) <= x <= Fraction(high[i, k])
    assert ((high - low) <= 4e-5 * (64 * 64 * size * size + 64)).all()


def test_close_centroids_are_compared_exactly():
    g = np.random.default_rng(3)
    base = g.integers(-900, 900, 64)
    c = np.stack([base, base + (np.arange(64) == 5), base])
    v = np.stack([base + g.integers(-700, 700, 64) for _ in range(300)])
    got, compared = cc.Screen(c).nearest(v)
    want = [min((int(((x - y) ** 2).sum()), k) for k, y in enumerate(c))[1] for x in v]
    assert got.tolist() == want and 2 not in want
    assert compared >= want.count(0)  # the first and the last centroid are equal, so their intervals always overlap


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0]), (8, [-0.0, 0.0])]
    assert clustered(spark, rows, dim=2, clusters=8) == plain(rows, 8, 10, 2)
    assert clustered(spark, rows[:6], dim=2) == []
    keyless = clustered(spark, [(7, [1.0, 2.0])], dim=2) + clustered(spark, [(None, [1.0, 2.0])], dim=2)
    assert [r[0] for r in keyless] == [7, None]
    assert cc.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_float_columns_are_floored_as_doubles(spark):
    rows = [(i, np.random.default_rng(i).normal(size=3).astype(np.float32).astype(float).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert sorted(tuple(r) for r in cc.cluster(df, dim=3, clusters=2).collect()) == plain(rows, 2, 10, 3)
