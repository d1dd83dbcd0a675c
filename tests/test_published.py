"""Shuffles and folds against the generators themselves."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.operators import folds as FO
from pairloom.operators import published as PU


def drawn(kind, seed, n):
    if kind == "mt19937":
        return np.random.RandomState(seed).permutation(n).tolist()
    x = list(range(n))
    np.random.default_rng(seed).shuffle(x)
    return x


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(["pcg64", "mt19937"]), st.integers(0, 2**32 - 1), st.integers(0, 3000))
def test_swaps_give_the_published_order(kind, seed, n):
    x, told = list(range(n)), 0
    for i, j in PU.swaps(kind, seed, n):
        for a, b in zip(i.tolist(), j.tolist()):
            x[a], x[b] = x[b], x[a]
            told += 1
    assert x == drawn(kind, seed, n) and told == max(0, n - 1)


def test_long_streams_of_swaps():
    n, x = 300_000, list(range(300_000))
    for i, j in PU.swaps("mt19937", 43, n):
        for a, b in zip(i.tolist(), j.tolist()):
            x[a], x[b] = x[b], x[a]
    assert x == drawn("mt19937", 43, n)


@pytest.mark.parametrize("kind, seed, n", [("pcg64", 42, 1900), ("mt19937", 44, 2500), ("pcg64", 43, 40_000), ("mt19937", 1, 1), ("pcg64", 1, 0), ("pcg64", 7, 2)])
def test_permutations_in_spark(spark, kind, seed, n):
    got = sorted(tuple(r) for r in PU.permutation(spark, n, seed, kind).collect())
    assert got == list(enumerate(drawn(kind, seed, n)))


def plain_halves(rows, seed, name):
    if len(rows) < 2:
        return {r: f"test_{name}" for r in rows}
    p = np.random.RandomState(seed).permutation(len(rows))
    t = math.ceil(len(rows) / 2)
    return {rows[k]: (f"test_{name}" if at < t else f"val_{name}") for at, k in enumerate(p)}


def plain_fair(edges, seed, ratio=0.8):
    nodes = sorted({str(x) for e in edges for x in e})
    np.random.default_rng(seed).shuffle(nodes)
    g1 = set(nodes[: min(max(1, int(len(nodes) * ratio)), len(nodes) - 1)])
    cls = [[e for e in edges if sum(str(x) not in g1 for x in e) == k] for k in range(3)]
    s0 = cls[0]
    held = len(s0) - math.floor(len(s0) * 0.9)
    p = np.random.RandomState(seed).permutation(len(s0))
    out = {s0[k]: "train" for k in p[held:]} | plain_halves([s0[k] for k in p[:held]], seed, "s0")
    return g1, out | plain_halves(cls[1], seed, "s1") | plain_halves(cls[2], seed, "s2")


def graph(n, m, seed):
    g = random.Random(seed)
    return list(dict.fromkeys((f"D{min(p):04d}", f"D{max(p):04d}") for p in ((g.randrange(n), g.randrange(n)) for _ in range(m)) if p[0] != p[1]))


@pytest.mark.parametrize("seed", [42, 43, 44])
def test_fair_folds_have_the_published_members(spark, seed):
    edges = graph(60, 900, 5)
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "a string, b string, pos int")
    ends = df.selectExpr("explode(array(a, b)) AS node")
    groups = PU.published_groups(ends, seed)
    g1, want = plain_fair(edges, seed)
    assert {r["node"] for r in groups.where("grp = 'G1'").collect()} == g1
    got = {(r["a"], r["b"]): r["split"] for r in PU.published_fair_folds(df.repartition(5), groups, seed, ["pos"]).collect()}
    assert got == want


def test_legacy_folds_have_the_published_members(spark):
    edges, seed = graph(40, 300, 6), 42
    nodes = sorted({x for e in edges for x in e})
    np.random.default_rng(seed).shuffle(nodes)
    g1 = set(nodes[: max(1, int(len(nodes) // 1.5))])
    cls = [[e for e in edges if sum(x not in g1 for x in e) == k] for k in range(3)]
    order = np.arange(len(cls[0]))
    np.random.default_rng(seed).shuffle(order)
    unseen, anchors = set(g1), []
    for i in order:
        if unseen & set(cls[0][i]):
            anchors.append(int(i))
            unseen -= set(cls[0][i])
    rest = [i for i in range(len(cls[0])) if i not in set(anchors)]
    np.random.default_rng(seed + 17).shuffle(rest)
    extra = max(0, int(0.8 * len(cls[0])) - len(anchors))
    val = int(len(rest[extra:]) * 0.1)
    want = {cls[0][i]: "train" for i in [*anchors, *rest[:extra]]} | {cls[0][i]: "val_s0" for i in rest[extra : extra + val]} | {cls[0][i]: "test_s0" for i in rest[extra + val :]}
    for k, shift in ((1, 29), (2, 31)):
        later = list(range(len(cls[k])))
        np.random.default_rng(seed + shift).shuffle(later)
        cut = int(len(later) * 0.1)
        want |= {cls[k][i]: (f"val_s{k}" if at < cut else f"test_s{k}") for at, i in enumerate(later)}
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "a string, b string, pos int")
    groups = PU.published_groups(df.selectExpr("explode(array(a, b)) AS node"), seed, protocol=FO.resolve_protocol("legacy"))
    got = {(r["a"], r["b"]): r["split"] for r in PU.published_legacy_folds(df, groups, seed, ["pos"]).collect()}
    assert got == want


def test_small_and_empty_graphs(spark):
    empty = spark.createDataFrame([], "a string, b string, pos int")
    assert PU.published_groups(empty.selectExpr("a AS node"), 42).collect() == []
    one = spark.createDataFrame([("x", "y", 0), (None, "y", 1)], "a string, b string, pos int")
    groups = PU.published_groups(one.selectExpr("explode(array(a, b)) AS node"), 42)
    assert sorted(r["grp"] for r in groups.collect()) == ["G1", "G2"]
    assert [r["split"] for r in PU.published_fair_folds(one, groups, 42, ["pos"]).collect()] == ["test_s1"]
    assert PU.published_fair_folds(empty, groups, 42, ["pos"]).collect() == []
    sizes = PU.published_groups(spark.range(1900).selectExpr("concat('DB', lpad(id, 5, '0')) AS node"), 42).groupBy("grp").count().collect()
    assert {r["grp"]: r["count"] for r in sizes} == {"G1": 1520, "G2": 380}
