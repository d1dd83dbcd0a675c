"""Walks against exact step probabilities, subgraphs against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.operators import walks as WK

EDGES = "src long, dst long, w double"


def graph(seed=1, n=14, m=40):
    g = random.Random(seed)
    pairs = {tuple(sorted((g.randrange(n), g.randrange(n)))) for _ in range(m)}
    return [(a, b, float(g.randint(1, 9))) for a, b in pairs if a != b] + [(0, k, 1.0) for k in range(1, n)]


def weights(edges, weighted):
    w = defaultdict(Counter)
    for a, b, x in edges:
        for s, d in {(a, b), (b, a)}:
            w[s][d] = w[s][d] + x if weighted else 1.0
    return w


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0.001, 1000), min_size=1, max_size=40))
def test_alias_tables_hold_the_weights(ws):
    keep, other = WK.vose(np.array(ws))
    mass = keep.copy()
    np.add.at(mass, other, 1 - keep)
    assert np.allclose(mass / len(ws), np.array(ws) / sum(ws)) and (keep <= 1).all() and (keep >= -1e-9).all()


@pytest.mark.parametrize("weight, block, p, q", [(None, 4096, 0.25, 4.0), ("w", 3, 4.0, 0.5), ("w", 2, 1.0, 1.0)])
def test_steps_follow_the_second_order_weights(spark, weight, block, p, q):
    edges = graph()
    w = weights(edges, weight is not None)
    n, walks = len(w), 500
    got = WK.second_order_walks(spark.createDataFrame(edges, EDGES), spark.range(n).withColumnRenamed("id", "n"), 3, 7, p, q, walks, weight, block).collect()
    paths = defaultdict(dict)
    for r in got:
        paths[r["start"], r["walk"]][r["step"]] = r["node"]
    assert len(paths) == n * walks and all(len(x) == 4 for x in paths.values())
    seen = defaultdict(Counter)
    for x in paths.values():
        seen[None, x[0]][x[1]] += 1
        seen[x[0], x[1]][x[2]] += 1
        seen[x[1], x[2]][x[3]] += 1
    chi, free = 0.0, 0
    for (prev, at), counts in seen.items():
        exact = {d: x * (1.0 if prev is None else 1 / p if d == prev else 1.0 if d in w[prev] else 1 / q) for d, x in w[at].items()}
        assert set(counts) <= set(exact)
        total, whole = sum(counts.values()), sum(exact.values())
        cells = [(counts[d], total * x / whole) for d, x in exact.items()]
        if min(e for _, e in cells) >= 5:
            chi += sum((o - e) ** 2 / e for o, e in cells)
            free += len(cells) - 1
    assert free > 60 and abs(chi - free) < 4.5 * (2 * free) ** 0.5


def test_the_exact_draw_follows_the_weights_too(spark, monkeypatch):
    monkeypatch.setattr(WK, "ROUNDS", 0)
    edges = [(0, 1, 1.0), (0, 2, 3.0), (0, 3, 6.0)]
    got = WK.second_order_walks(spark.createDataFrame(edges, EDGES), spark.range(1).withColumnRenamed("id", "n"), 1, 3, walks=4000, weight="w").where("step = 1").collect()
    counts = Counter(r["node"] for r in got)
    assert sum((counts[k] - 400 * e) ** 2 / (400 * e) for k, e in ((1, 1), (2, 3), (3, 6))) < 16


def test_steps_without_weights_draw_from_all_places_of_a_hub(spark):
    """The first step from a hub of 40 neighbours takes the place that one keyed number names, whatever the block."""
    edges = spark.createDataFrame([(0, k, 1.0) for k in range(1, 41)], EDGES)
    for block in (4, 4096):
        got = WK.second_order_walks(edges, spark.range(1).withColumnRenamed("id", "n"), 1, 7, walks=30, block=block).where("step = 1").collect()
        slot = lambda w: int(hashlib.md5(f"7:slot:0:{w}:1:0:0".encode()).hexdigest()[:8], 16) * 40 // 2**32
        assert {r["walk"]: r["node"] for r in got} == {w: 1 + slot(w) for w in range(30)}


def test_a_hub_has_many_small_tables(spark):
    n = 100_000
    edges = spark.range(1, n + 1).selectExpr("0L AS src", "id AS dst", "cast(1 + id % 3 AS double) AS w")
    tables = WK.AliasGraph(WK.both_ways(edges, "w"), 64)
    assert len(tables.upper) == 2
    sizes = [t.where("node = 0").selectExpr("place div 64 AS b").groupBy("b").count().agg({"count": "max"}).first()[0] for t in (tables.leaves, *tables.upper)]
    assert max(sizes) <= 64
    got = WK.second_order_walks(edges, spark.range(1).withColumnRenamed("id", "n"), 2, 5, p=1e-3, walks=3000, weight="w", block=64)
    at = {(r["walk"], r["step"]): r["node"] for r in got.collect()}
    share = Counter(at[k, 1] % 3 for k in range(3000))
    assert abs(share[2] - 1500) < 140 and abs(share[0] - 500) < 100 and all(at[k, 2] == 0 for k in range(3000))


def test_walks_are_the_same_under_any_partitioning_and_end_without_edges(spark):
    edges = graph(4)
    df = spark.createDataFrame(edges + [(None, 1, 1.0), (3, None, 1.0), (5, 99, 0.0)], EDGES)
    sources = spark.createDataFrame([(0,), (3,), (3,), (77,), (None,)], "n long")
    one = {tuple(r) for r in WK.second_order_walks(df, sources, 3, 1, 0.5, 2.0, weight="w").collect()}
    two = {tuple(r) for r in WK.second_order_walks(df.repartition(7), sources.repartition(3), 3, 1, 0.5, 2.0, weight="w").collect()}
    assert one == two and (77, 0, 0, 77) in one and len([r for r in one if r[0] == 77]) == 1 and {r[0] for r in one} == {0, 3, 77}
    assert WK.second_order_walks(df.limit(0), sources, 2, 1).count() == 3
    with pytest.raises(ValueError):
        WK.second_order_walks(df, sources, 1, 1, p=0)


def plain_hops(edges, source, hops, most, seed):
    front, seen = {source}, {source}
    for hop in range(1, hops + 1):
        rows = sorted((hashlib.md5(f"{seed}:hop:{hop}:{s}:{d}:{r}".encode()).hexdigest(), s, d, r) for s, d, r in set(edges) if d in front)
        front = {s for _, s, _, _ in (rows if most is None else rows[:most])}
        seen |= front
    return sorted(seen)


@pytest.mark.parametrize("most", [None, 1, 3])
def test_subgraphs_against_plain_loops(spark, most):
    g = random.Random(5)
    edges = [(g.randrange(25), g.randrange(25), g.randrange(3)) for _ in range(90)] + [(k, 0, 1) for k in range(25)] + [(1, 2, 0), (1, 2, 0), (4, 4, 2)]
    df = spark.createDataFrame([*edges, (None, 3, 1)], "src long, dst long, rel int")
    sources = spark.createDataFrame([(k,) for k in [*range(0, 25, 2), 0, 500]] + [(None,)], "n long")
    nodes = WK.k_hop_nodes(df, sources, 2, most, 9)
    want = {s: plain_hops(edges, s, 2, most, 9) for s in [*range(0, 25, 2), 500]}
    got = defaultdict(dict)
    for r in nodes.collect():
        got[r["source"]][r["n"]] = r["node"]
        assert r["is_source"] == (r["source"] == r["node"])
    assert {s: [x[k] for k in sorted(x)] for s, x in got.items()} == want and all(sorted(x) == list(range(len(x))) for x in got.values())
    told = sorted(tuple(r) for r in WK.induced_edges(df, nodes).collect())
    assert told == sorted((s, x.index(a), x.index(b), r, a == s, b == s) for s, x in want.items() for a, b, r in edges if a in x and b in x)
