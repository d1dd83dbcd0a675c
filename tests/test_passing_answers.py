"""Message passing and answer labels against plain loops."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.operators import answers as AN
from pairloom.operators import graph as G


def plain_passing(edges, starts, gates, steps, mix, relu):
    state = defaultdict(lambda: [0.0, 0.0])
    for q, n, h in starts:
        state[q, n] = [a + b for a, b in zip(state[q, n], h)]
    for k in range(1, steps + 1):
        total = [sum(g[i] for s, _, g in gates if s == k) for i in range(2)]
        gate = {r: [x / t for x, t in zip(g, total)] for s, r, g in gates if s == k}
        got = defaultdict(lambda: [0.0, 0.0])
        for (q, n), h in state.items():
            for a, b, r in edges:
                if a == n and r in gate and any(h):
                    got[q, b] = [x + y * z for x, y, z in zip(got[q, b], h, gate[r])]
        state = defaultdict(lambda: [0.0, 0.0])
        for key, h in got.items():
            m = [sum(h[i] * mix[k - 1][i][j] for i in range(2)) for j in range(2)] if mix else h
            state[key] = [max(x, 0.0) for x in m] if relu else m
    return {key: pytest.approx(h) for key, h in state.items()}


@pytest.mark.parametrize("relu", [True, False])
@pytest.mark.parametrize("mix", [None, [[[1.0, -1.0], [0.5, 0.25]]] * 3])
def test_passing_against_plain_loops(spark, mix, relu):
    g = random.Random(3)
    edges = [(g.randrange(9), g.randrange(9), g.randrange(4)) for _ in range(30)] + [(1, 2, 0), (1, 2, 0), (3, 3, 1)]
    starts = [("p", 1, [1.0, -2.0]), ("p", 1, [1.0, 0.5]), ("q", 3, [0.0, 3.0]), ("z", 4, [0.0, 0.0]), ("far", 77, [1.0, 1.0])]
    gates = [(k, r, [g.random() + 0.1, g.random() + 0.1]) for k in (1, 2, 3) for r in range(3)]  # relation 3 has none
    e = spark.createDataFrame([*edges, (None, 1, 0)], "src long, dst long, rel int")
    s = spark.createDataFrame(starts, "query string, node long, h array<double>")
    w = spark.createDataFrame(gates, "step int, rel int, gate array<double>")
    got = {(r["query"], r["node"]): r["h"] for r in G.message_passing(e, s, w, 3, mix, relu).collect()}
    assert got == plain_passing(edges, starts, gates, 3, mix, relu)
    assert G.message_passing(e, s.limit(0), w, 2).collect() == [] and G.message_passing(e.limit(0), s, w, 1).collect() == []


def plain_end(ids, header):
    return max((k + len(header) for k in range(len(ids) - len(header) + 1) if ids[k : k + len(header)] == header), default=-1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=25), st.lists(st.integers(0, 2), min_size=1, max_size=5))
def test_the_automaton_finds_every_header(ids, header):
    table, state, ends = AN.automaton(header), 0, []
    for k, x in enumerate(ids):
        state = table[state].get(x, 0)
        if state == len(header):
            ends.append(k + 1)
    assert ends == [k + len(header) for k in range(len(ids) - len(header) + 1) if ids[k : k + len(header)] == header]


@pytest.mark.parametrize("header", [[1, 1], [1, 2, 1], [7]])
def test_labels_against_plain_loops(spark, header):
    g = random.Random(4)
    rows = [[g.choice([1, 2, 3]) for _ in range(g.randint(0, 15))] for _ in range(60)] + [[], [1], [1, 1, 1], [1, 2, 1, 2, 1], header * 3]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(900, None), (901, [None, *header, None, 5])], "k int, ids array<int>")
    got = {r["k"]: (r["end"], r["labels"]) for r in df.select("k", AN.header_end(F.col("ids"), header).alias("end"), AN.answer_labels(F.col("ids"), header).alias("labels")).collect()}
    for i, ids in enumerate(rows):
        end = plain_end(ids, header)
        start = end if end >= 0 else max(len(ids) - 1, 0)
        assert got[i] == (end, [AN.MASKED] * start + ids[start:])
    assert got[900] == (None, None) and got[901][1] == [AN.MASKED] * (len(header) + 1) + [None, 5]
    with pytest.raises(ValueError):
        AN.header_end(F.col("ids"), [])
