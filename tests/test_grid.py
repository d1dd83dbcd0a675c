"""Pairs that meet what their ends hold, in cells."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import annotate, grid, retrieval


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("distinct", [False, True])
def test_cells_equal_two_joins(spark, monkeypatch, how, distinct):
    """Repeated pairs, loops, null ends, ends that hold nothing, null keys and values of what is held."""
    monkeypatch.setattr(grid, "CELL_NODES", 3)
    g = random.Random(2)
    end = lambda: g.choice([None, *range(30)])
    pairs = spark.createDataFrame([(g.randint(0, 2), end(), end(), g.choice(["x", None])) for _ in range(600)], "w long, a long, b long, t string")
    left = spark.createDataFrame([(n, f"l{n}", None) for n in range(0, 25)] + [(None, "no", 1)], "a long, x string, y int")
    right = spark.createDataFrame([(n, None if n % 7 == 0 else [n]) for n in range(5, 40)] + [(None, [0])], "b long, z array<long>")
    given = pairs.distinct() if distinct else pairs
    want = given.join(left, "a", how).join(right, "b", how).select(*pairs.columns, "x", "y", "z")
    got = grid.met_in_cells(pairs, left, right, "a", "b", how, distinct)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pairs_move_once_and_alone(spark):
    pairs = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    context = spark.range(60).select(F.col("id").alias("node"), F.array(F.col("id").cast("string")).alias("k"))
    plan = retrieval.pair_context(pairs, context, ("k",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_contexts_come_back_as_they_were(spark):
    odd = [None, [], [""], [None], ["a", None, ""], ["\x01", "\x02\x03", "\x01a\x01", "\x01n", "\x01e", "\x01c"], ["e|f", "g, h"]]
    context = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate((x, y) for x in odd for y in odd)], "node int, k array<string>, m array<string>")
    pairs = spark.createDataFrame([(i, (i * 5 + 3) % 49) for i in range(49)] + [(99, 3)], "a int, b int")
    held = {r["node"]: (r["k"], r["m"]) for r in context.collect()} | {99: (None, None)}
    for r in retrieval.pair_context(pairs, context, ("k", "m")).collect():
        for i, t in enumerate(("k", "m")):
            want = [["unknown"] if held[r[s]][i] is None else held[r[s]][i] for s in ("a", "b")]
            assert (r["ctx"][i]["type"], [r["ctx"][i]["A"], r["ctx"][i]["B"]]) == (t, want)


def test_mediators_of_pairs_as_often_as_they_meet(spark):
    """Repeated pairs count once, the text is made late, and no pair without a shared entity in a role goes on to the bindings."""
    rows = [("u", "enzyme", "1", "A", "Inhibitor ", 0), ("v", "enzyme", "1", "C", "substrate", 1), ("w", "enzyme", "1", "C", "inducer", 0), ("u", "transporter", "9", "T", "inhibitor", 0), ("w", "transporter", "9", "T", "inhibitor", 2)]
    bound = spark.createDataFrame(rows, "node string, edge_type string, entity_id string, entity_name string, action string, pos int")
    pairs = spark.createDataFrame([("u", "v"), ("u", "v"), ("u", "w"), ("u", "w"), ("u", "x")], "a string, b string")
    out = annotate.pk_mediators(pairs, bound, made=F.lit("serum concentration"), distinct=True)
    got = sorted((r["a"], r["b"], r["key_entity_id"], r["match_pattern"], r["rank_sum"], r["n_candidates"], r["ddi_type"]) for r in out.collect())
    assert got == [("u", "v", "1", "inhibitor-substrate", 1, 0, "serum concentration"), ("u", "w", "9", "inhibitor-inhibitor", 2, 0, "serum concentration")]
