"""What keeps the work of the shared steps in proportion to the input."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions.scalars import hash_order
from pairloom.operators import diagnostics, features, folds, render, sampling
from pairloom.plans import registry, rendering_all, sources_scoring
from pairloom.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_from_one_pass(spark, tmp_path):
    rows = [(o, p) for o in range(40) for p in range(o % 7, 30, 1 + o % 5)] + [(1, 3), (None, 1), (None, 2), (7, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    e = Tables(spark, str(tmp_path)).edges()
    want = {(p, q) for o, p in rows for x, q in rows if o is not None and o == x and p is not None and q is not None and p < q}
    got = [tuple(r) for r in e.collect()]
    assert len(got) == len(want) and set(got) == want
    assert plan(e).count("Join") == 0  # rows do not meet by a join of the table with itself


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_parts_equal_places(spark, n):
    rows = spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") / 2).cast("long").alias("k"))  # every row twice
    order = hash_order("x", F.col("k"))
    marks = lambda c: [F.floor(c * 0.3), F.floor(c * 0.3) + 1, F.floor(c * 0.9)]
    sizes = rows.groupBy("g").agg(F.count("*").alias("c"))
    placed = folds.numbered(rows, ["g"], order, ["k"]).join(sizes, "g")
    below = sum((m < F.col("place")).cast("int") for m in marks(F.col("c")))
    got = folds.parts_of(rows, ["g"], order, ["k"], marks)
    assert sorted(map(tuple, got.select("g", "k", "part").collect())) == sorted(map(tuple, placed.select("g", "k", below.alias("part")).collect()))


def test_fold_edges_are_moved_for_their_ends_alone(spark):
    f = Tables(spark, SF).folds()
    assert "Exchange" not in f._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert plan(f).count("Generate") == 0  # edges are made once, and read as written


def test_triples_meet_within_groups(spark):
    src = spark.createDataFrame([(1, 2, "x", 0)], "a int, b int, label string, prio int")
    pool = spark.createDataFrame([(3, 2, "x", 0), (4, 2, "y", 0), (4, 2, "z", 0), (5, 2, "x", 0), (5, 2, "y", 0), (2, 2, "y", 0)], "a int, b int, label string, prio int")
    groups = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "A"), (5, "B")], "node int, grp string")
    got = [tuple(r) for r in diagnostics.swap_triples(src, pool).collect()]
    assert sorted(got) == [(1, 2, 4, "x"), (1, 2, 5, "x")]  # each once, whatever its labels
    t = diagnostics.swap_triples(src, pool, groups)
    assert [tuple(r) for r in t.collect()] == [(1, 2, 4, "x")]
    top = next(x for x in plan(t).splitlines() if "Join" in x)
    assert "grp" in top  # the meeting itself asks for one group


def test_small_samples_are_merged(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"))
    want = [r["k"] for r in rows.orderBy(hash_order("5", "t", F.col("k")), "k").limit(50).collect()]
    got = sampling.hash_top(rows, 50, 5, "t", "k")
    assert sorted(r["k"] for r in got.collect()) == sorted(want)
    assert "Limit" in plan(got)


def test_classes_are_told_before_pairs_are_made(spark):
    t = Tables(spark, SF)
    groups = t.groups()
    old = folds.edge_class(t.edges(), groups).select("a", "b", "n_g2").collect()
    new = t.classed_edges(groups)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old))
    assert "Join" not in plan(new).split("Generate")[0]  # no pair is moved for its ends
    cut = {tuple(r) for r in t.folds().select("a", "b", "split").collect() if r["split"].endswith("s2")}
    assert {tuple(r) for r in t.folds(2).select("a", "b", "split").collect()} == cut and cut


def test_draws_are_about_the_number_wanted(spark, monkeypatch):
    assert sampling.likely_draws(10**6, 10**6, 10**6, True, 10**6) < 1.03 * 10**6
    pool = spark.range(300).select(F.col("id").alias("idx"), (F.col("id") * 3).alias("node"))
    known = spark.range(299).select((F.col("id") * 3).alias("a"), (F.col("id") * 3 + 3).alias("b")).localCheckpoint()
    wanted, pools = {"x": (400, 1, "p", "p"), "none": (0, 2, "p", "p"), "y": (90, 3, "p", "p")}, pool.withColumn("pool", F.lit("p"))
    monkeypatch.setattr(sampling, "SMALL", 50)
    drawn = lambda: sorted(map(tuple, sampling.draw_tagged(spark, wanted, pools, known).collect()))
    likely = drawn()
    for told in (lambda n, *more: 3 * n + 1000, lambda n, *more: n // 3):  # more than enough, and too few at first
        monkeypatch.setattr(sampling, "likely_draws", told)
        assert drawn() == likely
    assert [sum(r[0] == tag for r in likely) for tag in wanted] == [400, 0, 90] and len(set(likely)) == 490
    assert not {r[1:] for r in likely} & {(3 * k, 3 * k + 3) for k in range(299)}


def test_interaction_pairs_move_once(spark):
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 5), (5, None), (4, 1)]
    out = features.interaction_edges(spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 6)], "node long"))
    want = {(a, b) for a, b in rows} | {(b, a) for a, b in rows} | {(6, 6)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Generate" in plan(out).split("Aggregate")[0]  # made distinct before they are turned round


def test_edge_lists_hold_the_edges(spark):
    t = Tables(spark, SF)
    got = [(r["a"], b) for r in t.edge_lists().collect() for b in r["bs"]]
    assert sorted(got) == sorted(map(tuple, t.edges().collect()))


def test_prompts_are_joined_from_constants(spark):
    ends, blank = ("x", " x \n", "", " \n", "### Answer: ", None), F.lit(" \n\t\r")
    rows = spark.createDataFrame([(b, e, a) for b in ends for e in (" \n", "e", None) for a in (" Yes", "", None)], "block string, examples string, answer string")
    msg = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    for m in ("zero_shot", "ohs_full", "none_known"):
        note = render.NOTES.get(m, render.KG_NOTE if m in render.SEQUENCE_METHODS else "")
        for family in render.FAMILIES:
            for examples in (None, F.col("examples")):
                user = F.btrim(F.concat(F.lit(note), F.lit("") if examples is None else examples, F.lit(render.CONSTRAINT), "block"), blank)
                want = render.turns(F.array(msg("system", F.lit((render.TASK + render.INSTRUCTION).strip())), msg("user", user), msg("assistant", F.col("answer"))), family)
                got = rows.select(render.prompt(m, family, F.col("block"), examples, F.col("answer")).alias("got"), want.alias("want"))
                assert got.where("NOT got <=> want").count() == 0
    assert "transform" not in plan(rows.select(render.prompt("zero_shot", "gemma", F.col("block")).alias("x")))


def test_equal_prompts_are_digested_once(spark):
    made = rendering_all.r10_all(Tables(spark, SF))
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)  # or the plan is cut
    text = plan(made)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert text.count("md5(") == 11 * len(render.FAMILIES)  # sixteen methods have eleven texts
    methods = {m for m, f, n in (tuple(r) for r in made.groupBy("method", "family").count().collect())}
    assert methods == set(rendering_all.METHODS)


def test_g2_alone_meets_the_rows_of_its_pairs(spark, monkeypatch):
    t, sides = Tables(spark, SF), []
    monkeypatch.setattr(registry, "bounded_broadcast", lambda df: sides.append(df) or df)
    groups = t.groups()
    two = sorted(map(tuple, t.classed_edges(groups, 2).collect()))
    assert {r["g"] for r in sides[0].collect()} == {1}  # nodes of G1 are neither counted nor sent to make no pair
    assert two == sorted(x for x in map(tuple, t.classed_edges(groups).collect()) if x[2] == 2)


def test_xml_is_written_without_indents(spark, monkeypatch):
    paths = []
    fresh = sources_scoring.fresh
    monkeypatch.setattr(sources_scoring, "fresh", lambda t, tag: paths.append(fresh(t, tag)) or paths[-1])
    rows = sources_scoring.s17(Tables(spark, SF))
    assert rows.count() > 0 and len(paths) == 2
    for path in paths:
        assert spark.read.text(path).where("value LIKE ' %'").count() == 0  # unpacked
