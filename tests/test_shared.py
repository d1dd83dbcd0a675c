"""Shared entities and mediators: whole results, and one shuffled row for a pair, not one for each entity of its ends."""

from pyspark.sql import functions as F

from pairloom.operators import annotate, folds, kg


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_neighbours_meet_as_arrays(spark):
    rows = [("u", "t", "1", "One"), ("u", "t", "1", None), ("u", "t", "2", "Two"), ("v", "t", "1", "Uno"), ("v", "e", "2", "Two"), ("v", "t", None, "N"), ("u", "t", None, "N"), ("w", "t", "2", "Two")]
    bound = spark.createDataFrame(rows, "node string, edge_type string, entity_id string, entity_name string")
    pairs = spark.createDataFrame([("u", "v"), ("u", "v"), ("u", "w"), ("v", "w"), ("u", "x")], "a string, b string")
    out = kg.shared_neighbours(bound, pairs)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("u", "v", "t", "1", "One"), ("u", "v", "t", "1", None), ("u", "w", "t", "2", "Two")], key=str)
    assert "array_intersect" in plan(out)


def test_mediators_meet_as_arrays(spark):
    rows = [("u", "enzyme", "1", "A", "inhibitor", 0), ("u", "enzyme", "1", "B", "inducer", 1), ("v", "enzyme", "1", "C", "substrate", 3), ("v", "enzyme", None, "D", "substrate", 0)]
    bound = spark.createDataFrame(rows, "node string, edge_type string, entity_id string, entity_name string, action string, pos int")
    pairs = spark.createDataFrame([("u", "v", "metabolism")], "a string, b string, ddi_type string")
    out = annotate.pk_mediators(pairs, bound)
    r = out.first()
    assert (r["key_entity_id"], r["key_entity_name"], r["rank_sum"], r["n_candidates"]) == ("1", "A", 3, 1) and "array_intersect" in plan(out)


def test_legacy_places_are_sorted_in_buckets_of_the_hash(spark, monkeypatch):
    """Anchors and others are numbered by the digits of their hashes, not by a mark before them."""
    edges = spark.createDataFrame([(x, y) for x in range(40) for y in range(x + 1, 40)], "a long, b long")
    groups = folds.node_groups(spark.range(40).withColumnRenamed("id", "node"), 3)
    plain, seen = folds.numbered, []

    def counted(rows, by, order, ties, *more, **named):
        seen.append(rows.groupBy(F.substring(order, 1, 2)).count().count())
        return plain(rows, by, order, ties, *more, **named)

    monkeypatch.setattr(folds, "numbered", counted)
    out = folds.legacy_folds(edges, groups, 3)
    assert out.count() == 780 and seen[-1] > 100
