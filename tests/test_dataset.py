"""The check of a whole dataset, and of prompt settings."""

import pytest

from pairloom.operators import dataset as DS
from pairloom.operators import runs
from pairloom.operators.validate import Invalid, required_values


def tables(spark):
    df = spark.createDataFrame
    edges = [("a", "b", "t"), ("a", "c", "u"), ("c", "d", "t"), ("x", "a", "t")]
    return {
        "edges": df(edges, "a string, b string, ddi_type string"),
        "folds": df([("b", "a", "train"), ("a", "c", "train"), ("c", "d", "val_s0"), ("a", "x", "test_s1")], "a string, b string, split string"),
        "groups": df([(n, "G2" if n == "x" else "G1") for n in "abcdx"], "node string, grp string"),
        "negatives": df([("b", "c", "train"), ("b", "d", "train"), ("a", "d", "val_s0"), ("b", "x", "test_s1")], "a string, b string, split string"),
        "epochs": df([(0, "b", "c"), (0, "d", "a"), (1, "b", "d"), (1, "c", "b")], "epoch int, a string, b string"),
        "counts": df([(1, 9, 9, 9), (2, 5, 4, 2)], "step int, n_drugs int, n_edges int, n_types int"),
        "nodes": df([(n,) for n in "abcdx"], "node string"),
    }


def test_a_sound_dataset_has_no_problem(spark):
    assert DS.dataset_problems(**tables(spark)).collect() == []
    DS.check_dataset(**tables(spark))


def test_each_problem_is_told(spark):
    t, df = tables(spark), spark.createDataFrame
    t["folds"] = df([("b", "a", "train"), ("a", "c", "train"), ("a", "d", "val_s0"), ("a", "x", "test_s1")], "a string, b string, split string")
    t["negatives"] = t["negatives"].where("split <> 'val_s0'")
    t["epochs"] = df([(0, "b", "a"), (0, "d", "a"), (0, "a", "d"), (1, "b", "x")], "epoch int, a string, b string")
    t["counts"] = df([(2, 5, 7, None)], "step int, n_drugs int, n_edges int, n_types int")
    got = sorted(tuple(r) for r in DS.dataset_problems(**t).collect())
    assert got == [
        ("epoch has an edge", "0", 1), ("epoch outside G1", "1", 1), ("epoch size", "1", 1), ("not an edge", "", 1), ("not in a fold", "", 1), ("not one to one", "val_s0", 1),
        ("stored count", "n_edges", 3), ("stored count", "n_types", 2),
    ]
    with pytest.raises(Invalid, match="not in a fold"):
        DS.check_dataset(**t)
    with pytest.raises(Invalid, match="stored count n_drugs: 81"):
        DS.check_dataset(**tables(spark), profile="toy")


def test_prompt_settings_by_rows(spark):
    rows = [("zero_shot", "t", "Qwen"), ("Zero_Shot_Sequence", None, "Llama"), (None, "t", None), ("", "t", "other"), ("DESC_only", "s", "gemma")]
    pairs = [(f"{i}-{j}", a, b) for i, a in enumerate(rows) for j, b in enumerate(rows)]
    kind = "struct<method:string,task_name:string,model_name:string>"
    got = sorted(tuple(r) for r in runs.prompt_audit(spark.createDataFrame(pairs, f"key string, trained {kind}, now {kind}")).collect())
    names = ("method", "task_name", "model_name")
    assert got == sorted((k, *d) for k, a, b in pairs for d in runs.prompt_differences(dict(zip(names, a)), dict(zip(names, b))))


def test_required_values(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert [tuple(r) for r in required_values(df, ["a", "b", "c"]).collect()] == [("a", True, 1), ("b", True, 2), ("c", False, 2)]
