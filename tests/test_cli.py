"""The command line end to end on a small graph, and on a document without any survivor."""

import random

from test_sources import DOC

from pairloom import cli


def test_folds_and_diagnose(spark, tmp_path):
    g = random.Random(5)
    pairs = sorted({tuple(sorted(g.sample(range(50), 2))) for _ in range(250)})
    d = str(tmp_path)
    spark.createDataFrame(pairs, "a long, b long").write.parquet(f"{d}/edges")
    cli.main(["folds", "--edges", f"{d}/edges", "--out", f"{d}/f"])
    assert spark.read.parquet(f"{d}/f/folds").count() == len(pairs)
    want = spark.read.parquet(f"{d}/f/folds").where("split <> 'train'").count()
    assert spark.read.parquet(f"{d}/f/negatives").count() == want
    cli.main(["score", "--pairs", f"{d}/edges", "--out", f"{d}/s"])
    assert spark.read.parquet(f"{d}/s").where("p between 0 and 1").count() == len(pairs)


def test_reconstruct(spark, tmp_path):
    p = tmp_path / "x.xml"
    p.write_text(DOC)
    cli.main(["reconstruct", "--xml", str(p), "--out", str(tmp_path / "o")])
    stats = spark.read.parquet(str(tmp_path / "o/clean/stats.parquet"))
    assert stats.count() == 8 and stats.where("step = 0").first()["n_drugs"] == 2
    assert spark.read.parquet(str(tmp_path / "o/labels/pkpd.parquet")).columns[1] == "pk_pd_label"
