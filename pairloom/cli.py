"""Command line: reconstruct, folds, diagnose, aggregate, validate and score.

    python -m pairloom.cli reconstruct --xml FILE --out DIR
    python -m pairloom.cli folds --edges PARQUET --out DIR [--seed N] [--protocol fair|legacy]
    python -m pairloom.cli score --pairs PARQUET --scorer NAME --out DIR
    python -m pairloom.cli diagnose --triples PARQUET --predictions PARQUET --out DIR
    python -m pairloom.cli aggregate --runs DIR --out DIR
    python -m pairloom.cli validate --pairs PARQUET
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, cleaning, diagnostics, folds, metrics, runs, sampling, scoring, validate
from .sources import tables, xml

STAGES = ("extract", "clean", "label")


def reconstruct(spark: SparkSession, path: str, out: str, skip: tuple[str, ...] = ()) -> None:
    """XML to raw tables, cleaned tables and type labels.  A skipped stage's tables must be there."""
    runs.check_inputs(spark, out, STAGES, skip)
    names = ("enzymes", "targets", "transporters", "carriers", "pathways")
    if "extract" not in skip:
        tables.write_tables(xml.parse(spark, path).named(), f"{out}/raw", "parquet")
    if "clean" not in skip:
        raw = {n: tables.read_table(spark, f"{out}/raw", n) for n in ("drugs", "edges", *names)}
        edges = raw["edges"].withColumn("ord", F.struct("doc_ord", "pos"))
        done = cleaning.clean(raw["drugs"], edges, {n: raw[n] for n in names})
        cleaning.write_bundle(done, f"{out}/bundle")
        tables.write_tables({"drugs": done.drugs, "edges": done.edges.drop("ord"), **done.aux, "type_text": done.type_text, "stats": done.stats}, f"{out}/clean", "parquet")
    if "label" not in skip:
        tables.write_tables({"pkpd": annotate.label_types(tables.read_table(spark, f"{out}/clean", "edges"))}, f"{out}/labels", "parquet")


def make_folds(spark: SparkSession, edges: DataFrame, out: str, seed: int, protocol: str | None) -> None:
    p = folds.resolve_protocol(protocol)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    groups = folds.node_groups(nodes, seed, protocol=p)
    cut = folds.fair_folds if p["protocol"] == "fair" else folds.legacy_folds
    f = cut(edges, groups, seed).select("a", "b", "split")
    tables.write_folds(f, groups, {"seed": seed, **p}, out)
    stored, g, _ = tables.read_folds(spark, out)
    sampling.static_negatives(spark, stored, g, seed).write.mode("overwrite").partitionBy("split").parquet(f"{out}/negatives")


def diagnose(triples: DataFrame, preds: DataFrame, out: str) -> None:
    table = diagnostics.kps_f(triples, preds).unionByName(diagnostics.channel_deltas(triples, preds)).unionByName(diagnostics.ksai(triples, preds))
    table.write.mode("overwrite").parquet(f"{out}/indicators")
    diagnostics.ab_gap(table).write.mode("overwrite").parquet(f"{out}/ab_gap")
    diagnostics.coverage(triples, preds).write.mode("overwrite").parquet(f"{out}/coverage")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    for name, needed in {"reconstruct": ("xml", "out"), "folds": ("edges", "out"), "score": ("pairs", "out"), "diagnose": ("triples", "predictions", "out"), "aggregate": ("runs", "out"), "validate": ("pairs",)}.items():
        s = sub.add_parser(name)
        for n in needed:
            s.add_argument(f"--{n}", required=True)
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--protocol")
        s.add_argument("--scorer", default="hash_baseline")
        s.add_argument("--skip", nargs="*", default=[])
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "reconstruct":
        reconstruct(spark, a.xml, a.out, tuple(a.skip))
    elif a.what == "folds":
        make_folds(spark, spark.read.parquet(a.edges), a.out, a.seed, a.protocol)
    elif a.what == "score":
        scoring.scored(spark.read.parquet(a.pairs), scoring.scorer(a.scorer)).write.mode("overwrite").parquet(a.out)
    elif a.what == "diagnose":
        diagnose(spark.read.parquet(a.triples), spark.read.parquet(a.predictions), a.out)
    elif a.what == "aggregate":
        seeds = tables.load_runs(spark, a.runs, "indicator string, bucket string, value double, std double, n bigint")
        metrics.seed_rollup_all(seeds, ["method", "indicator", "bucket"]).write.mode("overwrite").parquet(a.out)
    else:
        validate.check_pairs(spark.read.parquet(a.pairs))


if __name__ == "__main__":
    main()
