"""Runs: what a stage needs, what a prompt was trained for, and whether a folder belongs to a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import has_table, read_json, write_json
from .render import family_of, method_name, method_of, model_family
from .validate import Invalid, file_digests, verify_digests

#: stage -> (file that it reads, stage that writes the file)
NEEDS = {
    "clean": (("raw/drugs.parquet", "extract"), ("raw/edges.parquet", "extract")),
    "label": (("clean/edges.parquet", "clean"),),
}


def missing_inputs(spark: SparkSession, out: str, stages: tuple[str, ...], skip: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(stage, file, producer) of every file that a stage to run needs, a skipped one writes and is not there."""
    unknown = set(skip) - set(stages)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [(s, f, p) for s in stages if s not in skip for f, p in NEEDS.get(s, ()) if p in skip and not has_table(spark, f"{out}/{f}")]


def check_inputs(spark: SparkSession, out: str, stages: tuple[str, ...], skip: tuple[str, ...]) -> None:
    lost = missing_inputs(spark, out, stages, skip)
    if lost:
        raise FileNotFoundError("; ".join(f"{s} needs {out}/{f}, which the skipped {p} writes" for s, f, p in lost))


def prompt_differences(trained: dict, now: dict) -> list[tuple[str, str, str]]:
    """(field, in training, now) where two prompt settings differ: methods by their meaning, tasks as
    written, models by their family.  A field that one side does not give is not compared."""
    meaning = {"method": method_name, "task_name": str, "model_name": model_family}
    shared = [f for f in meaning if trained.get(f) is not None and now.get(f) is not None]
    return [(f, meaning[f](trained[f]), meaning[f](now[f])) for f in shared if meaning[f](trained[f]) != meaning[f](now[f])]


def prompt_audit(rows: DataFrame) -> DataFrame:
    """(key, field, trained, now) where the settings of a row (key, trained, now: structs of method, task_name and
    model_name) differ, by the rules of ``prompt_differences``."""
    meaning = {"method": method_of, "task_name": lambda c: c, "model_name": family_of}
    both = F.array(*[
        F.struct(F.lit(f).alias("field"), F.when(F.col(f"trained.{f}").isNotNull(), m(F.col(f"trained.{f}"))).alias("trained"), F.when(F.col(f"now.{f}").isNotNull(), m(F.col(f"now.{f}"))).alias("now"))
        for f, m in meaning.items()
    ])
    return rows.select("key", F.explode(both).alias("x")).select("key", "x.*").where("trained <> now")


def check_prompt(trained: dict, now: dict) -> None:
    odd = prompt_differences(trained, now)
    if odd:
        raise Invalid("prompts differ from training: " + "; ".join(f"{f}: {a!r} then, {b!r} now" for f, a, b in odd))


class Run:
    """A folder that belongs to one run: its identity is written first, and its finished files with their
    digests; another identity, or a finished file that is gone or changed, is an error."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict):
        self.spark, self.folder = spark, folder
        told = read_json(spark, f"{folder}/identity.json")
        if told is None:
            write_json(identity, f"{folder}/identity.json", spark)
        elif told != identity:
            odd = sorted(k for k in told.keys() | identity.keys() if told.get(k) != identity.get(k))
            raise Invalid(f"{folder} belongs to another run: {odd} differ")

    def problems(self) -> DataFrame:
        """(path, problem) of finished files; path is of the form name/part."""
        done = read_json(self.spark, f"{self.folder}/finished.json") or {}
        told = self.spark.createDataFrame([(f"{n}/{p}", d) for n, parts in done.items() for p, d in parts.items()], "path string, md5 string")
        found = None
        for n in done:
            if has_table(self.spark, f"{self.folder}/{n}"):
                one = file_digests(self.spark, f"{self.folder}/{n}", "part-*").select(F.concat(F.lit(f"{n}/"), "path").alias("path"), "md5")
                found = one if found is None else found.unionByName(one)
        return verify_digests(found if found is not None else told.limit(0), told)

    def check(self) -> None:
        odd = self.problems().limit(20).collect()
        if odd:
            raise Invalid(f"finished files of {self.folder}: " + "; ".join(f"{r['path']} {r['problem']}" for r in odd))

    def finish(self, name: str) -> None:
        """Keep the digests of the files under ``name``: one line for each part file."""
        done = read_json(self.spark, f"{self.folder}/finished.json") or {}
        done[name] = {r["path"]: r["md5"] for r in file_digests(self.spark, f"{self.folder}/{name}", "part-*").select("path", "md5").collect()}
        write_json(done, f"{self.folder}/finished.json", self.spark)
