"""Table bundles in CSV, Parquet and JSON, with explicit schemas."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EDGE_TYPES, ENTITIES, PATHWAYS, RAW_TABLES


def has_table(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv") if fmt == "csv" else w.parquet(f"{folder}/{name}.parquet"))


def read_table(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    """Parquet if there is one, else CSV with the table's schema; neither is an error."""
    if has_table(spark, f"{folder}/{name}.parquet"):
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if has_table(spark, f"{folder}/{name}.csv"):
        return spark.read.schema(schema or RAW_TABLES[name]).option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    raise FileNotFoundError(f"{folder}/{name}: neither Parquet nor CSV")


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet by the suffix of the path, else CSV with a header."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    r = spark.read.option("header", True).option("escape", '"')
    return (r.schema(schema) if schema is not None else r).csv(path)


def find_one(spark: SparkSession, places: list[str]) -> str:
    """The first place that exists; none is an error that names them all."""
    for p in places:
        if has_table(spark, p):
            return p
    raise FileNotFoundError(f"in none of {places}")


def cached_negatives(spark: SparkSession, folder: str) -> tuple[DataFrame | None, list[DataFrame]]:
    """(static negatives with their split, epochs in order) stored as ``<split>.parquet`` and
    ``epoch_<n>.parquet``.  Static ones count only if all six folds are there; epochs end at the
    first gap."""
    names = [f"{kind}_s{i}" for i in range(3) for kind in ("val", "test")]
    static = None
    if all(has_table(spark, f"{folder}/{n}.parquet") for n in names):
        for n in names:
            one = spark.read.parquet(f"{folder}/{n}.parquet").withColumn("split", F.lit(n))
            static = one if static is None else static.unionByName(one)
    epochs: list[DataFrame] = []
    while has_table(spark, f"{folder}/epoch_{len(epochs)}.parquet"):
        epochs.append(spark.read.parquet(f"{folder}/epoch_{len(epochs)}.parquet"))
    return static, epochs


def load_kg(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.kg import long_view

    schemas = {**{k: ENTITIES[k] for k in ENTITIES}, "pathway": PATHWAYS}
    return long_view({k: read_table(spark, folder, f"drug_{k}s", schemas[k]) for k in EDGE_TYPES})


def write_folds(folds: DataFrame, groups: DataFrame, manifest: dict, folder: str) -> None:
    """Folds partitioned by split, groups, and a manifest with their counts."""
    folds.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/folds")
    groups.write.mode("overwrite").parquet(f"{folder}/groups")
    spark = folds.sparkSession
    written = spark.read.parquet(f"{folder}/folds")  # counted by its folders' files, not made again
    counts = {str(r["split"]): r["n"] for r in written.groupBy("split").agg(F.count("*").alias("n")).collect()}
    spark.createDataFrame([(json.dumps({**manifest, "n_pairs": counts}, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_folds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """Folds, groups and manifest; a manifest without a protocol is a legacy one."""
    m = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    m.setdefault("protocol", "legacy")
    return spark.read.parquet(f"{folder}/folds"), spark.read.parquet(f"{folder}/groups"), m


def load_text_map(spark: SparkSession, path: str) -> DataFrame:
    """(drug_id, text) from one JSON object, read and taken apart by Spark; its size is bounded by that of
    a variant (128 MB).  No object, an empty one, a repeated key, a blank key and a text that is blank or
    no text are errors."""
    raw = spark.read.text(path, wholetext=True)
    sql = """SELECT v.key AS drug_id, CASE WHEN schema_of_variant(v.value) = 'STRING' THEN CAST(v.value AS STRING) END AS text
             FROM {raw}, LATERAL variant_explode(parse_json({raw}.value)) AS v"""
    try:
        out = spark.sql(sql, raw=raw).where("drug_id IS NOT NULL")
        n, odd = out.agg(F.count("*"), F.sum((F.trim("drug_id") == "").cast("int") + (F.coalesce(F.trim("text"), F.lit("")) == "").cast("int"))).first()
    except Exception as e:  # malformed text and repeated keys end the parse
        raise ValueError(f"no JSON object with distinct keys: {str(e)[:200]}") from e
    if not n or odd:
        raise ValueError("expected an object that is not empty, with a text for every key" if not n else f"{odd} keys or texts are blank or no text")
    return out


def write_bytes(data: bytes, path: str, spark: SparkSession) -> None:
    """A file in any store that Spark writes: written beside and renamed in one step, so at no moment is there none."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    to, beside = jvm.Path(path), jvm.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = to.getFileSystem(conf).create(beside, True)
    out.write(bytearray(data))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    how[0] = jvm.Options.Rename.OVERWRITE
    store = jvm.FileContext.getFileContext(to.toUri(), conf)
    store.rename(store.makeQualified(beside), store.makeQualified(to), how)


def write_json(obj, path: str, spark: SparkSession | None = None) -> None:
    """Written beside and renamed, so that a reader sees the old file or the new one; NaN is refused.
    With a session the path may be in any store that Spark writes."""
    text = json.dumps(obj, indent=2, sort_keys=True, allow_nan=False)
    if spark is not None:
        write_bytes(text.encode(), path, spark)
        return
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(tmp, path)


def read_json(spark: SparkSession, path: str):
    """The one JSON value of a file, null if there is no file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if has_table(spark, path) else None


def write_json_rows(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def load_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """CSV files under ``<method>/seed<N>/`` as one table with method and seed."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    name = F.input_file_name()
    return df.withColumn("method", F.regexp_extract(name, r"([^/]+)/seed\d+/", 1)).withColumn("seed", F.regexp_extract(name, r"/seed(\d+)/", 1).cast("int"))


def read_links(spark: SparkSession, path: str, sep: str = " ", columns: str = "src string, dst string, rel string") -> DataFrame:
    """Delimited edge lists, repeated lines once."""
    return spark.read.schema(columns).option("sep", sep).csv(path).distinct()


def dump_release(tables: dict[str, DataFrame], folder: str, mode: str = "full", also_csv: bool = False) -> None:
    if mode not in ("full", "sample"):
        raise ValueError(f"unknown mode {mode!r}")
    named = {(k if mode == "full" else f"{k}_sample"): v for k, v in tables.items()}
    write_tables(named, folder, "parquet")
    if also_csv:
        write_tables(named, folder, "csv")
