"""Audits of tables: each is one aggregate (or a few set operations) that a caller may assert on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pair_hi, pair_lo


class Invalid(ValueError):
    """A table breaks its contract."""


def column_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, present) of required columns."""
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in columns], "name string, present boolean")


def required_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, present, n_missing) of required columns: rows without a value, all of them if the column is absent."""
    none = [F.count(F.when(F.col(c).isNull(), 1)) if c in df.columns else F.count("*") for c in columns]
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in df.columns).alias("present"), n.alias("n_missing")) for c, n in zip(columns, none)])
    return df.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Invalid(f"missing columns: {missing}")
    return df


def pair_key_audit(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: null, blank, untrimmed, self and duplicate (in either direction) pairs."""
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    c = lambda p: F.coalesce(F.sum(F.coalesce(p, F.lit(False)).cast("bigint")), F.lit(0))
    base = pairs.agg(
        F.count("*").alias("n"), c(x.isNull() | y.isNull()).alias("n_null"), c((F.trim(x) == "") | (F.trim(y) == "")).alias("n_blank"),
        c((F.trim(x) != x) | (F.trim(y) != y)).alias("n_untrimmed"), c(x == y).alias("n_self"),
    )
    dup = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(pair_lo(x, y).alias("lo"), pair_hi(x, y).alias("hi")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicate"))
    return base.withColumn("__j", F.lit(1)).join(dup.withColumn("__j", F.lit(1)), "__j").drop("__j")


def check_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    row = pair_key_audit(require_columns(pairs, a, b), a, b).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n" and v}
    if bad:
        raise Invalid(f"pair keys: {bad}")
    return pairs


def partition_audit(folds: DataFrame, groups: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """(split, n, n_g2_0, n_g2_1, n_g2_2) of every fold."""
    from .folds import edge_class

    c = edge_class(folds, groups, a, b, node)
    of = lambda k: F.sum((F.col("n_g2") == k).cast("bigint")).alias(f"n_g2_{k}")
    return c.groupBy("split").agg(F.count("*").alias("n"), of(0), of(1), of(2))


def fold_overlap(folds: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(split_x, split_y, n): unordered pairs that two folds have in common."""
    p = folds.select("split", pair_lo(a, b).alias("lo"), pair_hi(a, b).alias("hi")).distinct()
    sets = p.groupBy("lo", "hi").agg(F.array_sort(F.collect_set("split")).alias("s")).where("size(s) > 1")
    x = sets.select("s", F.posexplode("s").alias("i", "split_x"))
    return x.select("split_x", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("split_y")).groupBy("split_x", "split_y").agg(F.count("*").alias("n"))


def prediction_audit(wanted: DataFrame, preds: DataFrame, p: str = "p") -> DataFrame:
    """One row: keys wanted, missing, unexpected, duplicate, not finite, out of [0, 1]."""
    w = wanted.select("a", "b").distinct().withColumn("__w", F.lit(1))
    g = preds.groupBy("a", "b").agg(F.count("*").alias("__c"), F.min(p).alias("__min"), F.max(p).alias("__max"), F.max(F.col(p).isNull().cast("int")).alias("__null"))
    j = w.join(g, ["a", "b"], "full")
    c = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("bigint")), F.lit(0))
    odd = (F.col("__null") == 1) | F.isnan("__max") | (F.abs("__max") == float("inf")) | (F.abs("__min") == float("inf"))
    return j.agg(
        F.count("__w").alias("n_wanted"), c(F.col("__c").isNull()).alias("n_missing"), c(F.col("__w").isNull()).alias("n_unexpected"), c(F.col("__c") > 1).alias("n_duplicate"),
        c(odd).alias("n_not_finite"), c(~odd & ((F.col("__min") < 0) | (F.col("__max") > 1))).alias("n_out_of_range"),
    )


def check_predictions(wanted: DataFrame, preds: DataFrame, partial: bool = False) -> DataFrame:
    row = prediction_audit(wanted, preds).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_wanted" and v and not (partial and k == "n_missing")}
    if bad:
        raise Invalid(f"predictions: {bad}")
    return preds


def kg_audit(kg: DataFrame, nodes: DataFrame, column: str = "drugbank_id", node: str = "drugbank_id") -> DataFrame:
    known = nodes.select(F.col(node).alias(column)).distinct()
    unknown = kg.where(F.col(column).isNotNull()).join(known, column, "left_anti").agg(F.count("*").alias("n_unknown")).withColumn("__j", F.lit(1))
    return kg.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(column).isNull().cast("bigint")), F.lit(0)).alias("n_null")).withColumn("__j", F.lit(1)).join(unknown, "__j").drop("__j")


def annotation_audit(pairs: DataFrame, annotated: DataFrame) -> DataFrame:
    """Cover of the pairs and validity of labels, flags and names of Type A."""
    key = ["drug_a_id", "drug_b_id"]
    missing = pairs.select(*key).join(annotated, key, "left_anti").agg(F.count("*").alias("n_missing")).withColumn("__j", F.lit(1))
    c = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("bigint")), F.lit(0))
    nameless = F.col("has_key_entity") & ((F.coalesce(F.trim("key_entity_name"), F.lit("")) == "") | F.col("key_entity_type").isNull())
    own = annotated.agg(
        F.count("*").alias("n"), c(F.col("has_key_entity").isNull()).alias("n_no_flag"), c(~F.col("pk_pd_label").isin("PK", "PD", "Mixed", "Unknown")).alias("n_bad_label"), c(nameless).alias("n_nameless"),
    )
    return own.withColumn("__j", F.lit(1)).join(missing, "__j").drop("__j")


def negative_overlap(negatives: DataFrame, train: DataFrame) -> DataFrame:
    """(split, n, n_in_train) of the negatives of each fold."""
    t = train.select(pair_lo("a", "b").alias("lo"), pair_hi("a", "b").alias("hi")).distinct().withColumn("__t", F.lit(1))
    j = negatives.withColumn("lo", pair_lo("a", "b")).withColumn("hi", pair_hi("a", "b")).join(t, ["lo", "hi"], "left")
    return j.groupBy("split").agg(F.count("*").alias("n"), F.count("__t").alias("n_in_train"))


def fingerprint(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """An order-free digest of a table: the sum of row hashes, with the row count."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(*(by or [])).agg(F.sum(h).alias("digest"), F.count("*").alias("n"))


def file_digests(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, md5, bytes) of files, read by Spark so that any store works."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.md5("content").alias("md5"), F.col("length").alias("bytes"))


def verify_digests(found: DataFrame, told: DataFrame) -> DataFrame:
    """(path, problem) for missing, extra, changed, duplicate and unsafe paths of a manifest."""
    names = told.groupBy("path").agg(F.count("*").alias("c"), F.first("md5").alias("want"))
    j = names.join(found.select("path", "md5"), "path", "full")
    unsafe = F.col("path").startswith("/") | F.col("path").contains("..")
    problem = (
        F.when(unsafe, "unsafe").when(F.col("c") > 1, "duplicate").when(F.col("md5").isNull(), "missing").when(F.col("want").isNull(), "extra")
        .when(F.col("want") != F.col("md5"), "changed")
    )
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")
