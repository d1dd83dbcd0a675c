"""Mixing sources to target weights: iterative proportional fitting (raking).

Token weights of the cells source x language x topic are scaled in turn to each target marginal
until all agree.  A document is then sampled with a probability in proportion to its cell's
calibrated weight over its observed tokens, by a hash of its key.

Cells and targets are tables, set up once.  Few cells rake on the driver, many on tables; both go
the same rounds by the same rules and give the same weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize

#: Cells up to which raking runs on the driver and the weights are broadcast (about 20 MB).
DRIVER_CELLS = 100_000
#: Rounds at most, and the greatest distance of a marginal from its target that ends them; rounds
#: that no longer change that distance (targets that exclude each other) end too.
ROUNDS, TOL = 200, 1e-9
#: Halvings of the scale of probabilities.
HALVINGS = 60
NULL = "\0null"
#: The published split pattern of byte-level vocabularies (fixed value): its parts are counted.
PRETOKENS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++"


def tokens_of(text: Column) -> Column:
    """Pre-tokens of a text by the published split, as a measure of its tokens that costs no
    vocabulary; 0 for null or empty text.  Any other count of tokens may be given to ``mix``."""
    return F.coalesce(F.regexp_count(text, F.lit(PRETOKENS)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form, for tables without a topic column."""
    return (
        F.when(text.contains(" | "), "tabular").when(text.contains("icense"), "legal").when(text.contains("***") | text.contains("!! "), "marked")
        .when(F.length(text) > 4000, "long prose").otherwise("prose")
    )


def rake(index: np.ndarray, share: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tol: float = TOL) -> np.ndarray:
    """Weights (sum 1) of cells of observed ``share`` whose marginals are the targets.

    ``index``: (cells, dims) value numbers.  A value whose cells have all become 0 stays 0, so targets
    that exclude each other are met as far as they can; if nothing is left, all weights are 0.
    """
    w, before = share.copy(), np.inf
    for _ in range(rounds):
        off = 0.0
        for d, target in enumerate(targets):
            have = np.bincount(index[:, d], w, len(target))
            off = max(off, np.abs(have - target).max())
            w = w * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[index[:, d]]
        if off < tol or abs(before - off) < tol / 10:
            break
        before = off
    return w / w.sum() if w.sum() > 0 else w


def rake_tables(cells: DataFrame, dims: list[str], targets: DataFrame, rounds: int = ROUNDS, tol: float = TOL) -> DataFrame:
    """The same on tables: ``cells`` (dims, share) with ``w``; ``targets``: dim, value, want.

    Cells are never rewritten: a cell's weight is its share times one factor of each dim, and the
    factors, a row for each value, are the only thing that a step writes.
    """
    factors: dict[str, DataFrame] = {}

    def weighted() -> DataFrame:
        out, w = cells, F.col("share")
        for d, f in factors.items():
            out, w = out.join(f.withColumnRenamed("factor", f"__f{d}"), d), w * F.col(f"__f{d}")
        return out.select(*dims, "share", w.alias("w"))

    sizes = {r["dim"]: r["count"] for r in targets.groupBy("dim").count().collect()}
    before = np.inf
    for _ in range(rounds):
        off = 0.0
        for d in dims:
            have = weighted().groupBy(d).agg(F.sum("w").alias("have"))
            want = targets.where(F.col("dim") == d).select(F.col("value").alias(d), "want")
            step = F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0)
            moved = have.join(want, d).select(d, F.abs(F.col("have") - F.col("want")).alias("off"), step.alias("step"))
            if d in factors:
                moved = moved.join(factors[d], d).select(d, "off", (F.col("step") * F.col("factor")).alias("factor"))
            else:
                moved = moved.withColumnRenamed("step", "factor")
            moved = materialize(moved, "rake")
            off = max(off, moved.agg(F.max("off")).first()[0] or 0.0)
            factors[d] = bounded_broadcast(moved.select(d, "factor"), sizes.get(d, 0))
        if off < tol or abs(before - off) < tol / 10:
            break
        before = off
    done = materialize(weighted(), "raked")
    total = done.agg(F.sum("w")).first()[0] or 0.0
    return done.withColumn("w", F.col("w") / total) if total > 0 else done


def wanted(cells: DataFrame, dims: dict[str, float | dict[str | None, float]], named: dict[str, str]) -> DataFrame:
    """(dim, value, want): the target of every value that occurs, with sum 1 for each dim.

    A power tempers the observed shares: 1 keeps them, 0 makes them equal.  With a dict, values that
    it does not name get 0, and those of absent values are shared out in proportion; where no value
    that occurs is named, all are wanted alike.
    """
    spark = cells.sparkSession
    out = None
    for d, told in dims.items():
        seen = cells.groupBy(F.col(named[d]).alias("value")).agg(F.sum("share").alias("s"))
        if isinstance(told, dict):
            listed = spark.createDataFrame([(NULL if v is None else v, max(float(x), 0.0)) for v, x in told.items()], "value string, raw double")
            raw = seen.join(bounded_broadcast(listed, len(told)), "value", "left").select("value", F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            raw = seen.select("value", F.pow("s", F.lit(float(told))).alias("raw"))
        total, count = raw.agg(F.sum("raw"), F.count("*")).first()
        one = raw.select(F.lit(named[d]).alias("dim"), "value", (F.col("raw") / F.lit(total) if total else F.lit(1.0 / max(count, 1))).alias("want"))
        out = one if out is None else out.unionAll(one)
    return materialize(out, "targets")


def scale_for(kept, low_weight: float, reachable: float, keep: float) -> float:
    """The scale s at which the share kept, ``kept(s)`` = sum(share * min(1, s * weight)), is ``keep``.
    ``low_weight``: the smallest weight above 0; ``reachable``: the share of cells with one."""
    if reachable <= 0:
        return 0.0
    low, high = 0.0, 1.0 / max(low_weight, 1e-12)
    if reachable <= keep:
        return high
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < keep else (low, mid)
    return high


def mix(
    rows: DataFrame, dims: dict[str, float | dict[str | None, float]], keep: float = 0.5, key: str = "doc_id", tokens: str = "n_tokens", seed: str = "mix",
    driver_cells: int = DRIVER_CELLS, prefix: str = "",
) -> DataFrame:
    """``rows`` with weight (calibrated share of the cell over its observed share), prob and sampled.

    ``dims``: columns to rake and their targets, each a dict of shares or a power that tempers the
    observed shares (``wanted`` says what becomes of values without a target or a row).  ``keep``:
    expected share of tokens sampled; probabilities end at 1.  A null value of a dim is a value of its
    own (None in a dict).  Rows without tokens follow their cell; cells without any count as 1e-9 of a
    token.  Equal rows share their draw, rows with a null key another one.  Nothing is dropped here:
    ``sampled`` marks the sample.  ``prefix`` goes before the names of the three new columns; columns
    of ``rows`` already so named are replaced.  Cells are aggregated with partial sums; their weights
    are broadcast within the bound, else joined.
    """
    spark = rows.sparkSession
    weight, prob, sampled = (prefix + c for c in ("weight", "prob", "sampled"))
    named = {d: f"__dim{i}" for i, d in enumerate(dims)}
    names = list(named.values())
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (weight, prob, sampled)]
    told = rows.withColumns({n: F.coalesce(F.col(d).cast("string"), F.lit(NULL)) for d, n in named.items()})
    mass = F.greatest(F.coalesce(F.sum(F.col(tokens).cast("double")), F.lit(0.0)), F.lit(1e-9))
    cells = materialize(told.groupBy(*names).agg(mass.alias("mass")), "cells")
    few, total = cells.agg(F.count("*"), F.sum("mass")).first()
    if few == 0:
        return rows.select(*rest, F.lit(0.0).alias(weight), F.lit(0.0).alias(prob), F.lit(False).alias(sampled))
    cells = cells.select(*names, (F.col("mass") / F.lit(total)).alias("share"))
    targets = wanted(cells, dims, named)
    if few <= driver_cells:
        got = cells.orderBy(*names).collect()
        share = np.array([r["share"] for r in got])
        index, want = np.empty((len(got), len(names)), int), []
        goals: dict[str, dict[str, float]] = {n: {} for n in names}
        for r in targets.collect():
            goals[r["dim"]][r["value"]] = r["want"]
        for k, n in enumerate(names):
            values = sorted(goals[n])
            at = {v: i for i, v in enumerate(values)}
            index[:, k] = [at[r[n]] for r in got]
            want.append(np.array([goals[n][v] for v in values]))
        ratio = rake(index, share, want) / share
        some = ratio > 0
        scale = scale_for(lambda s: (share * np.minimum(1, s * ratio)).sum(), ratio[some].min(initial=np.inf), share[some].sum(), keep)
        out = [(*[r[n] for n in names], float(a), float(min(1.0, scale * a))) for r, a in zip(got, ratio, strict=True)]
        weights = spark.createDataFrame(out, ", ".join([*(f"{n} string" for n in names), "__weight double, __prob double"]))
    else:
        done = materialize(rake_tables(cells, names, targets).withColumn("__weight", F.col("w") / F.col("share")), "weights")
        low, reach = done.where("__weight > 0").agg(F.min("__weight"), F.coalesce(F.sum("share"), F.lit(0.0))).first()
        kept = lambda s: done.agg(F.sum(F.col("share") * F.least(F.lit(1.0), F.col("__weight") * F.lit(s)))).first()[0]
        scale = scale_for(kept, low or 0.0, reach, keep)
        weights = done.select(*names, "__weight", F.least(F.lit(1.0), F.col("__weight") * F.lit(scale)).alias("__prob"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) * (2.0**-53)
    out = told.join(bounded_broadcast(weights, few, max(DRIVER_CELLS, 1)), names)
    return out.select(*rest, F.col("__weight").alias(weight), F.col("__prob").alias(prob), (draw < F.col("__prob")).alias(sampled))
