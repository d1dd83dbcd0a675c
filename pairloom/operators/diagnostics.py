"""Sensitivity indicators over swapped pairs.

Predictions are (cond, a, b, p) with directed keys; a lookup falls back to the reversed key only if
the key itself is absent.  Two equi joins do that; there is no join on either-or.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import staged

# Primary buckets, and the pairs of conditions of each channel indicator.
PRIMARY = ("PK-A", "PK-B", "PD-A", "PD-B")
BUCKETS = (*PRIMARY, "ALL")
CHANNELS = (("KPS-Name", "R0", "R1"), ("KPS-KG", "R0", "R2"), ("KPS-KG-Named", "R0", "R2"), ("KPS-KG-Masked", "R1", "R3"), ("KPS-Name-KGMasked", "R2", "R3"))


def bucket_of(label: Column, has_entity: Column) -> Column:
    """PK-A, PK-B, PD-A, PD-B; Other for any other label."""
    return F.when(label.isin("PK", "PD"), F.concat(label, F.when(has_entity, "-A").otherwise("-B"))).otherwise("Other")


def with_score(rows: DataFrame, preds: DataFrame, out: str, a: str = "a", b: str = "b", p: str = "p") -> DataFrame:
    """Rows with ``out`` and ``out``_found: the directed prediction, else the reversed one."""
    exact = preds.select(F.col("a").alias(a), F.col("b").alias(b), F.col(p).alias("__x"), F.lit(True).alias("__fx"))
    back = preds.select(F.col("b").alias(a), F.col("a").alias(b), F.col(p).alias("__y"), F.lit(True).alias("__fy"))
    j = rows.join(exact, [a, b], "left").join(back, [a, b], "left")
    fx = F.coalesce("__fx", F.lit(False))
    return j.withColumns({out: F.when(fx, F.col("__x")).otherwise(F.col("__y")), f"{out}_found": fx | F.coalesce("__fy", F.lit(False))}).drop("__x", "__y", "__fx", "__fy")


def swap_triples(source: DataFrame, pool: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Distinct (qa, qb, qa_prime, label_uv): replacements u' of u that carry the other label with v.

    ``source``, ``pool``: (a, b, label, prio), smaller prio first.  Both are read in both directions;
    a directed key keeps its first label in the source.  u' is neither u nor v and in u's group.
    A hub v with many partners on both sides yields as many triples as it must; the optimiser splits
    its skewed join.
    """
    both = lambda t: t.select("a", "b", "label", "prio").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), "label", "prio"))
    base, other, keys = both(source), both(pool).where("a <> b").select(F.col("a").alias("up"), "b", "label"), ["b"]
    if groups is not None:
        # groups go to the ends before these meet, so that only members of one group do
        g, keys = groups.select("node", "grp"), ["b", "grp"]
        base, other = base.join(g.withColumnRenamed("node", "a"), "a"), other.join(g.withColumnRenamed("node", "up"), "up")
    base = base.groupBy("a", *keys).agg(F.min_by("label", "prio").alias("label"))
    # each replacement once, with its least and greatest label: one of its labels is another one if either is
    other = other.groupBy("up", *keys).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    j = base.join(other, keys).where("(label <> low OR label <> high) AND up <> a")
    return j.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("up").alias("qa_prime"), F.col("label").alias("label_uv"))


def swap_ends(source: DataFrame, pool: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(node, b, grp, label, low, high) of each directed key (node, b): its label in the source, and its least and greatest
    label in the pool, null where it is not there.  ``source`` and ``pool`` as for ``swap_triples``."""
    both = lambda t: t.select("a", "b", "label", "prio").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), "label", "prio")).withColumnRenamed("a", "node")
    base = both(source).groupBy("node", "b").agg(F.min_by("label", "prio").alias("label")).where("label IS NOT NULL")
    other = both(pool).where("node <> b").groupBy("node", "b").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low IS NOT NULL")
    ends = base.join(other, ["node", "b"], "full").where("node IS NOT NULL AND b IS NOT NULL")
    if groups is None:
        return ends.select("node", "b", F.lit(0).alias("grp"), "label", "low", "high")
    return ends.join(groups.select("node", "grp").where("grp IS NOT NULL"), "node").select("node", "b", "grp", "label", "low", "high")


def swap_numbers(ends: DataFrame) -> DataFrame:
    """(node, b, label, replaced, n): in how many triples of ``swap_triples`` a key is the pair whose node is replaced, and
    in how many the replacement (two rows, if it is in source and pool).  No triple is made.

    Pairs at b and replacements of one group meet unless the replacement has the pair's label alone, so n is the number
    of all at b, less those of that one label, less the key itself."""
    pair = F.struct(F.lit(True).alias("replaced"), F.col("label").alias("one"))
    instead = F.struct(F.lit(False).alias("replaced"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("one"))
    parts = F.filter(F.array(F.when(F.col("label").isNotNull(), pair), F.when(F.col("low").isNotNull(), instead)), lambda x: x.isNotNull())
    rows = ends.select("node", "b", "grp", "label", "low", "high", F.explode(parts).alias("x")).select("*", "x.*").drop("x")
    at, like, replaced = W.partitionBy("b", "grp"), W.partitionBy("b", "grp", "one"), F.col("replaced")
    count = lambda x, of: F.count(F.when(x, 1)).over(of)
    rows = rows.withColumns({"__pairs": count(replaced, at), "__others": count(~replaced, at)})
    rows = rows.withColumns({"__like_pairs": count(replaced, like), "__like_others": count(~replaced, like)})
    own = F.coalesce((F.col("label") != F.col("low")) | (F.col("label") != F.col("high")), F.lit(False)).cast("long")
    n = F.when(replaced, F.col("__others") - F.col("__like_others")).otherwise(F.col("__pairs") - F.col("__like_pairs")) - own
    return rows.select("node", "b", "label", "replaced", n.alias("n"))


def summarise(deltas: DataFrame, by: str = "indicator") -> DataFrame:
    """(indicator, bucket, value, std, n): primary buckets, and ALL over positives alone.  NaN deltas
    count in n but not in the mean; one row has deviation 0."""
    primary = deltas.where(F.col("bucket").isin(*PRIMARY)).select(by, "bucket", "delta")
    whole = deltas.where("label = 1").select(by, F.lit("ALL").alias("bucket"), "delta")
    v = F.nanvl("delta", F.lit(None).cast("double"))
    out = primary.unionByName(whole).groupBy(by, "bucket").agg(F.avg(v).alias("value"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    return out.select(F.col(by).alias("indicator"), "bucket", "value", "std", "n")


def kps_f(triples: DataFrame, preds: DataFrame, cond: str = "R0", name: str = "KPS-F") -> DataFrame:
    """Mean absolute change of the score when u is swapped for u', over triples with both scores.

    ``triples``: (qa, qb, qa_prime, label, bucket)."""
    p = preds.where(F.col("cond") == cond)
    t = with_score(triples, p, "s0", "qa", "qb")
    t = with_score(t, p, "s1", "qa_prime", "qb")
    kept = t.where("s0_found AND s1_found").select(F.lit(name).alias("indicator"), "bucket", "label", F.abs(F.col("s0") - F.col("s1")).alias("delta"))
    return summarise(kept)


def swap_sensitivity(source: DataFrame, pool: DataFrame, groups: DataFrame | None, preds: DataFrame, bucket: Callable[[Column, Column], Column], cond: str = "R0", name: str = "KPS-F") -> DataFrame:
    """What ``kps_f`` gives over ``swap_triples``, without a triple: ``bucket`` is that of a pair (u, v).

    All replacements of u at v carry the other label (labels are 0 and 1) and lie in u's group.  Sorted by score with
    running counts and sums, they give every pair its sum of distances and of squares; u itself, if it carries both
    labels with v, is taken off.  A hub with n pairs and m replacements costs a sort of n + m rows, not n times m.
    """
    both = lambda t: t.select("a", "b", "label", "prio").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), "label", "prio"))
    p = preds.where(F.col("cond") == cond)
    base = both(source).groupBy("a", "b").agg(F.min_by("label", "prio").alias("label")).where("label IN (0, 1)")
    other = both(pool).where("label IN (0, 1) AND a <> b").select("a", "b", F.col("label").alias("side")).distinct()
    known = lambda c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")).isNotNull(), F.lit(False)).cast("long")
    base = with_score(base, p, "s").where("s_found").select("a", "b", "label", (1 - F.col("label")).alias("side"), F.col("s").cast("double").alias("s"))
    other = with_score(other, p, "s").where("s_found").select("a", "b", "side", F.col("s").cast("double").alias("s"))
    own = other.select("a", "b", "side", F.col("s").alias("own"), F.lit(1).cast("long").alias("has"))
    base = base.join(own, ["a", "b", "side"], "left")
    if groups is not None:
        g = groups.select(F.col("node").alias("a"), "grp")
        base, other = base.join(g, "a"), other.join(g, "a")
    else:
        base, other = base.withColumn("grp", F.lit(0)), other.withColumn("grp", F.lit(0))
    cast = {"label": "int", "own": "double", "has": "long"}
    rows = staged(
        base.withColumn("kind", F.lit(0)).unionByName(other.withColumn("kind", F.lit(1)).withColumns({c: F.lit(None).cast(t) for c, t in cast.items()})).withColumn("fine", known(F.col("s"))), "swaps"
    )
    whole = W.partitionBy("b", "grp", "side")
    upto = whole.orderBy("s", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    there, mine = F.col("kind") == 1, (F.col("kind") == 1) & (F.col("fine") == 1)
    add = lambda c, of: F.coalesce(F.sum(F.when(mine, c)).over(of), F.lit(0))
    v = F.col("s")
    sums = rows.withColumns({
        "n_all": F.count(F.when(there, 1)).over(whole), "n": add(F.lit(1), whole), "sum": add(v, whole), "squares": add(v * v, whole), "below": add(F.lit(1), upto), "below_sum": add(v, upto),
    }).where("kind = 0")
    gap = F.when(F.col("has").isNotNull() & (known(F.col("own")) == 1), F.abs(v - F.col("own")))
    taken = F.when(gap.isNotNull(), 1).otherwise(0)
    scored = F.col("fine") == 1
    per = sums.select(
        bucket(F.col("a"), F.col("b")).alias("bucket"), "label", (F.col("n_all") - F.coalesce("has", F.lit(0))).alias("n_all"), F.when(scored, F.col("n") - taken).otherwise(0).alias("n"),
        F.when(scored, v * (2 * F.col("below") - F.col("n")) - 2 * F.col("below_sum") + F.col("sum") - F.coalesce(gap, F.lit(0.0))).otherwise(0.0).alias("far"),
        F.when(scored, F.col("n") * v * v - 2 * v * F.col("sum") + F.col("squares") - F.coalesce(gap * gap, F.lit(0.0))).otherwise(0.0).alias("far2"),
    ).where("n_all > 0")
    out = per.where(F.col("bucket").isin(*PRIMARY)).unionByName(per.where("label = 1").withColumn("bucket", F.lit("ALL")))
    total = out.groupBy("bucket").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("k"), F.sum("far").alias("far"), F.sum("far2").alias("far2"))
    mean = F.when(F.col("k") > 0, F.col("far") / F.col("k"))
    spread = F.when(F.col("k") > 1, F.sqrt(F.greatest(F.col("far2") - F.col("far") * mean, F.lit(0.0)) / (F.col("k") - 1))).otherwise(F.lit(0.0))
    return total.select(F.lit(name).alias("indicator"), "bucket", mean.alias("value"), spread.alias("std"), F.col("n_all").alias("n"))


def base_pairs(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(F.min("bucket").alias("bucket"), F.min("label").alias("label"))


def with_conditions(pairs: DataFrame, preds: DataFrame, conds: list[str]) -> DataFrame:
    """A score column for each condition, all looked up at once: predictions are made wide by key, so
    that two joins do for any number of conditions."""
    wide = preds.groupBy("a", "b").agg(*[F.max(F.when(F.col("cond") == c, F.struct(F.col("p").alias("p")))).alias(c) for c in conds])
    exact = wide.select("a", "b", *[F.col(c).alias(f"__x{c}") for c in conds])
    back = wide.select(F.col("b").alias("a"), F.col("a").alias("b"), *[F.col(c).alias(f"__y{c}") for c in conds])
    j = pairs.join(exact, ["a", "b"], "left").join(back, ["a", "b"], "left")
    out = {}
    for c in conds:
        # a key counts as there if it is there for this condition, even with a null score
        got = F.when(F.col(f"__x{c}").isNotNull(), F.col(f"__x{c}")).otherwise(F.col(f"__y{c}"))
        out |= {c: got["p"], f"{c}_found": got.isNotNull()}
    return j.withColumns(out).drop(*[f"__{s}{c}" for c in conds for s in "xy"])


def missing_rows(deltas: DataFrame, names: list[str]) -> DataFrame:
    """NaN rows in all five buckets for indicators of which nothing is left."""
    spark = deltas.sparkSession
    dim = spark.createDataFrame([(n, b) for n in names for b in BUCKETS], "indicator string, bucket string")
    there = deltas.select("indicator").distinct()
    gone = F.broadcast(dim).join(there, "indicator", "left_anti")
    return gone.select("indicator", "bucket", F.lit(float("nan")).alias("value"), F.lit(float("nan")).alias("std"), F.lit(0).cast("bigint").alias("n"))


def channel_deltas(triples: DataFrame, preds: DataFrame, channels=CHANNELS) -> DataFrame:
    """The channel indicators over distinct base pairs.  All conditions are looked up in one pass;
    an indicator with no pair, or without one of its conditions, has NaN rows."""
    conds = sorted({c for _, x, y in channels for c in (x, y)})
    p = with_conditions(base_pairs(triples), preds, conds)
    rows = F.array(*[
        F.struct(F.lit(n).alias("indicator"), (F.col(f"{x}_found") & F.col(f"{y}_found")).alias("ok"), F.abs(F.col(x) - F.col(y)).alias("delta")) for n, x, y in channels
    ])
    long = p.select("bucket", "label", F.explode(rows).alias("r")).where("r.ok").select("r.indicator", "bucket", "label", "r.delta")
    out = staged(summarise(long), "indicators")  # a few rows, read twice
    return out.unionByName(missing_rows(out, [n for n, *_ in channels]))


def ksai(triples: DataFrame, preds: DataFrame) -> DataFrame:
    """|R1 - R3| - |R0 - R2| over distinct base pairs with all four scores."""
    p = with_conditions(base_pairs(triples), preds, ["R0", "R1", "R2", "R3"])
    kept = p.where("R0_found AND R1_found AND R2_found AND R3_found")
    d = F.abs(F.col("R1") - F.col("R3")) - F.abs(F.col("R0") - F.col("R2"))
    out = staged(summarise(kept.select(F.lit("KSAI").alias("indicator"), "bucket", "label", d.alias("delta"))), "indicators")
    return out.unionByName(missing_rows(out, ["KSAI"]))


def masked_panel(triples: DataFrame, preds: DataFrame, swaps: DataFrame | None = None) -> DataFrame:
    """Indicators of a scorer with maskable channels: KPS-F on the base condition, and the changes of
    score with the structure channel (``mask_mol``) or the binding channel (``mask_kg``) masked.

    With ``swaps``, KPS-F as :func:`swap_sensitivity` gives it, base pairs will do for ``triples``."""
    swaps = staged(kps_f(triples, preds, "base") if swaps is None else swaps, "panel")
    swaps = swaps.unionByName(missing_rows(swaps, ["KPS-F"])) if preds.where("cond = 'base'").isEmpty() else swaps
    return swaps.unionByName(channel_deltas(triples, preds, (("KPS-mol", "base", "mask_mol"), ("KPS-KG", "base", "mask_kg"))))


def scored_conditions(pairs: DataFrame, models: dict) -> DataFrame:
    """(cond, a, b, p) of scorers, or of stored (a, b, p) tables, by condition."""
    from .scoring import scored

    out = None
    for cond, m in models.items():
        one = (m if isinstance(m, DataFrame) else scored(pairs, m)).select(F.lit(cond).alias("cond"), "a", "b", "p")
        out = one if out is None else out.unionByName(one)
    return out


def winner(rows: DataFrame, by: str = "split", auc: str = "auc", step: str = "step") -> DataFrame:
    """The row of the best AUC of each split, the earlier step on a tie; a split of NaN alone is an error."""
    good = rows.where(F.col(auc).isNotNull() & ~F.isnan(auc))
    lost = rows.select(by).distinct().join(good, by, "left_anti")
    bad = [r[0] for r in lost.limit(10).collect()]
    if bad:
        raise ValueError(f"no valid AUC for {bad}")
    return rank_first(good, [by], [F.desc(auc), F.col(step)], 1).drop("place")


def ab_gap(indicators: DataFrame) -> DataFrame:
    """(PK-A + PD-A) / 2 - (PK-B + PD-B) / 2 of each indicator, null where one is missing."""
    v = lambda b: F.max(F.when(F.col("bucket") == b, F.col("value")))
    return indicators.groupBy("indicator").agg(((v("PK-A") + v("PD-A")) / 2 - (v("PK-B") + v("PD-B")) / 2).alias("ab_gap"))


def coverage(triples: DataFrame, preds: DataFrame, cond: str = "R0") -> DataFrame:
    """Triples kept, skipped and in total for a condition."""
    p = preds.where(F.col("cond") == cond)
    t = with_score(with_score(triples, p, "s0", "qa", "qb"), p, "s1", "qa_prime", "qb")
    ok = (F.col("s0_found") & F.col("s1_found")).cast("bigint")
    return t.agg(F.coalesce(F.sum(ok), F.lit(0)).alias("kept"), F.coalesce(F.sum(1 - ok), F.lit(0)).alias("skipped"), F.count("*").alias("total"))


def swap_coverage(ends: DataFrame, preds: DataFrame, cond: str = "R0") -> DataFrame:
    """What ``coverage`` gives over the triples of ``swap_ends``, without a triple: both keys of a triple are ends, so those
    kept are the triples of the ends with a score."""
    known = staged(with_score(ends, preds.where(F.col("cond") == cond), "s", "node", "b"), "known-ends")
    number = lambda e, kept: swap_numbers(e).where("replaced").select("n", F.lit(kept).alias("kept"))
    both = number(known, False).unionByName(number(known.where("s_found"), True))
    total, kept = (F.coalesce(F.sum(F.when(F.col("kept") == k, F.col("n"))), F.lit(0)) for k in (False, True))
    return both.agg(kept.alias("kept"), (total - kept).alias("skipped"), total.alias("total"))


def bucket_coverage(pairs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Pairs found in each bucket of a lookup table, zero where none is."""
    dim = F.broadcast(pairs.sparkSession.createDataFrame([(b,) for b in (*PRIMARY, "Other")], "bucket string"))
    found = with_score(pairs, lookup.withColumnRenamed("bucket", "p"), "bk").select(F.coalesce("bk", F.lit("Other")).alias("bucket"))
    return dim.join(found.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def scored_universe(test: DataFrame, swapped: DataFrame) -> DataFrame:
    """Distinct directed keys that need a score: those of the test, and both keys of each triple (``swap_numbers`` above 0)."""
    return test.select("a", "b").union(swapped.where("n > 0").select(F.col("node").alias("a"), "b")).distinct()


def priority_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(a, b, label): a key that is in both is positive."""
    u = positives.select("a", "b", F.lit(1).alias("label")).unionByName(negatives.select("a", "b", F.lit(0).alias("label")))
    return u.groupBy("a", "b").agg(F.max("label").alias("label"))


def rank_first(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
