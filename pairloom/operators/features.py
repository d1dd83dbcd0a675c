"""Feature tables of pairs and nodes: similarity profiles, components, bins and relation graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_index, tanimoto
from .metrics import percentile_edges


def reference_profiles(prints: DataFrame, reference: DataFrame, node: str = "node", bits: str = "bits") -> DataFrame:
    """(node, profile): similarities to a fixed, small reference list, in its order.

    ``reference``: (pos, bits), 10,000 rows at most.  It is one broadcast row, so each node is worked out
    in place."""
    if reference.limit(10_001).count() > 10_000:
        raise ValueError("a reference list has at most 10000 rows")
    ref = reference.agg(F.array_sort(F.collect_list(F.struct("pos", F.col(bits).alias("b")))).alias("refs")).withColumn("__j", F.lit(1))
    j = prints.select(node, bits).withColumn("__j", F.lit(1)).join(F.broadcast(ref), "__j")
    return j.select(node, F.transform("refs", lambda r: tanimoto(F.col(bits), r["b"])).alias("profile"))


def principal_components(rows: DataFrame, fit_on: DataFrame, k: int, node: str = "node", vector: str = "profile") -> DataFrame:
    """(node, components): fitted on the rows of ``fit_on`` alone (no leakage) and centred by their
    mean; signs are arbitrary.  k is capped by rows and columns."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    all_rows = rows.select(node, array_to_vector(vector).alias("v"))
    train = all_rows.join(fit_on.select(node).distinct(), node, "left_semi")
    n, width = train.count(), rows.select(F.size(vector)).first()[0]
    centre = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(train)
    model = PCA(k=max(1, min(k, n, width)), inputCol="c", outputCol="p").fit(centre.transform(train))
    return model.transform(centre.transform(all_rows)).select(node, vector_to_array("p").alias("components"))


def property_bins(values: DataFrame, names: list[str], bins: int = 10, node: str = "node") -> DataFrame:
    """(node, prop, bin) by exact percentile edges of each property; fewer than two values: bin 0."""
    out = None
    for name in names:
        e = F.broadcast(percentile_edges(values, name, bins).withColumn("__j", F.lit(1)))
        one = values.where(F.col(name).isNotNull()).withColumn("__j", F.lit(1)).join(e, "__j").select(node, F.lit(name).alias("prop"), bin_index(F.col(name), F.col("edges")).alias("bin"))
        out = one if out is None else out.unionByName(one)
    return out


def print_edges(prints: DataFrame, ghost: int = -1, node: str = "node", bits: str = "bits") -> DataFrame:
    """(node, bit): a row for each on-bit, or the ghost for a node without any."""
    return prints.select(node, F.explode_outer(bits).alias("bit")).select(node, F.coalesce("bit", F.lit(ghost)).alias("bit"))


def interaction_edges(train: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(src, dst) of training pairs in both directions; nodes without any point at themselves."""
    turned = F.coalesce(F.col("b").isNull() | (F.col("b") < F.col("a")), F.lit(False))  # a null end comes first
    # pairs are made distinct before they are turned round, so that each moves once
    pairs = train.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    ways = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    both = pairs.select(F.explode(ways).alias("x")).select("x.*")
    ends = both.select("src").distinct()
    alone = nodes.select(F.col(node).alias("src")).distinct().join(ends, "src", "left_anti")
    return both.unionByName(alone.select("src", F.col("src").alias("dst")))


def biomedical_edges(train: DataFrame, groups: DataFrame, kg: DataFrame, kinds: tuple[str, ...], node: str = "node") -> DataFrame:
    """(src, dst, rel): training pairs without held-out ends (rel 1 both ways) and bindings both ways,
    numbered from 2 by kind."""
    out_of = groups.where("grp = 'G2'").select(F.col(node).alias("__g"))
    kept = train.join(out_of, F.col("a") == F.col("__g"), "left_anti").join(out_of, F.col("b") == F.col("__g"), "left_anti")
    s = lambda c: F.col(c).cast("string")
    pairs = kept.select(s("a").alias("src"), s("b").alias("dst"), F.lit(1).alias("rel"))
    rel = F.array_position(F.array(*map(F.lit, kinds)), F.col("edge_type")).cast("int") + 1
    binds = kg.where(F.col("edge_type").isin(*kinds)).select(s(node).alias("src"), F.concat(F.lit("entity:"), s("entity_id")).alias("dst"), rel.alias("rel")).distinct()
    one_way = pairs.unionByName(binds)
    return one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))


def samples(pairs: DataFrame, names: DataFrame, context: DataFrame | None = None, node: str = "node") -> DataFrame:
    """Pairs with names (an unknown id stands for itself) and, if given, their contexts, as one record."""
    n = lambda s: names.select(F.col(node).alias(s), F.col("name").alias(f"name_{s}"))
    j = pairs.join(n("a"), "a", "left").join(n("b"), "b", "left")
    j = j.withColumns({f"name_{s}": F.coalesce(f"name_{s}", F.col(s).cast("string")) for s in "ab"})
    return j if context is None else j.join(context.select("a", "b", "ctx"), ["a", "b"], "left")
