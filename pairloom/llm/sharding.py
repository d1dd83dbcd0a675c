"""Sharding: a hierarchical weighted hash tree, in native expressions only.

A row descends region, rack and shard levels.  At each level every child draws
``-ln(u) / weight`` from a hash of the row's key and the child's name, and the smallest draw wins,
so children win in proportion to their weights.  A draw depends on that child alone: where a
weight changes, rows move only into, out of or inside the subtree that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: region -> rack -> {shard: weight}
Tree = dict[str, dict[str, dict[int, float]]]


def default_tree(shards: int, racks: int = 2, per_rack: int = 4, base: int = 16) -> Tree:
    """The first ``base`` shards fill racks of ``per_rack`` and regions of ``racks``; each later
    shard is a region of its own, so growing by one never changes the weight of an older subtree."""
    tree: Tree = {}
    for s in range(min(shards, base)):
        region, rack = f"region{s // (racks * per_rack)}", f"rack{s // per_rack}"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    for s in range(base, shards):
        tree[f"grown{s}"] = {f"rack-of-{s}": {s: 1.0}}
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw with rate ``weight``; a weight of 0 never wins."""
    if weight <= 0:
        return F.lit(float("inf"))
    # 53 high bits of the hash, shifted by a half to stay inside (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node), key), 11).cast("double") + 0.5) * (2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _winner(draws: list[tuple[Column, Column]]) -> Column:
    """The value of the smallest draw; the earlier child wins a tie."""
    least = F.least(*[d for d, _ in draws]) if len(draws) > 1 else draws[0][0]
    out = draws[-1][1]
    for d, v in reversed(draws[:-1]):
        out = F.when(d == least, v).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key as one expression.  Draws of each level are hashed only on the path taken."""

    def rack(name: str, shards: dict[int, float]) -> Column:
        return _winner([(_draw(key, f"{name}/{s}", w), F.lit(int(s))) for s, w in shards.items()])

    def region(name: str, racks: dict[str, dict[int, float]]) -> Column:
        return _winner([(_draw(key, f"{name}/{k}", sum(x.values())), rack(f"{name}/{k}", x)) for k, x in racks.items()])

    return _winner([(_draw(key, f"/{k}", sum(sum(y.values()) for y in x.values())), region(f"/{k}", x)) for k, x in tree.items()])


def hash_tree_shards(docs: DataFrame, tree: Tree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row's key.  Narrow: no shuffle, no state, any order of rows.

    Rows with a null key all go where the node names alone decide; repeated keys share a shard.  A
    column already named ``out`` is replaced.
    """
    return docs.withColumn(out, shard_of(F.col(key), tree).cast("int"))


def with_slots(rows: DataFrame, shard: str = "shard", key: str = "doc_id", pieces: int = 256, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``slot``: a gapless count from 0 within each shard, in the order of a hash, the key and
    ``ties``; only rows equal in all of them may change places.

    Every shard is cut into ``pieces`` hash ranges.  A range is numbered on its own, starting
    behind the ranges before it, whose sizes are a table of at most shards x pieces rows: no task
    numbers a whole shard.
    """
    from pyspark.sql import Window as W

    h = F.xxhash64(F.lit("slot"), F.col(key), *ties)  # ties also spread rows of one key, or of none
    cut = rows.withColumn("__h", h).withColumn("__p", F.pmod(F.col("__h"), F.lit(pieces)).cast("int"))
    sizes = cut.groupBy(F.col(shard).alias("__s"), F.col("__p").alias("__q")).count()
    before = sizes.select(
        "__s", "__q", F.coalesce(F.sum("count").over(W.partitionBy("__s").orderBy("__q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    rank = F.row_number().over(W.partitionBy(shard, "__p").orderBy("__h", key, *ties))
    ranked = cut.withColumn("__r", rank)
    joined = ranked.join(F.broadcast(before), (F.col(shard) == F.col("__s")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn("slot", F.col("__before") + F.col("__r") - 1).drop("__h", "__p", "__s", "__q", "__before", "__r")


def shard_table(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row.

    Law ``key``: the key and the shard count decide; a further shard takes rows only into itself.
    Null text counts as empty (size 1, checksum 0).  An empty table gives an empty table.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    slim = hash_tree_shards(slim, default_tree(shards), key)
    slim = hash_tree_shards(slim, default_tree(shards + 1), key, "grown_shard")
    return with_slots(slim, key=key, ties=("size", "text_crc32")).select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
