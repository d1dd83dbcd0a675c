"""Near-duplicate groups by SetSketch registers.

Texts become sets of word shingles.  Equal sets are one class at once, so copies never meet as
pairs.  Each class has a SetSketch: registers are truncated logarithms, in steps of BASE, of minima
of exponential draws, so the sketch of a union is the elementwise maximum and equal registers are
as likely as the sets are similar.  Bands of registers are buckets.  Inside a bucket the joint
likelihood of two sketches rules pairs out, and a forest of the likely ones leaves; their components are
the candidate groups, so texts that share a passage but are not alike do not chain.  Inside a group full
sets confirm links, and a forest of those leaves.  Large buckets and groups are cut into blocks.  The
blocks of a group first link within, then through one member of each part that they found; only members
that are still apart from the largest part meet all others.  Components of the confirmed links are the
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, connected_components, materialize

BANDS, ROWS = 20, 5
#: SetSketch parameters: base, rate and largest register (16 bits).
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: A candidate pair is verified if its likelihood estimate is no more than this below the threshold.
SLACK = 0.2
#: Bounds of a block of a bucket or a candidate group: members and shingles (16 MB of sets).
MEMBERS, SHINGLES = 128, 2_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
U = np.uint64


class Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    return h


def shingles(text: str | None, words: Words, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words, if they are fewer.

    Words are split at the bytes 0x20 and 0x09-0x0D after lower-casing A-Z.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, U)
    h = np.fromiter(map(words.__getitem__, split), U, len(split))
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= U(0x9FB21C651E98DF25)
        acc ^= acc >> U(31)
        acc += h[i : i + n]
    acc += U(k)
    return np.unique(mixed(acc))


class Sketcher:
    def __init__(self, registers: int = BANDS * ROWS, seed: int = 5):
        g = np.random.default_rng(seed)
        self.a = (g.integers(0, 2**63, registers, dtype=U) << U(1) | U(1))[:, None]
        self.b = g.integers(0, 2**63, registers, dtype=U)[:, None]
        self.band = g.integers(0, 2**63, (BANDS, ROWS), dtype=U) | U(1)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """The SetSketch of a set that is not empty."""
        low = np.full(len(self.a), 2**64 - 1, U)
        for i in range(0, len(hashes), 1024):
            np.minimum(low, (self.a * hashes[None, i : i + 1024] + self.b).min(1), out=low)
        draw = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)) + LIMIT // 2, 0, LIMIT).astype(np.uint16)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        rows = registers.reshape(BANDS, ROWS).astype(U) + U(1)
        return mixed((rows * self.band).sum(1, dtype=U) + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def likely_similarity(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray, registers: int) -> np.ndarray:
    """Joint maximum-likelihood estimates of the Jaccard similarity of sketched sets of known sizes,
    from the numbers of registers that are larger in the first and in the second."""
    u = n1 / (n1 + n2)
    grid = np.linspace(0, 1, 201)[None, :]
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    j = grid * top[:, None]
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * c) / np.log(BASE)
    p1, p2 = p(u[:, None] - (1 - u)[:, None] * j), p((1 - u)[:, None] - u[:, None] * j)
    same = np.maximum(1 - p1 - p2, 1e-12)
    ll = more[:, None] * np.log(np.maximum(p1, 1e-12)) + less[:, None] * np.log(np.maximum(p2, 1e-12)) + (registers - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), ll.argmax(1)]


def likely(sketches: np.ndarray, n: np.ndarray, at: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Estimates for the pairs (at, rest); -1 where the sizes alone rule a pair out."""
    out = np.full(len(rest), -1.0)
    ok = np.flatnonzero(100 * np.minimum(n[at], n[rest]) >= percent * np.maximum(n[at], n[rest]))
    if len(ok):
        a, b = sketches[at[ok]], sketches[rest[ok]]
        out[ok] = likely_similarity((a > b).sum(1), (a < b).sum(1), n[at[ok]].astype(float), n[rest[ok]].astype(float), sketches.shape[1])
    return out


def forest(sets: list[np.ndarray] | None, sketches: np.ndarray, n: np.ndarray, side: np.ndarray, node: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """What the pairs that link connect, as stars (node, smallest node): with ``sets`` those with
    100 * common >= percent * union, without them those whose sketches are likely to.  ``side`` tells two
    blocks apart: if both are there, only pairs across them are looked at.  Members of one ``part`` are
    connected already, and one of them is in the star.  Stars of the same members are the same whatever
    bucket they meet in."""
    label = np.unique(part, return_inverse=True)[1]
    begun, across = label.copy(), len(np.unique(side)) > 1
    for i in range(len(n) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if across:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            continue
        hat = likely(sketches, n, np.full(len(rest), i), rest, percent)
        order = np.argsort(-hat, kind="stable")
        for j in rest[order[hat[order] >= percent / 100 - SLACK]]:
            if label[j] == label[i]:
                continue
            if sets is not None:
                both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * both < percent * (n[i] + n[j] - both):
                    continue
            label[label == label[j]] = label[i]
    out = []
    for l in np.unique(label[label != begun]):
        at = np.flatnonzero(label == l)
        at = at[np.argsort(node[at], kind="stable")]
        first = at[np.unique(begun[at], return_index=True)[1]]  # the smallest node of each part
        out += [(int(node[i]), int(node[at[0]])) for i in first if node[i] != node[at[0]]]
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable over links) and kept, one row for
    each row of ``docs``.

    Links join rows with 100 * common >= percent * union of their sets of ``words``-word shingles.
    A null or blank text has no shingles and is linked with nothing.  Rows with a null key link
    with nothing, have a null component_id and are kept.  Rows with equal keys and words are one
    document: what any of their texts links with is reachable from all.  Equal rows give equal results.
    """
    kind = docs.schema[key].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sk = Words(), Sketcher()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                n, keys, sketches, bands = [], [], [], []
                for t in part.column(1):
                    s = shingles(t.as_py(), seen, words)
                    r = sk.registers(s) if len(s) else None
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sketches.append(r.tobytes() if len(s) else None)
                    bands.append(sk.bands(r) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=[key, "n_shingles", "set_key", "sketch", "bands"],
                )

    slim = docs.select(F.col(key), F.col(text).alias("__text"))
    feats = materialize(slim.mapInArrow(features, f"`{key}` {kind}, n_shingles long, set_key binary, sketch binary, bands array<long>"), "features")
    usable = feats.where(F.col("set_key").isNotNull() & F.col(key).isNotNull())
    first = [F.first(c).alias(c) for c in ("sketch", "bands")]
    classes = usable.groupBy("set_key").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), *first)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed by writing them
    banded = classes.select("node", "n", F.explode("bands").alias("grp"))
    shared = banded.groupBy("grp").agg(F.count("*").alias("c"), _blocks(F.count("*") / F.lit(MEMBERS)).alias("blocks")).where("c > 1").drop("c")
    shared = materialize(shared, "shared")
    likely_links = _forests(banded.join(bounded_broadcast(shared, shared.count()), "grp"), classes.select("node", "sketch", F.lit(None).cast("binary").alias("elements")), percent, "likely")
    groups = connected_components(likely_links, "groups")
    members = materialize(classes.select("node", "set_key", "rep", "n").join(groups, "node").withColumnRenamed("component", "grp"), "members")
    # classes of one key are one document
    several = usable.groupBy(key).agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select(key)
    several = materialize(several, "several")
    held = usable.join(bounded_broadcast(several, several.count()), key, "left_semi").select(key, "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
    same = held.join(held.groupBy(key).agg(F.min("node").alias("b")), key).select(F.col("node").alias("a"), "b")
    linked = connected_components(_confirmed(slim, members, words, percent, key).unionByName(same), "links")

    ids = linked.join(classes.select("node", "rep"), "node")
    low = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = ids.select("component", "node").join(low, "component").select("node", "component_id")
    told = classes.join(of_class, "node", "left").where("component_id IS NOT NULL OR copies > 1").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    told = materialize(told, "told")
    joined = feats.select(key, "n_shingles", "set_key").join(bounded_broadcast(told, told.count()), "set_key", "left")
    component = F.when(F.col(key).isNotNull(), F.coalesce("component_id", key))
    return joined.select(key, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(key), F.lit(True)).alias("kept"))


def _blocks(least) -> F.Column:
    """A power of two of at least so many blocks: members meet in like blocks in buckets of like size."""
    return F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(least)), F.lit(0))).cast("int")


def _forests(rows: DataFrame, payload: DataFrame, percent: int, tag: str) -> DataFrame:
    """(a, b): links that connect what the links of all pairs inside each group connect.

    ``rows``: grp, node, n and blocks, the number of blocks that the group is cut into; a node may be in
    several groups.  ``payload``: node, sketch and elements (null: likely links are enough).  Light rows
    are dealt to tasks before the payload joins them.  A task holds two blocks at most.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(tasks: list[list]) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            pairs = [h for h in tasks if len(h) == 2 and h[0][5] is None and h[0][2] != h[1][2]]
            if pairs:  # most buckets hold two: all of them at once
                flat = [x for h in pairs for x in h]
                n, sk = np.array([x[3] for x in flat]), np.stack([np.frombuffer(x[4], np.uint16) for x in flat])
                left = np.arange(0, len(flat), 2)
                ok = likely(sk, n, left, left + 1, percent) >= percent / 100 - SLACK
                out += [(flat[i + 1][0], flat[i][0]) for i in left[ok]]
            for h in tasks:
                if len(h) > 2 or len(h) == 2 and h[0][5] is not None:
                    node, side, part, n, sketch, elements = zip(*h, strict=True)
                    sets = None if elements[0] is None else [np.frombuffer(x, U) for x in elements]
                    sk = np.stack([np.frombuffer(x, np.uint16) for x in sketch])
                    out += forest(sets, sk, np.array(n), np.array(side), np.array(node), np.array(part), percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        now, held, done, size = None, [], [], 0
        for batch in batches:
            for task, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                task = tuple(task.values())
                if task != now:
                    done.append(held)
                    size += len(held)
                    if size > MEMBERS:
                        yield found(done)
                        done, size = [], 0
                    now, held = task, []
                held.append(row)
        yield found([*done, held])

    def linked(dealt: DataFrame, name: str) -> DataFrame:
        ready = dealt.join(payload, "node").select("task", "node", "side", "part", "n", "sketch", "elements")
        edges = ready.repartition("task").sortWithinPartitions("task", "side", "node").mapInArrow(verify, "a long, b long")
        return materialize(edges.distinct(), f"{tag}-{name}")

    alone, itself = F.lit(0).alias("side"), F.col("node").alias("part")
    task = lambda *of: F.struct(*of).alias("task")
    cut = rows.withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    within = linked(cut.select(task("grp", "block", F.lit(0).alias("strip")), "node", alone, itself, "n"), "within")
    big = materialize(cut.where("blocks > 1"), f"{tag}-big")
    if big.isEmpty():
        return within

    def parted(links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Stars of ``links``, and the members of large groups with the part that each belongs to by now."""
        known = connected_components(links, f"{tag}-{name}")
        parts = materialize(big.join(known, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), f"{tag}-{name}")
        return known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")), parts

    ends = big.select(F.col("node").alias("a")).distinct()
    stars, parts = parted(within.join(ends, "a", "left_semi").select("a", "b"), "parts")
    one = parts.groupBy("grp", "part").agg(F.min(F.struct("node", "n")).alias("m")).select("grp", "m.*")
    crowd = one.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("of"))
    through = one.join(crowd, "grp").withColumn("block", F.pmod(F.hash("node"), F.col("of"))).select(task("grp", "block", F.lit(0).alias("strip")), "node", alone, itself, "n")
    more = linked(through, "through")
    if not more.isEmpty():
        stars, parts = parted(stars.unionAll(more), "joined")
    joined = within.join(ends, "a", "left_anti").select("a", "b").unionAll(stars)
    # all that are not in the largest part of their group meet everyone else
    counts = parts.groupBy("grp", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = counts.groupBy("grp").agg(F.max(F.struct("c", "part", "s")).alias("top"), F.sum("c").alias("all"), F.sum("s").alias("sum"))
    most = most.select("grp", F.col("top.part").alias("major"), (F.col("all") - F.col("top.c")).alias("rest"), (F.col("sum") - F.col("top.s")).alias("words")).where("rest > 0")
    told = parts.join(most, "grp").withColumn("strips", F.greatest(F.ceil(F.col("rest") / F.lit(MEMBERS)), F.ceil(F.col("words") / F.lit(SHINGLES))).cast("int"))
    every = told.select("grp", "node", "n", "part", F.lit(0).alias("side"), "block", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    minors = told.where("part <> major").select("grp", "node", "n", "part", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.hash("node", F.lit(7)), F.col("strips")).alias("strip"))
    dealt = every.unionByName(minors).select(task("grp", "block", "strip"), "node", "side", "part", "n")
    return joined.unionAll(linked(dealt, "across"))


def _confirmed(slim: DataFrame, members: DataFrame, words: int, percent: int, key: str) -> DataFrame:
    """Confirmed links (a, b) of the candidate groups."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sk = Words(), Sketcher()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingles(t.as_py(), seen, words) for t in whole.column(1).slice(at, 500)]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([sk.registers(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["set_key", "sketch", "elements"],
                )

    count = members.count()
    texts = slim.join(bounded_broadcast(members.select(F.col("rep").alias(key)).distinct(), count, BROADCAST_ROWS), key, "left_semi")
    made = texts.mapInArrow(full, "set_key binary, sketch binary, elements binary")
    made = made.join(bounded_broadcast(members.select("set_key", "node"), count, BROADCAST_ROWS), "set_key").dropDuplicates(["node"]).select("node", "sketch", "elements")
    sizes = members.groupBy("grp").agg(_blocks(F.greatest(F.count("*") / F.lit(MEMBERS), F.sum("n") / F.lit(SHINGLES))).alias("blocks"))
    sizes = materialize(sizes, "sizes")
    return _forests(members.join(bounded_broadcast(sizes, sizes.count()), "grp").select("grp", "node", "n", "blocks"), materialize(made, "sets"), percent, "links")
