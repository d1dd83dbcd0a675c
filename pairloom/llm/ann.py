"""Nearest neighbours by inner product over shifted Hilbert curves.

Every vector is projected several times to a few dimensions, by independent rotations, shifted and
put in the order of a Hilbert curve.  Spark range-partitions each ordering, which numbers its places.
A query meets the vectors whose place lies within a window of its own on any curve; windows cross
partition borders, as places are cut into blocks and a query goes to every block that its window
touches.  The hits of all windows merge and rerank.

How wide the windows are is measured, not guessed: a bounded sample of queries is answered by a scan
of all rows, and the window is the least one that would have met the target share of those true
neighbours.  Structured vectors get narrow windows.  Where there is no structure, as in independent
random directions, no ordering keeps neighbours together and the windows grow to most of the table;
the README states the figures.  Rows with equal vectors are one class: it is placed and met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, received, sent

CURVES, DIMS, BITS = 3, 8, 7
#: Share of the true neighbours of the sampled queries that the windows have to meet.
TARGET = 0.95
#: Bounds of the samples: vectors that fit the cells, and queries that are answered by a scan.
FIT, TRUTH = 4096, 400
#: Places to each side that every window has at least.
LEAST = 512
#: Components of a block (16 MB as doubles), queries scored together, and rows that they meet at once.
BLOCK, TOGETHER, STEP = 1 << 21, 256, 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, dims), by Gray-code transposition."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Rotations, shifts and keys.  Cells are even shares of a sample of the projections, so skewed
    vectors spread over the curve like others."""

    def __init__(self, sample: np.ndarray, seed: int = 3):
        g = np.random.default_rng(seed)
        dim = sample.shape[1]
        turns = [np.linalg.qr(g.standard_normal((dim, dim)))[0] for _ in range(-(-CURVES * DIMS // dim))]
        self.turn = np.concatenate(turns, 1)[:, : CURVES * DIMS]
        self.known = np.sort(sample @ self.turn, axis=0)
        self.shift = g.uniform(0, 0.25, CURVES * DIMS)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, CURVES) keys."""
        y = x @ self.turn
        n = len(self.known)
        at = np.stack([np.searchsorted(self.known[:, d], y[:, d]) for d in range(y.shape[1])], 1) / max(n, 1)
        cells = np.clip((at * 0.75 + self.shift) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c * DIMS : (c + 1) * DIMS], BITS) for c in range(CURVES)], 1)


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, seen: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row, score) of the ``k`` best rows of each query among those ``seen``; ties to
    smaller ids.  A rough product chooses, the exact one is added up alike for every pair."""
    rough = q @ x.T
    if seen is not None:
        rough = np.where(seen, rough, -np.inf)
    eps = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(rough), rough, 0)).max(1, initial=0.0))
    kth = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    a, b = np.nonzero((rough >= (kth - eps)[:, None]) & np.isfinite(rough))
    score = np.einsum("nd,nd->n", q[a], x[b])
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a, "left")
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep], score[keep]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _batch(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _hashed(seed: str, *of: str) -> Column:
    """A hash as a number from 0 up to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") * (2.0**-53)


def _sample(rows: DataFrame, of: int, most: int, seed: str, *key: str) -> list:
    """At most ``most`` of ``of`` rows, in the order of a hash; a threshold keeps the sort small."""
    h = _hashed(seed, *key)
    return rows.where(h < F.lit(2.0 * most / max(of, 1))).orderBy(h, *key).limit(most).collect()


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows met by the windows of each row
    whose key is a multiple of ``every``; nearest first, ties to the smaller key.

    Null keys, null or zero vectors, vectors with null or non-finite components, and vectors not of
    the most frequent length take no part.  Rows with the query's own key are not its neighbours;
    of rows with equal keys the best counts once.  Fewer than ``k`` candidates: all of them.

    Vectors move once for each curve, and once to meet their places.  Samples of a fixed size, one
    row for each partition, and copies (only within BROADCAST_ROWS) come to the driver or are broadcast.
    """
    out = "query_id long, rank int, vec_id long, score double"
    index, copies, dim, n = _classes(vectors, every, k, key, vector)
    if index is None:
        return vectors.sparkSession.createDataFrame([], out)
    places = _places(index, dim, n)
    wide = max(LEAST, _window(index, places, dim, k, target))
    hits = _ranked(_met(index, places, dim, n, wide, k + 1), "q", "x", k + 1).drop("rank")
    # classes back to rows; a class without copies is its own row
    copies = materialize(copies.join(places.select("h1", "h2", F.col("at")[0].alias("uid")), ["h1", "h2"]), "copies")
    count = copies.count()
    mine = bounded_broadcast(copies.where("asks").select(F.col("uid").alias("q"), F.col("id").alias("qm")), count)
    near = bounded_broadcast(copies.where(F.col("nth") <= k + 1).select(F.col("uid").alias("x"), F.col("id").alias("xm")), count)
    rows = hits.join(near, "x", "left").join(mine, "q", "left").select(F.coalesce("qm", "qid").alias("query_id"), F.coalesce("xm", "xid").alias("vec_id"), "score")
    return _ranked(rows.where("query_id <> vec_id"), "query_id", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def _ranked(hits: DataFrame, by: str, of: str, k: int) -> DataFrame:
    """The k best of each query, each neighbour once; all columns."""
    rest = [c for c in hits.columns if c not in (by, of, "score")]
    once = hits.groupBy(by, of).agg(F.max("score").alias("score"), *[F.min(c).alias(c) for c in rest])
    tie = "xid" if "xid" in rest else of
    return once.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), tie))).where(F.col("rank") <= k)


def _classes(vectors: DataFrame, every: int, k: int, key: str, vector: str) -> tuple:
    """The index (h1, h2, id, asks, v), a row for each distinct vector with its smallest id, and the
    rows of vectors that occur more than once: (h1, h2, id, nth, asks)."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col("v")
    real = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind if kind == 'float' else 'double'}>").alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"
    )
    real = real.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    common = real.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if common is None:
        return None, None, 0, 0
    zero = F.lit(0).cast(kind if kind == "float" else "double")
    real = real.where(F.size("v") == common["n"]).withColumn("v", F.transform("v", lambda x: F.when(x == 0, zero).otherwise(x)))  # -0 is 0
    real = real.select("id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    light = materialize(real.select("h1", "h2", "id"), "vector-hashes")
    asks = F.pmod("id", F.lit(every)) == 0
    copied = light.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("id").alias("rep"), F.max(asks).alias("any")).where("c > 1")
    copied = materialize(copied, "copied")
    size = copied.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    told = bounded_broadcast(copied, size[0])
    # of each class its k + 1 smallest ids can be neighbours, and all that ask
    rows = light.join(told, ["h1", "h2"], "left_semi").distinct()
    few = rows.withColumn("nth", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= k + 1)
    rest = rows.where(asks).join(few, ["h1", "h2", "id"], "left_anti").withColumn("nth", F.lit(k + 2))
    copies = few.unionByName(rest).withColumn("asks", asks)
    lone = real.join(told, ["h1", "h2"], "left_anti").select("h1", "h2", "id", asks.alias("asks"), "v")
    one = real.join(told, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("v").alias("v")).join(told, ["h1", "h2"]).select("h1", "h2", F.col("rep").alias("id"), F.col("any").alias("asks"), "v")
    return lone.unionAll(one), copies, common["n"], common["c"] - size[1] + size[0]


def _places(index: DataFrame, dim: int, n: int) -> DataFrame:
    """(h1, h2, id, asks, at): the place of each class from 0 on every curve."""
    spark = index.sparkSession
    sample = _sample(index.select("h1", "h2", "v"), n, FIT, "fit", "h1", "h2")
    told = sent(spark, Curves(np.array([r["v"] for r in sample], float).reshape(-1, dim)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = received(told)
        for batch in batches:
            if batch.num_rows:
                keys = curves.keys(_matrix(batch.column(4), dim))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, CURVES), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), flat], names=["h1", "h2", "id", "asks", "keys"])

    light = materialize(index.mapInArrow(keyed, "h1 long, h2 long, id long, asks boolean, keys array<long>"), "keys")
    long = light.select("h1", "h2", "id", "asks", F.posexplode("keys").alias("curve", "key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "key", "h1", "h2"]
    ids = F.monotonically_increasing_id()
    ranged = materialize(long.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("mid", ids), "curves")
    # one row for each partition and curve in it: where its places begin
    starts = ranged.groupBy("curve", F.shiftright("mid", 33).alias("part")).agg(F.min("mid").alias("low"), F.count("*").alias("c"))
    starts = starts.withColumn("start", F.coalesce(F.sum("c").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.withColumn("part", F.shiftright("mid", 33)).join(F.broadcast(starts), ["curve", "part"]).withColumn("place", F.col("start") + F.col("mid") - F.col("low"))
    at = F.array(*[F.max(F.when(F.col("curve") == c, F.col("place"))) for c in range(CURVES)])
    return materialize(placed.groupBy("h1", "h2").agg(F.first("id").alias("id"), F.first("asks").alias("asks"), at.alias("at")), "places")


def _window(index: DataFrame, places: DataFrame, dim: int, k: int, target: float) -> int:
    """The least window that meets the target share of the true neighbours of the sampled queries."""
    spark = index.sparkSession
    asked = places.where("asks")
    chosen = _sample(asked, asked.count(), TRUTH, "truth", "h1", "h2")
    if not chosen:
        return 0
    names = spark.createDataFrame([(r["h1"], r["h2"], i) for i, r in enumerate(chosen)], "h1 long, h2 long, i int")
    found = {r["i"]: r["v"] for r in index.join(F.broadcast(names), ["h1", "h2"]).select("i", "v").collect()}
    told = spark.sparkContext.broadcast(np.array([found[i] for i in range(len(chosen))], float))
    fields = "i int, h1 long, h2 long, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, held = told.value, None
        for batch in batches:
            if batch.num_rows:
                h1, h2, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dim)
                a, b, score = best(x, h1, qs, None, k + 1)
                now = [a.astype(np.int32), h1[b], h2[b], score]
                if held:  # the best of all batches so far
                    now = [np.concatenate(p) for p in zip(held, now, strict=True)]
                    order = np.lexsort((now[1], -now[3], now[0]))
                    now = [p[order] for p in now]
                    keep = np.arange(len(order)) - np.searchsorted(now[0], now[0], "left") <= k
                    now = [p[keep] for p in now]
                held = now
        if held:
            yield _batch(["i", "h1", "h2", "score"], *held)

    true = index.select("h1", "h2", "v").mapInArrow(scan, fields)
    own = spark.createDataFrame([(i, r["h1"], r["h2"], r["at"]) for i, r in enumerate(chosen)], "i int, o1 long, o2 long, own array<long>")
    true = true.join(F.broadcast(own), "i").where("h1 <> o1 OR h2 <> o2")
    true = true.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "h1"))).where(F.col("rank") <= k)
    apart = F.array_min(F.zip_with("at", "own", lambda a, b: F.abs(a - b)))
    gaps = np.sort([r["gap"] for r in true.join(places.select("h1", "h2", "at"), ["h1", "h2"]).select(apart.alias("gap")).collect()])
    return int(gaps[min(len(gaps) - 1, int(np.ceil(target * len(gaps))) - 1)]) if len(gaps) else 0


def _met(index: DataFrame, places: DataFrame, dim: int, n: int, wide: int, k: int) -> DataFrame:
    """(q, qid, x, xid, score): the k best classes of each asking class in each block of its windows."""
    block = max(1, BLOCK // dim)
    rows = index.select("h1", "h2", "v").join(places, ["h1", "h2"]).select(F.col("at")[0].alias("uid"), "id", "asks", "v", F.posexplode("at").alias("curve", "place"))
    fields = ["curve", "block", "asking", "place", "uid", "id", "v"]
    held = rows.withColumn("block", F.floor(F.col("place") / block)).withColumn("asking", F.lit(False)).select(*fields)
    low, high = F.floor(F.greatest(F.col("place") - wide, F.lit(0)) / block), F.floor(F.least(F.col("place") + wide, F.lit(n - 1)) / block)
    asking = rows.where("asks").withColumn("block", F.explode(F.sequence(low, high))).withColumn("asking", F.lit(True)).select(*fields)

    def best_of(held: list[np.ndarray], place: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of a block for some queries in the order of their places, in steps along the curve."""
        first, last = np.searchsorted(held[0], [place[0] - wide, place[-1] + wide + 1])
        now = None
        for at in range(first, last, STEP):
            part = slice(at, min(last, at + STEP))
            i, j, score = best(held[3][part], held[2][part], x, np.abs(held[0][part][None, :] - place[:, None]) <= wide, k)
            now = [i, j + at, score] if now is None else [np.concatenate(p) for p in zip(now, (i, j + at, score), strict=True)]
            order = np.lexsort((held[2][now[1]], -now[2], now[0]))
            now = [p[order] for p in now]
            keep = np.arange(len(order)) - np.searchsorted(now[0], now[0], "left") < k
            now = [p[keep] for p in now]
        return now or (np.empty(0, int), np.empty(0, int), np.empty(0))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            curve, number, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            place, uid, ids = (batch.column(c).to_numpy() for c in range(3, 6))
            x = _matrix(batch.column(6), dim)
            cuts = np.flatnonzero(np.r_[True, (curve[1:] != curve[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(curve)], strict=True):
                if (curve[a], number[a]) != now:
                    now, parts, held = (curve[a], number[a]), [], None
                if not asks[a]:
                    parts.append((place[a:b], uid[a:b], ids[a:b], x[a:b]))
                    continue
                if held is None:
                    held = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else []
                    parts = []
                for s in range(a, b, TOGETHER) if held else ():
                    e = min(b, s + TOGETHER)
                    i, j, score = best_of(held, place[s:e], x[s:e])
                    yield _batch(["q", "qid", "x", "xid", "score"], uid[s:e][i], ids[s:e][i], held[1][j], held[2][j], score)

    # the rows of a block come before the queries that meet it
    dealt = held.unionAll(asking).repartition("curve", "block").sortWithinPartitions("curve", "block", "asking", "place")
    return dealt.mapInArrow(meet, "q long, qid long, x long, xid long, score double")
