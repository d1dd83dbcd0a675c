"""Centroid clustering of integer vectors: float32 screening with rigorous intervals, exact where they overlap.

A component x becomes floor(scale * x).  Each round is one pass over the table: a task multiplies its
vectors with all centroids in float32, and knows how far each product can be off, whatever the order
of its additions.  A centroid whose interval of distances lies below all others is the nearest; where
intervals overlap, those centroids are compared by exact integers, ties to the lowest number.  Tasks
return sums of integers for each centroid, which Spark adds; only centroids, sums and counts come to
the driver: clusters times components numbers.  The table is read again in each round, two columns
wide; nothing but the last assignment is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Integers up to which float32 is exact, distances of 4096 components fit 64 bits, and values are taken at all.
FLOAT_EXACT, LONG_EXACT, MOST = 2**24, 2**24, 2**62
#: Rounding unit of float32.
UNIT = 2.0**-24
#: Rows multiplied at a time.
STEP = 8192


def kept_vectors(vectors: DataFrame, dim: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows whose vector has ``dim`` components, all finite; v as doubles.

    Components of 2^62 or more after scaling fit no long column: such vectors are left out too.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(MOST) / scale))
    return rows.where((F.size("v") == dim) & ~bad)


def first_centroids(kept: DataFrame, clusters: int, seed: str) -> list[list[float]]:
    """The vectors with the smallest sha256 of ``seed:<id>``, in that order; ties by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["v"] for r in kept.orderBy(digest.asc_nulls_last(), "v").limit(clusters).select("v").collect()]


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: the product is rounded only where doubles hold no fractions any more."""
    return np.floor(x * scale).astype(np.int64)


def exact_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows: int64 where they fit, Python integers otherwise."""
    dim = max(1, v.shape[1])
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= LONG_EXACT and dim <= 4096:
        return ((v - c) ** 2).sum(axis=1)
    d = v.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


class Screen:
    """Centroids with what bounds the error of float32 products with them."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids
        self.few = int(np.abs(centroids).max(initial=0)) <= FLOAT_EXACT  # else nothing is screened
        self.single = centroids.astype(np.float32)
        self.norm = np.array([float(sum(int(x) ** 2 for x in row)) for row in centroids])
        dim = centroids.shape[1]
        #: A sum of dim products in any order is off by at most this times the sum of their sizes.
        self.gamma = dim * UNIT / (1 - dim * UNIT)

    def intervals(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 v.c for each row and centroid.

        The sizes of the products sum to |v||c| at most (Cauchy-Schwarz).  The few operations in
        doubles are covered by a slack of 2^-48 of everything that enters them.
        """
        dot = (v.astype(np.float32) @ self.single.T).astype(np.float64)
        lengths = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(self.norm)[None, :]
        mid = self.norm[None, :] - 2 * dot
        off = 2 * self.gamma * lengths * 1.000001 + (self.norm[None, :] + 2 * np.abs(dot) + lengths) * 2.0**-48
        return mid - off, mid + off

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, int]:
        """The number of each row's nearest centroid, and how many rows were compared exactly."""
        out, k = np.zeros(len(v), np.int64), len(self.exact)
        fits = (np.abs(v).max(axis=1, initial=0) <= FLOAT_EXACT) & self.few
        near = np.ones((len(v), k), bool)
        if fits.any():
            low, high = self.intervals(v[fits])
            near[fits] = low <= high.min(axis=1, keepdims=True)
        sure = near.sum(axis=1) == 1
        out[sure] = near[sure].argmax(axis=1)
        rest = np.flatnonzero(~sure)
        if len(rest):
            row, cent = np.nonzero(near[rest])
            d = exact_distances(v[rest[row]], self.exact[cent])
            best: dict[int, tuple] = {}
            if d.dtype == object:
                for r, c, x in zip(row.tolist(), cent.tolist(), d.tolist()):
                    best[r] = min(best.get(r, (x, c)), (x, c))
                out[rest] = [best[r][1] for r in range(len(rest))]
            else:
                order = np.lexsort((cent, d, row))
                first = np.searchsorted(row[order], np.arange(len(rest)))
                out[rest] = cent[order[first]]
        return out, len(rest)


def _steps(batch: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for at in range(0, batch.num_rows, STEP):
        part = batch.slice(at, STEP)
        yield part.column(0), to_integers(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)


def _moved(kept: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, total, count = Screen(centroids), np.zeros((k, dim), object), [0] * k
        for batch in batches:
            for _, v in _steps(batch, dim, scale):
                at, _ = screen.nearest(v)
                wide = np.abs(v).max(initial=0) > 2**48
                for c in np.unique(at).tolist():
                    mine = v[at == c]
                    count[c] += len(mine)
                    total[c] += mine.astype(object).sum(axis=0) if wide else mine.sum(axis=0).astype(object)
        full = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c in full for _ in range(dim)], pa.int32()), pa.array(list(range(dim)) * len(full), pa.int32()),
             pa.array([int(x) for c in full for x in total[c]], pa.decimal128(38, 0)), pa.array([count[c] for c in full for _ in range(dim)], pa.int64())],
            names=["c", "i", "s", "n"],
        )

    parts = kept.mapInArrow(sums, "c int, i int, s decimal(38,0), n long")
    out = centroids.copy()
    for r in parts.groupBy("c", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).collect():
        out[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return out


def fit(kept: DataFrame, dim: int, clusters: int, rounds: int, scale: int, seed: str) -> np.ndarray:
    """The centroids after ``rounds`` rounds; fewer than ``clusters`` vectors: one centroid for each."""
    first = first_centroids(kept, clusters, seed)
    centroids = to_integers(np.array(first, np.float64).reshape(-1, dim), scale)
    for _ in range(rounds if len(first) else 0):
        moved = _moved(kept, centroids, scale)
        if (moved == centroids).all():  # every further round would give the same
            break
        centroids = moved
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every row and the exact squared distance, which
    is null where it does not fit a long."""
    dim = centroids.shape[1]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            for ids, v in _steps(batch, dim, scale):
                at, _ = screen.nearest(v)
                d = exact_distances(v, centroids[at])
                far = pa.array([int(x) if x < 2**63 else None for x in d], pa.int64()) if d.dtype == object else pa.array(d)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(told, "vec_id long, cluster int, distance long")


def _lookup(values: list, kind: str) -> Column:
    table = F.array(*[F.lit(x).cast(kind) for x in values]) if values else F.array().cast(f"array<{kind}>")
    return F.get(table, F.col("cluster"))


def cluster(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Null vectors, vectors of another length or with null or non-finite components take no part.  Repeated
    rows count each.  A null key is returned as null, and starts a centroid only after all others.  Sums
    of distances that do not fit a long are null.  No kept vector: no row.  Other columns are not read.
    """
    kept = kept_vectors(vectors, dim, scale, key, vector)
    centroids = fit(kept, dim, clusters, rounds, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = materialize(assign(kept, centroids, scale), "clusters")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count("*").alias("of")).collect()
    sums = {r["cluster"]: int(r["s"]) if r["n"] == r["of"] else None for r in per}
    each = [sums.get(c, 0) for c in range(len(centroids))]
    total = None if None in each else reduce(int.__add__, each, 0)
    fits = [x if x is not None and x < 2**63 else None for x in (*each, total)]
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    return found.select(
        "vec_id", "cluster", "distance", _lookup(fits[:-1], "long").alias("cluster_inertia"), F.lit(fits[-1]).cast("long").alias("inertia"), _lookup(digests, "string").alias("centroid_sha256")
    )
