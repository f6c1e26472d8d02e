"""Clustering around centroids, each vector's nearest one found by the threshold algorithm.

Components become integers, so every sum and distance is exact and no order of tasks shows
in the result. Every dimension has its list of centroids sorted by value. A vector starts
at its own value in each list and walks outward, one entry a step; centroids it comes upon
for the first time are measured exactly. The squares of the gaps to the next entries add up
to the least distance that a centroid not yet seen may have, and the walk stops when that
sum is strictly greater than the best distance, so that ties still go to the smaller number.

A round needs the sums per centroid and dimension only: a task adds up its own vectors, so
vectors that repeat weigh on no shuffle. The centroids, ``k`` times ``dims`` integers, are
the one thing the driver holds.

Cases: vectors that are null, of another length, or with null or non-finite components take
no part, nor do those with an integer component beyond 2**62; a null key is kept and its
vector is a first centroid only after all others; rows that repeat are clustered once each;
equal centroids are told apart by number, the later ones stay empty and as they are; fewer
than ``k`` vectors make fewer centroids and an empty table none; a distance or sum beyond a
long is null; other columns are left out.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm.tables import bounded_batches, written

K = 40
DIMS = 64
ROUNDS = 5
SCALE = 256
SEED = 2
BLOCK = 512
MOST = 1 << 62  # the largest integer component
NARROW = 1 << 26  # up to here squared distances of 64 components fit 63 bits
LONG = (1 << 63) - 1


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that take part and their components as integers."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    x = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.floor(scale * x)
        fit = (np.abs(v) <= MOST).all(1)
    return rows[fit], v[fit].astype(np.int64)


def _walk(x: np.ndarray, centroids: np.ndarray, lists: np.ndarray, names: np.ndarray, most: int):
    """Nearest centroid, squared distance, and how many centroids were measured, for a block of vectors."""
    n, (k, dims) = len(x), centroids.shape
    base = np.arange(dims) * (k + 2)
    low = np.empty((n, dims), np.int64)
    for j in range(dims):
        low[:, j] = np.searchsorted(lists[j * (k + 2) + 1 : (j + 1) * (k + 2) - 1], x[:, j], side="right")
    best, who = np.full(n, most, x.dtype), np.zeros(n, np.int64)
    seen, live = np.zeros((n, k), bool), np.arange(n)
    for step in range(k):
        at = base + low
        below, above = x[live] - lists[at], lists[at + 1 + step] - x[live]
        gap = np.minimum(below, above)
        going = ((gap * gap).sum(1) <= best[live]) & ~seen[live].all(1)
        if not going.all():
            live, low, at, below, above = live[going], low[going], at[going], below[going], above[going]
        if not len(live):
            break
        down = below <= above
        met = np.zeros((len(live), k), bool)
        met[np.arange(len(live))[:, None], names[np.where(down, at, at + 1 + step)]] = True
        met &= ~seen[live]
        seen[live] |= met
        row, name = np.nonzero(met)
        apart = x[live[row]] - centroids[name]
        measured = np.full((len(live), k), most, x.dtype)
        measured[row, name] = (apart * apart).sum(1)
        first = measured.argmin(1)
        least = measured[np.arange(len(live)), first]
        better = (least < best[live]) | ((least == best[live]) & (first < who[live]))
        best[live[better]], who[live[better]] = least[better], first[better]
        low = low - down
    return who, best, seen.sum(1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (ties: the smaller number), their squared distance and the centroids measured."""
    k, dims = centroids.shape
    largest = max((int(np.abs(a).max()) for a in (vectors, centroids) if a.size), default=0)
    kind = np.int64 if largest < NARROW and dims <= DIMS else object
    vectors, centroids = vectors.astype(kind), centroids.astype(kind)
    far = 4 * max(largest, 1)  # beyond every gap between two values
    order = np.argsort(centroids, axis=0, kind="stable").T
    lists = np.full((dims, k + 2), far, kind)
    lists[:, 0] = -far
    lists[:, 1:-1] = np.take_along_axis(centroids.T, order, 1)
    names = np.zeros((dims, k + 2), np.int64)
    names[:, 1:-1] = order
    most = LONG if kind is np.int64 else dims * (2 * far) ** 2
    parts = [
        _walk(vectors[i : i + BLOCK], centroids, lists.ravel(), names.ravel(), most) for i in range(0, max(len(vectors), 1), BLOCK)
    ]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _kept(dims: int, scale: int):
    def run(batches):
        for batch in batches:
            rows, v = integers(batch.column("vector"), dims, scale)
            bounds = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column("key").take(pa.array(rows)), "v": pa.ListArray.from_arrays(bounds, pa.array(v.ravel()))}
            )

    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(centroids: np.ndarray):
    def run(batches):
        sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch)
            who, _, _ = nearest(v, centroids)
            wide = int(np.abs(v).max()) * len(v) >= MOST
            order = np.argsort(who, kind="stable")
            found, first = np.unique(who[order], return_index=True)
            sums[found] += np.add.reduceat(v[order].astype(object if wide else np.int64), first, axis=0).astype(object)
            counts += np.bincount(who, minlength=len(centroids))
        name, dim = np.nonzero(np.broadcast_to(counts[:, None] > 0, centroids.shape))
        total = pa.array([Decimal(int(s)) for s in sums[name, dim]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_pydict(
            {"cluster": name.astype(np.int32), "dim": dim.astype(np.int32), "total": total, "n": counts[name]}
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                who, distance, measured = nearest(_matrix(batch), centroids)
                fits = pa.array([int(d) if d <= LONG else None for d in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {"key": batch.column("key"), "cluster": who.astype(np.int32), "distance": fits, "measured": measured.astype(np.int32)}
                )

    return run


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and key, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "key", "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors becomes the floor of their mean."""
    parts = kept.select("v").mapInArrow(_summed(centroids), "cluster int, dim int, total decimal(38,0), n bigint")
    moved = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return moved


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS,
    scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """Key, ``cluster``, squared ``distance`` and ``measured`` (centroids the walk came upon) of every vector; the centroids."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector"))
    kept = written(rows.mapInArrow(_kept(dims, scale), "key bigint, v array<bigint>"), "vectors")
    centroids = first_centroids(kept, k, seed)
    schema = "key bigint, cluster int, distance bigint, measured int"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key), []
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    found = written(kept.mapInArrow(_assigned(centroids), schema), "clusters")
    return found.withColumnRenamed("key", key), centroids.tolist()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds the inertia of the cluster and of all, and the digest of the final centroid: one row per centroid is broadcast."""
    spark = found.sparkSession
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond")
    )
    own = {r["cluster"]: int(r["total"] or 0) if not r["beyond"] else None for r in sums.collect()}
    whole = None if None in own.values() else sum(own.values())
    long = lambda n: n if n is not None and n <= LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(i, long(own.get(i, 0)), long(whole), d) for i, d in enumerate(digests)]
    stated = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(stated), "cluster")
