"""Centroid clustering against brute force with exact integers, on vectors with odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwarden.llm import centroids, queries

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster int, v string, key int, `a.b` int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, 4) for i, v in rows], SCHEMA)


def vectors(dims, n=400):
    rng = np.random.default_rng(dims)
    middles = rng.normal(size=(9, dims))
    rows = [(i, (middles[i % 9] + 0.2 * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(150)] + [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1)), (904, [None] + [0.0] * (dims - 1))]
    return rows + [(905, [math.nan] * dims), (906, [math.inf] * dims), (907, [1e300] * dims), (908, [0.0] * dims)]


def brute(rows, k, dims, rounds, scale, seed):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and max(map(abs, v)) * scale <= 2**62:
            kept.append((i, [math.floor(scale * x) for x in v]))
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    middles = [v for _, v in sorted(kept, key=rank)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middles))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        middles = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(middles)]
    return Counter((i, near(v)[1], near(v)[0] if near(v)[0] < 1 << 63 else None) for i, v in kept), middles


@pytest.mark.parametrize("k,dims,scale", [(7, 3, 256), (40, 8, 4), (5, 4, 1 << 30), (2000, 2, 16)])
def test_clusters(spark, k, dims, scale):
    rows = vectors(dims, 150 if scale > 256 else 400)
    got, middles = centroids.cluster(make(spark, rows).repartition(3), k=k, dims=dims, rounds=3, scale=scale)
    want, last = brute(rows, k, dims, 3, scale, centroids.SEED)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want and middles == last
    assert got.columns == ["vec_id", "cluster", "distance", "measured"]


def test_beyond_long(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 2**55, -(2**55), 2**54])]
    got, middles = centroids.cluster(make(spark, rows), k=2, dims=2, rounds=2, scale=128)
    want, last = brute(rows, 2, 2, 2, 128, centroids.SEED)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want and middles == last
    told = centroids.with_inertia(got, middles).collect()
    assert {r.inertia for r in told} == {None} and any(d is None for _, _, d in want)


def test_nothing(spark):
    got, middles = centroids.cluster(make(spark, []))
    assert got.count() == 0 and middles == [] and centroids.with_inertia(got, middles).count() == 0


def test_walk_stops_early():
    rng = np.random.default_rng(2)
    middles = np.floor(1000 * rng.normal(size=(400, 3))).astype(np.int64)
    points = (middles[rng.integers(0, 400, 2000)] + rng.integers(-20, 20, (2000, 3))).astype(np.int64)
    who, distance, measured = centroids.nearest(points, middles)
    apart = ((points[:, None] - middles[None]) ** 2).sum(2)
    assert (who == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert measured.mean() < 40  # of 400
    tied = np.array([[0, 0], [2, 0], [0, 0], [1, 5]])
    who, distance, _ = centroids.nearest(np.array([[1, 0], [0, 0], [1, 1]]), tied)
    assert who.tolist() == [0, 0, 0] and distance.tolist() == [1, 0, 2]


def test_query(spark, tmp_path):
    rows = vectors(64, 120)
    make(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_centroid_clustering(spark, str(tmp_path))
    want, last = brute(rows, 40, 64, 5, 256, 2)
    per, total = Counter(), sum(d * n for (_, _, d), n in want.items())
    for (_, c, d), n in want.items():
        per[c] += d * n
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in last]
    assert Counter(map(tuple, got.collect())) == Counter({(i, c, d, per[c], total, digest[c]): n for (i, c, d), n in want.items()})
