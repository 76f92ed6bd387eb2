"""Clustering in whole numbers against a plain form, and the screening by block norms."""

import hashlib
import math
import random

import numpy as np
import pytest

from pulsefield.llm import clusters


def plain(rows, k, rounds, dim, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centers = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [tuple(sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)) if i in groups else c for i, c in enumerate(centers)]
    return sorted((str(i), *near(v)[::-1]) for i, v in kept), centers


def vectors(dim, n=300, seed=3):
    rng = random.Random(seed)
    bases = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    out = [(i, [b + rng.gauss(0, 0.3) for b in bases[i % 6]]) for i in range(n)]
    out += [(n + i, list(bases[0])) for i in range(40)] + [(n + 50, list(bases[1]))] * 3  # copies and rows repeated under one id
    out += [(None, list(bases[2])), (900, None), (901, [0.0] * (dim - 1)), (902, [float("nan")] + [0.0] * (dim - 1)), (903, [None] + [0.0] * (dim - 1)), (904, [float("inf")] * dim), (905, [])]
    return out


def frame(spark, rows, kind="long"):
    df = spark.createDataFrame([(None if i is None else str(i), v, "x", 1) for i, v in rows], "vec_id string, embedding array<double>, id string, cluster int")
    return df.withColumn("vec_id", df.vec_id.cast(kind)).repartition(3)


@pytest.mark.parametrize("dim, k, kind", [(64, 40, "long"), (5, 7, "string"), (16, 1, "long"), (3, 500, "long")])
def test_rows_equal_plain_form(spark, dim, k, kind):
    rows = vectors(dim)
    found, centers = clusters.clusters(frame(spark, rows, kind), k=k, dim=dim, rounds=3, blocks=min(8, dim))
    want, plain_centers = plain(rows, k, 3, dim, 256)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert centers.tolist() == [list(c) for c in plain_centers]
    assert dict(found.dtypes)["vec_id"] == ("bigint" if kind == "long" else kind)


def test_screening_spares_distances_and_misses_none():
    rng = np.random.default_rng(1)
    centers = rng.integers(-400, 400, (40, 64))
    v = centers[rng.integers(0, 40, 2000)] + rng.integers(-60, 60, (2000, 64))
    best, distance, measured = clusters.nearest(v, clusters.block_norms(v, 16), centers, clusters.block_norms(centers, 16))
    every = ((v[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.5 * every.size


def test_ties_large_values_and_overflow(spark):
    v = np.array([[0, 0], [3, 4]])
    centers = np.array([[3, 4], [-3, -4], [3, 4]])
    best, distance, _ = clusters.nearest(v, clusters.block_norms(v, 2), centers, clusters.block_norms(centers, 2))
    assert best.tolist() == [0, 0] and distance.tolist() == [25, 0]
    far = np.array([[3 * 10**9 + 1, 0], [3 * 10**9, 0]])
    best, distance, _ = clusters.nearest(far, clusters.block_norms(far, 1), np.array([[2, 0], [0, 0]]), clusters.block_norms(np.array([[2, 0], [0, 0]]), 1))
    assert best.tolist() == [0, 0] and distance.tolist() == [(3 * 10**9 - 1) ** 2, (3 * 10**9 - 2) ** 2]
    with pytest.raises(OverflowError):
        clusters.nearest(far * 2, clusters.block_norms(far * 2, 1), -far, clusters.block_norms(-far, 1))
    rows = [(i, [float(2**40 + i), 1.0]) for i in range(6)]
    found, centers = clusters.clusters(frame(spark, rows), k=2, dim=2, rounds=2, blocks=2)
    want, plain_centers = plain(rows, 2, 2, 2, 256)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want and centers.tolist() == [list(c) for c in plain_centers]


def test_empty_table(spark, tmp_path):
    frame(spark, vectors(64)).limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = clusters.op12_centroid_clusters(spark, str(tmp_path))
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and df.count() == 0
