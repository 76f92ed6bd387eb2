"""Centroid clustering of vectors in whole numbers, screened by block norms.

A vector's components become floor(scale * x) once, in a table that also holds its norm in each of ``blocks`` segments: the compressed form of the
vector. Centroids are compressed alike. Of two vectors a segment's inner product is at most the product of its norms (Cauchy-Schwarz), so

    |x|**2 + |c|**2 - 2 * sum over segments of |x_s| * |c_s|

bounds their squared distance from below. All bounds of a tile of vectors are one small matrix product. The centroid of least bound is measured exactly, in
integers; only those whose bound, less what rounding may add, isn't above that distance are measured as well. So the nearest centroid, and of
equally near ones the first, is always found. A round sends a row a centroid and task: member counts and sums in unbounded integers; the new centroid
is the floor of their quotient. Only centroids, k times the dimension, are on the driver and in the tasks.

Edge cases: vectors of another length, null ones and those with a null, NaN or infinite component take no part. Ids of any type are kept; rows without an id come
last among the seeds and take part otherwise, rows repeated under one id are vectors of their own (seeds of equal hash in the order of their components). Fewer
vectors than k give as many centroids; a centroid without members stays where it is. Sums and distances are exact at any size; a component of 2**62 / scale
or more, or a distance or inertia beyond 64 bits, can't be given back and raises. An empty table yields no rows.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, IntegerType, StructField, StructType

from pulsefield.llm.common import materialize, table
from pulsefield.llm.topk import quantize

TILE = 1024
_LARGEST = np.iinfo(np.int64).max


def block_norms(vectors: np.ndarray, blocks: int) -> np.ndarray:
    """The norm of each segment; the last one is shorter if the length isn't a multiple."""
    squares = vectors.astype(np.float64) ** 2
    starts = np.linspace(0, vectors.shape[1], blocks, endpoint=False).astype(int)
    return np.sqrt(np.add.reduceat(squares, starts, axis=1))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; raises where one leaves 64 bits."""
    gap = a - b
    if gap.dtype != object:
        return np.einsum("ij,ij->i", gap, gap)
    return np.array([sum(int(x) * int(x) for x in row) for row in gap], object).astype(np.int64)


def nearest(vectors: np.ndarray, norms: np.ndarray, centers: np.ndarray, center_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest center of each vector (the first of several), the squared distance, and how many distances were computed."""
    high = max((abs(int(x)) for m in (vectors, centers) if m.size for x in (m.min(), m.max())), default=0)
    if (2 * high) ** 2 * max(1, vectors.shape[1]) > _LARGEST:
        vectors, centers = vectors.astype(object), centers.astype(object)
    size = (norms**2).sum(axis=1)[:, None] + (center_norms**2).sum(axis=1)
    bound = size - 2 * (norms @ center_norms.T)
    rows, first = np.arange(len(vectors)), bound.argmin(axis=1)
    exact = np.full(bound.shape, _LARGEST, np.int64)
    exact[rows, first] = least = squared_distances(vectors, centers[first])
    open_ = bound - 1e-9 * size - 1 <= least[:, None].astype(np.float64) * (1 + 1e-9)
    open_[rows, first] = False
    i, j = np.nonzero(open_)
    exact[i, j] = squared_distances(vectors[i], centers[j])
    best = exact.argmin(axis=1)
    return best, exact[rows, best], len(rows) + len(i)


def _tiles(batch: pa.RecordBatch, dim: int, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norms = batch.column("norms").flatten().to_numpy(zero_copy_only=False).reshape(-1, blocks)
    for at in range(0, len(vectors), TILE):
        yield at, vectors[at : at + TILE], norms[at : at + TILE]


def compressed(vectors: DataFrame, dim: int, scale: int, blocks: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v (whole numbers) and norms of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            norms = pa.FixedSizeListArray.from_arrays(pa.array(block_norms(v, blocks).ravel()), blocks).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), norms], ["id", "v", "norms"])

    whole = F.when(F.size(vector_col) == dim, quantize(F.col(vector_col), scale))
    kept = vectors.select(F.col(id_col).alias("id"), whole.alias("v")).where("v is not null")
    return kept.mapInArrow(run, StructType([kept.schema["id"], *StructType.fromDDL("v array<bigint>, norms array<double>").fields]))


def seeds(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose salted id has the least SHA-256."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return np.array([r.v for r in kept.select(order.alias("o"), "v").orderBy(F.asc_nulls_last("o"), "v").limit(k).collect()], np.int64)


def moved(kept: DataFrame, centers: np.ndarray, blocks: int) -> np.ndarray:
    """The centroids after one round: the componentwise floor of their members' mean."""
    (k, dim), norms = centers.shape, block_norms(centers, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]
        for batch in batches:
            for _, v, own in _tiles(batch, dim, blocks):
                found, _, _ = nearest(v, own, centers, norms)
                wide = v.astype(object) if np.abs(v).max() > 1 << 50 else v
                for c in np.unique(found).tolist():
                    members = wide[found == c]
                    counts[c] += len(members)
                    sums[c] = [a + b for a, b in zip(sums[c], members.sum(axis=0).tolist(), strict=True)]
        held = [c for c in range(k) if counts[c]]
        whole = pa.array([[decimal.Decimal(x) for x in sums[c]] for c in held], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([counts[c] for c in held], pa.int64()), whole], ["cluster", "n", "sums"])

    parts = kept.select("v", "norms").mapInArrow(run, "cluster int, n bigint, sums array<decimal(38,0)>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    out = centers.copy()
    for r in total.collect():
        out[r.cluster] = [int(x) // r.n for x in r.sums]
    return out


def assigned(kept: DataFrame, centers: np.ndarray, blocks: int) -> DataFrame:
    """id, cluster and distance of every vector."""
    dim, norms = centers.shape[1], block_norms(centers, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v, own in _tiles(batch, dim, blocks):
                found, distance, _ = nearest(v, own, centers, norms)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(v)), pa.array(found.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return kept.mapInArrow(run, StructType([kept.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())]))


def clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, blocks: int = 16, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that takes part, and the final centroids."""
    kept = materialize(compressed(vectors, dim, scale, blocks, id_col, vector_col), "compressed")
    centers = seeds(kept, k, salt).reshape(-1, dim)
    for _ in range(rounds if len(centers) else 0):
        centers = moved(kept, centers, blocks)
    if not len(centers):
        return kept.selectExpr("id as vec_id", "0 as cluster", "0L as distance"), centers
    return assigned(kept, centers, blocks).withColumnRenamed("id", "vec_id"), centers


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centers = clusters(table(spark, sf_dir, "embeddings"))
    rows = materialize(found, "clusters")
    total = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row a centroid, small whatever the input
    digest = lambda center: hashlib.sha256(",".join(map(str, center)).encode()).hexdigest()
    named = [(i, total[i], sum(total.values()), digest(c)) for i, c in enumerate(centers.tolist()) if i in total]
    of_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int, dim: int, scale: int) -> str:
    near = """{a} AS (
  SELECT rid, vec_id, v, min(d) AS distance, arg_min(c, (d, c)) AS cluster FROM (
    SELECT rid, vec_id, v.v, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN {c} c
  ) GROUP BY rid, vec_id, v
)"""
    move = """m{i} AS (
  SELECT cluster, p, count(*) AS n, sum(x) AS s FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {last})) AS p FROM a{i}) GROUP BY cluster, p
), n{i} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM m{i} GROUP BY cluster
), c{next} AS MATERIALIZED (
  SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n ON n.cluster = c.c
)"""
    steps = ",\n".join(f"{near.format(a=f'a{i}', c=f'c{i}')}, {move.format(i=i, next=i + 1, last=dim + 1)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k})
), {steps}, {near.format(a="f", c=f"c{rounds}")}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.c = f.cluster
"""


OP12_SQL = _sql(40, 5, 64, 256)
