"""Exact top-k inner-product search, term at a time.

Queries and candidates meet in a grid of (query block, candidate block) cells, so a task
holds one block of each whatever the sizes of the two sides. In a cell, each dimension
is a term: its posting list, made once for the cell, is the candidates with a nonzero component, and every query
row that has the term scatters weight times posting into its dense score array. A
partition selection keeps k per query and cell, and a window merges the cells.

Edge cases: vectors that are null or hold a null, NaN or infinite component take no
part, nor do rows without an id, unless ``unnamed`` makes candidates of them. Vectors of different lengths are compared as if the
shorter ended in zeros, so an empty one scores 0 with all. Scores are exact: a cell whose products might leave 64 bits is summed in
unbounded integers. A component of 2**62 / scale or more, or a best score beyond 64 bits, can't be given back and raises. Ties go to the smaller id, null last. Rows are told apart
by their place, not by their id: every row but the query's own is a candidate, also one of the same id, and each of several query rows
of an id has a ranking of its own. Fewer than k candidates yield all. An empty table yields no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, table


def quantize(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), null if the vector can't take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**62, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is too large for a whole-number score")).cast("long")))
    return F.when(vector.isNotNull() & ~bad, whole)


def postings(candidates: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term the places of the candidates that have it, and their components."""
    by_term = np.ascontiguousarray(candidates.T)
    return [(at := np.flatnonzero(values), values[at]) for values in by_term]


def scatter_scores(queries: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Dense scores of every query row for n candidates, accumulated term by term from posting lists."""
    scores = np.zeros((len(queries), n), queries.dtype)
    for weights, (at, values) in zip(np.ascontiguousarray(queries.T), lists, strict=False):
        rows = np.flatnonzero(weights)
        if len(rows) == len(queries) and len(at) == n:
            scores += weights[:, None] * values
        elif len(rows) and len(at):
            scores[np.ix_(rows, at)] += weights[rows, None] * values
    return scores


def _matrix(column: pd.Series) -> np.ndarray:
    rows = [np.asarray(x, np.int64) for x in column]
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    query_block: int = 1024,
    candidate_block: int = 4096,
    tile: int = 64,
    unnamed: bool = False,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row with an id where is_query holds."""
    own = F.col(id_col).cast("long")
    asks = own.isNotNull() & F.coalesce(is_query, F.lit(False))
    kept = materialize(
        # Numbers instead of nulls, which pandas would turn into floats.
        vectors.select(
            F.monotonically_increasing_id().alias("rid"), F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), quantize(F.col(vector_col), scale).alias("v"), asks.alias("q")
        ).where((F.lit(unnamed) | ~F.col("none")) & F.col("v").isNotNull()),
        "topk",
    )
    size = kept.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    n_c, n_q = max(1, math.ceil(size.n / candidate_block)), max(1, math.ceil(size.q / query_block))
    hashed = F.xxhash64("rid")
    # The two sides have no column in common, as cogroup() would prune one side's. One copy of a vector for each block of the other side: the grid's cells, not pairs of rows.
    cells_q = kept.where("q").select(F.col("rid").alias("asker"), F.col("id").alias("query_id"), F.col("v").alias("asked"), F.pmod(hashed, F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    cells_c = kept.select("rid", "id", "none", "v", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.pmod(hashed, F.lit(n_c)).alias("cb"))

    def cell(queries: pd.DataFrame, candidates: pd.DataFrame) -> Iterator[pd.DataFrame]:
        columns = ("asker", "query_id", "vec_id", "none", "score")
        empty = pd.DataFrame({c: [] for c in columns}, dtype="int64").astype({"none": bool})
        if queries.empty or candidates.empty:
            return empty
        candidates = candidates.sort_values(["none", "id"], kind="stable")
        rids, ids, none, held = candidates["rid"].to_numpy(), candidates["id"].to_numpy(), candidates["none"].to_numpy(), _matrix(candidates["v"])
        asked = list(zip(queries["asker"].tolist(), queries["query_id"].tolist(), strict=True))
        q, out = _matrix(queries["asked"]), []
        if _largest(q) * _largest(held) * min(q.shape[1], held.shape[1]) >= 1 << 63:
            q, held = q.astype(object), held.astype(object)
        lists = postings(held)
        for at in range(0, len(q), tile):
            for (rid, query), row in zip(asked[at : at + tile], scatter_scores(q[at : at + tile], lists, len(ids)), strict=True):
                others = np.flatnonzero(rids != rid)
                s = row[others]
                if len(s) > k:
                    least = (np.sort(s) if s.dtype == object else np.partition(s, len(s) - k))[len(s) - k]
                    above, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
                    keep = np.concatenate([above, ties[: k - len(above)]])  # ids ascend, so the first ties are the smallest
                else:
                    keep = np.arange(len(s))
                kept_at = others[keep]
                out.append((np.full(len(keep), rid), np.full(len(keep), query), ids[kept_at], none[kept_at], s[keep].astype(np.int64)))  # raises beyond 64 bits
        if not out:
            return empty
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    best = cells_q.groupBy("qb", "cb").cogroup(cells_c.groupBy("qb", "cb")).applyInPandas(cell, "asker long, query_id long, vec_id long, none boolean, score long")
    best = best.withColumn("vec_id", F.when(~F.col("none"), F.col("vec_id")))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, unnamed=True)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
