"""The keys that a source holds now, kept in buckets: whole reads replace them, deltas are merged in, deleted rows leave tombstones.

A snapshot is a folder of writes, ``seq=<n>/bucket=<b>``, and a manifest that says which writes make up each bucket, in order. A whole read
is one write for all buckets. A delta writes only the buckets of its keys, so a read by watermark never stands for the whole. Readers merge on read: the last
write that has a key decides, and a tombstone takes it out. ``compact`` rewrites the buckets that several writes make up and no others.

The manifest is written beside the old one and moved over it, so a reader sees the state before or after a write. A write that ended
before its manifest did is written over by the next. There is one writer a snapshot. Buckets are the leading hexadecimal digits of the key's md5.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.sources.sinks import remove, replace_file

COLUMNS = "row_key string, source string, run_id string, gone boolean"


def bucket_of(key: Column, digits: int) -> Column:
    return F.concat(F.lit("b"), F.substring(F.md5(key), 1, digits))


def manifest(spark: SparkSession, root: str) -> dict | None:
    """``seq``, the number of writes, and ``buckets``, the writes of each bucket; None before the first write."""
    try:
        return json.loads(spark.read.text(f"{root}/_manifest/current", wholetext=True).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _write(keys: DataFrame, root: str, seq: int, digits: int) -> list[str]:
    """Write keys as one more part and return the buckets that it touches."""
    spark = keys.sparkSession
    placed = keys.select("row_key", "source", "run_id", "gone", bucket_of(F.col("row_key"), digits).alias("bucket")).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/seq={seq}")
    back = spark.read.schema(f"{COLUMNS}, bucket string").parquet(f"{root}/seq={seq}")
    return sorted(r[0] for r in back.select("bucket").distinct().collect())


def _commit(spark: SparkSession, root: str, seq: int, digits: int, buckets: dict[str, list[int]]) -> None:
    replace_file(spark, f"{root}/_manifest/current", json.dumps({"seq": seq, "digits": digits, "buckets": buckets}))


def _one_row_a_key(rows: DataFrame, run_id: str) -> DataFrame:
    """rows (row_key, source, gone): a key counts as deleted if all its rows say so."""
    found = rows.where(F.coalesce("row_key", F.lit("")) != "").groupBy("row_key", "source").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("gone"))
    return found.withColumn("run_id", F.lit(run_id))


def replace(rows: DataFrame, root: str, run_id: str, digits: int = 2) -> None:
    """Make the keys of a whole read (row_key, source, gone) the snapshot."""
    spark = rows.sparkSession
    old = manifest(spark, root)
    seq = (old["seq"] if old else 0) + 1
    touched = _write(_one_row_a_key(rows, run_id).where("not gone"), root, seq, digits)
    _commit(spark, root, seq, digits, {b: [seq] for b in touched})


def merge(rows: DataFrame, root: str, run_id: str) -> list[str]:
    """Merge the keys of a delta (row_key, source, gone) into the snapshot; the buckets touched. Raises if there is none to merge into."""
    spark = rows.sparkSession
    old = manifest(spark, root)
    if old is None:
        raise ValueError(f"no whole read was recorded in {root}")
    seq, buckets = old["seq"] + 1, old["buckets"]
    touched = _write(_one_row_a_key(rows, run_id), root, seq, old["digits"])
    _commit(spark, root, seq, old["digits"], buckets | {b: [*buckets.get(b, []), seq] for b in touched})
    return touched


def _merged(spark: SparkSession, root: str, buckets: dict[str, list[int]]) -> DataFrame:
    paths = [f"{root}/seq={s}/bucket={b}" for b, parts in buckets.items() for s in parts]
    if not paths:
        return spark.createDataFrame([], f"row_key string, source string, run_id string, bucket string")
    rows = spark.read.schema(f"{COLUMNS}, seq int, bucket string").option("basePath", root).parquet(*paths)
    last = rows.groupBy("bucket", "source", "row_key").agg(F.max(F.struct("seq", "run_id", "gone")).alias("last"))
    return last.where("not last.gone").select("row_key", "source", "last.run_id", "bucket")


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """row_key, source, run_id (that wrote it last) and bucket of the keys that the source holds; None if nothing was recorded, which keeps all rows."""
    now = manifest(spark, root)
    return None if now is None else _merged(spark, root, now["buckets"])


def compact(spark: SparkSession, root: str, writes: int = 2) -> list[str]:
    """Rewrite the buckets that so many writes or more make up, each as one write; the buckets rewritten."""
    now = manifest(spark, root)
    old = {b: parts for b, parts in (now["buckets"] if now else {}).items() if len(parts) >= writes}
    if not old:
        return []
    seq = now["seq"] + 1
    kept = _write(_merged(spark, root, old).withColumn("gone", F.lit(False)), root, seq, now["digits"])
    rest = {b: parts for b, parts in now["buckets"].items() if b not in old}
    _commit(spark, root, seq, now["digits"], rest | {b: [seq] for b in kept})
    return sorted(old)


def expire(spark: SparkSession, root: str) -> list[int]:
    """Delete the writes that no bucket needs any more; their numbers. Only when nobody reads an older state."""
    now = manifest(spark, root)
    used = {s for parts in now["buckets"].values() for s in parts} if now else set()
    gone = [s for s in range(1, (now["seq"] if now else 0) + 1) if s not in used]
    for s in gone:
        remove(spark, f"{root}/seq={s}")
    return gone


def still_there(rows: DataFrame, key: Column, root: str) -> DataFrame:
    """The rows whose key the snapshot has; all of them if none was recorded."""
    keys = current(rows.sparkSession, root)
    return rows if keys is None else rows.withColumn("_key", key).join(keys.select(F.col("row_key").alias("_key")).distinct(), "_key", "left_semi").drop("_key")
