"""A weekly cleanup: orders that were copied three ways are deleted at their source, by guard, in two attempts.

The copies are views of orders: a legacy table with the price as guard, a newer one of every second order, whose guard is the later word, and events of orders
without one. At the source an order in nine is gone by now, one in ten has changed, and the first attempt is refused for one in seven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.operators import cleanup as C
from pulsefield.plans.base import query
from pulsefield.session import table, work_folder


def _copies(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    o = table(spark, sf_dir, "orders")
    key, price = F.concat(F.lit(" "), F.col("o_orderkey").cast("string")), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    newer = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("key"), F.concat(price, F.lit("!")).alias("guard"))
    return [o.select(key.alias("key"), price.alias("guard")), newer, o.where("o_orderstatus = 'X'").select(key.alias("key"), F.lit(None).cast("string").alias("guard"))]


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.when(k % 2 == 0, "!").otherwise(""), F.when(k % 10 == 0, "changed").otherwise(""))
    return o.where("o_orderkey % 9 <> 0").select(k.cast("string").alias("key"), price.alias("guard"))


def _two_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states after two attempts and a third that finds nothing to do; the log is written after each."""
    folder = work_folder(spark, "cleanup")
    rows, source = C.manifest(_copies(spark, sf_dir)), _source(spark, sf_dir)
    log = spark.createDataFrame([], C.EVENTS)
    for number in (1, 2, 3):
        refused = F.when((F.col("key").cast("long") % 7 == 0) & F.lit(number == 1), "connection lost")
        gone = log.where("status = 'DELETED'").select("key")
        events = C.attempt(rows, log, source.join(gone, "key", "left_anti"), lambda df, e=refused: df.withColumn("error", e), number)
        events.write.parquet(f"{folder}/attempt={number}")
        log = spark.read.schema(C.EVENTS).parquet(*[f"{folder}/attempt={i}" for i in range(1, number + 1)])
        log = log.drop("attempt").withColumn("attempt", F.regexp_extract(F.input_file_name(), r"attempt=(\d+)", 1).cast("int")).select("key", "attempt", "status", "error")
    return C.states(rows, log)


STATES = """s AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 9 = 0 THEN 'ALREADY_ABSENT' WHEN o_orderkey % 10 = 0 THEN 'GUARD_BLOCKED' ELSE 'DELETED' END AS status,
  CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM orders)"""


@query(f"WITH {STATES} SELECT key, status, CAST(attempts AS BIGINT) AS attempts FROM s")
def cleanup_states(spark, sf_dir):
    """What became of every copied order, and in how many attempts."""
    return _two_attempts(spark, sf_dir).select("key", "status", "attempts")


@query(f"WITH {STATES} SELECT count(*) AS copied, count(*) FILTER (WHERE status = 'DELETED') AS deleted, count(*) FILTER (WHERE status = 'ALREADY_ABSENT') AS already_absent, count(*) FILTER (WHERE status = 'GUARD_BLOCKED') AS guard_blocked, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS pending, CASE WHEN bool_or(status = 'GUARD_BLOCKED') THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status FROM s")
def cleanup_run(spark, sf_dir):
    """The cleanup in one row."""
    return C.run_summary(_two_attempts(spark, sf_dir))
