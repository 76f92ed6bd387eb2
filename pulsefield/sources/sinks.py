"""Sinks: staged publishing, campaign partitions, CSV exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsefield.functions.text import campaign_alnum


def campaign_token(c: Column) -> Column:
    """One spelling for all of a campaign id, so that ids which differ in signs or case share a partition."""
    return F.coalesce(F.nullif(campaign_alnum(c), F.lit("")), F.lit("unknown"))


def write_run(tables: dict[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """Write all tables of a run to a folder of its own. Tables with a campaign are partitioned by its token.

    A campaign that a run doesn't have has no folder in it, so nothing is left over from runs before.
    """
    paths = {name: f"{root}/runs/{run_id}/{name}" for name in tables}
    for name, df in tables.items():
        by_campaign = "campaign" in df.columns and len(df.columns) > 1
        df = df.withColumn("campaign_token", campaign_token(F.col("campaign"))) if by_campaign else df
        writer = df.write.mode("overwrite")
        (writer.partitionBy("campaign_token") if by_campaign else writer).parquet(paths[name])
        # A partitioned table without rows has no files that tell its columns.
        df.sparkSession.createDataFrame([(df.schema.json(),)], "s string").coalesce(1).write.mode("overwrite").text(f"{root}/runs/{run_id}/_columns/{name}")
    return paths


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its old version and move it over that, so a reader always finds a whole one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    place, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    files = place.getFileSystem(conf)
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(beside), files.makeQualified(place), overwrite)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a run made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def point_to(spark: SparkSession, root: str, run_id: str) -> None:
    """Make a run the published one."""
    replace_file(spark, f"{root}/CURRENT", run_id)


def publish(tables: dict[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """Write a run and then point to it: readers see the old run or the new one whole, also if this ends in between."""
    paths = write_run(tables, root, run_id)
    point_to(next(iter(tables.values())).sparkSession, root, run_id)
    return paths


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the run that was published last; a filter on campaign_token prunes folders."""
    run_id = spark.read.text(f"{root}/CURRENT").first()[0]
    columns = StructType.fromJson(json.loads(spark.read.text(f"{root}/runs/{run_id}/_columns/{name}").first()[0]))
    return spark.read.schema(columns).parquet(f"{root}/runs/{run_id}/{name}")


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)
