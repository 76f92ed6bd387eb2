"""Database tables read in even ranges of skewed keys, against the Derby that comes with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from pulsefield.sources import tables

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all keys within a hundred of each other, the rest spread over a billion, and rows without a key."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    near = spark.range(2000).select((F.col("id") % 100 + 500).alias("K"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("V"))
    far = spark.range(2000).select((F.col("id") * 500_000 - 1000).alias("K"), F.lit("far").alias("V"))
    none = spark.range(5).select(F.lit(None).cast("long").alias("K"), F.lit("none").alias("V"))
    rows = near.unionByName(far).unionByName(none)
    rows.coalesce(1).write.jdbc(url, "t", properties=DRIVER | {"createTableColumnTypes": "V VARCHAR(20)"})
    return url, rows


def test_ranges_are_even(spark, skewed):
    url, rows = skewed
    df = tables.read_jdbc(spark, url, "t", "K", parts=8, **DRIVER)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4005 and df.rdd.getNumPartitions() in (8, 9, 10) and max(sizes) <= 2 * 4000 / 8
    assert df.exceptAll(rows).isEmpty() and rows.exceptAll(df).isEmpty()


def test_filters_and_columns_are_pushed_down(spark, skewed):
    url, _ = skewed
    df = tables.read_jdbc(spark, url, "t", "K", parts=4, **DRIVER).where(F.col("V") == "far").select("K")
    scan = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Scan JDBC" in x][0]
    assert "EqualTo(V,far)" in scan.replace(" ", "") and "struct<K:bigint>" in scan and df.count() == 2000


def test_odd_keys(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    for name, ids in (("one", [7] * 50), ("empty", [])):
        spark.createDataFrame([(i,) for i in ids], "K long").coalesce(1).write.jdbc(url, name, properties=DRIVER)
        assert tables.read_jdbc(spark, url, name, "K", parts=4, **DRIVER).count() == len(ids)
    assert tables.key_bounds(spark, url, "one", "K", 4, **DRIVER) == []
