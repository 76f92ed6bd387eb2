"""Snapshots by bucket, and ingest runs over sources that move, fail late or delete rows."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulsefield.sources import ingest, snapshots


def keys(spark, rows):
    return spark.createDataFrame(rows, "row_key string, source string, gone boolean")


def state(spark, root):
    return {(r.row_key, r.source): r.run_id for r in snapshots.current(spark, root).collect()}


def test_deltas_merge_and_tombstones_hide(spark, tmp_path):
    root = f"{tmp_path}/s"
    assert snapshots.current(spark, root) is None
    with pytest.raises(ValueError, match="no whole read"):
        snapshots.merge(keys(spark, [("a", "t", False)]), root, "r0")
    snapshots.replace(keys(spark, [("a", "t", False), ("b", "t", None), ("b", "u", False), ("c", "t", True), (None, "t", False), ("", "t", False)]), root, "r1")
    assert state(spark, root) == {("a", "t"): "r1", ("b", "t"): "r1", ("b", "u"): "r1"}
    touched = snapshots.merge(keys(spark, [("b", "t", True), ("d", "t", False), ("a", "t", False), ("a", "t", True)]), root, "r2")
    assert state(spark, root) == {("a", "t"): "r2", ("b", "u"): "r1", ("d", "t"): "r2"} and len(touched) <= 3
    snapshots.merge(keys(spark, [("b", "t", False)]), root, "r3")
    before, parts = state(spark, root), snapshots.manifest(spark, root)["buckets"]
    rewritten = snapshots.compact(spark, root)
    assert before == state(spark, root) and before["b", "t"] == "r3"
    after = snapshots.manifest(spark, root)["buckets"]
    assert set(rewritten) == {b for b, p in parts.items() if len(p) > 1} and all(after[b] == p for b, p in parts.items() if b not in rewritten)
    assert snapshots.compact(spark, root) == [] and set(snapshots.expire(spark, root)) == {1, 2, 3} - {s for p in after.values() for s in p}
    assert state(spark, root) == before
    snapshots.replace(keys(spark, [("z", "t", False)]), root, "r4")
    assert state(spark, root) == {("z", "t"): "r4"}
    snapshots.replace(keys(spark, []), root, "r5")
    assert state(spark, root) == {}
    rows = spark.createDataFrame([("z",), ("y",)], "k string")
    assert snapshots.still_there(rows, F.col("k"), root).count() == 0 and snapshots.still_there(rows, F.col("k"), f"{tmp_path}/none").count() == 2


def test_a_write_without_its_manifest_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/s"
    snapshots.replace(keys(spark, [("a", "t", False)]), root, "r1")
    snapshots._write(keys(spark, [("b", "t", False), ("c", "t", False)]).withColumn("run_id", F.lit("r2")), root, 2, 2)  # and a crash
    assert state(spark, root) == {("a", "t"): "r1"}
    snapshots.merge(keys(spark, [("d", "t", False)]), root, "r2")
    assert state(spark, root) == {("a", "t"): "r1", ("d", "t"): "r2"}


SPEC = ingest.Spec("x", ("s",), {"id": "long", "v": "string", "d": "date", "deleted": "boolean"}, ("id",), watermark="d", gone="deleted", bucket_digits=1)


def test_a_delta_keeps_all_keys(spark, tmp_path):
    day = dt.date(2024, 6, 1)
    rows = [(i, "v", day - dt.timedelta(days=i), False) for i in range(100)]
    read = lambda more: lambda name: spark.createDataFrame(rows + more, "id long, v string, d date, deleted boolean")
    root = str(tmp_path)
    ingest.ingest(spark, [SPEC], read([]), root, "r1", dt.datetime(2024, 6, 1))
    log = ingest.ingest(spark, [SPEC], read([(200, "new", day, False), (7, "v", day, True), (99, "v", day - dt.timedelta(days=99), True)]), root, "r2", dt.datetime(2024, 6, 2)).first()
    assert (log.rows_read, log.rows_new) == (33, 2)
    got = snapshots.current(spark, f"{root}/snapshots/x")
    held = {int(r.row_key) for r in got.collect()}
    # 7 has a row that isn't deleted beside the deleted one; 99 lies before the delta.
    assert held == {*range(100), 200}
    ingest.ingest(spark, [SPEC], lambda name: read([(300, "v", day, True), (200, "new", day, True)])(name).where("id not in (7)"), root, "r3", dt.datetime(2024, 6, 3))
    held = {int(r.row_key) for r in snapshots.current(spark, f"{root}/snapshots/x").collect()}
    assert held == set(range(100))


def test_late_failures_are_tried_again(spark, tmp_path):
    calls, waits = [], []

    def read(name):
        calls.append(name)
        df = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), False)], "id long, v string, d date, deleted boolean")
        late = F.raise_error(F.lit("gone away")).cast("string")
        return df.withColumn("v", late) if len(calls) < 3 else df

    spec = ingest.Spec("x", ("s",), {"id": "long", "v": "string"}, ("id",))
    log = ingest.ingest(spark, [spec], read, str(tmp_path), "r1", dt.datetime(2024, 1, 1), times=2, wait=0.01).first()
    assert (log.status, log.rows_new, len(calls)) == ("SUCCESS", 1, 3)
    with pytest.raises(OSError):
        ingest.with_retries(lambda: open(f"{tmp_path}/none"), times=3, wait=1, sleep=waits.append)
    assert waits == [1, 2, 4]
    with pytest.raises(PySparkException):
        ingest.with_retries(lambda: spark.read.parquet(f"{tmp_path}/none"), times=3, wait=1, sleep=waits.append)
    assert waits == [1, 2, 4]


def test_the_history_is_not_hashed_again(spark, tmp_path):
    stored = spark.createDataFrame([("h",)], "_append_hash string")
    stored.write.parquet(f"{tmp_path}/raw")
    incoming = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s")], "id long, _source_table string")
    new = ingest.new_payloads(spark.read.parquet(f"{tmp_path}/raw"), incoming, ["id"])
    assert new.count() == 2
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in [line for line in plan.split("\n") if "Relation" in line][0]
