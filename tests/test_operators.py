"""Operators, sources, sinks and streams on small relations with gaps, ties and repeats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsefield.operators import matching as J
from pulsefield.operators import metrics
from pulsefield.operators import policy as P
from pulsefield.operators import rows as R
from pulsefield.sources import ingest, sinks, tables
from pulsefield.streaming import jobs


def test_survivor_fills_gaps_and_widens_bounds(spark):
    df = spark.createDataFrame([(1, 0, "", None, True, 5), (1, 1, "x", "y", False, 2), (2, 0, None, None, None, None)], "id int, p int, a string, b string, f boolean, n int")
    got = {r.id: (r.a, r.b, r.f, r.lo, r.hi) for r in R.survivor_merge(df.withColumn("lo", F.col("n")).withColumn("hi", F.col("n")), ["id"], [F.col("p")], ["a", "b"], ["f"], ["lo"], ["hi"]).collect()}
    assert got == {1: ("x", "y", True, 2, 5), 2: (None, None, None, None, None)}


def test_append_is_idempotent(spark):
    old = spark.createDataFrame([("a", None), ("b", "")], "x string, y string")
    new = spark.createDataFrame([("a", None), ("b", None), ("b", None), ("c", "1")], "x string, y string")
    added = R.append_new_payloads(old, new, ["x", "y"])
    assert sorted((r.x, r.y or "~") for r in added.collect()) == [("b", "~"), ("c", "1")]
    assert R.append_new_payloads(old.unionByName(added.select("x", "y")), new, ["x", "y"]).count() == 0


def test_snapshot_absent_keeps_all(spark):
    cur, old = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(r.k for r in R.active_rows(cur, None, old, ["k"]).collect()) == [1, 2, 3]
    assert sorted(r.k for r in R.active_rows(cur, cur.limit(0), old, ["k"]).collect()) == [2, 3]


def test_unique_within_bounds_are_inclusive(spark):
    t = dt.datetime(2024, 1, 1, 12)
    ev = spark.createDataFrame([(1, "a", t), (2, "b", t), (3, "c", t), (4, None, t)], "ev int, who string, ts timestamp")
    clicks = spark.createDataFrame([("a", t - dt.timedelta(minutes=120), "x"), ("a", t, "x"), ("b", t - dt.timedelta(minutes=5), "x"), ("b", t, "y"), ("c", t - dt.timedelta(minutes=121), "x"), ("c", t + dt.timedelta(seconds=1), "x")], "who string, cts timestamp, v string")
    got = {r.ev: (r.v, r.match) for r in J.unique_within(ev, clicks, ["who"], "ev", "ts", "cts", "v", 120).collect()}
    assert got == {1: ("x", "unique"), 2: (None, "ambiguous"), 3: (None, "none"), 4: (None, "none")}


def test_empty_allowlist_allows_all(spark):
    df = spark.createDataFrame([("C-1", "x"), ("c2", None)], "a string, b string")
    assert P.allow_campaigns(df, spark.createDataFrame([], "c string"), ["a", "b"]).count() == 2
    assert [r.a for r in P.allow_campaigns(df, spark.createDataFrame([("c1",)], "c string"), ["a", "b"]).collect()] == ["C-1"]


def test_person_rule_without_campaign_hides(spark):
    df = spark.createDataFrame([(1, "c1", "A@x", None), (2, "c1", None, "98765 43210"), (3, "c1", None, None)], "id int, c string, e string, p string")
    rules = spark.createDataFrame([("a@x", None, "C-1"), (None, "+91 9876543210", None)], "email string, phone string, campaign string")
    assert sorted(r.id for r in P.person_visible(df, rules, "id", "c", "e", "p").collect()) == [1, 3]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", "Yes"), (2, "2024-02-01", "no")], "id int, d string, is_current string").withColumn("d", F.to_date("d"))
    got = tables.projected(df, {"id": "long", "gone": "string"}, "d", dt.date(2023, 1, 1), "is_current").collect()
    assert [tuple(r) for r in got] == [(1, None)]
    assert tables.optional(lambda: spark.read.parquet(f"{tmp_path}/none"), spark, "x int").columns == ["x"]
    assert tables.source_chain({"a": df, "b": df.drop("d")}).count() == 4
    assert tables.stale(0, None) and tables.stale(1, 10) and not tables.stale(2, 10) and not tables.stale(1, None)
    assert tables.since_watermark(df, "d", dt.date(2024, 2, 1), 30).count() == 1
    assert tables.next_watermark(df.limit(0), "d", dt.date(2020, 1, 1)) == dt.date(2020, 1, 1)
    assert "_record_hash" in tables.audited(df, "r", "s", "t", dt.datetime(2024, 1, 1)).columns
    with pytest.raises(ValueError, match="required sources without rows: b"):
        tables.require_rows({"a": 1, "b": 0})


def test_publish_switches_whole_runs(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1), ("c2", 2)], "campaign string, n int")
    sinks.publish({"kpi": df}, str(tmp_path), "r1")
    sinks.publish({"kpi": df.where("n = 2")}, str(tmp_path), "r2")
    assert [(r.campaign, r.n) for r in sinks.published(spark, str(tmp_path), "kpi").collect()] == [("c2", 2)]
    sinks.export_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2


def test_a_run_that_ends_before_the_pointer_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([("C-1", 1), ("c1", 2)], "campaign string, n int")
    sinks.publish({"kpi": old}, root, "r1")
    sinks.write_run({"kpi": old.limit(0)}, root, "r2")  # and a crash
    assert sinks.published(spark, root, "kpi").where("campaign_token = 'c1'").count() == 2
    (tmp_path / "CURRENT.r2").write_text("r2")  # a pointer that was written but not moved
    assert sinks.published(spark, root, "kpi").count() == 2
    sinks.point_to(spark, root, "r2")
    assert sinks.published(spark, root, "kpi").count() == 0


def test_ingest_falls_back_and_reports(spark, tmp_path):
    good = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, v string")
    calls = []

    def read(name):
        calls.append(name)
        if name == "broken":
            raise OSError("no connection")
        return {"good": good, "empty": good.limit(0)}[name]

    spec = ingest.Spec("x", ("broken", "empty", "good"), {"id": "long", "v": "string", "gone": "string"}, ("id",))
    rows, errors = ingest.extract(spec, ingest.retried(read, 2))
    assert rows.count() == 3 and len(errors) == 2 and calls.count("broken") == 3
    with pytest.raises(ValueError, match="can't be read"):
        ingest.extract(ingest.Spec("x", ("broken", "empty"), {"id": "long"}, ("id",)), read)
    root = f"{tmp_path}/state"
    first = ingest.ingest(spark, [spec], read, root, "r1", dt.datetime(2024, 1, 1)).first()
    second = ingest.ingest(spark, [spec], read, root, "r2", dt.datetime(2024, 1, 2)).first()
    assert (first.rows_read, first.rows_new, first.previous_rows) == (3, 2, None) and (second.rows_new, second.previous_rows, second.is_stale) == (0, 2, False)
    assert {r.row_key for r in spark.read.parquet(f"{root}/snapshots/x").collect()} == {"1", "2"}
    with pytest.raises(ValueError, match="required sources without rows: y"):
        ingest.ingest(spark, [ingest.Spec("y", ("broken",), {"id": "long"}, ("id",))], read, root, "r3", dt.datetime(2024, 1, 3))
    assert spark.read.parquet(f"{root}/log").where("status = 'FAILED'").count() == 1


def test_snapshot_keys_and_orders(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, " ")], "x string, y string")
    keys = [r[0] for r in df.select(ingest.snapshot_key(("x", "y"), df.columns)).collect()]
    assert keys[:2] == ["a\x1fb", "a\x1f"] and keys[2].startswith("hash:")
    assert len(R.order_by_existing(df, [("y", True), ("gone", False)])) == 2
    df.createOrReplaceTempView("raw_seen")
    assert "raw_seen" in ingest.discover(spark)


def test_activity_before_the_range_and_people_without_any(spark):
    day = lambda s: F.lit(s).cast("date")
    daily = spark.createDataFrame([("a", "2023-12-30", 5), ("b", "2023-12-01", 1), ("b", "2024-01-02", 1), ("d", "2024-02-01", 9)], "who string, d string, n long").withColumn("d", F.to_date("d"))
    people = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "who string")
    got = {(r.who, str(r.d)): (r.rolling, r.status, str(r.last_active)) for r in metrics.rolling_activity(daily, people, "who", day("2024-01-01"), day("2024-01-14")).collect()}
    assert len(got) == 4 * 14
    assert got["a", "2024-01-01"] == (5, "active", "2023-12-30") and got["a", "2024-01-14"] == (0, "inactive", "2023-12-30")
    assert got["b", "2024-01-01"] == (0, "inactive", "2023-12-01") and got["b", "2024-01-02"] == (1, "low", "2024-01-02")
    assert {got[w, "2024-01-05"] for w in "cd"} == {(0, "inactive", "None")}


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 7, 1)
    rows = [(1, "a", t), (1, "a", t), (2, "a", t + dt.timedelta(days=1)), (3, "a", t + dt.timedelta(days=20))]
    spark.createDataFrame(rows, "id int, k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id int, k string, ts timestamp").parquet(f"{tmp_path}/in")

    def drained(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.id for r in drained(jobs.distinct_events(stream(), "id", "ts"), "once")) == [1, 2, 3]
    assert [(r.k, str(r.week_start), r.n) for r in drained(jobs.weekly_counts(stream(), "ts", ["k"]), "weekly")] == [("a", "2024-01-07", 3)]
    assert sorted((r.started, r.n) for r in drained(jobs.sessions(stream(), "ts", "k"), "runs"))[0] == (t, 2)
