"""As-of and interval joins against plain forms, on overlapping, open and empty spans, and their cost on a key with many versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsefield.operators import intervals
from pulsefield.operators import matching as J

DAY0 = dt.date(2023, 12, 25)


def tables(spark, length, seed):
    rng = random.Random(seed)
    day = lambda lo, hi: DAY0 + dt.timedelta(days=rng.randrange(lo, hi))
    dims = [(rng.randrange(6), day(-9, length + 9) if rng.random() < 0.9 else None, None, i, f"n{i}") for i in range(60)]
    dims = [(k, s, None if rng.random() < 0.3 else (s or DAY0) + dt.timedelta(days=rng.randrange(-2, length)), i, n) for k, s, _, i, n in dims]
    events = [(i, rng.randrange(8), day(0, length) if rng.random() < 0.93 else None, "e") for i in range(200)]
    return events, dims, spark.createDataFrame(events, "ev long, k int, at date, note string"), spark.createDataFrame(dims, "k int, s date, e date, dim long, name string")


def open_at(at, s, e):
    return (s is None or s <= at) and (e is None or at <= e)


@pytest.mark.parametrize("length, seed", [(1, 1), (8, 2), (70, 3), (600, 4)])
def test_asof_equals_plain_form(spark, length, seed):
    events, dims, ev, dm = tables(spark, length, seed)
    got = {r.ev: (r.dim, r.tier, r.name, r.e) for r in J.asof_dimension(ev, dm, "k", "ev", "at", "s", "e", "dim").collect()}
    low = dt.date(1, 1, 1)
    for i, k, at, _ in events:
        mine = [d for d in dims if d[0] == k]
        if at is None:
            active, before, after = [d for d in mine if d[1] is None and d[2] is None], mine, []
        else:
            active, before = [d for d in mine if open_at(at, d[1], d[2])], [d for d in mine if d[1] is None or d[1] <= at]
            after = [d for d in mine if d[1] and d[1] > at]
        latest = lambda ds: max(ds, key=lambda d: (d[1] or low, d[3]))
        want = (latest(active), 0) if active else (latest(before), 1) if before else (min(after, key=lambda d: (d[1], d[3])), 2) if after else None
        assert got[i] == ((want[0][3], want[1], want[0][4], want[0][2]) if want else (None, None, None, None)), (i, at)
    assert len(got) == len(events)


@pytest.mark.parametrize("length, seed", [(1, 5), (30, 6), (600, 7)])
def test_single_active_equals_plain_form(spark, length, seed):
    events, dims, ev, dm = tables(spark, length, seed)
    got = {r.ev: (r.dim, r.match) for r in J.single_active(ev, dm, ["k"], "ev", "at", "s", "e", "dim").collect()}
    for i, k, at, _ in events:
        found = {d[3] for d in dims if d[0] == k and (at is None or open_at(at, d[1], d[2]))}
        assert got[i] == ((min(found), "unique") if len(found) == 1 else (None, "ambiguous" if found else "none"))


def test_blocks_cover_each_day_once(spark):
    pairs = [(a, b) for a in range(0, 75) for b in range(a, 75, 3)] + [(0, 511), (5, 4000), (4095, 4095)]
    rows = spark.createDataFrame(pairs, "a long, b long").withColumn("at", intervals._blocks(F.col("a"), F.col("b"), F.lit(4).cast("long"))).collect()
    for r in rows:
        days = [d for x in r["at"] for d in range(x.block * 8**x.level, (x.block + 1) * 8**x.level)]
        assert sorted(days) == list(range(r.a, r.b + 1)) and len(r["at"]) <= 2 * 7 * 3 + 8


def test_cost_of_a_key_with_many_versions(spark):
    """An event looks up a row a level, whether its key has ten versions or 10,000."""
    ev = spark.range(2000).select(F.col("id").alias("ev"), F.lit(1).alias("k"), F.date_add(F.lit(DAY0), (F.col("id") % 300).cast("int")).alias("at"))
    met = {}
    for versions in (10, 10_000):
        dm = spark.range(versions).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY0), (F.col("id") * 7 % 300).cast("int")).alias("s"), F.lit(None).cast("date").alias("e"), F.col("id").alias("dim"))
        found = intervals.covering(ev, dm, ["k"], "ev", "at", {"max_dim": F.max("dim")}, "s", "e")
        found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        met[versions] = largest_join(plan)
    # At most a row a level for an event, and one for a version that is placed; all pairs were 20 million.
    assert met[10] <= 3 * 2000 and met[10_000] <= 10_000


def largest_join(plan):
    """The most rows that a join of an executed plan gave."""
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    plan = plan.plan() if "QueryStage" in plan.nodeName() else plan
    metrics, own = plan.metrics(), 0
    if "Join" in plan.nodeName() and metrics.contains("numOutputRows"):
        own = metrics.apply("numOutputRows").value()
    children = plan.children()
    return max([own, *[largest_join(children.apply(i)) for i in range(children.size())]])


def test_empty_sides(spark):
    _, _, ev, dm = tables(spark, 10, 8)
    assert J.asof_dimension(ev.limit(0), dm, "k", "ev", "at", "s", "e", "dim").count() == 0
    assert {(r.dim, r.tier) for r in J.asof_dimension(ev, dm.limit(0), "k", "ev", "at", "s", "e", "dim").collect()} == {(None, None)}
    assert {r.match for r in J.single_active(ev, dm.limit(0), ["k"], "ev", "at", "s", "e", "dim").collect()} == {"none"}
