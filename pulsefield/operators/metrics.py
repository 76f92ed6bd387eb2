"""Funnels, weekly indicators, health scores, rolling activity, windows of counts and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.functions.text import capped_percent, engagement_health, health_band, saturday

#: Which event is which stage of a campaign's funnel.
STAGES = {"signup": "reached", "view": "opened", "click": "video", "purchase": "pdf"}


def first_seen(activity: DataFrame, keys: list[str], stages: dict[str, str] = STAGES) -> DataFrame:
    """The first date of each stage and the last of any, per key, in one aggregation."""
    each = [F.min(F.when(F.col("event_type") == e, F.col("d"))).alias(s) for e, s in stages.items()]
    return activity.where(F.col("event_type").isin(*stages)).groupBy(*keys).agg(*each, F.max("d").alias("last_d"))


def week_spine(spans: DataFrame, start: str, end: str) -> DataFrame:
    """A row (week from 1, week_start, week_end) for each seven days of a span."""
    weeks = F.posexplode(F.sequence(F.col(start), F.col(end), F.expr("interval 7 days"))).alias("_i", "week_start")
    return spans.select("*", weeks).withColumn("week", (F.col("_i") + 1).cast("int")).withColumn("week_end", F.date_add("week_start", 6)).drop("_i")


def weekly_kpis(seen: DataFrame, spans: DataFrame, bases: DataFrame) -> DataFrame:
    """Distinct doctors by stage in the weeks of each (campaign, collateral), and the week's health.

    seen has one row per doctor, so a week's distinct doctors are rows: each row goes to the at most four weeks of its dates
    instead of joining every week by range.
    """
    keys = ["campaign", "collateral"]
    dated = seen.join(spans, keys)
    week = lambda c: (F.floor(F.datediff(c, "start_d") / 7) + 1).cast("int")
    own = F.array_distinct(F.array_compact(F.array(*[week(s) for s in STAGES.values()])))
    placed = dated.withColumn("week", F.explode(own))
    hit = {s: F.count(F.when(week(s) == F.col("week"), 1)) for s in STAGES.values()}
    consumed = F.count(F.when((week("video") == F.col("week")) | (week("pdf") == F.col("week")), 1))
    counts = placed.groupBy(*keys, "week").agg(F.count("*").alias("reached"), hit["opened"].alias("opened"), hit["video"].alias("video"), hit["pdf"].alias("pdf"), consumed.alias("consumed"))
    rows = week_spine(spans, "start_d", "end_d").join(counts, [*keys, "week"], "left").join(bases, "campaign")
    filled = rows.fillna(0, ["reached", "opened", "video", "pdf", "consumed"])
    health = F.round(engagement_health(F.col("reached"), F.col("opened"), F.col("consumed"), F.col("doctors") / 4.0), 6)
    return filled.select(*keys, "week", "week_start", "week_end", "doctors", "reached", "opened", "video", "pdf", "consumed", health.alias("health")).withColumn("band", health_band(F.col("health")))


def stage_counts(seen: DataFrame, keys: list[str], within: tuple[Column, Column] | None = None) -> DataFrame:
    """Distinct doctors by stage over a whole period; not the sum of its weeks."""
    inside = lambda c: F.col(c).isNotNull() if within is None else F.col(c).between(*within)
    distinct = lambda cond: F.count_distinct(F.when(cond, F.col("doctor")))
    return seen.groupBy(*keys).agg(*[distinct(inside(s)).alias(s) for s in STAGES.values()], distinct(inside("video") | inside("pdf")).alias("consumed"))


def campaign_health(seen: DataFrame, bases: DataFrame) -> DataFrame:
    """Per campaign the mean health of its collaterals, and the band."""
    rolled = stage_counts(seen, ["campaign", "collateral"]).join(bases, "campaign")
    health = engagement_health(F.col("reached"), F.col("opened"), F.col("consumed"), F.col("doctors"))
    out = rolled.withColumn("h", health).groupBy("campaign").agg(F.round(F.avg("h"), 6).alias("health"), F.count("*").alias("collaterals"))
    return out.withColumn("band", health_band(F.col("health")))


def nearest_rank(values: Column, share: float) -> Column:
    """The element of an array at round-half-even((n - 1) * share), after sorting."""
    return F.get(F.sort_array(values), F.bround((F.size(values) - 1) * F.lit(share), 0).cast("int"))


def rolling_activity(daily: DataFrame, people: DataFrame, who: str, first: Column, last: Column, days: int = 15, active_from: int = 3) -> DataFrame:
    """A row per person and day of [first, last] with the events of the last ``days`` days and the last active day.

    daily has one row (who, d, n) per active day, people a row (who) per person; those without events are inactive. Of the time before
    the range only the days that its first window reaches and each person's last active day before those are carried along. Days and
    events of a person meet in one shuffle and one sort.
    """
    reach = F.date_sub(first, days - 1)
    near = daily.where((F.col("d") >= reach) & (F.col("d") <= last)).select(who, "d", "n")
    early = daily.where(F.col("d") < reach).groupBy(who).agg(F.max("d").alias("d")).select(who, "d", F.lit(1).cast("long").alias("n"))
    spine = people.select(who).distinct().select(who, F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("d"))
    every = spine.select(who, "d", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    for events in (near, early):
        every = every.unionByName(events.withColumn("n", F.col("n").cast("long")).withColumn("asked", F.lit(False)))
    dense = every.groupBy(who, "d").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    w = Window.partitionBy(who).orderBy(F.datediff("d", F.lit("1970-01-01")))
    total = F.sum("n").over(w.rangeBetween(-(days - 1), 0))
    last_active = F.max(F.when(F.col("n") > 0, F.col("d"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    status = F.when(F.col("rolling") >= active_from, "active").when(F.col("rolling") == 0, "inactive").otherwise("low")
    return dense.withColumn("rolling", total).withColumn("last_active", last_active).where("asked").withColumn("status", status).drop("n", "asked")


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Frames of one row each side by side: their union, of which each column has one value that isn't null."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def window_counts(facts: DataFrame, d: str, as_of: Column, who: str) -> DataFrame:
    """Rows and distinct people for a day, a week, a month and all time, in one pass: a fact goes to the windows it is in."""
    back = F.datediff(as_of, F.col(d))
    spans = F.array(*[F.when(cond, F.lit(name)) for name, cond in (("24h", back == 0), ("week", back.between(0, 6)), ("month", back.between(0, 29)), ("cumulative", back >= 0))])
    return facts.select(F.explode(F.array_compact(spans)).alias("span"), who).groupBy("span").agg(F.count("*").alias("n"), F.count_distinct(who).alias("people"))


def rankings(facts: DataFrame, partition: list[str], group: str, at: str, n: int) -> DataFrame:
    """The n most frequent groups of each partition, ties by name, with their latest time."""
    counted = facts.groupBy(*partition, group).agg(F.count("*").alias("n"), F.max(at).alias("latest"))
    order = Window.partitionBy(*partition).orderBy(F.desc("n"), group)
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def with_weekly_change(weekly: DataFrame, partition: list[str], week: str, measures: list[str]) -> DataFrame:
    """The change of each measure against the week before; the first week changes from 0."""
    w = Window.partitionBy(*partition).orderBy(week)
    return weekly.withColumns({f"{m}_change": F.col(m) - F.lag(m, 1, 0).over(w) for m in measures})


def share_funnel(shares: DataFrame, plays: DataFrame, key: str, progress: str, at: str, marks: tuple[int, ...] = (25, 50, 75, 100)) -> DataFrame:
    """Per share the first time of play and of each progress mark; plays are aggregated before the join."""
    first = plays.groupBy(key).agg(F.min(at).alias("played"), *[F.min(F.when(F.col(progress) >= m, F.col(at))).alias(f"p{m}") for m in marks])
    return shares.join(first, key, "left")


def bottom_ranked(df: DataFrame, partition: list[str], order: list[Column], worst: int = 3) -> DataFrame:
    """A rank from the worst, and whether it is among the worst few."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    return ranked.withColumn("attention", F.col("rank") <= worst)


def trend(weekly: DataFrame) -> DataFrame:
    """Weekly series, capped: reached against a quarter of the doctors, opened of reached, video and pdf of opened."""
    steps = (("reached", F.col("doctors") / 4.0), ("opened", F.col("reached")), ("video", F.col("opened")), ("pdf", F.col("opened")))
    return weekly.select("campaign", "collateral", "week", *[F.round(capped_percent(F.col(c), base), 6).alias(f"{c}_pct") for c, base in steps])


def saturday_weeks(first: Column, last: Column) -> Column:
    """The Saturdays from a date's week to another's, as an array."""
    return F.sequence(saturday(first), saturday(last), F.expr("interval 7 days"))


def full_outer_counts(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One count column per part, 0 where a part lacks the key. Parts are tagged and aggregated in one shuffle."""
    tagged = [df.select(key, *[F.lit(1 if n == name else 0).cast("long").alias(n) for n in parts]) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy(key).agg(*[F.sum(n).alias(n) for n in parts])
