"""The campaign report: its tables as a graph of shared parts, published as one run, and the context of a report page, a row a campaign, joined from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.functions.text import engagement_health
from pulsefield.operators import metrics as M
from pulsefield.operators.builds import Part, made
from pulsefield.plans.base import SQL, activity, query
from pulsefield.plans.kpis import KEYS
from pulsefield.session import work_folder
from pulsefield.sources import sinks

MEASURES = ("reached", "opened", "video", "pdf", "consumed")
PERIOD = ("2024-01-05", "2024-01-20")


def _rollup(seen: DataFrame, bases: DataFrame) -> DataFrame:
    health = engagement_health(F.col("reached"), F.col("opened"), F.col("consumed"), F.col("doctors"))
    return M.stage_counts(seen, KEYS).join(bases, "campaign").withColumn("health", F.round(health, 6))


def _period(seen: DataFrame) -> DataFrame:
    return M.stage_counts(seen, ["campaign"], tuple(F.lit(d).cast("date") for d in PERIOD))


def _latest_week(weekly: DataFrame) -> DataFrame:
    """The measures of a campaign's last week, over its collaterals."""
    last = weekly.groupBy("campaign").agg(F.max("week_end").alias("latest_week"), F.count_distinct("week_start").alias("weeks"))
    met = weekly.join(last, (weekly.campaign == last.campaign) & (weekly.week_end == last.latest_week)).drop(last.campaign)
    return met.groupBy("campaign", "latest_week", "weeks").agg(*[F.sum(m).alias(f"latest_{m}") for m in MEASURES])


def _best(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("campaign").agg(F.max_by("collateral", F.struct("health", -F.col("collateral"))).alias("best_collateral"), F.max("health").alias("best_health"))


def _context(health: DataFrame, bases: DataFrame, period: DataFrame, latest: DataFrame, best: DataFrame) -> DataFrame:
    """A row a campaign; tiles that have nothing for a campaign leave nulls."""
    tiles = (bases, period.select("campaign", *[F.col(m).alias(f"period_{m}") for m in MEASURES]), latest, best)
    return reduce(lambda a, b: a.join(b, "campaign", "left"), tiles, health)


def graph(spark: SparkSession, sf_dir: str) -> list[Part]:
    """The events are read once, into the part that all others come from."""
    fine = lambda a: a.where("event_type <> 'error'")
    return [
        Part("activity", (), lambda: activity(spark, sf_dir).select("campaign", "collateral", "doctor", "event_type", "d"), False),
        Part("seen", ("activity",), lambda a: M.first_seen(fine(a), [*KEYS, "doctor"]), False),
        Part("bases", ("activity",), lambda a: a.groupBy("campaign").agg(F.count_distinct("doctor").alias("doctors")), False),
        Part("spans", ("activity",), lambda a: a.groupBy(*KEYS).agg(F.min("d").alias("start_d"), F.max("d").alias("end_d")), False),
        Part("weekly_kpi", ("seen", "spans", "bases"), M.weekly_kpis),
        Part("weekly_trend", ("weekly_kpi",), M.trend),
        Part("collateral_rollup", ("seen", "bases"), _rollup),
        Part("campaign_health", ("seen", "bases"), M.campaign_health),
        Part("period_kpi", ("seen",), _period),
        Part("latest_week", ("weekly_kpi",), _latest_week, False),
        Part("best_collateral", ("collateral_rollup",), _best, False),
        Part("report_context", ("campaign_health", "bases", "period_kpi", "latest_week", "best_collateral"), _context),
    ]


def published_report(spark: SparkSession, sf_dir: str, root: str, run_id: str) -> dict[str, DataFrame]:
    """Build and publish the report's tables as one run and read them back."""
    parts = graph(spark, sf_dir)
    names = tuple(p.name for p in parts if p.published)

    def hold(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/parts/{run_id}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/parts/{run_id}/{name}")

    tables = made(parts, names, hold)
    sinks.publish({n: tables[n] for n in names}, root, run_id)
    sinks.remove(spark, f"{root}/parts/{run_id}")
    return {n: sinks.published(spark, root, n) for n in names}


_LATEST = ", ".join(f"CAST(sum(w.{m}) AS BIGINT) AS latest_{m}" for m in MEASURES)
_PERIOD = ", ".join(f"p.{m} AS period_{m}" for m in MEASURES)


@query(f"""WITH w AS ({SQL['weekly_kpi']}), h AS ({SQL['campaign_health']}), r AS ({SQL['collateral_rollup']}), p AS ({SQL['period_kpi']}),
l AS (SELECT w.campaign, w.week_end AS latest_week, {_LATEST} FROM w JOIN (SELECT campaign, max(week_end) AS e FROM w GROUP BY campaign) x ON x.campaign = w.campaign AND x.e = w.week_end GROUP BY ALL),
n AS (SELECT campaign, count(DISTINCT week_start) AS weeks, min(doctors) AS doctors FROM w GROUP BY campaign), b AS (SELECT campaign, arg_max(collateral, (health, -collateral)) AS best_collateral, max(health) AS best_health FROM r GROUP BY campaign)
SELECT h.*, n.doctors, {_PERIOD}, l.* EXCLUDE (campaign), n.weeks, b.best_collateral, b.best_health FROM h JOIN n ON n.campaign = h.campaign LEFT JOIN p ON p.campaign = h.campaign LEFT JOIN l ON l.campaign = h.campaign LEFT JOIN b ON b.campaign = h.campaign""")
def report_context(spark, sf_dir):
    """What the report page of each campaign shows, from the published tables."""
    out = published_report(spark, sf_dir, work_folder(spark, "report"), "r1")["report_context"]
    return out.drop("campaign_token")


def _melted_sql(name: str, week: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS part, campaign, CAST(collateral AS BIGINT) AS collateral, CAST({week} AS BIGINT) AS week, '{m}' AS measure, {m} AS value FROM ({SQL[name]})" for m in MEASURES)


@query(f"""{_melted_sql('weekly_kpi', 'week')} UNION ALL {_melted_sql('collateral_rollup', 'NULL')}
UNION ALL {' UNION ALL '.join(f"SELECT 'period_kpi', campaign, NULL, NULL, '{m}', {m} FROM ({SQL['period_kpi']})" for m in MEASURES)}""")
def published_report_rows(spark, sf_dir):
    """The contents of the published tables that count people, a row a measure."""
    tables = published_report(spark, sf_dir, work_folder(spark, "report"), "r1")
    measures = F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "value")
    none = F.lit(None).cast("long")
    rows = lambda name, collateral, week: tables[name].select(F.lit(name).alias("part"), "campaign", collateral.cast("long").alias("collateral"), week.cast("long").alias("week"), measures)
    parts = [rows("weekly_kpi", F.col("collateral"), F.col("week")), rows("collateral_rollup", F.col("collateral"), none), rows("period_kpi", none, none)]
    return reduce(lambda a, b: a.unionByName(b), parts)
