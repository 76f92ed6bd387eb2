"""Builds of the reporting tables: each system's tables are computed, published as one run and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.plans import attribution, clinics, details, kpis, rollups  # noqa: F401  (they register the queries)
from pulsefield.plans.base import QUERIES, SQL, query
from pulsefield.session import work_folder
from pulsefield.sources import sinks

#: The reporting tables of each system, by the queries that compute them.
SYSTEMS = {
    "visits": ("first_seen_funnel", "weekly_kpi", "campaign_health", "collateral_rollup", "period_kpi", "benchmark_percentiles", "in_clinic_rollup", "in_clinic_counts", "state_attention", "rep_insight", "action_rules"),
    "education": ("education_rollup", "education_clinics", "education_details", "navigation_context", "share_funnel", "state_week_rank", "rep_week_rank", "language_mix", "content_ranking"),
    "screening": ("dashboard_kpis", "doctor_status_report", "rolling_activity", "status_by_day", "clinic_details", "red_flag_rollup", "course_status_pivot", "certification_min", "window_counts"),
}


def build(spark: SparkSession, sf_dir: str, system: str, root: str, run_id: str) -> dict[str, DataFrame]:
    """Compute and publish a system's tables with a status table, and read the published run back.

    Nothing is visible before all tables are written; the tables are independent, so Spark plans each on its own.
    """
    tables = {name: QUERIES[name](spark, sf_dir) for name in SYSTEMS[system]}
    status = spark.createDataFrame([(run_id, system, len(tables))], "run_id string, system string, tables long")
    sinks.publish({**tables, "refresh_status": status}, root, run_id)
    return {name: sinks.published(spark, root, name) for name in (*tables, "refresh_status")}


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("name")) for name, df in tables.items() if name != "refresh_status"]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("name").agg(F.count("*").alias("n"))


def _register(system: str) -> None:
    missing = [name for name in SYSTEMS[system] if name not in SQL]
    if missing:
        raise KeyError(f"{system}: no query {missing}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _counted(build(spark, sf_dir, system, work_folder(spark, f"gold-{system}"), "r1"))

    run.__name__ = f"gold_{system}"
    run.__doc__ = f"Rows of each published table of the {system} system."
    query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({SQL[name]})" for name in SYSTEMS[system]))(run)


for _system in SYSTEMS:
    _register(_system)
