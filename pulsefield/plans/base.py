"""The relations that the queries share, in Spark and as SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign events: event_id, doctor, campaign, collateral, event_type, ts, d, value, k."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", F.col("user_id").alias("doctor"), F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("campaign"), (k % 4).alias("collateral"),
        "event_type", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("d"), "value", k.alias("k"),
    )


ACT = """act AS (
  SELECT event_id, user_id AS doctor, 'C' || (user_id % 3) AS campaign, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS collateral,
    event_type, ts, CAST(ts AS DATE) AS d, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""
SEEN = ACT + """, seen AS (
  SELECT campaign, collateral, doctor, min(d) FILTER (WHERE event_type = 'signup') AS reached, min(d) FILTER (WHERE event_type = 'view') AS opened,
    min(d) FILTER (WHERE event_type = 'click') AS video, min(d) FILTER (WHERE event_type = 'purchase') AS pdf, max(d) AS last_d
  FROM act WHERE event_type <> 'error' GROUP BY campaign, collateral, doctor
), bases AS (SELECT campaign, count(DISTINCT doctor) AS doctors FROM act GROUP BY campaign
), spans AS (SELECT campaign, collateral, min(d) AS start_d, max(d) AS end_d FROM act GROUP BY campaign, collateral
)"""
WEEKS = SEEN + """, wk AS (
  SELECT campaign, collateral, start_d, CAST(unnest(generate_series(start_d, end_d, INTERVAL 7 DAY)) AS DATE) AS week_start FROM spans
), kpi AS (
  SELECT w.campaign, w.collateral, CAST((w.week_start - w.start_d) // 7 + 1 AS INTEGER) AS week, w.week_start, w.week_start + 6 AS week_end, b.doctors,
    count(DISTINCT s.doctor) FILTER (WHERE s.reached BETWEEN w.week_start AND w.week_start + 6 OR s.opened BETWEEN w.week_start AND w.week_start + 6
      OR s.video BETWEEN w.week_start AND w.week_start + 6 OR s.pdf BETWEEN w.week_start AND w.week_start + 6) AS reached,
    count(DISTINCT s.doctor) FILTER (WHERE s.opened BETWEEN w.week_start AND w.week_start + 6) AS opened,
    count(DISTINCT s.doctor) FILTER (WHERE s.video BETWEEN w.week_start AND w.week_start + 6) AS video,
    count(DISTINCT s.doctor) FILTER (WHERE s.pdf BETWEEN w.week_start AND w.week_start + 6) AS pdf,
    count(DISTINCT s.doctor) FILTER (WHERE s.video BETWEEN w.week_start AND w.week_start + 6 OR s.pdf BETWEEN w.week_start AND w.week_start + 6) AS consumed
  FROM wk w JOIN bases b ON w.campaign = b.campaign LEFT JOIN seen s ON s.campaign = w.campaign AND s.collateral = w.collateral
  GROUP BY ALL
)"""


def health_sql(reached: str, opened: str, consumed: str, base: str) -> str:
    part = lambda a, b: f"least(CASE WHEN coalesce({b}, 0) <> 0 THEN {a} * 100.0::DOUBLE / {b} ELSE 0 END, 100)"
    return f"(({part(reached, base)} + {part(opened, reached)} + {part(consumed, opened)}) / 3.0::DOUBLE)"


def band_sql(score: str) -> str:
    return f"CASE WHEN {score} <= 40 THEN 'red' WHEN {score} < 60 THEN 'yellow' ELSE 'green' END"


def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster: doctor, name, state, rep, segment, balance, phone, email."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        key.alias("doctor"), F.col("c_name").alias("name"), F.col("n_name").alias("state"), F.concat(F.lit("R"), (key % 7).cast("string")).alias("rep"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), F.concat(F.lit("+91 9-"), F.lpad(F.expr("c_custkey div 3").cast("string"), 9, "0")).alias("phone"), F.concat(F.lit("Doc"), F.expr("c_custkey div 2").cast("string"), F.lit("@Mail.example")).alias("email"),
    )


DOC = """doc AS (
  SELECT c_custkey AS doctor, c_name AS name, n_name AS state, 'R' || (c_custkey % 7) AS rep, c_mktsegment AS segment, c_acctbal AS balance,
    '+91 9-' || lpad(CAST(c_custkey // 3 AS VARCHAR), 9, '0') AS phone, 'Doc' || (c_custkey // 2) || '@Mail.example' AS email
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""
