"""Metric queries: funnels, weekly indicators, health, rankings, windows and reconciliations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.functions.text import capped_percent, engagement_health, health_band, monday, percent, saturday, sharing_health
from pulsefield.operators import metrics as M
from pulsefield.operators.rows import latest_by
from pulsefield.plans.base import ACT, DOC, SEEN, WEEKS, activity, band_sql, doctors, health_sql, query
from pulsefield.session import table

KEYS = ["campaign", "collateral"]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    a = activity(spark, sf_dir)
    bases = a.groupBy("campaign").agg(F.count_distinct("doctor").alias("doctors"))
    spans = a.groupBy(*KEYS).agg(F.min("d").alias("start_d"), F.max("d").alias("end_d"))
    return a, M.first_seen(a, [*KEYS, "doctor"]), bases, spans


@query(f"WITH {SEEN} SELECT * FROM seen")
def first_seen_funnel(spark, sf_dir):
    return _parts(spark, sf_dir)[1]


@query(f"WITH {WEEKS} SELECT *, {band_sql('health')} AS band FROM (SELECT *, round({health_sql('reached', 'opened', 'consumed', '(doctors / 4.0::DOUBLE)')}, 6) AS health FROM kpi)")
def weekly_kpi(spark, sf_dir):
    _, seen, bases, spans = _parts(spark, sf_dir)
    return M.weekly_kpis(seen, spans, bases)


@query(f"""WITH {WEEKS} SELECT campaign, collateral, week,
  round(least(reached * 100.0::DOUBLE / (doctors / 4.0::DOUBLE), 100), 6) AS reached_pct,
  round(CASE WHEN reached <> 0 THEN least(opened * 100.0::DOUBLE / reached, 100) ELSE 0 END, 6) AS opened_pct,
  round(CASE WHEN opened <> 0 THEN least(video * 100.0::DOUBLE / opened, 100) ELSE 0 END, 6) AS video_pct,
  round(CASE WHEN opened <> 0 THEN least(pdf * 100.0::DOUBLE / opened, 100) ELSE 0 END, 6) AS pdf_pct FROM kpi""")
def weekly_trend(spark, sf_dir):
    return M.trend(weekly_kpi(spark, sf_dir))


@query(f"""WITH {SEEN} SELECT campaign, count(DISTINCT doctor) FILTER (WHERE reached BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') AS reached,
  count(DISTINCT doctor) FILTER (WHERE opened BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') AS opened, count(DISTINCT doctor) FILTER (WHERE video BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') AS video,
  count(DISTINCT doctor) FILTER (WHERE pdf BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') AS pdf,
  count(DISTINCT doctor) FILTER (WHERE video BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' OR pdf BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') AS consumed FROM seen GROUP BY campaign""")
def period_kpi(spark, sf_dir):
    return M.stage_counts(_parts(spark, sf_dir)[1], ["campaign"], (F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))


ROLL = SEEN + """, roll AS (SELECT campaign, collateral, count(reached) AS reached, count(opened) AS opened, count(video) AS video, count(pdf) AS pdf,
  count(*) FILTER (WHERE video IS NOT NULL OR pdf IS NOT NULL) AS consumed FROM seen GROUP BY campaign, collateral)"""


@query(f"WITH {ROLL} SELECT r.*, doctors, round({health_sql('reached', 'opened', 'consumed', 'doctors')}, 6) AS health FROM roll r JOIN bases b ON r.campaign = b.campaign")
def collateral_rollup(spark, sf_dir):
    _, seen, bases, _ = _parts(spark, sf_dir)
    rolled = M.stage_counts(seen, KEYS).join(bases, "campaign")
    return rolled.withColumn("health", F.round(engagement_health(F.col("reached"), F.col("opened"), F.col("consumed"), F.col("doctors")), 6))


@query(f"""WITH {ROLL} SELECT campaign, health, collaterals, {band_sql('health')} AS band FROM (SELECT r.campaign, round(avg({health_sql('reached', 'opened', 'consumed', 'doctors')}), 6) AS health,
  count(*) AS collaterals FROM roll r JOIN bases b ON r.campaign = b.campaign GROUP BY r.campaign)""")
def campaign_health(spark, sf_dir):
    _, seen, bases, _ = _parts(spark, sf_dir)
    return M.campaign_health(seen, bases)


LAST10 = "WITH h AS (SELECT p_brand, max(p_partkey) AS seq, avg(p_retailprice) AS score FROM part GROUP BY p_brand), t AS (SELECT * FROM h ORDER BY seq DESC, p_brand LIMIT 10)"


def _last10(spark, sf_dir):
    scores = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_partkey").alias("seq"), F.avg("p_retailprice").alias("score"))
    return scores.orderBy(F.desc("seq"), "p_brand").limit(10)


@query(LAST10 + " SELECT count(*) AS campaigns, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75 FROM t")
def benchmark_percentiles(spark, sf_dir):
    return _last10(spark, sf_dir).agg(F.count("*").alias("campaigns"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.percentile("score", 0.5), 6).alias("p50"), F.round(F.percentile("score", 0.75), 6).alias("p75"))


@query(LAST10 + " SELECT round(list_sort(list(score))[CAST(round_even((count(*) - 1) * 0.75, 0) AS INTEGER) + 1], 6) AS p75, round(median(score), 6) AS p50 FROM t")
def benchmark_nearest_rank(spark, sf_dir):
    return _last10(spark, sf_dir).agg(F.round(M.nearest_rank(F.collect_list("score"), 0.75), 6).alias("p75"), F.round(F.median("score"), 6).alias("p50"))


PLAYS = ACT + """, share AS (SELECT event_id AS share, doctor, campaign, collateral, d, ts FROM act WHERE event_type = 'view'),
play AS (SELECT event_id - event_id % 5 AS share, k + 20 AS progress, d FROM act WHERE event_type IN ('click', 'purchase')),
fun AS (SELECT s.*, played, p25, p50, p75, p100 FROM share s LEFT JOIN (SELECT share, min(d) AS played, min(d) FILTER (WHERE progress >= 25) AS p25, min(d) FILTER (WHERE progress >= 50) AS p50,
  min(d) FILTER (WHERE progress >= 75) AS p75, min(d) FILTER (WHERE progress >= 100) AS p100 FROM play GROUP BY share) p ON s.share = p.share)"""


def _funnel(spark, sf_dir):
    a = activity(spark, sf_dir)
    shares = a.where("event_type = 'view'").select(F.col("event_id").alias("share"), "doctor", "campaign", "collateral", "d", "ts")
    plays = a.where("event_type in ('click', 'purchase')").select((F.col("event_id") - F.col("event_id") % 5).alias("share"), (F.col("k") + 20).alias("progress"), F.col("d").alias("pd"))
    return M.share_funnel(shares, plays, "share", "progress", "pd")


@query(f"WITH {PLAYS} SELECT share, doctor, campaign, collateral, d, played, p25, p50, p75, p100 FROM fun")
def share_funnel(spark, sf_dir):
    return _funnel(spark, sf_dir).drop("ts")


@query(f"""WITH {PLAYS} SELECT f.campaign, enrolled, sharing, shares, played, half, whole, round((sharing * 100.0::DOUBLE / enrolled + played * 100.0::DOUBLE / shares + half * 100.0::DOUBLE / shares + whole * 100.0::DOUBLE / shares) / 4, 6) AS health
  FROM (SELECT campaign, count(DISTINCT doctor) AS sharing, count(*) AS shares, count(played) AS played, count(p50) AS half, count(p100) AS whole FROM fun GROUP BY campaign) f
  JOIN (SELECT campaign, count(DISTINCT doctor) AS enrolled FROM act GROUP BY campaign) e ON f.campaign = e.campaign""")
def sharing_health_score(spark, sf_dir):
    f = _funnel(spark, sf_dir).groupBy("campaign").agg(F.count_distinct("doctor").alias("sharing"), F.count("*").alias("shares"), F.count("played").alias("played"), F.count("p50").alias("half"), F.count("p100").alias("whole"))
    e = activity(spark, sf_dir).groupBy("campaign").agg(F.count_distinct("doctor").alias("enrolled"))
    score = sharing_health(*[F.col(c) for c in ("enrolled", "sharing", "shares", "played", "half", "whole")])
    return f.join(e, "campaign").withColumn("health", F.round(score, 6))


@query(f"""WITH {PLAYS}, w AS (SELECT campaign, CAST(d + CAST(6 - dayofweek(d) AS INTEGER) AS DATE) AS week_end, count(*) AS shares, count(played) AS played, count(p50) AS half, count(p100) AS whole FROM fun GROUP BY ALL),
  e AS (SELECT campaign, doctor, CAST(min(d) + CAST(6 - dayofweek(min(d)) AS INTEGER) AS DATE) AS first_week FROM act GROUP BY campaign, doctor)
  SELECT w.*, (SELECT count(*) FROM e WHERE e.campaign = w.campaign AND e.first_week <= w.week_end) AS enrolled,
    shares - coalesce(lag(shares) OVER (PARTITION BY campaign ORDER BY week_end), 0) AS shares_change, played - coalesce(lag(played) OVER (PARTITION BY campaign ORDER BY week_end), 0) AS played_change FROM w""")
def weekly_wow(spark, sf_dir):
    f = _funnel(spark, sf_dir).withColumn("week_end", saturday(F.col("d")))
    weekly = f.groupBy("campaign", "week_end").agg(F.count("*").alias("shares"), F.count("played").alias("played"), F.count("p50").alias("half"), F.count("p100").alias("whole"))
    # Distinct enrolments up to a week are a running sum of first weeks.
    first = activity(spark, sf_dir).groupBy("campaign", "doctor").agg(saturday(F.min("d")).alias("week_end"))
    new = first.groupBy("campaign", "week_end").agg(F.count("*").alias("new"))
    both = weekly.join(new, ["campaign", "week_end"], "full_outer")
    w = M.Window.partitionBy("campaign").orderBy("week_end")
    both = both.withColumn("enrolled", F.sum(F.coalesce("new", F.lit(0))).over(w)).where("shares is not null").drop("new")
    return M.with_weekly_change(both, ["campaign"], "week_end", ["shares", "played"])


@query(f"""WITH {ACT}, {DOC}, s AS (SELECT state, CAST(d + CAST(6 - dayofweek(d) AS INTEGER) AS DATE) AS week_end, count(*) AS shares, count(DISTINCT a.doctor) AS sharing FROM act a JOIN doc ON a.doctor = doc.doctor WHERE event_type = 'view' GROUP BY ALL),
  u AS (SELECT * FROM (SELECT DISTINCT state FROM doc) CROSS JOIN (SELECT DISTINCT week_end FROM s)), f AS (SELECT u.state, u.week_end, coalesce(shares, 0) AS shares, coalesce(sharing, 0) AS sharing FROM u LEFT JOIN s ON s.state = u.state AND s.week_end = u.week_end)
  SELECT *, rank <= 3 AS attention FROM (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY sharing, shares, state) AS rank FROM f)""")
def state_week_rank(spark, sf_dir):
    roster, a = doctors(spark, sf_dir), activity(spark, sf_dir).where("event_type = 'view'")
    s = a.join(roster.select("doctor", "state"), "doctor").groupBy("state", saturday(F.col("d")).alias("week_end")).agg(F.count("*").alias("shares"), F.count_distinct("doctor").alias("sharing"))
    first, last = a.agg(F.min("d"), F.max("d")).first()  # two dates
    weeks = M.saturday_weeks(F.lit(first).cast("date"), F.lit(last).cast("date"))
    spine = roster.select("state").distinct().select("state", F.explode(weeks).alias("week_end"))
    dense = spine.join(s, ["state", "week_end"], "left").fillna(0)
    return M.bottom_ranked(dense, ["week_end"], [F.col("sharing"), F.col("shares"), F.col("state")])


@query(f"""WITH {ACT}, {DOC}, f AS (SELECT coalesce(rep, 'Unassigned') AS rep, CAST(d + CAST(6 - dayofweek(d) AS INTEGER) AS DATE) AS week_end, count(*) AS shares, count(DISTINCT a.doctor) AS sharing
  FROM act a LEFT JOIN (SELECT * FROM doc WHERE doctor % 11 <> 0) doc ON a.doctor = doc.doctor WHERE event_type = 'view' GROUP BY ALL)
  SELECT *, rank <= 3 AS attention FROM (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY shares, rep) AS rank FROM f)""")
def rep_week_rank(spark, sf_dir):
    roster, a = doctors(spark, sf_dir).where("doctor % 11 <> 0").select("doctor", "rep"), activity(spark, sf_dir).where("event_type = 'view'")
    f = a.join(roster, "doctor", "left").groupBy(F.coalesce("rep", F.lit("Unassigned")).alias("rep"), saturday(F.col("d")).alias("week_end")).agg(F.count("*").alias("shares"), F.count_distinct("doctor").alias("sharing"))
    return M.bottom_ranked(f, ["week_end"], [F.col("shares"), F.col("rep")])


@query("""WITH d AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY source), 6) AS share_pct FROM d""")
def language_mix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return d.withColumn("share_pct", F.round(percent(F.col("n"), F.sum("n").over(M.Window.partitionBy("source"))), 6))


@query(f"""WITH {ACT}, r AS (SELECT campaign, collateral, count(*) AS n, max(d) AS latest FROM act GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, collateral) AS rank FROM r) WHERE rank <= 3""")
def content_ranking(spark, sf_dir):
    return M.rankings(activity(spark, sf_dir), ["campaign"], "collateral", "d", 3)


@query("""SELECT * FROM (SELECT p_brand AS label, n, latest, row_number() OVER (ORDER BY n DESC, p_brand) AS rank FROM (SELECT p_brand, count(*) AS n, max(p_partkey) AS latest FROM part GROUP BY p_brand)) WHERE rank <= 5""")
def top_n(spark, sf_dir):
    counted = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"), F.max("p_partkey").alias("latest"))
    top = counted.orderBy(F.desc("n"), "label").limit(5)  # each task keeps five rows
    return top.withColumn("rank", F.row_number().over(M.Window.orderBy(F.desc("n"), "label")).cast("long"))


@query(f"""WITH {ACT}, {DOC} SELECT doctor, CAST(sum(roster) AS BIGINT) AS roster, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(clicks) AS BIGINT) AS clicks FROM (
  SELECT doctor, 1 AS roster, 0 AS shares, 0 AS clicks FROM doc UNION ALL SELECT doctor + 1000 * (doctor % 2), 0, 1, 0 FROM act WHERE event_type = 'view' UNION ALL SELECT doctor, 0, 0, 1 FROM act WHERE event_type = 'click') GROUP BY doctor""")
def doctor_activity_outer(spark, sf_dir):
    a = activity(spark, sf_dir)
    shares = a.where("event_type = 'view'").select((F.col("doctor") + 1000 * (F.col("doctor") % 2)).alias("doctor"))
    return M.full_outer_counts({"roster": doctors(spark, sf_dir), "shares": shares, "clicks": a.where("event_type = 'click'")}, "doctor")


@query(f"""WITH {PLAYS}, w AS (SELECT campaign, CAST(d + CAST(6 - dayofweek(d) AS INTEGER) AS DATE) AS week_end, count(*) AS shares, count(played) AS played, count(p50) AS half, count(p100) AS whole FROM fun GROUP BY ALL)
  SELECT campaign, week_end, CASE WHEN played * 100.0 / shares < 40 THEN 'low_play_rate' WHEN half * 100.0 / shares < 40 THEN 'low_engagement_50' WHEN whole * 100.0 / shares < 40 THEN 'low_completion' ELSE 'stable_execution' END AS issue FROM w""")
def action_rules(spark, sf_dir):
    f = _funnel(spark, sf_dir).groupBy("campaign", saturday(F.col("d")).alias("week_end")).agg(F.count("*").alias("shares"), F.count("played").alias("played"), F.count("p50").alias("half"), F.count("p100").alias("whole"))
    rule = F.lit("stable_execution")
    for measure, name in (("whole", "low_completion"), ("half", "low_engagement_50"), ("played", "low_play_rate")):
        rule = F.when(percent(F.col(measure), F.col("shares")) < 40, name).otherwise(rule)
    return f.select("campaign", "week_end", rule.alias("issue"))


#: The days that the activity queries report; events lie before and after them.
FIRST, LAST = "2024-01-10", "2024-01-20"
ROLLING = ACT + f""", day AS (SELECT doctor, d, count(*) AS n FROM act WHERE event_type = 'click' GROUP BY ALL), people AS (SELECT c_custkey AS doctor FROM customer UNION SELECT doctor FROM act),
sp AS (SELECT doctor, CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS d FROM people),
rl AS (SELECT sp.doctor, sp.d, CAST(coalesce((SELECT sum(n) FROM day WHERE day.doctor = sp.doctor AND day.d BETWEEN sp.d - 14 AND sp.d), 0) AS BIGINT) AS rolling, (SELECT max(d) FROM day WHERE day.doctor = sp.doctor AND day.d <= sp.d) AS last_active FROM sp),
status AS (SELECT *, CASE WHEN rolling >= 3 THEN 'active' WHEN rolling = 0 THEN 'inactive' ELSE 'low' END AS status FROM rl)"""


@query(f"WITH {ROLLING} SELECT * FROM status")
def rolling_activity(spark, sf_dir, first: str = FIRST, last: str = LAST):
    a = activity(spark, sf_dir)
    daily = a.where("event_type = 'click'").groupBy("doctor", "d").agg(F.count("*").alias("n"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doctor")).union(a.select("doctor")).distinct()
    return M.rolling_activity(daily, people, "doctor", F.lit(first).cast("date"), F.lit(last).cast("date"))


@query(f"""WITH {ROLLING} SELECT d, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'low') AS low, count(*) FILTER (WHERE status = 'inactive') AS inactive FROM status GROUP BY d""")
def status_by_day(spark, sf_dir):
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return rolling_activity(spark, sf_dir).groupBy("d").agg(count("active"), count("low"), count("inactive"))


@query(f"""WITH {ROLLING} SELECT DISTINCT doctor FROM status WHERE status = 'inactive' AND d BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'
  AND doctor NOT IN (SELECT doctor FROM status WHERE status = 'active' AND d BETWEEN DATE '2024-01-10' AND DATE '2024-01-15')""")
def inactive_minus_active(spark, sf_dir):
    inside = rolling_activity(spark, sf_dir).where("d between date '2024-01-10' and date '2024-01-15'")
    both = inside.groupBy("doctor").agg(F.bool_or(F.col("status") == "inactive").alias("i"), F.bool_or(F.col("status") == "active").alias("a"))
    return both.where("i and not a").select("doctor")


@query(f"""WITH {ACT}, {DOC} SELECT campaign, state, rep, count(*) AS events, count(DISTINCT a.doctor) AS doctors, round(sum(value), 4) AS value FROM act a JOIN doc ON a.doctor = doc.doctor GROUP BY ALL""")
def kpi_cube(spark, sf_dir):
    joined = activity(spark, sf_dir).join(doctors(spark, sf_dir), "doctor")
    return joined.groupBy("campaign", "state", "rep").agg(F.count("*").alias("events"), F.count_distinct("doctor").alias("doctors"), F.round(F.sum("value"), 4).alias("value"))


@query("""SELECT o_orderpriority AS audience, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS in_progress, count(*) FILTER (WHERE o_orderstatus = 'O') AS not_started, count(*) AS total FROM orders GROUP BY 1""")
def course_status_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.groupBy(F.col("o_orderpriority").alias("audience")).pivot("o_orderstatus", ["F", "P", "O"]).count().fillna(0)
    return p.select("audience", F.col("F").alias("completed"), F.col("P").alias("in_progress"), F.col("O").alias("not_started"), (F.col("F") + F.col("P") + F.col("O")).alias("total"))


@query(f"WITH {ACT} SELECT campaign, doctor, count(*) AS logins, min(d) AS first_login, max(d) AS last_login, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS last_event FROM act WHERE event_type = 'signup' GROUP BY ALL")
def latest_login(spark, sf_dir):
    a = activity(spark, sf_dir).where("event_type = 'signup'")
    return a.groupBy("campaign", "doctor").agg(F.count("*").alias("logins"), F.min("d").alias("first_login"), F.max("d").alias("last_login"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query(f"""WITH {ACT} SELECT campaign, doctor, epoch(date_trunc('hour', ts))::BIGINT AS hour, min(event_id) AS event_id, bool_or(event_type = 'purchase') AS purchased, bool_or(event_type = 'error') AS failed, count(*) AS merged FROM act GROUP BY ALL""")
def screening_merge(spark, sf_dir):
    hour = F.unix_seconds(F.date_trunc("hour", "ts"))
    return activity(spark, sf_dir).groupBy("campaign", "doctor", hour.alias("hour")).agg(F.min("event_id").alias("event_id"), F.bool_or(F.col("event_type") == "purchase").alias("purchased"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count("*").alias("merged"))


@query(f"WITH {ACT} SELECT doctor, min(d) AS certified, arg_min(campaign, (d, event_id)) AS campaign FROM act WHERE event_type = 'purchase' GROUP BY doctor")
def certification_min(spark, sf_dir):
    return activity(spark, sf_dir).where("event_type = 'purchase'").groupBy("doctor").agg(F.min("d").alias("certified"), F.min_by("campaign", F.struct("d", "event_id")).alias("campaign"))


@query("""WITH f AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS facts FROM lineitem GROUP BY 1) SELECT o_orderkey, round(o_totalprice, 2) AS summary, coalesce(facts, 0) AS facts, abs(round(o_totalprice, 2) - coalesce(facts, 0)) < 0.01 AS matches FROM orders LEFT JOIN f ON k = o_orderkey""")
def recon_counts(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("facts"))
    j = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("summary")).join(f, "o_orderkey", "left").fillna(0.0, ["facts"])
    return j.withColumn("matches", F.abs(F.col("summary") - F.col("facts")) < 0.01)


@query(f"""WITH {ACT}, w AS (SELECT unnest(['24h', 'week', 'month', 'cumulative']) AS span, unnest([0, 6, 29, 100000]) AS back) SELECT span, count(*) AS n, count(DISTINCT doctor) AS people FROM act JOIN w ON d BETWEEN DATE '2024-01-20' - back AND DATE '2024-01-20' GROUP BY span""")
def window_counts(spark, sf_dir):
    return M.window_counts(activity(spark, sf_dir), "d", F.lit("2024-01-20").cast("date"), "doctor")


@query(f"""WITH {ACT}, {DOC}, s AS (SELECT state, count(DISTINCT doc.doctor) AS doctors, count(event_id) AS events, round(coalesce(sum(value), 0), 4) AS value FROM doc LEFT JOIN act ON doc.doctor = act.doctor GROUP BY state)
  SELECT *, round(doctors * 100.0::DOUBLE / max(doctors) OVER (), 6) AS doctors_pct, round(events * 100.0::DOUBLE / max(events) OVER (), 6) AS events_pct FROM s""")
def state_performance(spark, sf_dir):
    per = activity(spark, sf_dir).groupBy("doctor").agg(F.count("*").alias("n"), F.sum("value").alias("v"))  # before the join: a row a doctor
    s = doctors(spark, sf_dir).join(per, "doctor", "left").groupBy("state").agg(F.count_distinct("doctor").alias("doctors"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("value"))
    most = M.Window.partitionBy(F.lit(0))  # a row a state
    return s.withColumn("doctors_pct", F.round(percent(F.col("doctors"), F.max("doctors").over(most)), 6)).withColumn("events_pct", F.round(percent(F.col("events"), F.max("events").over(most)), 6))


@query(f"WITH {WEEKS} SELECT strftime(week_start, '%Y-%m') AS month, count(DISTINCT week_start) AS weeks, min(week_start) AS first_week, CAST(sum(reached) AS BIGINT) AS reached FROM kpi GROUP BY 1")
def month_options(spark, sf_dir):
    return weekly_kpi(spark, sf_dir).groupBy(F.date_format("week_start", "yyyy-MM").alias("month")).agg(F.count_distinct("week_start").alias("weeks"), F.min("week_start").alias("first_week"), F.sum("reached").alias("reached"))


@query(f"""WITH {ACT} SELECT doctor, count(*) FILTER (WHERE event_type = 'signup') AS forms, count(*) FILTER (WHERE event_type = 'error') AS flags, count(DISTINCT k) FILTER (WHERE event_type = 'view') AS codes, min(d) AS period_start, max(d) AS period_end FROM act GROUP BY doctor""")
def clinic_rollup(spark, sf_dir):
    of = lambda e, c="event_id": F.when(F.col("event_type") == e, F.col(c))
    return activity(spark, sf_dir).groupBy("doctor").agg(F.count(of("signup")).alias("forms"), F.count(of("error")).alias("flags"), F.count_distinct(of("view", "k")).alias("codes"), F.min("d").alias("period_start"), F.max("d").alias("period_end"))


@query(f"WITH {ACT} SELECT campaign, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM act GROUP BY ALL")
def monday_week_trend(spark, sf_dir):
    of = lambda e: F.count(F.when(F.col("event_type") == e, 1))
    return activity(spark, sf_dir).groupBy("campaign", monday(F.col("ts")).alias("week")).agg(of("view").alias("views"), of("purchase").alias("purchases"))


@query(f"""WITH {SEEN}, r AS (SELECT s.campaign, count(DISTINCT s.doctor) FILTER (WHERE pdf IS NOT NULL) * 100.0::DOUBLE / any_value(doctors) AS rate FROM seen s JOIN bases b ON s.campaign = b.campaign GROUP BY s.campaign)
  SELECT round(avg(rate), 6) AS mean_rate, arg_max(campaign, (rate, campaign)) AS best, count(*) AS systems FROM r""")
def adoption(spark, sf_dir):
    _, seen, bases, _ = _parts(spark, sf_dir)
    r = seen.groupBy("campaign").agg(F.count_distinct(F.when(F.col("pdf").isNotNull(), F.col("doctor"))).alias("n")).join(bases, "campaign").select("campaign", percent(F.col("n"), F.col("doctors")).alias("rate"))
    return r.agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.max_by("campaign", F.struct("rate", "campaign")).alias("best"), F.count("*").alias("systems"))


@query(f"""WITH {ACT}, {DOC}, per AS (SELECT rep, a.doctor, max((event_type = 'signup')::INT) AS sent, max((event_type = 'view')::INT) AS viewed, max((event_type = 'click')::INT) AS video, max((event_type = 'purchase')::INT) AS pdf,
    string_agg(DISTINCT campaign, ',' ORDER BY campaign) AS campaigns FROM act a JOIN doc ON a.doctor = doc.doctor GROUP BY rep, a.doctor)
  SELECT r.rep, assigned, coalesce(CAST(sum(sent) AS BIGINT), 0) AS sent, coalesce(CAST(sum(viewed) AS BIGINT), 0) AS viewed, coalesce(CAST(sum(video) AS BIGINT), 0) AS video, coalesce(CAST(sum(pdf) AS BIGINT), 0) AS pdf, count(DISTINCT campaigns) AS campaign_sets
  FROM (SELECT rep, count(*) AS assigned FROM doc GROUP BY rep) r LEFT JOIN per p ON p.rep = r.rep GROUP BY r.rep, assigned""")
def rep_insight(spark, sf_dir):
    roster = doctors(spark, sf_dir).select("doctor", "rep")
    flag = lambda e: F.max((F.col("event_type") == e).cast("long"))
    per = activity(spark, sf_dir).groupBy("doctor").agg(flag("signup").alias("sent"), flag("view").alias("viewed"), flag("click").alias("video"), flag("purchase").alias("pdf"), F.array_join(F.sort_array(F.collect_set("campaign")), ",").alias("campaigns"))
    joined = roster.join(per, "doctor", "left")
    return joined.groupBy("rep").agg(F.count("*").alias("assigned"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sent", "viewed", "video", "pdf")], F.count_distinct("campaigns").alias("campaign_sets"))


@query(f"""WITH {SEEN}, {DOC}, roster AS (SELECT doctor, state FROM doc WHERE doctor % 9 <> 0), ev AS (SELECT x.doctor, doc.state, min(reached) AS reached, min(opened) AS opened, min(video) AS video, min(pdf) AS pdf FROM seen x LEFT JOIN doc ON doc.doctor = x.doctor GROUP BY ALL),
base AS (SELECT doctor, state FROM roster UNION SELECT doctor, coalesce(state, 'Unknown') FROM ev WHERE doctor NOT IN (SELECT doctor FROM roster)),
s AS (SELECT base.state, count(DISTINCT base.doctor) AS doctors, count(DISTINCT base.doctor) FILTER (WHERE reached IS NOT NULL) AS reached, count(DISTINCT base.doctor) FILTER (WHERE opened IS NOT NULL) AS opened,
  count(DISTINCT base.doctor) FILTER (WHERE video IS NOT NULL OR pdf IS NOT NULL) AS consumed FROM base LEFT JOIN ev ON ev.doctor = base.doctor GROUP BY base.state) SELECT *, {band_sql('health')} AS band FROM (SELECT *, round({health_sql('reached', 'opened', 'consumed', '(doctors / 4.0::DOUBLE)')}, 6) AS health FROM s)""")
def state_attention(spark, sf_dir):
    """Per state the distinct doctors of the roster and of events that it lacks, by stage; one full outer join on the doctor."""
    directory = doctors(spark, sf_dir).select("doctor", "state")
    roster = directory.where("doctor % 9 <> 0").withColumnRenamed("state", "own")
    seen = M.first_seen(activity(spark, sf_dir), ["doctor"]).join(directory, "doctor", "left")
    both = roster.join(seen, "doctor", "full").withColumn("at", F.coalesce("own", "state", F.lit("Unknown")))
    has = lambda c: F.count(F.when(c, 1))
    s = both.groupBy(F.col("at").alias("state")).agg(F.count("*").alias("doctors"), has(F.col("reached").isNotNull()).alias("reached"), has(F.col("opened").isNotNull()).alias("opened"), has(F.col("video").isNotNull() | F.col("pdf").isNotNull()).alias("consumed"))
    s = s.withColumn("health", F.round(engagement_health(F.col("reached"), F.col("opened"), F.col("consumed"), F.col("doctors") / 4.0), 6))
    return s.withColumn("band", health_band(F.col("health")))


@query("""WITH s AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS size, CASE WHEN p_size < 15 THEN 'current' WHEN p_size < 35 THEN 'past' ELSE 'future' END AS phase FROM part)
  SELECT p_brand, p_partkey, phase FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE phase WHEN 'current' THEN 0 WHEN 'past' THEN 1 ELSE 2 END, size DESC, p_partkey) AS n FROM s) WHERE n = 1""")
def schedule_pick(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    phase = F.when(F.col("p_size") < 15, "current").when(F.col("p_size") < 35, "past").otherwise("future")
    order = [F.when(F.col("phase") == "current", 0).when(F.col("phase") == "past", 1).otherwise(2), F.desc("p_size"), F.col("p_partkey")]
    return latest_by(p.withColumn("phase", phase), ["p_brand"], order).select("p_brand", "p_partkey", "phase")


@query("""WITH s AS (SELECT p_name, p_partkey, p_size AS a, CAST(p_size + p_partkey % 30 AS BIGINT) AS b FROM part) SELECT p_name, p_partkey FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.p_name = x.p_name AND y.p_partkey <> x.p_partkey
  AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b OR y.p_partkey < x.p_partkey))""")
def containment_dedupe(spark, sf_dir):
    # In order of start (and, from one start, of falling end) a span is contained if an earlier one ends as late: no self join.
    s = table(spark, sf_dir, "part").select("p_name", "p_partkey", F.col("p_size").alias("a"), (F.col("p_size") + F.col("p_partkey") % 30).alias("b"))
    w = M.Window.partitionBy("p_name").orderBy("a", F.desc("b"), "p_partkey").rowsBetween(M.Window.unboundedPreceding, -1)
    return s.withColumn("reach", F.max("b").over(w)).where("reach is null or reach < b").select("p_name", "p_partkey")


@query("SELECT label, row_number() OVER (ORDER BY label) AS sort_order FROM (SELECT DISTINCT n_name AS label FROM nation)")
def filter_dims(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label")).distinct()
    return d.withColumn("sort_order", F.row_number().over(M.Window.orderBy("label")).cast("long"))


@query(f"""WITH {ACT}, {DOC}, r AS (SELECT campaign, count(DISTINCT a.doctor) AS roster FROM act a JOIN doc ON a.doctor = doc.doctor WHERE campaign <> 'C2' GROUP BY campaign), g AS (SELECT campaign, count(DISTINCT doctor) AS seen FROM act GROUP BY campaign)
  SELECT g.campaign, coalesce(roster, 0) AS roster, seen, CASE WHEN coalesce(roster, 0) > 0 THEN roster ELSE greatest(seen, 40) END AS denominator FROM g LEFT JOIN r ON r.campaign = g.campaign""")
def denominator_fallback(spark, sf_dir):
    a = activity(spark, sf_dir)
    r = a.where("campaign <> 'C2'").join(doctors(spark, sf_dir).select("doctor"), "doctor").groupBy("campaign").agg(F.count_distinct("doctor").alias("roster"))
    g = a.groupBy("campaign").agg(F.count_distinct("doctor").alias("seen")).join(r, "campaign", "left").fillna(0, ["roster"])
    return g.withColumn("denominator", F.when(F.col("roster") > 0, F.col("roster")).otherwise(F.greatest("seen", F.lit(40).cast("long"))))


@query(f"""WITH {WEEKS}, b AS (SELECT campaign, CAST(sum(reached) AS BIGINT) AS sum_of_uniques FROM kpi GROUP BY campaign), x AS (SELECT campaign, least(count(DISTINCT doctor) FILTER (WHERE opened IS NOT NULL), 1000000) AS opened, count(DISTINCT doctor) AS period_unique FROM seen GROUP BY campaign)
  SELECT b.campaign, sum_of_uniques, period_unique, opened FROM b JOIN x ON b.campaign = x.campaign""")
def weekly_against_period(spark, sf_dir):
    sums = weekly_kpi(spark, sf_dir).groupBy("campaign").agg(F.sum("reached").alias("sum_of_uniques"))
    true = _parts(spark, sf_dir)[1].groupBy("campaign").agg(F.count_distinct(F.when(F.col("opened").isNotNull(), F.col("doctor"))).alias("opened"), F.count_distinct("doctor").alias("period_unique"))
    return sums.join(true, "campaign")
