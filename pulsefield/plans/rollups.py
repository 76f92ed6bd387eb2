"""Rollups per clinic, summary counts, navigation, denominators and option lists of the campaign reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.functions.text import capped_percent, engagement_health, format_number, format_percent, monday, pretty_date, reporting_window
from pulsefield.operators import metrics as M
from pulsefield.plans import kpis
from pulsefield.plans.base import ACT, DOC, SEEN, SQL, activity, doctors, health_sql, query
from pulsefield.plans.clinics import DIM, dimension
from pulsefield.session import table

def _event() -> tuple[Column, Column]:
    """The columns that tell what an event is; made in a session."""
    return F.col("event_type"), F.col("k")


def _n(cond: Column, name: str) -> Column:
    return F.count(F.when(cond, 1)).alias(name)


#: A clinic by its roster entry; events of doctors that the roster lacks stand under their key.
CLINIC = "coalesce(dim.city, 'Unknown') AS clinic_group, coalesce(dim.doctor_display_name, CAST(f.doctor AS VARCHAR)) AS clinic"


def _labelled(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """rows with clinic_group and clinic in place of doctor."""
    named = rows.join(dim.select("doctor", "city", "doctor_display_name"), "doctor", "left")
    return named.withColumns({"clinic_group": F.coalesce("city", F.lit("Unknown")), "clinic": F.coalesce("doctor_display_name", F.col("doctor").cast("string"))}).drop("doctor", "city", "doctor_display_name")


@query(f"""WITH {ACT}, {DIM}, f AS (
  SELECT doctor, count(*) FILTER (WHERE event_type = 'click') AS form_fills, count(*) FILTER (WHERE event_type = 'error') AS red_flags_total, count(*) FILTER (WHERE event_type = 'view' AND k % 2 = 0) AS patient_video_views,
    count(*) FILTER (WHERE event_type = 'click') AS reports_emailed_to_doctors, count(DISTINCT CASE WHEN event_type = 'view' AND k % 3 = 0 AND k % 10 <> 0 THEN k END) AS form_shares,
    count(*) FILTER (WHERE event_type = 'view' AND k % 3 = 0) AS patient_scans, count(*) FILTER (WHERE event_type = 'purchase') AS follow_ups_scheduled, count(*) FILTER (WHERE event_type = 'signup' AND k % 5 = 0) AS reminders_sent,
    min(CASE WHEN event_type = 'purchase' THEN CAST(d + k % 14 AS DATE) ELSE d END) AS period_start, max(CASE WHEN event_type = 'purchase' THEN CAST(d + k % 14 AS DATE) ELSE d END) AS period_end
  FROM act WHERE event_type IN ('click', 'error', 'purchase') OR event_type = 'view' AND (k % 2 = 0 OR k % 3 = 0) OR event_type = 'signup' AND k % 5 = 0 GROUP BY doctor
) SELECT {CLINIC}, f.* EXCLUDE (doctor) FROM f LEFT JOIN dim ON dim.doctor = f.doctor""")
def red_flag_rollup(spark, sf_dir):
    """Eight measures and the period of each clinic, from one pass over the facts."""
    E, K = _event()
    video, scan, reminder = (E == "view") & (K % 2 == 0), (E == "view") & (K % 3 == 0), (E == "signup") & (K % 5 == 0)
    used = activity(spark, sf_dir).where(E.isin("click", "error", "purchase") | video | scan | reminder)
    at = F.when(E == "purchase", F.date_add("d", (K % 14).cast("int"))).otherwise(F.col("d"))
    counts = used.groupBy("doctor").agg(
        _n(E == "click", "form_fills"), _n(E == "error", "red_flags_total"), _n(video, "patient_video_views"), _n(E == "click", "reports_emailed_to_doctors"),
        F.count_distinct(F.when(scan & (K % 10 != 0), K)).alias("form_shares"), _n(scan, "patient_scans"), _n(E == "purchase", "follow_ups_scheduled"), _n(reminder, "reminders_sent"),
        F.min(at).alias("period_start"), F.max(at).alias("period_end"),
    )
    return _labelled(counts, dimension(spark, sf_dir))


#: A share's reading state as sources give it: pages and percentages as texts, some of which are no numbers.
TX = ACT + """, tx AS (SELECT *, CASE k % 6 WHEN 0 THEN 'x' ELSE CAST(k % 20 AS VARCHAR) END AS last_page, CAST(k % 7 AS VARCHAR) AS pages, CASE k % 5 WHEN 0 THEN 'n/a' ELSE ' ' || k * 2 || '.0 ' END AS percent FROM act),
typed AS (SELECT *, CASE WHEN regexp_full_match(trim(last_page), '-?[0-9]+(\\.[0-9]+)?') THEN CAST(trim(last_page) AS DOUBLE) END AS page_n, CASE WHEN regexp_full_match(trim(pages), '-?[0-9]+(\\.[0-9]+)?') THEN CAST(trim(pages) AS DOUBLE) END AS pages_n,
  CASE WHEN regexp_full_match(trim(percent), '-?[0-9]+(\\.[0-9]+)?') THEN CAST(trim(percent) AS DOUBLE) END AS percent_n FROM tx)"""


def _typed(a: DataFrame) -> DataFrame:
    """Guarded numbers: null unless the whole text is one."""
    _, K = _event()
    number = lambda c: F.when(F.trim(c).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.trim(c).try_cast("double"))
    text = lambda c: c.cast("string")
    page = F.when(K % 6 == 0, "x").otherwise(text(K % 20))
    percent = F.when(K % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), text(K * 2), F.lit(".0 ")))
    return a.withColumns({"page_n": number(page), "pages_n": number(text(K % 7)), "percent_n": number(percent)})


def _read() -> Column:
    """Whether a document was read to its end."""
    return (F.col("k") % 10 == 1) | F.coalesce((F.col("pages_n") > 0) & (F.col("page_n") >= F.col("pages_n")), F.lit(False))


READ_SQL = "(k % 10 = 1 OR coalesce(pages_n > 0 AND page_n >= pages_n, FALSE))"


@query(f"""WITH {TX}, {DIM}, f AS (
  SELECT campaign, doctor, count(*) AS shares, count(*) FILTER (WHERE event_type <> 'signup') AS link_opens, count(*) FILTER (WHERE {READ_SQL}) AS pdf_reads_completed, count(*) FILTER (WHERE k % 17 = 0 OR percent_n >= 50) AS video_views,
    count(*) FILTER (WHERE k % 17 = 0 OR k % 13 = 0 OR percent_n >= 100) AS video_completions, count(*) FILTER (WHERE event_type = 'purchase') AS pdf_downloads, min(d) AS period_start, max(d) AS period_end FROM typed GROUP BY ALL
) SELECT campaign, {CLINIC}, f.* EXCLUDE (campaign, doctor) FROM f LEFT JOIN dim ON dim.doctor = f.doctor""")
def in_clinic_rollup(spark, sf_dir):
    E, K = _event()
    seen = lambda least: F.coalesce(F.col("percent_n") >= least, F.lit(False))
    counts = _typed(activity(spark, sf_dir)).groupBy("campaign", "doctor").agg(
        F.count("*").alias("shares"), _n(E != "signup", "link_opens"), _n(_read(), "pdf_reads_completed"), _n((K % 17 == 0) | seen(50), "video_views"),
        _n((K % 17 == 0) | (K % 13 == 0) | seen(100), "video_completions"), _n(E == "purchase", "pdf_downloads"), F.min("d").alias("period_start"), F.max("d").alias("period_end"),
    )
    return _labelled(counts, dimension(spark, sf_dir))


EDUCATION = ACT + ", " + DIM + """, enrolled AS (SELECT * FROM dim WHERE doctor % 5 <> 0), per AS (
  SELECT doctor, count(*) FILTER (WHERE event_type = 'click') AS video_views, count(*) FILTER (WHERE event_type = 'click' AND k >= 80) AS video_completions, count(*) FILTER (WHERE event_type = 'signup') AS cluster_shares,
    count(DISTINCT k) FILTER (WHERE event_type = 'signup') AS patient_scans, count(*) FILTER (WHERE event_type = 'error') AS banner_clicks, count(*) FILTER (WHERE event_type = 'signup') AS shared,
    min(d) FILTER (WHERE event_type IN ('signup', 'click', 'error')) AS lo, max(d) FILTER (WHERE event_type IN ('signup', 'click', 'error')) AS hi, min(d) FILTER (WHERE event_type IN ('signup', 'click')) AS lo2, max(d) FILTER (WHERE event_type IN ('signup', 'click')) AS hi2
  FROM act GROUP BY doctor)"""


def _education(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    E, K = _event()
    part = lambda *kinds: E.isin(*kinds)
    day = lambda f, *kinds: f(F.when(part(*kinds), F.col("d")))
    per = activity(spark, sf_dir).groupBy("doctor").agg(
        _n(E == "click", "video_views"), _n((E == "click") & (K >= 80), "video_completions"), _n(E == "signup", "cluster_shares"), F.count_distinct(F.when(E == "signup", K)).alias("patient_scans"), _n(E == "error", "banner_clicks"),
        *[day(f, "signup", "click", *more).alias(name) for more, names in ((("error",), ("lo", "hi")), ((), ("lo2", "hi2"))) for f, name in zip((F.min, F.max), names, strict=True)],
    )
    return dimension(spark, sf_dir).where("doctor % 5 <> 0"), per


MEASURES = ("video_views", "video_completions", "cluster_shares", "patient_scans", "banner_clicks")


@query(f"""WITH {EDUCATION} SELECT doctor, city AS clinic_group, doctor_display_name AS clinic, {', '.join(f'coalesce({m}, 0) AS {m}' for m in MEASURES)}, least(registered_at, lo) AS period_start, greatest(registered_at, hi) AS period_end
  FROM enrolled LEFT JOIN per USING (doctor) UNION ALL
  SELECT doctor, 'Unknown', CAST(doctor AS VARCHAR), 0, 0, 0, 0, 0, lo2, hi2 FROM per WHERE shared > 0 AND doctor NOT IN (SELECT doctor FROM enrolled)""")
def education_rollup(spark, sf_dir):
    """Enrolled doctors with their measures; doctors who only shared are listed with zeros. Plays lengthen a period, no more."""
    enrolled, per = _education(spark, sf_dir)
    own = enrolled.join(per, "doctor", "left")
    listed = own.select("doctor", F.col("city").alias("clinic_group"), F.col("doctor_display_name").alias("clinic"), *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES], F.least("registered_at", "lo").alias("period_start"), F.greatest("registered_at", "hi").alias("period_end"))
    others = per.where("cluster_shares > 0").join(enrolled.select("doctor"), "doctor", "left_anti")
    zeros = [F.lit(0).cast("long").alias(m) for m in MEASURES]
    return listed.unionByName(others.select("doctor", F.lit("Unknown").alias("clinic_group"), F.col("doctor").cast("string").alias("clinic"), *zeros, F.col("lo2").alias("period_start"), F.col("hi2").alias("period_end")))


@query(f"""WITH {EDUCATION} SELECT city AS clinic_group, 'Clinic ' || doctor // 4 AS clinic, {', '.join(f'CAST(sum(coalesce({m}, 0)) AS BIGINT) AS {m}' for m in MEASURES)} FROM enrolled LEFT JOIN per USING (doctor) GROUP BY ALL""")
def education_clinics(spark, sf_dir):
    enrolled, per = _education(spark, sf_dir)
    rows = enrolled.join(per, "doctor", "left").withColumn("clinic", F.concat(F.lit("Clinic "), F.expr("doctor div 4").cast("string")))
    return rows.groupBy(F.col("city").alias("clinic_group"), "clinic").agg(*[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in MEASURES])


@query(f"""WITH {SEEN.replace(ACT, TX)}, {DOC}, base AS (SELECT doctor, 'C' || doctor % 3 AS campaign FROM doc WHERE doctor % 6 <> 0),
action AS (SELECT campaign, doctor, min(reached) AS reached, min(opened) AS opened, min(video) AS video, min(pdf) AS pdf FROM seen GROUP BY ALL),
b AS (SELECT base.campaign, count(DISTINCT base.doctor) AS clinics_added, count(DISTINCT a.doctor) FILTER (WHERE coalesce(reached, opened, video, pdf) IS NOT NULL) AS active_records,
    count(DISTINCT a.doctor) FILTER (WHERE coalesce(reached, opened, video, pdf) IS NOT NULL) AS clinics_with_activity, count(DISTINCT a.doctor) FILTER (WHERE reached IS NOT NULL) AS shares,
    count(DISTINCT a.doctor) FILTER (WHERE opened IS NOT NULL) AS link_opens, count(DISTINCT a.doctor) FILTER (WHERE video IS NOT NULL) AS video_views, count(DISTINCT a.doctor) FILTER (WHERE pdf IS NOT NULL) AS pdf_downloads
  FROM base LEFT JOIN action a ON a.campaign = base.campaign AND a.doctor = base.doctor GROUP BY base.campaign),
c AS (SELECT campaign, count(DISTINCT doctor) FILTER (WHERE {READ_SQL}) AS pdf_reads, count(DISTINCT doctor) FILTER (WHERE k % 13 = 0 OR k % 17 = 0 OR coalesce(percent_n, 0) >= 100) AS video_completions FROM typed GROUP BY campaign)
SELECT b.*, coalesce(pdf_reads, 0) AS pdf_reads, coalesce(video_completions, 0) AS video_completions FROM b LEFT JOIN c ON c.campaign = b.campaign""")
def in_clinic_counts(spark, sf_dir):
    """Nine counts of distinct clinics per campaign. Both sides have a row per clinic, so distinct clinics are rows."""
    _, K = _event()
    a = activity(spark, sf_dir)
    base = doctors(spark, sf_dir).where("doctor % 6 <> 0").select("doctor", F.concat(F.lit("C"), (F.col("doctor") % 3).cast("string")).alias("campaign"))
    rows = base.join(M.first_seen(a, ["campaign", "doctor"]), ["campaign", "doctor"], "left")
    has = lambda c, name: F.count(c).alias(name)
    active = F.coalesce("reached", "opened", "video", "pdf")
    counts = rows.groupBy("campaign").agg(F.count("*").alias("clinics_added"), has(active, "active_records"), has(active, "clinics_with_activity"), has(F.col("reached"), "shares"), has(F.col("opened"), "link_opens"), has(F.col("video"), "video_views"), has(F.col("pdf"), "pdf_downloads"))
    done = (K % 13 == 0) | (K % 17 == 0) | (F.coalesce("percent_n", F.lit(0.0)) >= 100)
    per = _typed(a).groupBy("campaign", "doctor").agg(F.max(_read().cast("int")).alias("r"), F.max(done.cast("int")).alias("v"))
    return counts.join(per.groupBy("campaign").agg(F.sum("r").alias("pdf_reads"), F.sum("v").alias("video_completions")), "campaign", "left").fillna(0, ["pdf_reads", "video_completions"])


@query(f"""WITH {ACT}, {DOC}, c AS (SELECT campaign, count(*) AS total_clicks, count(DISTINCT act.doctor) AS participating_clinics, count(DISTINCT state) AS states_reached, min(ts) AS s, max(ts) AS e FROM act LEFT JOIN doc ON doc.doctor = act.doctor WHERE event_type = 'error' GROUP BY campaign),
w AS (SELECT campaign, string_agg(week || '=' || n, ',' ORDER BY week) AS click_trend FROM (SELECT campaign, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM act WHERE event_type = 'error' GROUP BY ALL) GROUP BY campaign)
SELECT c.campaign, CASE c.campaign WHEN 'C0' THEN 'Banner,WhatsApp' WHEN 'C1' THEN 'Email' ELSE '' END AS entry_channels, total_clicks, participating_clinics, states_reached, CAST(s AS DATE) AS period_start, CAST(e AS DATE) AS period_end, click_trend FROM c JOIN w USING (campaign)""")
def navigation_context(spark, sf_dir):
    """How a campaign is entered, and its banner clicks with their trend by Monday weeks."""
    E, _ = _event()
    clicks = activity(spark, sf_dir).where(E == "error").join(doctors(spark, sf_dir).select("doctor", "state"), "doctor", "left")
    total = clicks.groupBy("campaign").agg(F.count("*").alias("total_clicks"), F.count_distinct("doctor").alias("participating_clinics"), F.count_distinct("state").alias("states_reached"), F.min("d").alias("period_start"), F.max("d").alias("period_end"))
    weekly = clicks.groupBy("campaign", monday(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    point = F.concat(F.col("week").cast("string"), F.lit("="), F.col("n").cast("string"))
    trend = weekly.groupBy("campaign").agg(F.array_join(F.sort_array(F.collect_list(point)), ",").alias("click_trend"))  # a point a week
    switches = {"Banner": ("C0",), "WhatsApp": ("C0",), "Email": ("C1",)}
    channels = F.array_join(F.array_compact(F.array(*[F.when(F.col("campaign").isin(*on), F.lit(name)) for name, on in switches.items()])), ",")
    return total.join(trend, "campaign").withColumn("entry_channels", channels)


@query(f"""WITH {DOC}, reps AS (SELECT DISTINCT 'C' || doctor % 3 AS campaign, rep FROM doc WHERE rep <> 'R6'), roster AS (SELECT DISTINCT 'C' || doctor % 3 AS campaign, rep, doctor FROM doc WHERE rep NOT IN ('R2', 'R4') AND doctor % 4 <> 0),
known AS (SELECT r.* FROM roster r JOIN reps USING (campaign, rep)), assigned AS (SELECT campaign, rep, doctor FROM known UNION ALL
  SELECT reps.campaign, reps.rep, doc.doctor FROM reps JOIN doc ON doc.rep = reps.rep WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.campaign = reps.campaign AND k.rep = reps.rep)),
declared AS (SELECT 'C' || n_nationkey % 6 AS campaign, max(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 10 END) AS declared, max(CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 9 END) AS supported FROM nation GROUP BY 1)
SELECT d.campaign, CAST(CASE WHEN count(doctor) > 0 THEN count(doctor) ELSE greatest(coalesce(any_value(declared), 0), coalesce(any_value(supported), 0)) END AS BIGINT) AS assigned_total FROM declared d LEFT JOIN assigned a ON a.campaign = d.campaign GROUP BY d.campaign""")
def assigned_denominator(spark, sf_dir):
    """Doctors of a campaign's reps by its roster; for reps without one, by the whole directory; without reps, as declared."""
    d = doctors(spark, sf_dir).select("doctor", "rep", F.concat(F.lit("C"), (F.col("doctor") % 3).cast("string")).alias("campaign"))
    reps = d.where("rep <> 'R6'").select("campaign", "rep").distinct()
    known = d.where("rep not in ('R2', 'R4') and doctor % 4 <> 0").join(reps, ["campaign", "rep"]).distinct()
    without = reps.join(known.select("campaign", "rep").distinct(), ["campaign", "rep"], "left_anti")
    directory = d.groupBy("rep").agg(F.count("*").alias("n"))  # counted before the join, which then has a row a rep
    counted = known.groupBy("campaign").agg(F.count("*").alias("n")).unionByName(without.join(directory, "rep").groupBy("campaign").agg(F.sum("n").alias("n")))
    nation, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    text = lambda by: F.when(key % by == 0, "many").otherwise(key.cast("string"))
    number = lambda c: F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("long"))
    declared = nation.groupBy(F.concat(F.lit("C"), (key % 6).cast("string")).alias("campaign")).agg((F.max(number(text(4))) * 10).alias("declared"), (F.max(number(text(5))) * 9).alias("supported"))
    total = counted.groupBy("campaign").agg(F.sum("n").alias("n"))
    fallback = F.greatest(F.coalesce("declared", F.lit(0)), F.coalesce("supported", F.lit(0)))
    return declared.join(total, "campaign", "left").select("campaign", F.when(F.col("n") > 0, F.col("n")).otherwise(fallback).cast("long").alias("assigned_total"))


@query(f"""WITH r AS ({SQL['rep_insight']}), {DOC}, st AS (SELECT rep, min(state) AS state FROM doc GROUP BY rep), b AS (SELECT state, sum(sent) AS reached, sum(viewed) AS opened, sum(greatest(video, pdf)) AS consumed, sum(assigned) AS assigned FROM r JOIN st USING (rep) GROUP BY state),
t AS (SELECT *, CASE WHEN assigned > 0 THEN assigned ELSE reached END AS total FROM b), h AS (SELECT *, {health_sql('reached', 'opened', 'consumed', '(total / 4.0::DOUBLE)')} AS h FROM t WHERE reached > 0 OR opened > 0 OR consumed > 0 OR total > 0)
SELECT state, round(CASE WHEN reached > 0 THEN least(opened * 100.0::DOUBLE / reached, 100) ELSE 0 END, 1) AS open_pct, round(CASE WHEN total > 0 THEN least(reached * 100.0::DOUBLE / (total / 4.0::DOUBLE), 100) ELSE 0 END, 1) AS reached_pct,
  round(CASE WHEN opened > 0 THEN least(consumed * 100.0::DOUBLE / opened, 100) ELSE 0 END, 1) AS consumed_pct, round(h, 1) AS health_score, CASE WHEN h <= 40 THEN 'Low' WHEN h < 60 THEN 'Medium' ELSE 'Good' END AS label, row_number() OVER (ORDER BY round(h, 1), state) AS rank FROM h""")
def state_attention_from_reps(spark, sf_dir):
    """States by health, from the insight rows of their reps, where no state rows are at hand."""
    states = doctors(spark, sf_dir).groupBy("rep").agg(F.min("state").alias("state"))
    rows = kpis.rep_insight(spark, sf_dir).join(states, "rep").groupBy("state").agg(F.sum("sent").alias("reached"), F.sum("viewed").alias("opened"), F.sum(F.greatest("video", "pdf")).alias("consumed"), F.sum("assigned").alias("assigned"))
    rows = rows.withColumn("total", F.when(F.col("assigned") > 0, F.col("assigned")).otherwise(F.col("reached"))).where("reached > 0 or opened > 0 or consumed > 0 or total > 0")
    h = engagement_health(F.col("reached"), F.col("opened"), F.col("consumed"), F.col("total") / 4.0)
    scored = rows.withColumn("h", h)
    label = F.when(F.col("h") <= 40, "Low").when(F.col("h") < 60, "Medium").otherwise("Good")
    one = lambda a, b, name: F.round(capped_percent(F.col(a), b), 1).alias(name)
    shown = scored.select("state", one("opened", F.col("reached"), "open_pct"), one("reached", F.col("total") / 4.0, "reached_pct"), one("consumed", F.col("opened"), "consumed_pct"), F.round("h", 1).alias("health_score"), label.alias("label"))
    return shown.withColumn("rank", F.row_number().over(Window.orderBy("health_score", "state")).cast("long"))  # a row a state


@query("""WITH s AS (SELECT p_partkey, p_brand || '/' || p_size AS name, DATE '1995-01-01' + CAST(p_partkey % 300 AS INTEGER) AS a, DATE '1995-01-01' + CAST(p_partkey % 300 + p_partkey * 7 % 400 AS INTEGER) AS b, p_partkey % 10 = 0 AS fallback FROM part),
named AS (SELECT DISTINCT name FROM s WHERE NOT fallback),
kept AS (SELECT * FROM s WHERE a <= DATE '1995-10-01' AND NOT (name IN (SELECT name FROM named) AND (fallback OR EXISTS (SELECT 1 FROM s o WHERE o.name = s.name AND s.a <= o.a AND s.b >= o.b AND s.b - s.a > o.b - o.a AND s.b - s.a >= 90))))
SELECT p_partkey, name, a AS start_d, b AS end_d, status FROM (SELECT *, row_number() OVER (PARTITION BY name, a, b ORDER BY status, p_partkey) AS n FROM (SELECT *, CASE WHEN b < DATE '1995-10-01' THEN 'Past' ELSE 'Current' END AS status FROM kept)) WHERE n = 1""")
def collateral_options(spark, sf_dir):
    """Collaterals to choose from: no future ones, one of equal name and dates, and none that a narrower one of its name replaces.

    A span of 90 days or more goes if it holds a shorter one of its name. In order of falling start, the least end so far tells: the spans before
    (and, of one start, those that end sooner) start no earlier, so one of them is held if any ends by then. No self join.
    """
    key, base, today = F.col("p_partkey"), F.lit("1995-01-01").cast("date"), F.lit("1995-10-01").cast("date")
    s = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("name"), F.date_add(base, (key % 300).cast("int")).alias("start_d"),
        F.date_add(base, (key % 300 + key * 7 % 400).cast("int")).alias("end_d"), (key % 10 == 0).alias("fallback"),
    )
    order = Window.partitionBy("name").orderBy(F.desc("start_d"), "end_d")
    later = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = s.select("name", "start_d", "end_d").distinct()
    broad = spans.withColumn("held", F.min("end_d").over(later) <= F.col("end_d")).where((F.datediff("end_d", "start_d") >= 90) & F.col("held")).select("name", "start_d", "end_d", F.lit(True).alias("broad"))
    specific = s.groupBy("name").agg(F.bool_or(~F.col("fallback")).alias("specific"))
    rows = s.join(specific, "name").join(broad, ["name", "start_d", "end_d"], "left").where(F.col("start_d") <= today)
    rows = rows.where(~(F.col("specific") & (F.col("fallback") | F.coalesce("broad", F.lit(False)))))
    rows = rows.withColumn("status", F.when(F.col("end_d") < today, "Past").otherwise("Current"))
    first = Window.partitionBy("name", "start_d", "end_d").orderBy("status", "p_partkey")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("p_partkey", "name", "start_d", "end_d", "status")


@query(f"""WITH {ACT} SELECT event_id, format('{{:,}}', event_id * 1000) AS number, format('{{:.1f}}%', k / 4.0::DOUBLE) AS percent, strftime(d, '%b %d, %Y') AS day, 'Jan 01, 2024 to ' || strftime(d, '%b %d, %Y') AS period FROM act""")
def formatted_values(spark, sf_dir):
    """Numbers, percentages, dates and periods as reports show them."""
    day = F.col("d")
    return activity(spark, sf_dir).select(
        "event_id", format_number(F.col("event_id") * 1000).alias("number"), format_percent(F.col("k") / 4).alias("percent"), pretty_date(day).alias("day"), reporting_window(F.lit("2024-01-01"), day).alias("period")
    )
