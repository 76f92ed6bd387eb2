"""Fact builds: enriched shares, plays, enrolments, screenings, courses and what is checked about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefield.functions.text import joined_hash, percent, phone_last10, saturday
from pulsefield.operators.metrics import Window
from pulsefield.plans import kpis
from pulsefield.plans.base import ACT, DOC, activity, doctors, query
from pulsefield.session import table


@query(f"""WITH {ACT}, sh AS (SELECT event_id AS share, k % 6 AS bundle FROM act WHERE event_type = 'view'), bv AS (SELECT b AS bundle, 'v' || (b * 10 + i) AS video FROM (SELECT unnest(generate_series(0, 5)) AS b), (SELECT unnest([0, 1, 2]) AS i) WHERE (b + i) % 2 = 0 OR i = 1),
  pl AS (SELECT event_id - event_id % 5 AS share, 'v' || ((k % 6) * 10 + event_id % 3) AS video, k AS progress FROM act WHERE event_type = 'click'), p AS (SELECT share, video, max(progress) AS progress, count(*) AS plays FROM pl GROUP BY ALL), s AS (SELECT share, video FROM sh JOIN bv ON bv.bundle = sh.bundle)
  SELECT coalesce(s.share, p.share) AS share, coalesce(s.video, p.video) AS video, coalesce(plays, 0) AS plays, coalesce(progress, 0) >= 50 AS viewed_50, s.share IS NULL AS orphan FROM s FULL JOIN p ON p.share = s.share AND p.video = s.video""")
def video_views(spark, sf_dir):
    a = activity(spark, sf_dir)
    b = spark.range(6).select(F.col("id").alias("bundle"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).where("(bundle + i) % 2 = 0 or i = 1")
    videos = b.select("bundle", F.concat(F.lit("v"), (F.col("bundle") * 10 + F.col("i")).cast("string")).alias("video"))
    s = a.where("event_type = 'view'").select(F.col("event_id").alias("share"), (F.col("k") % 6).cast("bigint").alias("bundle")).join(videos, "bundle").select("share", "video", F.lit(True).alias("shared"))
    p = a.where("event_type = 'click'").select((F.col("event_id") - F.col("event_id") % 5).alias("share"), F.concat(F.lit("v"), ((F.col("k") % 6) * 10 + F.col("event_id") % 3).cast("string")).alias("video"), "k")
    p = p.groupBy("share", "video").agg(F.max("k").alias("progress"), F.count("*").alias("plays"))
    return s.join(p, ["share", "video"], "full_outer").select("share", "video", F.coalesce("plays", F.lit(0)).alias("plays"), (F.coalesce("progress", F.lit(0)) >= 50).alias("viewed_50"), F.col("shared").isNull().alias("orphan"))


@query(f"""WITH {ACT}, {DOC}, en AS (SELECT campaign, doctor, min(d) AS enrolled FROM act WHERE event_type = 'signup' GROUP BY ALL), cr AS (SELECT campaign, doctor, 'R' || (max(k) % 7) AS rep, min(d) AS credited FROM act WHERE event_type = 'purchase' AND k > 50 GROUP BY ALL)
  SELECT coalesce(en.campaign, cr.campaign) AS campaign, coalesce(en.doctor, cr.doctor) AS doctor, coalesce(cr.rep, doc.rep) AS rep, coalesce(credited, enrolled) AS since, enrolled IS NULL AS credit_only FROM en FULL JOIN cr ON cr.campaign = en.campaign AND cr.doctor = en.doctor LEFT JOIN doc ON doc.doctor = coalesce(en.doctor, cr.doctor)""")
def enrollment_credit(spark, sf_dir):
    a = activity(spark, sf_dir)
    en = a.where("event_type = 'signup'").groupBy("campaign", "doctor").agg(F.min("d").alias("enrolled"))
    cr = a.where("event_type = 'purchase' and k > 50").groupBy("campaign", "doctor").agg(F.concat(F.lit("R"), (F.max("k") % 7).cast("string")).alias("credit"), F.min("d").alias("credited"))
    base = en.join(cr, ["campaign", "doctor"], "full_outer").join(doctors(spark, sf_dir).select("doctor", "rep"), "doctor", "left")
    return base.select("campaign", "doctor", F.coalesce("credit", "rep").alias("rep"), F.coalesce("credited", "enrolled").alias("since"), F.col("enrolled").isNull().alias("credit_only"))


@query(f"WITH {ACT} SELECT p.event_id, p.k AS milestone, p.k IN (25, 50, 75, 100) AS valid, s.event_id IS NULL AS orphan FROM act p LEFT JOIN act s ON s.event_id = p.event_id - p.event_id % 5 AND s.event_type = 'view' WHERE p.event_type = 'click'")
def playback_milestones(spark, sf_dir):
    a = activity(spark, sf_dir)
    s = a.where("event_type = 'view'").select(F.col("event_id").alias("share"))
    p = a.where("event_type = 'click'").select("event_id", F.col("k").alias("milestone"), (F.col("event_id") - F.col("event_id") % 5).alias("ref"))
    return p.join(s, F.col("ref") == F.col("share"), "left").select("event_id", "milestone", F.col("milestone").isin(25, 50, 75, 100).alias("valid"), F.col("share").isNull().alias("orphan"))


@query(f"""WITH {ACT}, sc AS (SELECT doctor, d, min(event_id) AS screening FROM act WHERE event_type = 'view' GROUP BY ALL), cat AS (SELECT n AS flag, CASE WHEN n % 3 = 0 THEN NULL ELSE 'en' END AS lang, 'label ' || n AS label FROM (SELECT unnest(generate_series(0, 9)) AS n))
  SELECT f.event_id, screening, coalesce(c1.label, c2.label, 'unknown') AS label FROM (SELECT *, k % 12 AS flag FROM act WHERE event_type = 'error') f LEFT JOIN sc ON sc.doctor = f.doctor AND sc.d = f.d LEFT JOIN cat c1 ON c1.flag = f.flag AND c1.lang = 'en' LEFT JOIN cat c2 ON c2.flag = f.flag AND c2.lang IS NULL""")
def flag_occurrences(spark, sf_dir):
    a = activity(spark, sf_dir)
    sc = a.where("event_type = 'view'").groupBy("doctor", "d").agg(F.min("event_id").alias("screening"))
    labels = spark.range(10).select(F.col("id").cast("int").alias("flag"), (F.col("id") % 3 != 0).alias("english"), F.concat(F.lit("label "), F.col("id").cast("string")).alias("label"))
    best = labels.groupBy("flag").agg(F.max_by("label", "english").alias("label"))  # the language's label, else any
    f = a.where("event_type = 'error'").select("event_id", "doctor", "d", (F.col("k") % 12).alias("flag"))
    return f.join(sc, ["doctor", "d"], "left").join(best, "flag", "left").select("event_id", "screening", F.coalesce("label", F.lit("unknown")).alias("label"))


@query("""SELECT o_orderpriority AS course, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 6) AS completed_pct, round(count(*) FILTER (WHERE o_orderstatus <> 'O') * 100.0::DOUBLE / count(*), 6) AS engaged_pct FROM orders GROUP BY 1""")
def course_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("course")).agg(F.count("*").alias("total"), F.count(F.when(s == "F", 1)).alias("completed"), F.count(F.when(s != "O", 1)).alias("engaged"))
    return c.select("course", "total", "completed", F.round(percent(F.col("completed"), F.col("total")), 6).alias("completed_pct"), F.round(percent(F.col("engaged"), F.col("total")), 6).alias("engaged_pct"))


@query("""SELECT md5(o_orderkey || ':' || o_orderpriority) AS webinar_key, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + 1 END, CAST(o_orderdate AS DATE) + 2) AS effective FROM orders WHERE o_orderpriority LIKE '%URGENT%'""")
def webinar_facts(spark, sf_dir):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").contains("URGENT"))
    return o.select(joined_hash("md5", ":", F.col("o_orderkey"), F.col("o_orderpriority")).alias("webinar_key"), F.coalesce(F.when(k == 0, day), F.when(k == 1, F.date_add(day, 1)), F.date_add(day, 2)).alias("effective"))


@query(f"WITH {ACT}, l AS (SELECT doctor, arg_max(campaign || collateral, event_id) AS last_campaign FROM act WHERE event_type = 'signup' GROUP BY doctor) SELECT event_id, coalesce(CASE WHEN k < 50 THEN campaign END, last_campaign, 'none') AS campaign FROM act LEFT JOIN l ON l.doctor = act.doctor")
def campaign_backfill(spark, sf_dir):
    a = activity(spark, sf_dir)
    last = a.where("event_type = 'signup'").groupBy("doctor").agg(F.max_by(F.concat("campaign", F.col("collateral").cast("string")), "event_id").alias("last_campaign"))
    return a.join(last, "doctor", "left").select("event_id", F.coalesce(F.when(F.col("k") < 50, F.col("campaign")), "last_campaign", F.lit("none")).alias("campaign"))


@query(f"""WITH {ACT}, {DOC}, ev AS (SELECT event_id, campaign, rep, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS ph FROM act JOIN doc ON doc.doctor = act.doctor), r AS (SELECT 'C' || (doctor + 2) % 3 AS campaign, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS ph, 'R' || ((doctor + 1) % 7) AS affected FROM doc WHERE doctor % 6 = 0)
  SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.campaign = ev.campaign AND r.ph = ev.ph AND r.affected = ev.rep)""")
def activity_correction(spark, sf_dir):
    d = doctors(spark, sf_dir).select("doctor", "rep", phone_last10(F.col("phone")).alias("ph"))
    of = lambda c, n: F.concat(F.lit(c), (n).cast("string"))
    rules = d.where("doctor % 6 = 0").select(of("C", (F.col("doctor") + 2) % 3).alias("campaign"), "ph", of("R", (F.col("doctor") + 1) % 7).alias("rep")).distinct()
    return activity(spark, sf_dir).join(d, "doctor").join(rules, ["campaign", "ph", "rep"], "left_anti").select("event_id")


@query(f"""WITH {ACT}, s AS (SELECT doctor, CAST(max(k) AS BIGINT) AS claimed FROM act GROUP BY doctor), f AS (SELECT doctor, count(*) AS counted FROM act WHERE event_type <> 'error' GROUP BY doctor) SELECT s.doctor, claimed, coalesce(counted, 0) AS counted, claimed < coalesce(counted, 0) AS source_behind FROM s LEFT JOIN f ON f.doctor = s.doctor""")
def recon_sources(spark, sf_dir):
    per = activity(spark, sf_dir).groupBy("doctor").agg(F.max("k").cast("bigint").alias("claimed"), F.count(F.when(F.col("event_type") != "error", 1)).alias("counted"))
    return per.withColumn("source_behind", F.col("claimed") < F.col("counted"))


@query(f"WITH {ACT}, {DOC} SELECT s.event_id, coalesce(doc.rep, 'Unassigned') AS rep, CAST(s.d + CAST(6 - dayofweek(s.d) AS INTEGER) AS DATE) AS week_end, doc.doctor IS NULL AS doctor_missing, s.collateral IS NULL OR s.k > 95 AS content_suspect, count(*) OVER (PARTITION BY s.doctor, s.d) > 1 AS same_day_repeat FROM act s LEFT JOIN doc ON doc.doctor = s.doctor AND doc.doctor % 9 <> 0 WHERE s.event_type = 'view'")
def share_quality(spark, sf_dir):
    d = doctors(spark, sf_dir).where("doctor % 9 <> 0").select("doctor", "rep", F.lit(True).alias("known"))
    s = activity(spark, sf_dir).where("event_type = 'view'").withColumn("same_day_repeat", F.count("*").over(Window.partitionBy("doctor", "d")) > 1)
    return s.join(d, "doctor", "left").select("event_id", F.coalesce("rep", F.lit("Unassigned")).alias("rep"), saturday(F.col("d")).alias("week_end"), F.col("known").isNull().alias("doctor_missing"), (F.col("collateral").isNull() | (F.col("k") > 95)).alias("content_suspect"), "same_day_repeat")


@query(f"""WITH {kpis.ROLLING} SELECT campaign, count(DISTINCT act.doctor) AS doctors, count(DISTINCT act.doctor) FILTER (WHERE s.status = 'active') AS active, count(*) FILTER (WHERE event_type = 'view') AS screenings, count(*) FILTER (WHERE event_type = 'error') AS flags, count(DISTINCT act.d) AS days FROM act LEFT JOIN (SELECT doctor, status FROM status WHERE d = DATE '2024-01-20') s ON s.doctor = act.doctor GROUP BY campaign""")
def campaign_snapshot(spark, sf_dir):
    now = kpis.rolling_activity(spark, sf_dir, kpis.LAST).select("doctor", "status")
    a = activity(spark, sf_dir).join(now, "doctor", "left")
    e = F.col("event_type")
    return a.groupBy("campaign").agg(F.count_distinct("doctor").alias("doctors"), F.count_distinct(F.when(F.col("status") == "active", F.col("doctor"))).alias("active"), F.count(F.when(e == "view", 1)).alias("screenings"), F.count(F.when(e == "error", 1)).alias("flags"), F.count_distinct("d").alias("days"))
