"""Detail data sets behind the dashboards' numbers: a registry of specifications, each a DataFrame, counted by windows or listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.plans import kpis
from pulsefield.plans.base import ACT, activity, query
from pulsefield.plans.clinics import AS_OF, DIM, certifications, dimension
from pulsefield.session import table

#: Days back of each window's first day; the last has no bounds and may take undated rows.
WINDOWS = {"day": 0, "week": 6, "month": 29, "cumulative": None}
COURSES = {"started": "P", "completed": "F", "pending": "O"}
AUDIENCES = {"doctor": "1-URGENT", "paramedic": "2-HIGH"}


def clinic_sets(spark, sf_dir) -> dict[str, DataFrame]:
    """The data sets by metric: columns d (a date or null), who (null where rows are counted) and undated (whether rows without date count)."""
    a, e, k = activity(spark, sf_dir), F.col("event_type"), F.col("k")
    nobody = F.lit(None).cast("string")

    def of(df: DataFrame, d: Column, who: Column = nobody, undated: bool = False) -> DataFrame:
        return df.select(d.cast("date").alias("d"), who.cast("string").alias("who"), F.lit(undated).alias("undated"))

    day, doctor = F.col("d"), F.col("doctor")
    rep = F.when(k % 9 == 0, F.concat(F.lit("R"), (doctor % 7).cast("string"))).otherwise(F.concat(F.lit("S"), (k % 9).cast("string")))
    first = a.groupBy("doctor").agg(F.min("d").alias("first_seen_at"))
    onboarded = dimension(spark, sf_dir).where("onboarding_flag").join(first, "doctor", "left")
    history = kpis.rolling_activity(spark, sf_dir).where("status = 'active'")
    enrolled = certifications(spark, sf_dir).where("support").select("doctor")
    sets = {
        "webinar_registrations": of(a.where((e == "signup") & (k % 2 == 0)), day),
        "onboarded_doctors": of(onboarded, F.col("first_seen_at"), doctor),
        "field_rep_logins": of(a.where((e == "signup") & (k % 2 == 1)), day, rep),
        "active_clinics": of(history, day, doctor),
        "certified_clinics": of(history.join(enrolled, "doctor", "left_semi"), day, doctor),
        "total_screenings": of(a.where(e == "click"), day),
        "red_tags": of(a.where((e == "click") & (k % 3 == 0)), day),
        "yellow_tags": of(a.where((e == "click") & (k % 3 == 1)), day),
        "followups_scheduled": of(a.where(e == "purchase"), F.date_add("d", (k % 14).cast("int"))),
        "reminders_sent": of(a.where(e == "error"), day),
        "patient_videos": of(a.where((e == "view") & (k % 2 == 0)), day),
        "doctor_videos": of(a.where((e == "view") & (k % 2 == 1)), day),
    }
    o = table(spark, sf_dir, "orders").withColumn("at", F.when(F.col("o_orderkey") % 10 != 0, F.date_sub(F.lit(AS_OF).cast("date"), (F.col("o_orderkey") % 60).cast("int"))))
    for audience, priority in AUDIENCES.items():
        for state, code in COURSES.items():
            sets[f"{audience}_course_{state}"] = of(o.where((F.col("o_orderpriority") == priority) & (F.col("o_orderstatus") == code)), F.col("at"), undated=True)
    return sets


def _clinic_sql() -> str:
    def inside(back: int | None, undated: bool = False) -> str:
        return ("TRUE" if undated else "d IS NOT NULL") if back is None else f"d BETWEEN DATE '{AS_OF}' - {back} AND DATE '{AS_OF}'"

    def metric(name: str, source: str, what: str = "count(*)", undated: bool = False) -> str:
        return f"SELECT '{name}' AS metric, " + ", ".join(f'{what} FILTER (WHERE {inside(back, undated)}) AS "{w}"' for w, back in WINDOWS.items()) + f" FROM {source}"

    who, rep = "count(DISTINCT doctor)", "count(DISTINCT CASE WHEN k % 9 = 0 THEN 'R' || (doctor % 7) ELSE 'S' || (k % 9) END)"
    parts = [
        metric("webinar_registrations", "act WHERE event_type = 'signup' AND k % 2 = 0"),
        metric("onboarded_doctors", "(SELECT dim.doctor, first_seen_at AS d FROM dim LEFT JOIN seen ON seen.doctor = dim.doctor WHERE onboarding_flag)", who),
        metric("field_rep_logins", "act WHERE event_type = 'signup' AND k % 2 = 1", rep),
        metric("active_clinics", "status WHERE status = 'active'", who),
        metric("certified_clinics", "status WHERE status = 'active' AND doctor IN (SELECT doctor FROM cert WHERE support)", who),
        metric("total_screenings", "act WHERE event_type = 'click'"),
        metric("red_tags", "act WHERE event_type = 'click' AND k % 3 = 0"),
        metric("yellow_tags", "act WHERE event_type = 'click' AND k % 3 = 1"),
        metric("followups_scheduled", "(SELECT CAST(d + k % 14 AS DATE) AS d FROM act WHERE event_type = 'purchase')"),
        metric("reminders_sent", "act WHERE event_type = 'error'"),
        metric("patient_videos", "act WHERE event_type = 'view' AND k % 2 = 0"),
        metric("doctor_videos", "act WHERE event_type = 'view' AND k % 2 = 1"),
    ]
    for audience, priority in AUDIENCES.items():
        for state, code in COURSES.items():
            parts.append(metric(f"{audience}_course_{state}", f"(SELECT CASE WHEN o_orderkey % 10 <> 0 THEN DATE '{AS_OF}' - CAST(o_orderkey % 60 AS INTEGER) END AS d FROM orders WHERE o_orderpriority = '{priority}' AND o_orderstatus = '{code}')", undated=True))
    sets = [f"(SELECT count(*) FROM (SELECT doctor FROM status WHERE status = 'inactive' AND {inside(back)} EXCEPT SELECT doctor FROM status WHERE status = 'active' AND {inside(back)}))" for back in WINDOWS.values()]
    parts.append("SELECT 'inactive_clinics', " + ", ".join(sets))
    parts.append("SELECT 'doctor_logins', 0, 0, 0, (SELECT count(*) FROM dim WHERE has_password OR doctor IN (SELECT doctor FROM act WHERE event_type = 'view' AND k % 10 = 0))")
    return f"WITH {kpis.ROLLING}, {DIM} " + " UNION ALL ".join(parts)


def _inside(window: str) -> Column:
    back = WINDOWS[window]
    if back is None:
        return F.col("d").isNotNull() | F.col("undated")
    return F.coalesce(F.datediff(F.lit(AS_OF).cast("date"), F.col("d")).between(0, back), F.lit(False))


@query(_clinic_sql())
def clinic_details(spark, sf_dir):
    """Twenty data sets counted over a day, a week, a month and all time: rows, or distinct people where a set names them.

    All sets are tagged and counted together; people are flagged once per set before they are counted.
    """
    sets = clinic_sets(spark, sf_dir)
    named = spark.createDataFrame([(None, None, False, name) for name in sets], "d date, who string, undated boolean, metric string")  # sets without rows are listed, too
    tagged = reduce(lambda x, y: x.unionByName(y), [named, *(df.withColumn("metric", F.lit(name)) for name, df in sets.items())])
    hits = [F.sum(_inside(w).cast("long")).alias(w) for w in WINDOWS]
    per = tagged.groupBy("metric", "who").agg(*hits)
    once = lambda w: F.when(F.col("who").isNull(), F.col(w)).otherwise(F.least(F.col(w), F.lit(1)))
    counted = per.groupBy("metric").agg(*[F.sum(once(w)).alias(w) for w in WINDOWS])
    # Inactive: people who were inactive on some day of a window and active on none.
    history = kpis.rolling_activity(spark, sf_dir).withColumn("undated", F.lit(False))
    flags = [F.max(((F.col("status") == s) & _inside(w)).cast("int")).alias(f"{s}_{w}") for s in ("active", "inactive") for w in WINDOWS]
    inactive = history.groupBy("doctor").agg(*flags).agg(*[F.count(F.when((F.col(f"inactive_{w}") == 1) & (F.col(f"active_{w}") == 0), 1)).alias(w) for w in WINDOWS])
    logged = activity(spark, sf_dir).where("event_type = 'view' and k % 10 = 0").select("doctor").distinct().withColumn("did", F.lit(True))
    doctors = dimension(spark, sf_dir).join(logged, "doctor", "left").where("has_password or did")
    zero = F.lit(0).cast("long")
    logins = doctors.agg(F.count("*").alias("cumulative")).select(*[zero.alias(w) if w != "cumulative" else F.col(w) for w in WINDOWS])
    others = [df.select(F.lit(name).alias("metric"), *WINDOWS) for name, df in (("inactive_clinics", inactive), ("doctor_logins", logins))]
    return reduce(lambda x, y: x.unionByName(y), [counted.select("metric", *WINDOWS), *others])


SHARES = ACT + ", " + DIM + """, sh AS (SELECT event_id, doctor, k, d, value, CASE WHEN k % 2 = 0 THEN 'video' ELSE 'cluster' END AS kind, CASE WHEN k % 10 = 0 THEN NULL ELSE k END AS recipient, 'L' || (k % 4) AS lang, k % 20 AS code FROM act WHERE event_type = 'signup'),
st AS (SELECT coalesce(state, 'Unknown') AS state, coalesce(field_rep_id, 'Unassigned') AS rep, sh.* FROM sh LEFT JOIN dim ON dim.doctor = sh.doctor)"""

#: Data sets of the education reports as SQL: name to (key, source).
EDUCATION = {
    "enrolled_doctors": ("doctor", "dim WHERE doctor % 5 <> 0"),
    "doctors_sharing": ("doctor", "(SELECT DISTINCT doctor FROM sh)"),
    "total_shares": ("event_id", "sh"),
    "unique_recipients": ("recipient", "(SELECT DISTINCT recipient FROM sh WHERE recipient IS NOT NULL)"),
    "shares_played": ("event_id", "sh WHERE value > 50"),
    "shares_viewed_50": ("event_id", "sh WHERE value > 200"),
    "shares_viewed_100": ("event_id", "sh WHERE value > 400"),
    "video_shares": ("event_id", "sh WHERE kind = 'video'"),
    "bundle_shares": ("event_id", "sh WHERE kind = 'cluster'"),
    "banner_clicks": ("n", "(SELECT count(*) AS n FROM act WHERE event_type = 'error')"),
    "state_attention": ("n * rank", "(SELECT n, row_number() OVER (ORDER BY n, state) AS rank FROM (SELECT state, count(*) AS n FROM st GROUP BY state))"),
    "field_rep_attention": ("n * rank", "(SELECT n, row_number() OVER (ORDER BY n, rep) AS rank FROM (SELECT rep, count(*) AS n FROM st GROUP BY rep))"),
    "top_videos_shared": ("n * rank", "(SELECT n, row_number() OVER (ORDER BY n DESC, code) AS rank FROM (SELECT code, count(*) AS n FROM sh WHERE kind = 'video' GROUP BY code))"),
    "top_videos_viewed_50": ("n * rank", "(SELECT n, row_number() OVER (ORDER BY n DESC, code) AS rank FROM (SELECT code, count(*) FILTER (WHERE value > 200) AS n FROM sh WHERE kind = 'video' GROUP BY code))"),
    "top_bundles_shared": ("n * rank", "(SELECT n, row_number() OVER (ORDER BY n DESC, code) AS rank FROM (SELECT code, count(*) AS n FROM sh WHERE kind = 'cluster' GROUP BY code))"),
    "languages": ("n * rank", "(SELECT n, row_number() OVER (ORDER BY n DESC, lang) AS rank FROM (SELECT lang, count(*) AS n FROM sh GROUP BY lang))"),
}


def education_sets(spark, sf_dir) -> dict[str, DataFrame]:
    """The data sets by metric, each with a numeric ``key`` of its rows; ranked ones carry count times rank."""
    a, k = activity(spark, sf_dir), F.col("k")
    sh = a.where("event_type = 'signup'").select(
        "event_id", "doctor", "k", "d", "value", F.when(k % 2 == 0, "video").otherwise("cluster").alias("kind"), F.when(k % 10 != 0, k).alias("recipient"), F.concat(F.lit("L"), (k % 4).cast("string")).alias("lang"), (k % 20).alias("code")
    )
    dim = dimension(spark, sf_dir)
    placed = sh.join(dim.select("doctor", "state", "field_rep_id"), "doctor", "left").withColumns({"state": F.coalesce("state", F.lit("Unknown")), "rep": F.coalesce("field_rep_id", F.lit("Unassigned"))})
    video, cluster, many = sh.where("kind = 'video'"), sh.where("kind = 'cluster'"), F.count("*")

    def ranked(df: DataFrame, by: str, n: Column, worst: bool = False) -> DataFrame:
        """Groups counted first, so the ranking window holds a row a group."""
        order = Window.orderBy(F.asc("n") if worst else F.desc("n"), by)
        return df.groupBy(by).agg(n.alias("n")).select((F.col("n") * F.row_number().over(order)).alias("key"))

    plain = lambda df, key: df.select(F.col(key).alias("key"))
    return {
        "enrolled_doctors": plain(dim.where("doctor % 5 <> 0"), "doctor"),
        "doctors_sharing": plain(sh.select("doctor").distinct(), "doctor"),
        "total_shares": plain(sh, "event_id"),
        "unique_recipients": plain(sh.where("recipient is not null").select("recipient").distinct(), "recipient"),
        "shares_played": plain(sh.where("value > 50"), "event_id"),
        "shares_viewed_50": plain(sh.where("value > 200"), "event_id"),
        "shares_viewed_100": plain(sh.where("value > 400"), "event_id"),
        "video_shares": plain(video, "event_id"),
        "bundle_shares": plain(cluster, "event_id"),
        "banner_clicks": a.where("event_type = 'error'").agg(many.alias("key")),
        "state_attention": ranked(placed, "state", many, worst=True),
        "field_rep_attention": ranked(placed, "rep", many, worst=True),
        "top_videos_shared": ranked(video, "code", many),
        "top_videos_viewed_50": ranked(video, "code", F.count(F.when(F.col("value") > 200, 1))),
        "top_bundles_shared": ranked(cluster, "code", many),
        "languages": ranked(sh, "lang", many),
    }


@query(f"WITH {SHARES} " + " UNION ALL ".join(f"SELECT '{name}' AS dataset, count(*) AS n, CAST(sum({key}) AS BIGINT) AS keys FROM {source}" for name, (key, source) in EDUCATION.items()))
def education_details(spark, sf_dir):
    """Sixteen data sets, each told by its number of rows and the sum of their keys."""
    sets = education_sets(spark, sf_dir)
    named = spark.createDataFrame([(name, None) for name in sets], "dataset string, key long")  # sets without rows are listed, too
    tagged = [named, *(df.select(F.lit(name).alias("dataset"), F.col("key").cast("long").alias("key")) for name, df in sets.items())]
    return reduce(lambda x, y: x.unionByName(y), tagged).groupBy("dataset").agg(F.count("key").alias("n"), F.sum("key").alias("keys"))
