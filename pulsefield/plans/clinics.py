"""The clinic programme's dashboard and status report: every measure over its week, the week before and all time.

The facts are views of the given tables. Clicks are patient screenings, purchases schedule a follow-up, errors are reminders,
signups are webinar registrations (even k) or field-rep logins (odd k), views are clinic actions by k. Orders are course rows and, the latest
of a doctor, certifications.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.operators import metrics as M
from pulsefield.operators.rows import latest_by
from pulsefield.plans import kpis
from pulsefield.plans.base import ACT, activity, query
from pulsefield.session import table

AS_OF = kpis.LAST
#: Windows by name: days back from the as-of date of their first and last day, None for all time.
WINDOWS = {"weekly": (6, 0), "cumulative": None, "previous": (13, 7)}

DIM = """dim AS (
  SELECT c_custkey AS doctor, 'C' || (c_custkey % 3) AS campaign_key, 'Campaign ' || (c_custkey % 3) AS campaign_label, c_name AS doctor_display_name,
    'City ' || (c_custkey % 100) AS city, c_mktsegment AS district, n_name AS state, 'R' || (c_custkey % 7) AS field_rep_id, 'Rep ' || (c_custkey % 7) AS field_rep_name,
    c_custkey % 4 <> 0 AS onboarding_flag, c_custkey % 5 = 0 AS has_password, c_custkey % 9 = 0 AS has_instructions, c_custkey % 6 = 0 OR c_custkey % 11 = 0 AS has_staff,
    CAST(DATE '2023-12-01' + CAST(c_custkey % 60 AS INTEGER) AS DATE) AS registered_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), seen AS (SELECT doctor, min(d) AS first_seen_at, max(d) AS latest_seen_at FROM act GROUP BY doctor
), scr AS (SELECT *, CASE k % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END AS flag, CASE WHEN k % 4 = 0 THEN 'record:' || event_id ELSE 'P' || k END AS patient FROM act WHERE event_type = 'click'
), cert AS (SELECT o_custkey AS doctor, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS certification_status, arg_max(CAST(o_orderdate AS DATE), (o_orderdate, o_orderkey)) AS certification_date,
    arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS certification_source, bool_or(o_orderstatus = 'F') AS support FROM orders GROUP BY 1
)"""


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doctors with what the roster says of them."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    name = lambda lead, by: F.concat(F.lit(lead), (key % by).cast("string"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        key.alias("doctor"),
        name("C", 3).alias("campaign_key"),
        name("Campaign ", 3).alias("campaign_label"),
        F.col("c_name").alias("doctor_display_name"),
        name("City ", 100).alias("city"),
        F.col("c_mktsegment").alias("district"),
        F.col("n_name").alias("state"),
        name("R", 7).alias("field_rep_id"),
        name("Rep ", 7).alias("field_rep_name"),
        (key % 4 != 0).alias("onboarding_flag"),
        (key % 5 == 0).alias("has_password"),
        (key % 9 == 0).alias("has_instructions"),
        ((key % 6 == 0) | (key % 11 == 0)).alias("has_staff"),
        F.date_add(F.lit("2023-12-01").cast("date"), (key % 60).cast("int")).alias("registered_at"),
    )


def screenings(a: DataFrame) -> DataFrame:
    k = F.col("k")
    flag = F.when(k % 3 == 0, "red").when(k % 3 == 1, "yellow").otherwise("green")
    patient = F.when(k % 4 == 0, F.concat(F.lit("record:"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("P"), k.cast("string")))
    return a.where("event_type = 'click'").withColumn("flag", flag).withColumn("patient", patient)


def certifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per doctor the latest course order, and whether any supports certification."""
    o = table(spark, sf_dir, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.col("o_custkey").alias("doctor")).agg(
        F.max_by("o_orderstatus", order).alias("certification_status"),
        F.max_by(F.to_date("o_orderdate"), order).alias("certification_date"),
        F.max_by("o_orderpriority", order).alias("certification_source"),
        F.bool_or(F.col("o_orderstatus") == "F").alias("support"),
    )


def _inside(d: str, window: str) -> Column:
    span = WINDOWS[window]
    if span is None:
        return F.col(d).isNotNull()
    back = F.datediff(F.lit(AS_OF).cast("date"), F.col(d))
    return back.between(span[1], span[0])


def _counts(name: str, d: str, where: Column | None = None) -> list[Column]:
    """Rows in each window."""
    hit = lambda w: _inside(d, w) if where is None else _inside(d, w) & where
    return [F.count(F.when(hit(w), 1)).alias(f"{name}_{w}") for w in WINDOWS]


def _people(rows: DataFrame, who: str, name: str, d: str) -> DataFrame:
    """Distinct people in each window, by flags per person instead of several distinct counts."""
    flags = rows.where(F.col(who).isNotNull()).groupBy(who).agg(*[F.max(_inside(d, w).cast("int")).alias(w) for w in WINDOWS])
    return flags.agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(f"{name}_{w}") for w in WINDOWS])


def _inside_sql(d: str, window: str) -> str:
    span = WINDOWS[window]
    return f"{d} IS NOT NULL" if span is None else f"{d} BETWEEN DATE '{AS_OF}' - {span[0]} AND DATE '{AS_OF}' - {span[1]}"


def _rows_sql(name: str, source: str, d: str = "d", what: str = "count(*)") -> list[str]:
    return [f"(SELECT {what} FROM {source} AND {_inside_sql(d, w)}) AS {name}_{w}" for w in WINDOWS]


def _dashboard_sql() -> str:
    active, inactive = ("SELECT doctor FROM status WHERE status = '{}' AND d {}".format(s, "{when}") for s in ("active", "inactive"))
    when = {"current": f"= DATE '{AS_OF}'", "cumulative": "IS NOT NULL", "previous": f"= DATE '{AS_OF}' - 1"}
    parts = [f"DATE '{AS_OF}' AS as_of_date", f"CAST(DATE '{AS_OF}' - 6 AS DATE) AS weekly_window_start", f"DATE '{AS_OF}' AS weekly_window_end", f"CAST(DATE '{AS_OF}' - 14 AS DATE) AS activity_window_start", f"DATE '{AS_OF}' AS activity_window_end"]
    parts += _rows_sql("webinar_registrations", "act WHERE event_type = 'signup' AND k % 2 = 0")
    parts += _rows_sql("field_rep_logins", "act WHERE event_type = 'signup' AND k % 2 = 1", what="count(DISTINCT CASE WHEN k % 9 = 0 THEN 'R' || (doctor % 7) ELSE 'S' || (k % 9) END)")
    for w in WINDOWS:
        dated = "TRUE" if WINDOWS[w] is None else _inside_sql("first_seen_at", w)
        parts.append(f"(SELECT count(*) FROM dim LEFT JOIN seen ON seen.doctor = dim.doctor WHERE onboarding_flag AND {dated}) AS onboarded_doctors_{w}")
    for w, at in when.items():
        on = active.format(when=at)
        parts.append(f"(SELECT count(DISTINCT doctor) FROM ({on})) AS active_clinics_{w}")
        parts.append(f"(SELECT count(*) FROM ({inactive.format(when=at)} EXCEPT {on})) AS inactive_clinics_{w}")
        parts.append(f"(SELECT count(*) FROM ({on} INTERSECT SELECT doctor FROM cert WHERE support)) AS certified_clinics_{w}")
    parts.append("TRUE AS certified_clinics_supported")
    parts += _rows_sql("total_screenings", "scr WHERE TRUE") + _rows_sql("red_tags", "scr WHERE flag = 'red'") + _rows_sql("yellow_tags", "scr WHERE flag = 'yellow'")
    parts += _rows_sql("followups_scheduled", "(SELECT CAST(d + k % 14 AS DATE) AS d FROM act WHERE event_type = 'purchase') WHERE TRUE") + _rows_sql("reminders_sent", "act WHERE event_type = 'error'")
    for audience, priority in (("doctor", "1-URGENT"), ("paramedic", "2-HIGH")):
        for name, code in (("started", "P"), ("completed", "F"), ("pending", "O")):
            parts.append(f"(SELECT count(*) FROM orders WHERE o_orderpriority = '{priority}' AND o_orderstatus = '{code}') AS {audience}_course_{name}")
        parts.append(f"(SELECT count(*) FROM orders WHERE o_orderpriority = '{priority}' AND o_orderstatus IN ('P', 'F', 'O')) AS {audience}_course_total")
    return f"WITH {kpis.ROLLING}, {DIM} SELECT " + ", ".join(parts)


@query(_dashboard_sql())
def dashboard_kpis(spark, sf_dir):
    """One row with every measure; each fact is read once and aggregated once."""
    a, history = activity(spark, sf_dir), kpis.rolling_activity(spark, sf_dir)
    day = F.lit(AS_OF).cast("date")
    fixed = a.agg(F.min(day).alias("as_of_date"), F.min(F.date_sub(day, 6)).alias("weekly_window_start"), F.min(day).alias("weekly_window_end"), F.min(F.date_sub(day, 14)).alias("activity_window_start"), F.min(day).alias("activity_window_end"))
    e, k = F.col("event_type"), F.col("k")
    events = a.withColumn("due", F.date_add("d", (k % 14).cast("int"))).agg(
        *_counts("webinar_registrations", "d", (e == "signup") & (k % 2 == 0)),
        *_counts("total_screenings", "d", e == "click"),
        *_counts("red_tags", "d", (e == "click") & (k % 3 == 0)),
        *_counts("yellow_tags", "d", (e == "click") & (k % 3 == 1)),
        *_counts("followups_scheduled", "due", e == "purchase"),
        *_counts("reminders_sent", "d", e == "error"),
    )
    rep = F.when(k % 9 == 0, F.concat(F.lit("R"), (F.col("doctor") % 7).cast("string"))).otherwise(F.concat(F.lit("S"), (k % 9).cast("string")))
    logins = _people(a.where((e == "signup") & (k % 2 == 1)).select(rep.alias("rep"), "d"), "rep", "field_rep_logins", "d")
    first = a.groupBy("doctor").agg(F.min("d").alias("first_seen_at"))
    roster = dimension(spark, sf_dir).where("onboarding_flag").select("doctor").join(first, "doctor", "left")
    onboarded = roster.agg(*[F.count(F.when(F.lit(True) if WINDOWS[w] is None else _inside("first_seen_at", w), 1)).alias(f"onboarded_doctors_{w}") for w in WINDOWS])
    when = {"current": F.col("d") == day, "cumulative": F.lit(True), "previous": F.col("d") == F.date_sub(day, 1)}
    ever = [F.max(((F.col("status") == s) & at).cast("int")).alias(f"{s}_{w}") for s in ("active", "inactive") for w, at in when.items()]
    people = history.groupBy("doctor").agg(*ever).join(certifications(spark, sf_dir).select("doctor", "support"), "doctor", "left")
    clinics = []
    for w in when:
        on = F.col(f"active_{w}") == 1
        for name, cond in (("active", on), ("inactive", (F.col(f"inactive_{w}") == 1) & ~on), ("certified", on & F.col("support"))):
            clinics.append(F.count(F.when(cond, 1)).alias(f"{name}_clinics_{w}"))
    status = people.agg(*clinics, F.max(F.lit(True)).alias("certified_clinics_supported"))
    o = table(spark, sf_dir, "orders")
    codes, courses = {"started": "P", "completed": "F", "pending": "O"}, []
    for audience, priority in (("doctor", "1-URGENT"), ("paramedic", "2-HIGH")):
        mine = F.col("o_orderpriority") == priority
        courses += [F.count(F.when(mine & (F.col("o_orderstatus") == code), 1)).alias(f"{audience}_course_{name}") for name, code in codes.items()]
        courses.append(F.count(F.when(mine & F.col("o_orderstatus").isin(*codes.values()), 1)).alias(f"{audience}_course_total"))
    return M.one_row([fixed, events, logins, onboarded, status, o.agg(*courses)])


@query(f"""WITH {kpis.ROLLING}, {DIM}, m AS (
  SELECT doctor, bool_or(k % 10 = 0) AS doctor_login, bool_or(k % 10 = 1) AS staff_login, bool_or(k % 10 = 2) AS instruction, bool_or(k % 10 = 3) AS added, count(*) FILTER (WHERE k % 10 = 4) AS shared
  FROM act WHERE event_type = 'view' GROUP BY doctor
), f AS (
  SELECT doctor, count(*) AS forms, count(DISTINCT CASE WHEN flag = 'red' THEN patient END) AS red, count(DISTINCT CASE WHEN flag = 'yellow' THEN patient END) AS yellow FROM scr WHERE k % 5 <> 4 GROUP BY doctor
)
SELECT dim.doctor AS doctor_key, campaign_key, campaign_label, doctor_display_name, city, district, state, field_rep_id, field_rep_name,
  coalesce(rolling, 0) AS screenings_last_15d, coalesce(status = 'active', FALSE) AS active_flag, coalesce(status = 'inactive', FALSE) AS inactive_flag, last_active AS last_screening_at, onboarding_flag,
  coalesce(doctor_login, FALSE) OR has_password AS doctor_has_logged_in, coalesce(instruction, FALSE) OR has_instructions AS doctor_has_updated_special_instructions,
  coalesce(added, FALSE) OR has_staff AS doctor_has_added_clinic_staff, coalesce(staff_login, FALSE) AS clinic_staff_has_logged_in, coalesce(shared, 0) AS clinic_staff_forms_shared_count,
  coalesce(forms, 0) AS forms_filled_count, coalesce(red, 0) AS red_tagged_patients_count, coalesce(yellow, 0) AS yellow_tagged_patients_count, registered_at, first_seen_at, latest_seen_at,
  certification_status, certification_date, certification_source
FROM dim LEFT JOIN (SELECT * FROM status WHERE d = DATE '{AS_OF}') s ON s.doctor = dim.doctor LEFT JOIN m ON m.doctor = dim.doctor LEFT JOIN f ON f.doctor = dim.doctor
  LEFT JOIN seen ON seen.doctor = dim.doctor LEFT JOIN cert ON cert.doctor = dim.doctor""")
def doctor_status_report(spark, sf_dir):
    """The roster with each doctor's status, clinic actions, forms, tagged patients and certification as of one day."""
    a, k = activity(spark, sf_dir), F.col("k")
    now = kpis.rolling_activity(spark, sf_dir, AS_OF).drop("d")
    view, form = F.col("event_type") == "view", (F.col("event_type") == "click") & (k % 5 != 4)
    acted = lambda n: F.coalesce(F.bool_or(view & (k % 10 == n)), F.lit(False))
    # Clinic actions, dates and forms come from one aggregation of the events; tagged patients from one more, as they are distinct.
    did = a.groupBy("doctor").agg(
        acted(0).alias("doctor_login"), acted(1).alias("staff_login"), acted(2).alias("instruction"), acted(3).alias("added"), F.count(F.when(view & (k % 10 == 4), 1)).alias("shared"),
        F.count(F.when(form, 1)).alias("forms"), F.min("d").alias("first_seen_at"), F.max("d").alias("latest_seen_at"),
    )
    tagged = screenings(a.where(form)).groupBy("doctor", "patient").agg(F.max((F.col("flag") == "red").cast("int")).alias("r"), F.max((F.col("flag") == "yellow").cast("int")).alias("y"))
    tagged = tagged.groupBy("doctor").agg(F.sum("r").alias("red"), F.sum("y").alias("yellow"))
    rows = dimension(spark, sf_dir)
    for more in (now, did, tagged, certifications(spark, sf_dir)):
        rows = rows.join(more, "doctor", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return rows.select(
        F.col("doctor").alias("doctor_key"), "campaign_key", "campaign_label", "doctor_display_name", "city", "district", "state", "field_rep_id", "field_rep_name",
        zero("rolling", "screenings_last_15d"),
        no(F.col("status") == "active").alias("active_flag"),
        no(F.col("status") == "inactive").alias("inactive_flag"),
        F.col("last_active").alias("last_screening_at"),
        "onboarding_flag",
        (no(F.col("doctor_login")) | F.col("has_password")).alias("doctor_has_logged_in"),
        (no(F.col("instruction")) | F.col("has_instructions")).alias("doctor_has_updated_special_instructions"),
        (no(F.col("added")) | F.col("has_staff")).alias("doctor_has_added_clinic_staff"),
        no(F.col("staff_login")).alias("clinic_staff_has_logged_in"),
        zero("shared", "clinic_staff_forms_shared_count"),
        zero("forms", "forms_filled_count"),
        zero("red", "red_tagged_patients_count"),
        zero("yellow", "yellow_tagged_patients_count"),
        "registered_at", "first_seen_at", "latest_seen_at", "certification_status", "certification_date", "certification_source",
    )


@query(f"""WITH {ACT} SELECT doctor, event_id AS latest_login_event, d AS latest_login FROM (SELECT *, row_number() OVER (PARTITION BY doctor ORDER BY ts DESC, event_id DESC) AS n FROM act WHERE event_type = 'view' AND k % 10 = 0 AND d <= DATE '{AS_OF}') WHERE n = 1""")
def latest_doctor_login(spark, sf_dir):
    a = activity(spark, sf_dir).where((F.col("event_type") == "view") & (F.col("k") % 10 == 0) & (F.col("d") <= F.lit(AS_OF).cast("date")))
    return latest_by(a, ["doctor"], [F.desc("ts"), F.desc("event_id")]).select("doctor", F.col("event_id").alias("latest_login_event"), F.col("d").alias("latest_login"))
