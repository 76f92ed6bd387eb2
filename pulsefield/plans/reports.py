"""Report queries: filters, drill-downs, deltas, set operations, audits and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefield.functions.text import as_float, capped_percent, engagement_health, health_band, percent, saturday, trimmed
from pulsefield.operators import metrics as M
from pulsefield.operators import policy as P
from pulsefield.operators.metrics import Window
from pulsefield.operators.rows import latest_by
from pulsefield.plans import kpis
from pulsefield.plans.base import ACT, DOC, SEEN, WEEKS, activity, band_sql, doctors, health_sql, query
from pulsefield.session import TABLES, table



def as_of():
    """Reports are made for a fixed day, never for the clock's."""
    return F.lit("2024-01-20").cast("date")



@query(f"WITH {ACT} SELECT event_id, event_type = 'signup' AS reached, event_type = 'view' AS opened, event_type = 'click' OR value >= 50 AS video_gt_50, CASE WHEN event_type IN ('purchase', 'click') THEN d END AS consumed_d FROM act WHERE event_type <> 'error'")
def event_facts(spark, sf_dir):
    e = F.col("event_type")
    return activity(spark, sf_dir).where(e != "error").select("event_id", (e == "signup").alias("reached"), (e == "view").alias("opened"), ((e == "click") | (F.col("value") >= 50)).alias("video_gt_50"), F.when(e.isin("purchase", "click"), F.col("d")).alias("consumed_d"))


@query(f"""WITH {SEEN}, {DOC} SELECT s.campaign, s.collateral, s.doctor, CAST(reached IS NOT NULL AS INTEGER) AS reached, CAST(opened IS NOT NULL AS INTEGER) AS opened, CAST(video IS NOT NULL OR pdf IS NOT NULL AS INTEGER) AS consumed, last_d, coalesce(state, 'Unmapped') AS state FROM seen s LEFT JOIN doc ON doc.doctor = s.doctor AND doc.doctor % 4 <> 0""")
def doctor_collateral_latest(spark, sf_dir):
    seen = M.first_seen(activity(spark, sf_dir), ["campaign", "collateral", "doctor"])
    d = doctors(spark, sf_dir).where("doctor % 4 <> 0").select("doctor", "state")
    flag = lambda *c: F.coalesce(*c).isNotNull().cast("int")
    return seen.join(d, "doctor", "left").select("campaign", "collateral", "doctor", flag("reached").alias("reached"), flag("opened").alias("opened"), flag("video", "pdf").alias("consumed"), "last_d", F.coalesce("state", F.lit("Unmapped")).alias("state"))


@query(f"WITH {ACT} SELECT greatest((SELECT max(d) FROM act WHERE d <= DATE '2024-01-20'), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate <= TIMESTAMP '2024-01-20')) AS as_of")
def latest_business_date(spark, sf_dir):
    parts = activity(spark, sf_dir).select("d").unionByName(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")))
    return parts.agg(F.max(F.when(F.col("d") <= as_of(), F.col("d"))).alias("as_of"))


@query(f"""WITH {ACT} SELECT event_type, count(*) FILTER (WHERE d BETWEEN DATE '2024-01-14' AND DATE '2024-01-20') AS week, count(*) FILTER (WHERE d BETWEEN DATE '2024-01-07' AND DATE '2024-01-13') AS previous, count(*) FILTER (WHERE d BETWEEN DATE '2024-01-14' AND DATE '2024-01-20') - count(*) FILTER (WHERE d BETWEEN DATE '2024-01-07' AND DATE '2024-01-13') AS delta,
  count(DISTINCT doctor) FILTER (WHERE d <= DATE '2024-01-20') AS doctors FROM act GROUP BY event_type""")
def kpi_deltas(spark, sf_dir):
    back = F.datediff(as_of(), "d")
    week, previous = F.count(F.when(back.between(0, 6), 1)), F.count(F.when(back.between(7, 13), 1))
    return activity(spark, sf_dir).groupBy("event_type").agg(week.alias("week"), previous.alias("previous"), (week - previous).alias("delta"), F.count_distinct(F.when(back >= 0, F.col("doctor"))).alias("doctors"))


@query(f"""WITH {ACT}, {DOC} SELECT CAST(d + CAST(6 - dayofweek(d) AS INTEGER) AS DATE) AS week_end, count(*) AS shares, count(DISTINCT act.doctor) AS doctors FROM act JOIN doc ON doc.doctor = act.doctor WHERE event_type = 'view' AND state IN ('NATION_1', 'NATION_2', 'NATION_3') AND campaign = 'C1' AND d <= DATE '2024-01-20' GROUP BY 1""")
def filtered_weeks(spark, sf_dir):
    a = activity(spark, sf_dir).where((F.col("event_type") == "view") & (F.col("campaign") == "C1") & (F.col("d") <= as_of()))
    return a.join(doctors(spark, sf_dir).where(F.col("state").isin("NATION_1", "NATION_2", "NATION_3")).select("doctor"), "doctor").groupBy(saturday(F.col("d")).alias("week_end")).agg(F.count("*").alias("shares"), F.count_distinct("doctor").alias("doctors"))


@query(f"""WITH {ACT}, w AS (SELECT campaign, CAST(d + CAST(6 - dayofweek(d) AS INTEGER) AS DATE) AS week_end, count(*) AS n FROM act GROUP BY ALL) SELECT campaign, week_end, n, CAST(sum(n) OVER (PARTITION BY campaign ORDER BY week_end) AS BIGINT) AS running FROM w""")
def cumulative_weeks(spark, sf_dir):
    w = activity(spark, sf_dir).groupBy("campaign", saturday(F.col("d")).alias("week_end")).agg(F.count("*").alias("n"))
    return w.withColumn("running", F.sum("n").over(Window.partitionBy("campaign").orderBy("week_end")))


@query(f"""WITH {WEEKS}, h AS (SELECT campaign, collateral, week, round({health_sql('reached', 'opened', 'consumed', '(doctors / 4.0::DOUBLE)')}, 6) AS health, opened * 1.0::DOUBLE / nullif(reached, 0) AS o, consumed * 1.0::DOUBLE / nullif(opened, 0) AS c FROM kpi)
  SELECT campaign, collateral, arg_max(week, (health, -week)) AS best_week, max(health) AS best_health, CASE WHEN avg(o) <= avg(c) THEN 'opened' ELSE 'consumed' END AS weakest FROM h GROUP BY ALL""")
def best_week(spark, sf_dir):
    k = kpis.weekly_kpi(spark, sf_dir)
    ratio = lambda a, b: F.avg(F.when(F.col(b) != 0, F.col(a) / F.col(b)))
    return k.groupBy("campaign", "collateral").agg(F.max_by("week", F.struct("health", -F.col("week"))).alias("best_week"), F.max("health").alias("best_health"), F.when(ratio("opened", "reached") <= ratio("consumed", "opened"), "opened").otherwise("consumed").alias("weakest"))


@query(f"""WITH {ACT}, {DOC} SELECT campaign, count(DISTINCT act.doctor) AS doctors, count(DISTINCT act.doctor) FILTER (WHERE event_type = 'view') AS opened, count(DISTINCT act.doctor) FILTER (WHERE try_cast(value AS DOUBLE) >= 20) AS completed, count(DISTINCT rep) AS reps, count(DISTINCT state) AS states, count(DISTINCT date_trunc('week', ts)) AS weeks FROM act LEFT JOIN doc ON doc.doctor = act.doctor GROUP BY campaign""")
def summary_counts(spark, sf_dir):
    a = activity(spark, sf_dir).join(doctors(spark, sf_dir).select("doctor", "rep", "state"), "doctor", "left")
    when = lambda c: F.when(c, F.col("doctor"))
    return a.groupBy("campaign").agg(F.count_distinct("doctor").alias("doctors"), F.count_distinct(when(F.col("event_type") == "view")).alias("opened"), F.count_distinct(when(as_float(F.col("value")) >= 20)).alias("completed"), F.count_distinct("rep").alias("reps"), F.count_distinct("state").alias("states"), F.count_distinct(F.date_trunc("week", "ts")).alias("weeks"))


@query(kpis.LAST10 + " SELECT p_brand, round(score, 6) AS score, score >= (SELECT avg(score) FROM t) AS above FROM t ORDER BY t.score DESC, p_brand LIMIT 1")
def benchmark_best(spark, sf_dir):
    t = kpis._last10(spark, sf_dir)
    return t.agg(F.max_by("p_brand", F.struct("score", -F.col("seq"))).alias("p_brand"), F.round(F.max("score"), 6).alias("score"), (F.max("score") >= F.avg("score")).alias("above"))


@query(f"WITH {kpis.ROLLING} SELECT count(DISTINCT s.doctor) AS certified FROM status s WHERE status = 'active' AND d BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' AND doctor IN (SELECT doctor FROM act WHERE event_type = 'purchase' AND d <= DATE '2024-01-20')")
def certified_window(spark, sf_dir):
    done = activity(spark, sf_dir).where((F.col("event_type") == "purchase") & (F.col("d") <= as_of())).select("doctor").distinct()
    active = kpis.rolling_activity(spark, sf_dir).where("status = 'active' and d between date '2024-01-14' and date '2024-01-20'")
    return active.join(done, "doctor", "left_semi").agg(F.count_distinct("doctor").alias("certified"))


@query("SELECT o_orderkey, page_row FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS page_row FROM orders) WHERE page_row BETWEEN 51 AND 100")
def paged_rows(spark, sf_dir):
    top = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)  # the pages up to this one
    return top.withColumn("page_row", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")).where("page_row > 50").drop("o_totalprice")


@query(f"""WITH {SEEN}, {DOC}, s AS (SELECT state, CASE WHEN count(x.doctor) > 0 THEN count(x.reached) * 100.0::DOUBLE / count(*) END AS health FROM doc LEFT JOIN seen x ON x.doctor = doc.doctor GROUP BY state) SELECT state, round(health, 6) AS health, row_number() OVER (ORDER BY health ASC NULLS LAST, state) AS rank FROM s""")
def attention_rank(spark, sf_dir):
    seen = M.first_seen(activity(spark, sf_dir), ["campaign", "collateral", "doctor"])
    s = doctors(spark, sf_dir).join(seen, "doctor", "left").groupBy("state").agg(F.count("campaign").alias("n"), F.count("reached").alias("r"), F.count("*").alias("rows"))
    s = s.withColumn("health", F.when(F.col("n") > 0, percent(F.col("r"), F.col("rows"))))
    order = [F.asc_nulls_last("health"), F.col("state")]
    return s.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("state", F.round("health", 6).alias("health"), "rank")


@query(f"""WITH {ACT}, a AS (SELECT DISTINCT doctor FROM act WHERE event_type = 'click' AND k < 30), b AS (SELECT DISTINCT doctor FROM act WHERE event_type = 'view' AND k > 60) SELECT 'both' AS part, doctor FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first_only', doctor FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark, sf_dir):
    e = activity(spark, sf_dir)
    a, b = e.where("event_type = 'click' and k < 30").select("doctor"), e.where("event_type = 'view' and k > 60").select("doctor")
    return a.intersect(b).select(F.lit("both").alias("part"), "doctor").unionByName(a.subtract(b).select(F.lit("first_only").alias("part"), "doctor"))


@query(f"WITH {WEEKS}, m AS (SELECT strftime(week_start, '%Y-%m') AS month, sum(opened) AS n FROM kpi GROUP BY 1) SELECT coalesce((SELECT max(month) FROM m WHERE n > 0), (SELECT max(month) FROM m)) AS month")
def default_month(spark, sf_dir):
    m = kpis.weekly_kpi(spark, sf_dir).groupBy(F.date_format("week_start", "yyyy-MM").alias("month")).agg(F.sum("opened").alias("n"))
    return m.agg(F.coalesce(F.max(F.when(F.col("n") > 0, F.col("month"))), F.max("month")).alias("month"))


@query(f"""WITH {ACT}, {DOC} SELECT rep, act.doctor, count(*) AS n, max(d) AS last_d FROM act JOIN doc ON doc.doctor = act.doctor WHERE event_type = 'purchase' GROUP BY ALL""")
def drill_down(spark, sf_dir):
    per = activity(spark, sf_dir).where("event_type = 'purchase'").groupBy("doctor").agg(F.count("*").alias("n"), F.max("d").alias("last_d"))
    return doctors(spark, sf_dir).select("doctor", "rep").join(per, "doctor").select("rep", "doctor", "n", "last_d")


@query(f"WITH {ACT}, {DOC} SELECT act.doctor, count(*) AS events FROM act LEFT JOIN doc ON doc.doctor = act.doctor AND doc.doctor % 3 <> 0 WHERE doc.doctor IS NULL AND act.doctor NOT IN (SELECT doctor FROM act WHERE k = 7) GROUP BY act.doctor")
def manual_mapping_export(spark, sf_dir):
    a = activity(spark, sf_dir)
    return a.join(doctors(spark, sf_dir).where("doctor % 3 <> 0").select("doctor"), "doctor", "left_anti").join(a.where("k = 7").select("doctor").distinct(), "doctor", "left_anti").groupBy("doctor").agg(F.count("*").alias("events"))


AUDITED = TABLES


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(*) = 0 AS is_empty FROM {t}" for t in AUDITED))
def table_audit(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", (F.col("n") == 0).alias("is_empty")) for t in AUDITED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT 'orders' AS name, count(*) AS n, max(o_orderkey) AS marker, CAST(max(o_orderdate) AS DATE) AS latest FROM orders UNION ALL SELECT 'events', count(*), max(event_id), CAST(max(ts) AS DATE) FROM events")
def snapshot_markers(spark, sf_dir):
    of = lambda t, key, at: table(spark, sf_dir, t).agg(F.count("*").alias("n"), F.max(key).alias("marker"), F.to_date(F.max(at)).alias("latest")).select(F.lit(t).alias("name"), "n", "marker", "latest")
    return of("orders", "o_orderkey", "o_orderdate").unionByName(of("events", "event_id", "ts"))


@query("""SELECT o_custkey AS run, CASE WHEN bool_and(o_orderstatus <> 'P') THEN 'SUCCESS' WHEN bool_or(o_orderstatus <> 'P') THEN 'PARTIAL_SUCCESS' ELSE 'FAIL' END AS status, count(*) AS steps FROM orders GROUP BY 1""")
def run_status(spark, sf_dir):
    fine = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.when(F.bool_and(fine), "SUCCESS").when(F.bool_or(fine), "PARTIAL_SUCCESS").otherwise("FAIL").alias("status"), F.count("*").alias("steps"))


@query(f"""WITH {ACT}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, doctor, d ORDER BY event_id) AS n FROM act) WHERE n = 1),
  b AS (SELECT event_type, count(*) AS before_rows, count(DISTINCT (doctor, d)) AS before_unique FROM act GROUP BY 1), a AS (SELECT event_type, count(*) AS after_rows, count(DISTINCT (doctor, d)) AS u FROM kept GROUP BY 1)
  SELECT b.event_type, before_rows, before_unique, after_rows, u = before_unique AS unique_unchanged FROM b JOIN a ON a.event_type = b.event_type""")
def dedupe_validation(spark, sf_dir):
    a = activity(spark, sf_dir).select("event_type", "doctor", "d", "event_id")
    before = a.groupBy("event_type").agg(F.count("*").alias("before_rows"), F.count_distinct("doctor", "d").alias("before_unique"))
    after = latest_by(a, ["event_type", "doctor", "d"], [F.col("event_id")]).groupBy("event_type").agg(F.count("*").alias("after_rows"), F.count_distinct("doctor", "d").alias("u"))
    return before.join(after, "event_type").select("event_type", "before_rows", "before_unique", "after_rows", (F.col("u") == F.col("before_unique")).alias("unique_unchanged"))


@query(f"WITH {ACT} SELECT md5(doctor || '|' || event_type) AS source_hash, string_agg(DISTINCT campaign || ':' || collateral, ',' ORDER BY campaign || ':' || collateral) AS refs FROM act GROUP BY 1")
def target_refs(spark, sf_dir):
    ref = F.concat_ws(":", "campaign", F.col("collateral").cast("string"))
    return activity(spark, sf_dir).groupBy(F.md5(F.concat_ws("|", F.col("doctor").cast("string"), "event_type")).alias("source_hash")).agg(F.array_join(F.sort_array(F.collect_set(ref)), ",").alias("refs"))


@query(f"WITH {ACT}, {DOC} SELECT event_id FROM act LEFT JOIN doc ON doc.doctor = act.doctor WHERE campaign <> 'C2' AND coalesce(rep, '') NOT IN ('R0', 'R4') AND collateral <> 3")
def visibility_cascade(spark, sf_dir):
    a, d = activity(spark, sf_dir), doctors(spark, sf_dir)
    hidden = {"campaign": a.where("campaign = 'C2'"), "collateral": a.where("collateral = 3"), "doctor": d.where("rep in ('R0', 'R4')")}
    for key, ids in hidden.items():
        a = P.visible(a, ids, key, "hide")
    return a.select("event_id")


@query(f"WITH {DOC}, s AS (SELECT doctor, unnest(string_split_regex('R' || doctor % 5 || ', ' || rep || '/R9', '[,/\\s]+')) AS affected FROM doc) SELECT DISTINCT doctor, affected FROM s WHERE affected <> ''")
def correction_ids(spark, sf_dir):
    text = F.concat(F.lit("R"), (F.col("doctor") % 5).cast("string"), F.lit(", "), F.col("rep"), F.lit("/R9"))
    return doctors(spark, sf_dir).select("doctor", F.explode(P.split_ids(text)).alias("affected")).distinct()


#: The typed tables that activity events are routed to, and the slugs of events without one of them that are logins or forms.
TARGETS = ("redflags_patientsubmission", "gnd_gndpatientsubmission", "redflags_submissionredflag", "gnd_gndsubmissionredflag", "redflags_followupreminder", "redflags_metricevent")
LOGIN_SLUGS = ("fieldreplogin", "fieldreploggedin")
FORM_SLUGS = (
    "rfapatientsubmission", "gndpatientsubmission", "patientsubmission", "patientsubmitted", "screeningsubmission", "screeningsubmitted", "patientscreening", "formsubmission",
    "formsubmitted", "patientformsubmission", "patientformsubmitted", "formfilled", "formfill", "redflagspatientsubmission", "gndgndpatientsubmission",
)
#: What the events call themselves here, by k: a table's name, or a spelling of a slug.
KINDS = ("redflags_patientsubmission", "gnd_gndpatientsubmission", "redflags_submissionredflag", "gnd_gndsubmissionredflag", "redflags_followupreminder", "redflags_metricevent", "Field-Rep Login", "form_submitted", "GND patient-submission", "page_view")


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"""WITH {ACT}, n AS (SELECT event_id, doctor, k, [{_quoted(KINDS)}][k % 10 + 1] AS kind, CASE k % 7 WHEN 3 THEN 'draft' ELSE 'submitted' END AS form_status FROM act),
t AS (SELECT *, regexp_replace(lower(kind), '[^a-z0-9]', '', 'g') AS slug FROM n), r AS (SELECT *, CASE WHEN kind IN ({_quoted(TARGETS)}) THEN kind WHEN slug IN ({_quoted(LOGIN_SLUGS)}) THEN 'redflags_metricevent'
  WHEN slug IN ({_quoted(FORM_SLUGS)}) THEN CASE WHEN slug LIKE '%gnd%' THEN 'gnd_gndpatientsubmission' ELSE 'redflags_patientsubmission' END END AS target FROM t)
SELECT event_id, target, doctor, CASE WHEN target LIKE '%patientsubmission' THEN form_status END AS form_status FROM r WHERE target IS NOT NULL AND (target NOT LIKE '%patientsubmission' OR form_status = 'submitted')""")
def activity_router(spark, sf_dir):
    """Events as rows of six typed tables: by the table they name, else by the slug of their type. Forms count only once submitted."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("k") % 10).cast("int"))
    n = activity(spark, sf_dir).select("event_id", "doctor", kind.alias("kind"), F.when(F.col("k") % 7 == 3, "draft").otherwise("submitted").alias("form_status"))
    slug = F.regexp_replace(F.lower("kind"), "[^a-z0-9]", "")
    form = F.when(slug.contains("gnd"), "gnd_gndpatientsubmission").otherwise("redflags_patientsubmission")
    target = F.when(F.col("kind").isin(*TARGETS), F.col("kind")).when(slug.isin(*LOGIN_SLUGS), "redflags_metricevent").when(slug.isin(*FORM_SLUGS), form)
    is_form = F.col("target").endswith("patientsubmission")
    routed = n.withColumn("target", target).where(F.col("target").isNotNull() & (~is_form | (F.col("form_status") == "submitted")))
    return routed.select("event_id", "target", "doctor", F.when(is_form, F.col("form_status")).alias("form_status"))


#: Hosts whose links are shown as videos here; a deployment passes its own.
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "youtu.be", "vimeo.com", "player.vimeo.com")


@query(f"""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '//youtu.be/' || page_id % 50 WHEN 1 THEN 'https://Vimeo.com/' || page_id % 50 || '?t=1' WHEN 2 THEN url ELSE 'ftp://youtu.be/x' END AS raw FROM pages),
l AS (SELECT page_id, CASE WHEN starts_with(raw, '//') THEN 'https:' || raw ELSE raw END AS raw FROM v), c AS (SELECT page_id, CASE WHEN regexp_extract(raw, '^https?://([^/?#]+)', 1) <> '' AND lower(regexp_extract(raw, '^https?://([^/?#]+)', 1)) IN ({_quoted(VIDEO_HOSTS)}) THEN raw END AS link, raw FROM l),
m AS (SELECT link, 'Video ' || max(page_id) AS title FROM c WHERE page_id % 3 = 0 AND link IS NOT NULL GROUP BY link)
SELECT page_id, c.link AS video_url, m.title AS video_title, coalesce(m.title, c.link, c.raw) AS label FROM c LEFT JOIN m ON m.link = c.link""")
def video_metadata(spark, sf_dir):
    """Links of supported video hosts, completed with their scheme, with the title known for them and a label to show."""
    k, page = F.col("page_id") % 4, (F.col("page_id") % 50).cast("string")
    raw = F.when(k == 0, F.concat(F.lit("//youtu.be/"), page)).when(k == 1, F.concat(F.lit("https://Vimeo.com/"), page, F.lit("?t=1"))).when(k == 2, F.col("url")).otherwise("ftp://youtu.be/x")
    c = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw")).withColumn("raw", F.when(F.col("raw").startswith("//"), F.concat(F.lit("https:"), F.col("raw"))).otherwise(F.col("raw")))
    c = c.withColumn("video_url", F.when(F.lower(F.regexp_extract("raw", "^https?://([^/?#]+)", 1)).isin(*VIDEO_HOSTS), F.col("raw")))
    titles = c.where("page_id % 3 = 0 and video_url is not null").groupBy("video_url").agg(F.concat(F.lit("Video "), F.max("page_id").cast("string")).alias("video_title"))
    return c.join(titles, "video_url", "left").select("page_id", "video_url", "video_title", F.coalesce("video_title", "video_url", "raw").alias("label"))


@query("""SELECT conv_id, turn, list_aggregate(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{4,}'), lambda x: x NOT IN ('this', 'that'))), 'count') AS refs FROM conversations""")
def reference_walk(spark, sf_dir):
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)), lambda x: ~x.isin("this", "that"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_distinct(found)).cast("long").alias("refs"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS canonical FROM pages""")
def canonical_links(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("host"), F.rtrim(F.regexp_replace(url, "[?#].*$", ""), F.lit("/")).alias("canonical"))


@query(f"""WITH {WEEKS}, h AS (SELECT *, round({health_sql('reached', 'opened', 'consumed', '(doctors / 4.0::DOUBLE)')}, 6) AS health FROM kpi) SELECT campaign, collateral, week, CASE WHEN health <= 40 THEN 'Low' WHEN health < 60 THEN 'Average' ELSE 'Good' END AS label, health >= (SELECT avg(health) FROM h) AS above_benchmark FROM h""")
def performance_labels(spark, sf_dir):
    k = kpis.weekly_kpi(spark, sf_dir)
    mean = k.agg(F.avg("health")).first()[0]  # one number
    label = F.when(F.col("health") <= 40, "Low").when(F.col("health") < 60, "Average").otherwise("Good")
    return k.select("campaign", "collateral", "week", label.alias("label"), (F.col("health") >= F.lit(mean)).alias("above_benchmark"))


@query("SELECT c_custkey, coalesce(try_cast(nullif(trim(CASE c_custkey % 3 WHEN 0 THEN ' 35.5 ' WHEN 1 THEN 'x' END), '') AS DOUBLE), 40) AS threshold FROM customer")
def thresholds(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, " 35.5 ").when(F.col("c_custkey") % 3 == 1, "x")
    return table(spark, sf_dir, "customer").select("c_custkey", as_float(trimmed(raw), 40.0).alias("threshold"))


@query(f"""WITH {kpis.PLAYS} SELECT share, campaign, CAST(d - CAST(dayofweek(d) AS INTEGER) AS DATE) AS week_start, CAST(d + CAST(6 - dayofweek(d) AS INTEGER) AS DATE) AS week_end, CASE WHEN p100 IS NOT NULL THEN 'completed' WHEN p50 IS NOT NULL THEN 'viewed_50' WHEN played IS NOT NULL THEN 'played' ELSE 'shared' END AS stage FROM fun""")
def share_stages(spark, sf_dir):
    f = kpis._funnel(spark, sf_dir)
    stage = F.when(F.col("p100").isNotNull(), "completed").when(F.col("p50").isNotNull(), "viewed_50").when(F.col("played").isNotNull(), "played").otherwise("shared")
    return f.select("share", "campaign", F.date_sub(saturday(F.col("d")), 6).alias("week_start"), saturday(F.col("d")).alias("week_end"), stage.alias("stage"))


@query(f"""WITH {SEEN}, {DOC}, r AS (SELECT campaign, rep, state, count(DISTINCT s.doctor) AS clinics, count(reached) AS reached, count(opened) AS opened, count(*) FILTER (WHERE video IS NOT NULL OR pdf IS NOT NULL) AS consumed FROM seen s JOIN doc ON doc.doctor = s.doctor GROUP BY ALL) SELECT *, {band_sql('health')} AS band FROM (SELECT *, round({health_sql('reached', 'opened', 'consumed', 'clinics')}, 6) AS health FROM r)""")
def detail_rollup(spark, sf_dir):
    seen = M.first_seen(activity(spark, sf_dir), ["campaign", "collateral", "doctor"])
    has = F.coalesce("video", "pdf").isNotNull()
    r = seen.join(doctors(spark, sf_dir).select("doctor", "rep", "state"), "doctor").groupBy("campaign", "rep", "state").agg(F.count_distinct("doctor").alias("clinics"), F.count("reached").alias("reached"), F.count("opened").alias("opened"), F.count(F.when(has, 1)).alias("consumed"))
    r = r.withColumn("health", F.round(engagement_health(F.col("reached"), F.col("opened"), F.col("consumed"), F.col("clinics")), 6))
    return r.withColumn("band", health_band(F.col("health")))


@query(f"""WITH {ACT}, t AS (SELECT 'visits' AS system, count(DISTINCT doctor) FILTER (WHERE event_type = 'view') AS done, count(DISTINCT doctor) AS base FROM act WHERE campaign = 'C0' UNION ALL SELECT 'education', count(DISTINCT doctor) FILTER (WHERE event_type = 'click'), count(DISTINCT doctor) FROM act WHERE campaign = 'C1' UNION ALL SELECT 'screening', count(DISTINCT doctor) FILTER (WHERE event_type = 'purchase' AND k < 30), count(DISTINCT doctor) FROM act WHERE campaign = 'C2')
  SELECT system, done, base, round(least(done * 100.0::DOUBLE / base, 100), 6) AS adoption_rate FROM t""")
def cross_system(spark, sf_dir):
    c, e = F.col("campaign"), F.col("event_type")
    system = F.when(c == "C0", "visits").when(c == "C1", "education").otherwise("screening")
    done = F.when(c == "C0", e == "view").when(c == "C1", e == "click").otherwise((e == "purchase") & (F.col("k") < 30))
    t = activity(spark, sf_dir).groupBy(system.alias("system")).agg(F.count_distinct(F.when(done, F.col("doctor"))).alias("done"), F.count_distinct("doctor").alias("base"))
    return t.withColumn("adoption_rate", F.round(capped_percent(F.col("done"), F.col("base")), 6))
