"""Dimension and resolution queries: campaigns, collaterals, reps, doctors, aliases and the ids they resolve from."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefield.functions.text import clean_text, email_loose, first_non_empty, identifier, joined_hash
from pulsefield.operators import matching as J
from pulsefield.operators.metrics import Window
from pulsefield.operators.rows import latest_by
from pulsefield.plans.base import ACT, DOC, activity, doctors, query
from pulsefield.plans.people import DIMS, _dims
from pulsefield.plans.records import DIRTY, _dirty
from pulsefield.session import table

CLEAN = "CASE WHEN lower(trim({0})) NOT IN ('', 'null', 'none', 'nil', 'n/a', 'na') THEN trim({0}) END"


@query(f"WITH {DIRTY} SELECT c_custkey, {CLEAN.format('t')} AS t, {CLEAN.format('w')} AS w, {CLEAN.format('ph')} AS ph, {CLEAN.format('em')} AS em FROM dirty")
def normalized_rows(spark, sf_dir):
    d = _dirty(spark, sf_dir)
    return d.select("c_custkey", *[clean_text(F.col(c)).alias(c) for c in d.columns[1:]])


@query("""SELECT p_partkey AS collateral, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_name END, p_type, 'Untitled') AS title, p_size > 25 AS is_long, p_partkey % 4 = 0 AS name_missing, p_type LIKE 'E%' AS is_economy FROM part""")
def collateral_dim(spark, sf_dir):
    missing = F.col("p_partkey") % 4 == 0
    title = first_non_empty(F.when(missing, "n/a").otherwise(F.col("p_name")), F.col("p_type"), F.lit("Untitled"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("collateral"), title.alias("title"), (F.col("p_size") > 25).alias("is_long"), missing.alias("name_missing"), F.col("p_type").startswith("E").alias("is_economy"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders) SELECT o_orderkey, try_cast(t AS DATE) AS start_d, try_cast(t AS DATE) + 28 AS end_d, c_name IS NOT NULL AS known FROM s LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0""")
def schedule_bridge(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", t.try_cast("date").alias("start_d"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return s.join(c, "o_custkey", "left").select("o_orderkey", "start_d", F.date_add("start_d", 28).alias("end_d"), F.col("c_name").isNotNull().alias("known"))


@query("""WITH m AS (SELECT p_brand AS campaign, min(p_name) AS name, bool_or(p_size > 45) AS live FROM part GROUP BY p_brand), o AS (SELECT p_brand AS campaign, 'Local ' || max(p_type) AS name FROM part WHERE p_partkey % 7 = 0 GROUP BY p_brand) SELECT m.campaign, coalesce(o.name, m.name) AS name, o.name IS NOT NULL AS overridden FROM m LEFT JOIN o ON o.campaign = m.campaign WHERE live""")
def campaign_dim(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m = p.groupBy(F.col("p_brand").alias("campaign")).agg(F.min("p_name").alias("name"), F.bool_or(F.col("p_size") > 45).alias("live")).where("live")
    o = p.where("p_partkey % 7 = 0").groupBy(F.col("p_brand").alias("campaign")).agg(F.concat(F.lit("Local "), F.max("p_type")).alias("local"))
    return m.join(o, "campaign", "left").select("campaign", F.coalesce("local", "name").alias("name"), F.col("local").isNotNull().alias("overridden"))


@query("""WITH a AS (SELECT p_brand AS campaign, min(p_partkey) AS k FROM part WHERE p_size < 30 GROUP BY p_brand), b AS (SELECT p_brand AS campaign, max(p_partkey) AS k FROM part WHERE p_size > 20 AND p_partkey % 3 = 0 GROUP BY p_brand) SELECT coalesce(a.campaign, b.campaign) AS campaign, a.k AS master, b.k AS publisher, a.k IS NULL AS publisher_only FROM a FULL JOIN b ON a.campaign = b.campaign""")
def campaign_dim_outer(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_size < 30").groupBy(F.col("p_brand").alias("campaign")).agg(F.min("p_partkey").alias("master"))
    b = p.where("p_size > 20 and p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("campaign")).agg(F.max("p_partkey").alias("publisher"))
    return a.join(b, "campaign", "full_outer").withColumn("publisher_only", F.col("master").isNull())


@query(f"""WITH {DOC}, i AS (SELECT rep, max_by(state, doctor) AS state FROM doc WHERE doctor % 4 = 0 GROUP BY rep), f AS (SELECT rep, min(state) AS state FROM doc GROUP BY rep) SELECT f.rep, coalesce(CASE WHEN f.rep IN ('R1', 'R2') THEN 'NATION_0' END, CASE WHEN f.rep <> 'R5' THEN i.state END, f.state) AS state FROM f LEFT JOIN i ON i.rep = f.rep""")
def rep_dim_state(spark, sf_dir):
    d = doctors(spark, sf_dir)
    both = d.groupBy("rep").agg(F.max_by("state", F.when(F.col("doctor") % 4 == 0, F.col("doctor"))).alias("seen"), F.min("state").alias("fallback"))
    return both.select("rep", F.coalesce(F.when(F.col("rep").isin("R1", "R2"), "NATION_0"), F.when(F.col("rep") != "R5", F.col("seen")), "fallback").alias("state"))


@query(f"WITH {DOC} SELECT 'C' || doctor % 3 AS campaign, rep, min(doctor) AS first_doctor, count(*) AS doctors FROM doc GROUP BY ALL")
def assignment_dim(spark, sf_dir):
    return doctors(spark, sf_dir).groupBy(F.concat(F.lit("C"), (F.col("doctor") % 3).cast("string")).alias("campaign"), "rep").agg(F.min("doctor").alias("first_doctor"), F.count("*").alias("doctors"))


@query("""WITH b AS (SELECT p_partkey AS local_id, p_brand AS brand FROM part), n AS (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS norm, min(p_brand) AS brand FROM part GROUP BY 1),
  r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'brand-' || (o_custkey % 60) WHEN 2 THEN md5(CAST(o_custkey AS VARCHAR)) ELSE 'x' END AS raw FROM orders)
  SELECT id, coalesce(b.brand, n.brand, CASE WHEN length(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) >= 24 THEN raw END, '') AS campaign FROM r LEFT JOIN b ON CAST(b.local_id AS VARCHAR) = raw LEFT JOIN n ON n.norm = lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g'))""")
def campaign_id_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    local = p.select(F.col("p_partkey").cast("string").alias("raw"), F.col("p_brand").alias("by_id"))
    norm = p.groupBy(identifier(F.col("p_brand")).alias("norm")).agg(F.min("p_brand").alias("by_name"))
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    raw = F.when(k == 0, c.cast("string")).when(k == 1, F.concat(F.lit("brand-"), (c % 60).cast("string"))).when(k == 2, F.md5(c.cast("string"))).otherwise("x")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).withColumn("norm", identifier(F.col("raw")))
    return r.join(local, "raw", "left").join(norm, "norm", "left").select("id", F.coalesce("by_id", "by_name", F.when(F.length("norm") >= 24, F.col("raw")), F.lit("")).alias("campaign"))


@query(f"""WITH {DOC}, u AS (SELECT doctor, 'u' || doctor % 9 AS usr FROM doc), us AS (SELECT 'u' || n AS usr, 'R' || n AS rep FROM (SELECT unnest(generate_series(0, 7)) AS n)), asg AS (SELECT DISTINCT rep, 'C' || doctor % 3 AS campaign FROM doc WHERE doctor % 2 = 0) SELECT u.doctor, us.rep, campaign FROM u JOIN us ON us.usr = u.usr JOIN asg ON asg.rep = us.rep""")
def legacy_roster(spark, sf_dir):
    d = doctors(spark, sf_dir)
    u = d.select("doctor", F.concat(F.lit("u"), (F.col("doctor") % 9).cast("string")).alias("usr"))
    reps = spark.range(8).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("usr"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("rep"))
    asg = d.where("doctor % 2 = 0").select("rep", F.concat(F.lit("C"), (F.col("doctor") % 3).cast("string")).alias("campaign")).distinct()
    return u.join(reps, "usr").join(asg, "rep").select("doctor", "rep", "campaign")


@query("""WITH e AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 150 AS VARCHAR) WHEN 1 THEN 'Supplier#' || lpad(CAST(o_custkey % 150 AS VARCHAR), 9, '0') WHEN 2 THEN 'rep-' || (o_custkey % 150) ELSE 'nobody' END AS raw FROM orders)
  SELECT id, coalesce(a.s_suppkey, b.s_suppkey, c.s_suppkey) AS rep, CASE WHEN a.s_suppkey IS NOT NULL THEN 'id' WHEN b.s_suppkey IS NOT NULL THEN 'external' WHEN c.s_suppkey IS NOT NULL THEN 'digits' ELSE 'none' END AS basis FROM e LEFT JOIN supplier a ON CAST(a.s_suppkey AS VARCHAR) = raw LEFT JOIN supplier b ON b.s_name = raw
  LEFT JOIN supplier c ON CAST(c.s_suppkey AS VARCHAR) = regexp_extract(raw, '([0-9]+)$', 1)""")
def rep_resolution_cascade(spark, sf_dir):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 150
    raw = F.when(k == 0, c.cast("string")).when(k == 1, F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0"))).when(k == 2, F.concat(F.lit("rep-"), c.cast("string"))).otherwise("nobody")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).withColumn("tail", F.regexp_extract("raw", "([0-9]+)$", 1))
    s = table(spark, sf_dir, "supplier")
    ids = s.select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_suppkey").alias("rep"))
    names = s.select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("rep"))
    return J.match_cascade(e, [("raw", ids, "id"), ("raw", names, "external"), ("tail", ids, "digits")], "rep").select("id", "rep", "basis")


@query("SELECT source, arg_min(md5(text), (CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id)) AS label FROM documents GROUP BY source")
def localized_label(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.min_by(F.md5("text"), F.struct(F.when(F.col("lang") == "en", 0).otherwise(1), "doc_id")).alias("label"))


@query("""WITH b AS (SELECT DISTINCT p_brand AS campaign, p_type AS bundle FROM part WHERE p_size > 40), v AS (SELECT DISTINCT p_type AS bundle, p_name AS video FROM part WHERE p_partkey % 3 = 0) SELECT campaign, b.bundle, video FROM b JOIN v ON v.bundle = b.bundle""")
def content_bridge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.where("p_size > 40").select(F.col("p_brand").alias("campaign"), F.col("p_type").alias("bundle")).distinct()
    return b.join(p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("bundle"), F.col("p_name").alias("video")).distinct(), "bundle")


@query(f"""WITH {ACT}, {DOC}, en AS (SELECT DISTINCT doctor, campaign FROM act) SELECT doc.doctor, coalesce(campaign, 'Unassigned') AS campaign, 'D' || doc.doctor || CASE WHEN campaign IS NOT NULL THEN '::campaign:' || campaign ELSE '' END AS doctor_key FROM doc LEFT JOIN en ON en.doctor = doc.doctor""")
def enrollment_fanout(spark, sf_dir):
    en = activity(spark, sf_dir).select("doctor", "campaign").distinct()
    key = F.concat(F.lit("D"), F.col("doctor").cast("string"), F.coalesce(F.concat(F.lit("::campaign:"), "campaign"), F.lit("")))
    return doctors(spark, sf_dir).select("doctor").join(en, "doctor", "left").select("doctor", F.coalesce("campaign", F.lit("Unassigned")).alias("campaign"), key.alias("doctor_key"))


@query("SELECT r_name AS zone, n_name AS state, count(*) AS doctors, min(c_name) AS first_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def geography_dim(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("doctors"), F.min("c_name").alias("first_name"))  # before the joins
    return per.join(n, per.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("zone"), F.col("n_name").alias("state")).agg(F.sum("doctors").alias("doctors"), F.min("first_name").alias("first_name"))


@query(f"WITH {ACT} SELECT campaign FROM act WHERE event_type = 'view' UNION SELECT 'C' || (doctor % 5) FROM act WHERE event_type = 'click' UNION SELECT DISTINCT p_brand FROM part")
def observed_campaigns(spark, sf_dir):
    a = activity(spark, sf_dir)
    other = a.where("event_type = 'click'").select(F.concat(F.lit("C"), (F.col("doctor") % 5).cast("string")).alias("campaign"))
    return a.where("event_type = 'view'").select("campaign").unionByName(other).unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("campaign"))).distinct()


@query(f"""WITH {ACT}, {DOC}, u AS (SELECT doctor, 0 AS tier, doctor AS seq, state AS v FROM doc WHERE doctor % 3 = 0 UNION ALL SELECT doctor, 1, event_id, event_type FROM act WHERE event_type <> 'view' UNION ALL SELECT doctor, 2, event_id, 'share' FROM act WHERE event_type = 'view') SELECT doctor, tier, v FROM (SELECT *, row_number() OVER (PARTITION BY doctor ORDER BY tier, seq DESC) AS n FROM u) WHERE n = 1""")
def doctor_dim_tiers(spark, sf_dir):
    a, d = activity(spark, sf_dir), doctors(spark, sf_dir)
    one = d.where("doctor % 3 = 0").select("doctor", F.lit(0).alias("tier"), F.col("doctor").alias("seq"), F.col("state").alias("v"))
    rest = a.select("doctor", F.when(F.col("event_type") == "view", 2).otherwise(1).alias("tier"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "share").otherwise(F.col("event_type")).alias("v"))
    return latest_by(one.unionByName(rest), ["doctor"], [F.col("tier"), F.desc("seq")]).drop("seq")


@query(f"WITH {DOC} SELECT doctor, CASE WHEN doctor % 4 = 0 THEN 'id:' || doctor WHEN doctor % 4 = 1 THEN 'email:' || lower(email) WHEN doctor % 4 = 2 THEN 'phone:' || phone ELSE 'key:' || md5(name) END AS identity FROM doc")
def identity_key_cascade(spark, sf_dir):
    k = F.col("doctor") % 4
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), c)  # noqa: E731  null if the part is
    return doctors(spark, sf_dir).select("doctor", F.coalesce(tag("id", F.when(k == 0, F.col("doctor").cast("string"))), tag("email", F.when(k == 1, F.lower("email"))), tag("phone", F.when(k == 2, F.col("phone"))), tag("key", joined_hash("md5", ":", F.col("name")))).alias("identity"))


@query(f"WITH {DOC}, x AS (SELECT doctor, unnest([lower(email), phone, lower(name)]) AS alias FROM doc) SELECT alias, count(DISTINCT doctor) AS doctors, min(doctor) AS first_doctor FROM x GROUP BY alias")
def alias_index(spark, sf_dir):
    x = doctors(spark, sf_dir).select("doctor", F.explode(F.array(F.lower("email"), "phone", F.lower("name"))).alias("alias"))
    return x.groupBy("alias").agg(F.count_distinct("doctor").alias("doctors"), F.min("doctor").alias("first_doctor"))


URLS = """pg AS (SELECT page_id, rtrim(lower(url), '/') AS u, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), tg AS (SELECT u, min(page_id) AS banner FROM pg WHERE page_id % 2 = 0 GROUP BY u), hs AS (SELECT host, min(page_id) AS banner FROM pg WHERE page_id % 3 = 0 GROUP BY host HAVING count(*) = 1)"""


@query(f"""WITH {URLS} SELECT page_id, coalesce(CASE WHEN page_id % 5 = 0 THEN page_id END, tg.banner, hs.banner) AS banner, CASE WHEN page_id % 5 = 0 THEN 'id' WHEN tg.banner IS NOT NULL THEN 'url' WHEN hs.banner IS NOT NULL THEN 'host' ELSE 'none' END AS basis FROM pg LEFT JOIN tg ON tg.u = pg.u LEFT JOIN hs ON hs.host = pg.host""")
def banner_click_cascade(spark, sf_dir):
    pg = table(spark, sf_dir, "pages").select("page_id", F.rtrim(F.lower("url"), F.lit("/")).alias("u"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.when(F.col("page_id") % 5 == 0, F.col("page_id")).alias("ref"))
    ids = pg.where("ref is not null").select("ref", F.col("ref").alias("banner"))
    urls = pg.where("page_id % 2 = 0").groupBy("u").agg(F.min("page_id").alias("banner"))
    hosts = pg.where("page_id % 3 = 0").groupBy("host").agg(F.min("page_id").alias("banner"), F.count("*").alias("n")).where("n = 1").drop("n")
    return J.match_cascade(pg, [("ref", ids, "id"), ("u", urls, "url"), ("host", hosts, "host")], "banner").select("page_id", "banner", "basis")


@query(f"""WITH {ACT}, ids AS (SELECT k AS banner, min(campaign) AS campaign FROM act WHERE event_type = 'signup' GROUP BY k HAVING count(DISTINCT campaign) = 1)
  SELECT event_id, CASE WHEN act.event_id % 4 = 0 THEN act.campaign ELSE ids.campaign END AS campaign, d FROM act LEFT JOIN ids ON ids.banner = act.k
  WHERE event_type = 'click' AND event_id % 4 <> 1 AND event_id % 7 <> 0 AND (event_id % 4 = 0 OR ids.campaign IS NOT NULL)""")
def direct_banner_events(spark, sf_dir):
    # A click's own campaign id wins (an ambiguous one drops the click), then a banner id of one campaign; undated clicks are dropped.
    a = activity(spark, sf_dir)
    ids = a.where("event_type = 'signup'").groupBy(F.col("k").alias("banner")).agg(F.min("campaign").alias("by_banner"), F.max("campaign").alias("last")).where("by_banner = last")
    clicks = a.where("event_type = 'click' and event_id % 4 <> 1").withColumn("d", F.when(F.col("event_id") % 7 != 0, F.col("d"))).where("d is not null")
    own = F.when(F.col("event_id") % 4 == 0, F.col("campaign"))
    return clicks.join(ids, F.col("k") == F.col("banner"), "left").select("event_id", F.coalesce(own, "by_banner").alias("campaign"), "d").where("campaign is not null")


#: Events name their rep by the head of a transaction id, an e-mail address or an id, or not at all.
REP_EVENTS = ACT + """, raw AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Supplier#' || lpad(CAST(doctor AS VARCHAR), 9, '0') || '-' || event_id END AS tx, CASE WHEN k % 2 = 0 THEN ' S' || doctor || '@Mail.example' END AS email,
    CASE WHEN event_id % 4 = 0 THEN CAST(k AS VARCHAR) END AS code, CASE WHEN event_id % 7 = 0 THEN event_id - 1 END AS linked FROM act),
dir AS (SELECT s_suppkey AS rep, s_name AS name, 's' || s_suppkey || '@mail.example' AS email, CAST(s_suppkey AS VARCHAR) AS code FROM supplier)"""


@query(f"""WITH {REP_EVENTS}, own AS (SELECT event_id, linked, coalesce((SELECT min(rep) FROM dir WHERE dir.name = split_part(tx, '-', 1)), (SELECT min(rep) FROM dir WHERE dir.email = lower(trim(raw.email))), (SELECT min(rep) FROM dir WHERE dir.code = raw.code)) AS rep FROM raw)
  SELECT a.event_id, coalesce(a.rep, b.rep) AS rep, CASE WHEN a.rep IS NULL AND b.rep IS NOT NULL THEN 'linked' WHEN a.rep IS NOT NULL THEN 'own' ELSE 'none' END AS via FROM own a LEFT JOIN own b ON b.event_id = a.linked""")
def event_rep_lookup(spark, sf_dir):
    """Three ranked lookups in the directory of reps, then the rep of the event that this one is linked to."""
    a, e = activity(spark, sf_dir), F.col("event_id")
    own = lambda cond, value: F.when(cond, value)
    raw = a.select(
        e,
        own(e % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("doctor").cast("string"), 9, "0"), F.lit("-"), e.cast("string"))).alias("tx"),
        own(F.col("k") % 2 == 0, F.concat(F.lit(" S"), F.col("doctor").cast("string"), F.lit("@Mail.example"))).alias("email"),
        own(e % 4 == 0, F.col("k").cast("string")).alias("code"),
        own(e % 7 == 0, e - 1).alias("linked"),
    ).select("event_id", "linked", F.split_part("tx", F.lit("-"), F.lit(1)).alias("head"), email_loose(F.col("email")).alias("email"), "code")
    s = table(spark, sf_dir, "supplier")
    lookup = lambda key: s.groupBy(key.alias("key")).agg(F.min("s_suppkey").alias("rep"))
    email = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@mail.example"))
    steps = [("head", lookup(F.col("s_name")), "head"), ("email", lookup(email), "email"), ("code", lookup(F.col("s_suppkey").cast("string")), "code")]
    found = J.match_cascade(raw, steps, "rep").select("event_id", "linked", "rep")
    linked = found.select(F.col("event_id").alias("linked"), F.col("rep").alias("other"))
    via = F.when(F.col("rep").isNotNull(), "own").when(F.col("other").isNotNull(), "linked").otherwise("none")
    return found.join(linked, "linked", "left").select("event_id", F.coalesce("rep", "other").alias("rep"), via.alias("via"))


@query(f"WITH {ACT}, {DOC}, asg AS (SELECT DISTINCT 'C' || doctor % 3 AS campaign, rep FROM doc WHERE rep IN ('R1', 'R3')) SELECT event_id FROM act JOIN doc ON act.doctor = doc.doctor WHERE EXISTS (SELECT 1 FROM asg WHERE asg.campaign = act.campaign AND asg.rep = doc.rep)")
def assigned_rep_attribution(spark, sf_dir):
    d = doctors(spark, sf_dir).select("doctor", "rep")
    asg = d.where("rep in ('R1', 'R3')").select(F.concat(F.lit("C"), (F.col("doctor") % 3).cast("string")).alias("campaign"), "rep").distinct()
    return activity(spark, sf_dir).join(d, "doctor").join(asg, ["campaign", "rep"], "left_semi").select("event_id")


@query(f"WITH {ACT}, {DOC} SELECT event_id, coalesce('D' || doc.doctor, 'unmatched:' || (act.doctor + 100000 * (act.doctor % 2))) AS doctor_key FROM act LEFT JOIN doc ON doc.doctor = act.doctor + 100000 * (act.doctor % 2)")
def doctor_match_sentinel(spark, sf_dir):
    a = activity(spark, sf_dir).select("event_id", (F.col("doctor") + 100000 * (F.col("doctor") % 2)).alias("doctor"))
    d = doctors(spark, sf_dir).select("doctor", F.concat(F.lit("D"), F.col("doctor").cast("string")).alias("known"))
    return a.join(d, "doctor", "left").select("event_id", F.coalesce("known", F.concat(F.lit("unmatched:"), F.col("doctor").cast("string"))).alias("doctor_key"))


@query(f"WITH {DIMS} SELECT dim, id, start_d, end_d, count(ev.ev) AS events FROM (SELECT * FROM dim) LEFT JOIN ev USING (id) WHERE ev.ev IS NULL OR start_d <= at_d AND (end_d IS NULL OR at_d <= end_d) GROUP BY ALL")
def dimension_usage(spark, sf_dir):
    ev, dim = _dims(spark, sf_dir)
    joined = dim.join(ev, "id", "left").where("ev is null or (start_d <= at and (end_d is null or at <= end_d))")
    return joined.groupBy("dim", "id", "start_d", "end_d").agg(F.count("ev").alias("events"))


@query("""WITH l AS (SELECT url AS link, 1 AS p, page_id % 2 = 0 AS live FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT rtrim(url, '/'), 2, true FROM pages UNION ALL SELECT lower(url), 3, false FROM pages WHERE page_id % 3 = 0) SELECT link, min(p) AS priority, bool_or(live) AS live, count(*) AS sources FROM l GROUP BY link""")
def link_library(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    one = p.where("page_id % 2 = 0").select(F.col("url").alias("link"), F.lit(1).alias("p"), F.lit(True).alias("live"))
    two = p.select(F.rtrim("url", F.lit("/")).alias("link"), F.lit(2).alias("p"), F.lit(True).alias("live"))
    three = p.where("page_id % 3 = 0").select(F.lower("url").alias("link"), F.lit(3).alias("p"), F.lit(False).alias("live"))
    return one.unionByName(two).unionByName(three).groupBy("link").agg(F.min("p").alias("priority"), F.bool_or("live").alias("live"), F.count("*").alias("sources"))


@query("""SELECT p_brand AS campaign, coalesce(arg_max(p_name, p_partkey) FILTER (WHERE p_name NOT LIKE '%ring%' AND p_size > 5), 'Unnamed') AS name FROM part GROUP BY p_brand""")
def campaign_display_name(spark, sf_dir):
    shown = ~F.col("p_name").like("%ring%") & (F.col("p_size") > 5)
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("campaign")).agg(F.coalesce(F.max_by("p_name", F.when(shown, F.col("p_partkey"))), F.lit("Unnamed")).alias("name"))


@query("""WITH o AS (SELECT p_brand AS key, 1 AS level, max(p_partkey) AS seq FROM part WHERE p_size > 47 GROUP BY 1 UNION ALL SELECT p_brand, 2, max(p_partkey) FROM part GROUP BY 1) SELECT key, level FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level) AS n FROM o) WHERE n = 1 AND lower(key) NOT LIKE '%test%' AND lower(key) NOT LIKE '%#11%'""")
def campaign_options(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.when(F.max("p_size") > 47, 1).otherwise(2).alias("level"))
    return p.where("lower(key) not like '%test%' and lower(key) not like '%#11%'")


@query("""WITH k AS (SELECT DISTINCT p_brand AS b, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS key FROM part), reg AS (SELECT 'BRAND-' || n AS raw, n FROM (SELECT unnest(generate_series(0, 30)) AS n)) SELECT raw, min(b) AS campaign, min(b) IS NOT NULL AS found FROM reg LEFT JOIN k ON key = lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) GROUP BY raw""")
def normalized_key_lookup(spark, sf_dir):
    k = table(spark, sf_dir, "part").select(F.col("p_brand").alias("b")).distinct().withColumn("key", identifier(F.col("b")))
    reg = spark.range(31).select(F.concat(F.lit("BRAND-"), F.col("id").cast("string")).alias("raw")).withColumn("key", identifier(F.col("raw")))
    return reg.join(k, "key", "left").groupBy("raw").agg(F.min("b").alias("campaign")).withColumn("found", F.col("campaign").isNotNull())


@query("SELECT c_mktsegment, s_name, rank FROM (SELECT c_mktsegment, s_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c, s_name) AS rank FROM (SELECT c_mktsegment, s_name, count(*) AS c FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY ALL)) WHERE rank <= 2")
def rep_per_segment(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").count()
    s = table(spark, sf_dir, "supplier")
    j = c.join(s, c.c_nationkey == s.s_nationkey).groupBy("c_mktsegment", "s_name").agg(F.sum("count").alias("c"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c", "s_name")).cast("long")).where("rank <= 2").drop("c")
