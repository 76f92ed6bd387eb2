"""Ingest, bronze, scalar, policy and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefield.functions import text as T
from pulsefield.operators import policy as P
from pulsefield.operators import rows as R
from pulsefield.plans.base import ACT, DOC, activity, doctors, query
from pulsefield.session import table


@query("SELECT count(*) AS total_rows, CAST(count(DISTINCT event_type || '|' || user_id) AS BIGINT) AS unique_rows FROM events")
def scan_projected(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id")
    return e.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_rows"), F.count("*").alias("unique_rows"))


@query(f"WITH {ACT} SELECT event_id, d FROM act WHERE d >= (SELECT max(d) FROM act WHERE d < DATE '2024-01-20') - 3")
def watermark_lookback_scan(spark, sf_dir):
    from pulsefield.sources.tables import since_watermark

    a = activity(spark, sf_dir)
    last = a.where("d < date '2024-01-20'").agg(F.max("d")).first()[0]
    return since_watermark(a, "d", last, 3).select("event_id", "d")


@query(f"WITH {ACT}, o AS (SELECT DISTINCT doctor, event_type, d FROM act WHERE d <= DATE '2024-01-18') SELECT DISTINCT doctor, event_type, d FROM act WHERE d >= DATE '2024-01-15' EXCEPT SELECT * FROM o")
def payload_hash_append(spark, sf_dir):
    a = activity(spark, sf_dir).select("event_id", "doctor", "event_type", "d")
    cols = ["doctor", "event_type", "d"]
    return R.append_new_payloads(a.where("d <= date '2024-01-18'").select(*cols), a.where("d >= date '2024-01-15'").select(*cols), cols).select(*cols)


@query(f"WITH {ACT} SELECT event_id FROM act WHERE doctor IN (SELECT doctor FROM act WHERE event_type = 'purchase')")
def snapshot_semi_join(spark, sf_dir):
    a = activity(spark, sf_dir)
    return a.join(a.where("event_type = 'purchase'").select("doctor").distinct(), "doctor", "left_semi").select("event_id")


@query("""WITH v AS (SELECT c_custkey, 'v2' AS src FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 20), l AS (SELECT c_custkey, 'v1' AS src FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM v UNION ALL SELECT * FROM l WHERE c_custkey NOT IN (SELECT c_custkey FROM v)""")
def fallback_backfill(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    current, legacy = (c.where(w).select("c_custkey", F.lit(s).alias("src")) for w, s in (("c_custkey % 2 = 0", "v2"), ("c_custkey % 3 = 0", "v1")))
    return R.active_rows(current, c.where("c_nationkey < 20"), legacy, ["c_custkey"])


@query("""SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IS NOT NULL AS replaced, coalesce(min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), min(o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def raw_key_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("replaced"))
    return R.upsert(o.where("not replaced"), o.where("replaced"), ["k"], [F.col("o_orderkey")])


@query("""WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups, max(n) AS largest_group FROM g""")
def duplicate_stats(spark, sf_dir):
    return R.duplicate_stats(table(spark, sf_dir, "documents"), ["text"])


@query(f"WITH {ACT} SELECT event_id, row_number() OVER (PARTITION BY doctor, event_type, d ORDER BY event_id) AS rank FROM act")
def duplicate_archive(spark, sf_dir):
    return R.split_duplicates(activity(spark, sf_dir), ["doctor", "event_type", "d"], [F.col("event_id")]).select("event_id", "rank")


@query(f"WITH {ACT} SELECT doctor, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY doctor, event_type ORDER BY ts DESC, event_id DESC) AS n FROM act) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return R.latest_by(activity(spark, sf_dir), ["doctor", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("doctor", "event_type", "event_id")


@query("""SELECT o_orderkey, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderdate DESC, o_orderkey) AS n FROM (SELECT *, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey || chr(31) || o_orderstatus ELSE 'h' || o_orderkey END AS key FROM orders)) WHERE n = 1""")
def composite_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")))
    key = R.non_empty_key((F.col("o_custkey"), F.col("status")), fallback=F.concat(F.lit("h"), F.col("o_orderkey").cast("string")))
    return R.latest_by(o.withColumn("key", key), ["key"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "key")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' OR o_orderpriority = '5-LOW')")
def rule_exclusion(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(~R.excluded(o, "orders", [("orders", "o_orderstatus", " p "), ("*", "o_orderpriority", "5-low"), ("other", "o_orderkey", "1")])).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT lower(p_name) LIKE '%widget%'")
def test_campaign_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~F.lower(F.coalesce("p_name", F.lit(""))).like("%widget%")).select("p_partkey")


DIRTY = """dirty AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN 'NULL' WHEN 2 THEN ' n/a ' WHEN 3 THEN '' WHEN 4 THEN c_name ELSE NULL END AS t,
  CASE c_custkey % 4 WHEN 0 THEN '2024-01-05 10:11:12' WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2023-12-31' ELSE 'soon' END AS w, CASE c_custkey % 5 WHEN 0 THEN '+91 98765 43210' WHEN 1 THEN '12-34' WHEN 2 THEN '9876543210' WHEN 3 THEN 'none' ELSE '+44 20 7946 0958' END AS ph,
  CASE c_custkey % 4 WHEN 0 THEN ' Ann@Mail.Example ' WHEN 1 THEN 'ann' WHEN 2 THEN 'ann@mail' ELSE NULL END AS em FROM customer)"""


def _dirty(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pick = lambda n, *values: F.element_at(F.array(*values), (F.col("c_custkey") % n + 1).cast("int"))
    lit, none = F.lit, F.lit(None).cast("string")
    return c.select("c_custkey", pick(6, F.concat(lit("  "), "c_name", lit(" ")), lit("NULL"), lit(" n/a "), lit(""), F.col("c_name"), none).alias("t"), pick(4, lit("2024-01-05 10:11:12"), lit("2024-02-30"), lit("2023-12-31"), lit("soon")).alias("w"),
                    pick(5, lit("+91 98765 43210"), lit("12-34"), lit("9876543210"), lit("none"), lit("+44 20 7946 0958")).alias("ph"), pick(4, lit(" Ann@Mail.Example "), lit("ann"), lit("ann@mail"), none).alias("em"))


@query(f"WITH {DIRTY} SELECT c_custkey, try_cast(w AS TIMESTAMP) IS NOT NULL AS parseable FROM dirty")
def parseability_flags(spark, sf_dir):
    return _dirty(spark, sf_dir).select("c_custkey", T.parse_datetime(F.col("w")).isNotNull().alias("parseable"))


@query(f"WITH {DIRTY} SELECT c_custkey, CASE WHEN lower(trim(t)) NOT IN ('', 'null', 'none', 'nil', 'n/a', 'na') THEN trim(t) END AS cleaned, nullif(trim(t), '') AS trimmed FROM dirty")
def clean_text_variants(spark, sf_dir):
    return _dirty(spark, sf_dir).select("c_custkey", T.clean_text(F.col("t")).alias("cleaned"), T.trimmed(F.col("t")).alias("trimmed"))


@query(f"""WITH {DIRTY}, g AS (SELECT *, regexp_replace(ph, '[^0-9]', '', 'g') AS dg FROM dirty) SELECT c_custkey, nullif(CASE WHEN length(dg) > 10 AND dg LIKE '91%' THEN right(dg, 10) ELSE dg END, '') AS local,
  CASE WHEN length(dg) >= 7 THEN CASE WHEN ph LIKE '+%' THEN '+' ELSE '' END || dg END AS international, CASE WHEN length(dg) >= 10 THEN right(dg, 10) ELSE dg END AS last10 FROM g""")
def phone_variants(spark, sf_dir):
    ph = F.col("ph")
    return _dirty(spark, sf_dir).select("c_custkey", T.phone_local(ph).alias("local"), T.phone_international(ph).alias("international"), T.phone_last10(ph).alias("last10"))


@query(f"WITH {DIRTY} SELECT c_custkey, CASE WHEN em LIKE '%@%' THEN lower(trim(em)) END AS loose, CASE WHEN regexp_matches(trim(em), '^[^@]+@.*\\..*$') THEN lower(trim(em)) END AS strict FROM dirty")
def email_variants(spark, sf_dir):
    return _dirty(spark, sf_dir).select("c_custkey", T.email_loose(F.col("em")).alias("loose"), T.email_strict(F.col("em")).alias("strict"))


@query("""SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS alnum, replace(lower(p_brand || '-X'), '-', '') AS dashless, trim(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def identifier_variants(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.identifier(b).alias("alnum"), T.campaign_dashless(F.concat(b, F.lit("-X"))).alias("dashless"), T.slug(F.concat(b, F.lit(" / "), "p_type")).alias("slug"))


@query(f"WITH {DIRTY} SELECT c_custkey, CAST(try_cast(w AS TIMESTAMP) AS DATE) AS day, CASE c_custkey % 4 WHEN 0 THEN '2024-01-05 10:11:12' WHEN 2 THEN '2023-12-31 00:00:00' END AS iso FROM dirty")
def parse_datetime_variants(spark, sf_dir):
    return _dirty(spark, sf_dir).select("c_custkey", F.to_date(T.parse_datetime(F.col("w"))).alias("day"), T.iso_datetime(F.col("w")).alias("iso"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'In Progress' END AS state FROM orders""")
def status_map(spark, sf_dir):
    spelled = F.when(F.col("o_orderstatus") == "F", "Course_Completed").when(F.col("o_orderstatus") == "P", " in-progress ").otherwise("whatever")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.course_state(spelled).alias("state"))


@query("""SELECT event_id, event_type = 'purchase' AS reminder, event_type = 'click' AS patient_education, event_type = 'view' AS doctor_education FROM events""")
def event_classify(spark, sf_dir):
    e = F.col("event_type")
    action = F.when(e == "purchase", "reminder_sent").when(e == "click", "PATIENT_EDU").otherwise("none")
    flags = T.metric_flags(F.when(e == "view", "doctor_edu_click").otherwise(e), action)
    return table(spark, sf_dir, "events").select("event_id", flags.alias("f")).select("event_id", "f.*")


FOLLOW = """f AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d1, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 14 END AS d2, CAST(o_orderdate AS DATE) AS first_d, CAST(o_orderkey % 4 AS INTEGER) AS n FROM orders),
x AS (SELECT id, d1 AS due, 1 AS sequence, 'explicit' AS method FROM f UNION ALL SELECT id, d2, 2, 'explicit' FROM f WHERE d2 IS NOT NULL UNION ALL SELECT id, due, sequence, 'derived' FROM (SELECT id, d1, d2, first_d + CAST((i - 1) * 7 AS INTEGER) AS due, CAST(i AS INTEGER) AS sequence FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM f)) WHERE due <> d1 AND (d2 IS NULL OR due <> d2))"""


@query(f"WITH {FOLLOW} SELECT * FROM x")
def followup_explode(spark, sf_dir):
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    dates = T.follow_ups([day, F.when(k % 2 == 0, F.date_add(day, 14))], day, F.lit(7), k % 4, F.lit("Days"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.explode_outer(dates).alias("x")).select("id", "x.*")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), event_type) AS picked FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.picked(T.json_fields(F.col("props")), F.col("event_type"), "missing", "k").alias("picked"))


@query("SELECT c_custkey, md5(c_name || ':' || c_mktsegment) AS m, sha256(c_name || '|' || c_mktsegment) AS s FROM customer")
def hash_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.joined_hash("md5", ":", F.col("c_name"), F.lit(""), F.col("c_mktsegment")).alias("m"), T.joined_hash("sha2", "|", F.col("c_name"), F.col("c_mktsegment")).alias("s"))


@query(f"WITH {ACT} SELECT event_id FROM act WHERE campaign IN ('C1', 'C2')")
def campaign_allowlist(spark, sf_dir):
    allowed = activity(spark, sf_dir).where("campaign <> 'C0'").select(F.concat(F.lit("c-"), F.right("campaign", F.lit(1))).alias("campaign")).distinct()
    return P.allow_campaigns(activity(spark, sf_dir), allowed, ["campaign"]).select("event_id")


@query(f"""WITH {DOC}, r AS (SELECT lower(email) AS email, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone, 'c' || (doctor % 2) AS campaign FROM doc WHERE doctor % 50 = 0), p AS (SELECT doctor, 'c' || (doctor % 3) AS campaign, lower(email) AS email, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone FROM doc)
  SELECT doctor FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.email = p.email OR r.phone = p.phone) OR EXISTS (SELECT 1 FROM r WHERE (r.email = p.email OR r.phone = p.phone) AND r.campaign = p.campaign)""")
def person_rules(spark, sf_dir):
    d = doctors(spark, sf_dir)
    rules = d.where("doctor % 50 = 0").select("email", "phone", F.concat(F.lit("C-"), (F.col("doctor") % 2).cast("string")).alias("campaign"))
    rows = d.select("doctor", F.concat(F.lit("C"), (F.col("doctor") % 3).cast("string")).alias("campaign"), "email", "phone")
    return P.person_visible(rows, rules, "doctor", "campaign", "email", "phone").select("doctor")


@query(f"WITH {ACT} SELECT event_id FROM act WHERE doctor % 4 <> 1")
def visibility_hide(spark, sf_dir):
    a = activity(spark, sf_dir)
    return P.visible(a, a.where("doctor % 4 = 1"), "doctor", "hide").select("event_id")


@query(f"WITH {ACT} SELECT event_id FROM act WHERE doctor % 4 = 1")
def visibility_keep_only(spark, sf_dir):
    a = activity(spark, sf_dir)
    return P.visible(a, a.where("doctor % 4 = 1"), "doctor", "keep_only").select("event_id")


@query(f"WITH {ACT}, {DOC} SELECT doctor, state FROM doc WHERE doctor IN (SELECT doctor FROM act WHERE event_type = 'error')")
def dim_prune(spark, sf_dir):
    return P.prune(doctors(spark, sf_dir), activity(spark, sf_dir).where("event_type = 'error'"), "doctor").select("doctor", "state")


@query(f"""WITH {DOC}, p AS (SELECT *, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS ph FROM doc), r AS (SELECT DISTINCT ph, CASE WHEN doctor % 20 = 0 THEN NULL ELSE rep END AS rep FROM p WHERE doctor % 10 = 0)
  SELECT doctor FROM p WHERE ph NOT IN (SELECT ph FROM r WHERE rep IS NULL) AND (ph NOT IN (SELECT ph FROM r WHERE rep IS NOT NULL) OR EXISTS (SELECT 1 FROM r WHERE r.ph = p.ph AND r.rep = p.rep))""")
def roster_correction(spark, sf_dir):
    d = doctors(spark, sf_dir)
    rules = d.where("doctor % 10 = 0").select("phone", F.when(F.col("doctor") % 20 != 0, F.col("rep")).alias("rep"))
    return P.keep_with_rep(d, rules, "phone", "rep").select("doctor")


@query(f"WITH {ACT} SELECT event_type AS issue, campaign, count(*) AS n FROM act WHERE k < 50 GROUP BY ALL")
def dq_counts(spark, sf_dir):
    return activity(spark, sf_dir).where("k < 50").groupBy(F.col("event_type").alias("issue"), "campaign").agg(F.count("*").alias("n"))


SNAP = """a AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'moved' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 3 <> 0)"""


def _snapshots(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.where("c_custkey % 5 <> 0").select(k.alias("k"), F.col("c_mktsegment").alias("m")), c.where("c_custkey % 3 <> 0").select(k.alias("k"), F.when(k % 7 == 0, "moved").otherwise(F.col("c_mktsegment")).alias("m"))


@query(f"WITH {SNAP} SELECT a.k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'changed' END AS change FROM a LEFT JOIN b ON a.k = b.k WHERE b.k IS NULL OR a.m <> b.m")
def preservation_diff(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    return R.preservation_diff(a, b, ["k"], ["m"])


@query(f"WITH {SNAP} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.m IS NOT DISTINCT FROM b.m THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k")
def snapshot_full_diff(spark, sf_dir):
    return R.snapshot_diff(*_snapshots(spark, sf_dir), "k", ["m"])


@query(f"""WITH {SNAP} SELECT a.k, CASE WHEN b.k IS NULL THEN 'ALREADY_ABSENT' WHEN a.m <> b.m THEN 'GUARD_BLOCKED' ELSE 'PENDING' END AS status FROM a LEFT JOIN b ON a.k = b.k""")
def cleanup_manifest_status(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    j = a.join(b.withColumnRenamed("m", "now"), "k", "left")
    return j.select("k", F.when(F.col("now").isNull(), "ALREADY_ABSENT").when(F.col("m") != F.col("now"), "GUARD_BLOCKED").otherwise("PENDING").alias("status"))


@query(f"WITH {SNAP} SELECT count(*) AS source_rows, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.m = a.m)) AS mapped, CASE WHEN bool_and(EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.m = a.m)) THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS status FROM a")
def migration_validation(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    hashed = lambda df: df.select(T.row_hash(F.col("k"), F.col("m")).alias("h"))
    j = hashed(a).join(hashed(b).distinct().withColumn("found", F.lit(True)), "h", "left")
    all_found = F.bool_and(F.coalesce("found", F.lit(False)))
    return j.agg(F.count("*").alias("source_rows"), F.count("found").alias("mapped"), F.when(all_found, "SUCCESS").otherwise("PARTIAL_SUCCESS").alias("status"))
