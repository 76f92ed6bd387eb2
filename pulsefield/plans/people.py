"""Identity and attribution queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pulsefield.functions.text import email_loose, identifier, joined_hash, key_variants, phone_local
from pulsefield.operators import matching as J
from pulsefield.operators.metrics import Window
from pulsefield.operators.rows import latest_by, overlay_by_freshness, survivor_merge
from pulsefield.plans.base import ACT, DOC, activity, doctors, query
from pulsefield.session import table

REPS = """reps AS (
  SELECT 'supplier' AS source, 1 AS priority, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS key, s_suppkey AS seq, CASE WHEN s_suppkey % 3 <> 0 THEN n_name END AS state, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'orders', 2, 'supplier' || lpad(CAST(o_custkey % 60 AS VARCHAR), 9, '0'), o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'NATION_' || (o_custkey % 25) END, o_totalprice FROM orders
)"""


def _reps(spark, sf_dir):
    s, n, o = (table(spark, sf_dir, t) for t in ("supplier", "nation", "orders"))
    a = s.join(n, s.s_nationkey == n.n_nationkey).select(F.lit("supplier").alias("source"), F.lit(1).alias("priority"), identifier(F.col("s_name")).alias("key"), F.col("s_suppkey").alias("seq"), F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name")).alias("state"), F.col("s_acctbal").alias("balance"))
    key = F.concat(F.lit("supplier"), F.lpad((F.col("o_custkey") % 60).cast("string"), 9, "0"))
    b = o.select(F.lit("orders").alias("source"), F.lit(2).alias("priority"), key.alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string"))).alias("state"), F.col("o_totalprice").alias("balance"))
    return a.unionByName(b)


@query(f"WITH {REPS} SELECT key, source, state, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN state IS NULL THEN 1 ELSE 0 END, priority, seq DESC) AS n FROM reps) WHERE n = 1")
def rep_union_survivor(spark, sf_dir):
    return latest_by(_reps(spark, sf_dir), ["key"], [F.col("state").isNull().cast("int"), F.col("priority"), F.desc("seq")]).select("key", "source", "state", "seq")


@query(f"""WITH {REPS} SELECT key, arg_min(source, (priority, -seq)) AS source, arg_min(state, (priority, -seq)) FILTER (WHERE state IS NOT NULL) AS state, bool_or(balance < 0) AS in_debt, min(seq) AS first_seq, max(seq) AS last_seq FROM reps GROUP BY key""")
def survivor_fill(spark, sf_dir):
    r = _reps(spark, sf_dir).withColumn("in_debt", F.col("balance") < 0).withColumn("first_seq", F.col("seq")).withColumn("last_seq", F.col("seq"))
    return survivor_merge(r, ["key"], [F.col("priority"), F.desc("seq")], ["source", "state"], ["in_debt"], ["first_seq"], ["last_seq"])


@query("""WITH v AS (SELECT s_suppkey AS rep, lower(s_name) AS t FROM supplier), x AS (SELECT rep, unnest(list_distinct([t, regexp_replace(t, '[-_ ]', '', 'g'), regexp_replace(t, '[- ]', '_', 'g'), regexp_replace(t, '[_ ]', '-', 'g'), regexp_replace(t, '[^a-z0-9]', '', 'g')])) AS alias FROM v)
  SELECT alias, min(rep) AS rep, count(DISTINCT rep) AS reps FROM x GROUP BY alias""")
def alias_map(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rep"), F.explode_outer(key_variants(F.col("s_name"))).alias("alias"))
    return s.groupBy("alias").agg(F.min("rep").alias("rep"), F.count_distinct("rep").alias("reps"))


@query(f"""WITH {DOC}, al AS (SELECT email AS alias, doctor, 1 AS rank FROM doc UNION ALL SELECT phone, doctor, 2 FROM doc), q AS (SELECT DISTINCT email, phone FROM doc)
  SELECT q.email, q.phone, (SELECT doctor FROM al WHERE alias IN (q.email, q.phone) ORDER BY rank, doctor LIMIT 1) AS doctor FROM q""")
def alias_best_lookup(spark, sf_dir):
    d = doctors(spark, sf_dir)
    best = lambda c: d.groupBy(F.col(c).alias(f"k_{c}")).agg(F.min("doctor").alias(f"v_{c}"))
    q = d.select("email", "phone").distinct()
    return q.join(best("email"), F.col("email") == F.col("k_email"), "left").join(best("phone"), F.col("phone") == F.col("k_phone"), "left").select("email", "phone", F.coalesce("v_email", "v_phone").alias("doctor"))


@query("""WITH m AS (SELECT p_name AS collateral, p_brand AS campaign FROM part) SELECT collateral, count(DISTINCT campaign) AS campaigns, CASE WHEN count(DISTINCT campaign) <= 1 THEN 'PASS' ELSE 'FAIL' END AS dq FROM m GROUP BY collateral""")
def campaign_map_dq(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("collateral")).agg(F.count_distinct("p_brand").alias("campaigns"))
    return m.withColumn("dq", F.when(F.col("campaigns") <= 1, "PASS").otherwise("FAIL"))


@query(f"""WITH {ACT}, {DOC}, u AS (SELECT doctor, 0 AS src FROM doc WHERE doctor % 2 = 0 UNION ALL SELECT doctor, 1 FROM act WHERE event_type = 'view' UNION ALL SELECT doctor + 100000, 2 FROM act WHERE event_type = 'click' AND doctor % 7 = 0)
  SELECT u.doctor, min(src) AS source, md5('base:' || u.doctor) AS doctor_key, coalesce(any_value(state), 'Unmapped') AS state FROM u LEFT JOIN doc ON u.doctor = doc.doctor GROUP BY u.doctor""")
def doctor_base_union(spark, sf_dir):
    a, d = activity(spark, sf_dir), doctors(spark, sf_dir).select("doctor", "state")
    parts = [d.where("doctor % 2 = 0").select("doctor", F.lit(0).alias("source")), a.where("event_type = 'view'").select("doctor", F.lit(1).alias("source")), a.where("event_type = 'click' and doctor % 7 = 0").select((F.col("doctor") + 100000).alias("doctor"), F.lit(2).alias("source"))]
    u = reduce(lambda x, y: x.unionByName(y), parts).groupBy("doctor").agg(F.min("source").alias("source"))
    return u.join(d, "doctor", "left").select("doctor", "source", joined_hash("md5", ":", F.lit("base"), F.col("doctor")).alias("doctor_key"), F.coalesce("state", F.lit("Unmapped")).alias("state"))


@query("""WITH a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS name, CAST(s_nationkey AS VARCHAR) AS zone, s_suppkey % 10 AS fresh FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey AS id, 'new ' || s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Z' END AS zone, s_suppkey % 7 AS fresh FROM supplier WHERE s_suppkey % 6 <> 0)
  SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.fresh >= a.fresh OR a.fresh IS NULL THEN coalesce(nullif(b.name, ''), nullif(a.name, '')) ELSE coalesce(nullif(a.name, ''), nullif(b.name, '')) END AS name, CASE WHEN b.fresh >= a.fresh OR a.fresh IS NULL THEN coalesce(b.zone, a.zone) ELSE coalesce(a.zone, b.zone) END AS zone,
    greatest(a.fresh, b.fresh) AS fresh FROM a FULL JOIN b ON a.id = b.id""")
def freshness_merge(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    a = s.where("s_suppkey % 5 <> 0").select(k.alias("id"), F.when(k % 4 == 0, "").otherwise(F.col("s_name")).alias("name"), F.col("s_nationkey").cast("string").alias("zone"), (k % 10).alias("fresh"))
    b = s.where("s_suppkey % 6 <> 0").select(k.alias("id"), F.concat(F.lit("new "), "s_name").alias("name"), F.when(k % 3 != 0, "Z").alias("zone"), (k % 7).alias("fresh"))
    return overlay_by_freshness(a, b, ["id"], ["name", "zone"], "fresh")


@query(f"WITH {REPS} SELECT key, arg_max(state, (priority * -1, seq)) FILTER (WHERE state IS NOT NULL) AS state FROM reps GROUP BY key")
def latest_known_state(spark, sf_dir):
    known = F.when(F.col("state").isNotNull(), F.struct(-F.col("priority"), "seq"))
    return _reps(spark, sf_dir).groupBy("key").agg(F.max_by("state", known).alias("state"))


@query("""WITH t AS (SELECT p_brand AS campaign, p_name AS collateral, 0 AS tier, CAST(p_size AS BIGINT) AS start_n, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 5 END AS end_n, p_partkey AS seq FROM part UNION ALL SELECT p_brand, p_type, 1, CAST(p_size AS BIGINT), p_size + 1, p_partkey FROM part)
  SELECT campaign, collateral, tier, start_n, CAST(end_n AS BIGINT) AS end_n, seq FROM (SELECT *, row_number() OVER (PARTITION BY campaign, collateral ORDER BY CASE WHEN end_n IS NULL THEN 1 ELSE 0 END, tier, seq) AS n FROM t) WHERE n = 1""")
def schedule_priority_build(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("bigint")
    one = p.select(F.col("p_brand").alias("campaign"), F.col("p_name").alias("collateral"), F.lit(0).alias("tier"), size.alias("start_n"), F.when(F.col("p_partkey") % 3 != 0, size + 5).alias("end_n"), F.col("p_partkey").alias("seq"))
    two = p.select(F.col("p_brand").alias("campaign"), F.col("p_type").alias("collateral"), F.lit(1).alias("tier"), size.alias("start_n"), (size + 1).alias("end_n"), F.col("p_partkey").alias("seq"))
    return latest_by(one.unionByName(two), ["campaign", "collateral"], [F.col("end_n").isNull().cast("int"), F.col("tier"), F.col("seq")])


@query(f"""WITH {DOC}, r AS (SELECT 'C' || doctor % 3 AS campaign, rep, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone, doctor, CASE WHEN doctor % 4 = 0 THEN 0 ELSE 1 END AS tier FROM doc)
  SELECT campaign, rep, phone, doctor FROM (SELECT *, row_number() OVER (PARTITION BY campaign, rep, phone ORDER BY tier, doctor) AS n FROM r) WHERE n = 1""")
def roster_priority_dedup(spark, sf_dir):
    r = doctors(spark, sf_dir).select(F.concat(F.lit("C"), (F.col("doctor") % 3).cast("string")).alias("campaign"), "rep", phone_local(F.col("phone")).alias("phone"), "doctor", F.when(F.col("doctor") % 4 == 0, 0).otherwise(1).alias("tier"))
    return latest_by(r, ["campaign", "rep", "phone"], [F.col("tier"), F.col("doctor")]).drop("tier")


CASC = DOC + """, master AS (SELECT doctor, lower(email) AS email, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone FROM doc WHERE doctor % 2 = 0),
ev AS (SELECT doctor AS ev, CASE WHEN doctor % 5 = 0 THEN doctor END AS ref, lower(email) AS email, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone FROM doc),
ue AS (SELECT email, min(doctor) AS doctor FROM master GROUP BY email HAVING count(DISTINCT doctor) = 1), up AS (SELECT phone, min(doctor) AS doctor FROM master GROUP BY phone HAVING count(DISTINCT doctor) = 1)"""


@query(f"""WITH {CASC} SELECT ev, coalesce(m.doctor, ue.doctor, up.doctor) AS doctor, CASE WHEN m.doctor IS NOT NULL THEN 'id' WHEN ue.doctor IS NOT NULL THEN 'email' WHEN up.doctor IS NOT NULL THEN 'phone' ELSE 'none' END AS basis
  FROM ev LEFT JOIN master m ON m.doctor = ev.ref LEFT JOIN ue ON ue.email = ev.email LEFT JOIN up ON up.phone = ev.phone""")
def unique_match_cascade(spark, sf_dir):
    d = doctors(spark, sf_dir)
    contacts = [email_loose(F.col("email")).alias("email"), phone_local(F.col("phone")).alias("phone")]
    master = d.where("doctor % 2 = 0").select("doctor", *contacts)
    ev = d.select(F.col("doctor").alias("ev"), F.when(F.col("doctor") % 5 == 0, F.col("doctor")).alias("ref"), *contacts)
    steps = [("ref", master.select(F.col("doctor").alias("ref"), "doctor"), "id"), ("email", J.unique_keys(master, "email", "doctor"), "email"), ("phone", J.unique_keys(master, "phone", "doctor"), "phone")]
    return J.match_cascade(ev, steps, "doctor").select("ev", "doctor", "basis")


SCORED = DOC + """, cand AS (SELECT a.doctor AS ev, b.doctor AS cand, 95 AS score FROM doc a JOIN doc b ON lower(a.email) = lower(b.email) UNION ALL SELECT a.doctor, b.doctor, 90 + CASE WHEN a.rep = b.rep THEN 5 ELSE 0 END FROM doc a JOIN doc b ON a.phone = b.phone),
best AS (SELECT ev, cand, max(score) AS score FROM cand GROUP BY ev, cand), top AS (SELECT ev, max(score) AS score FROM best GROUP BY ev)"""


@query(f"""WITH {SCORED}, r AS (SELECT t.ev, t.score, count(*) AS n, min(cand) AS cand FROM top t JOIN best b ON b.ev = t.ev AND b.score = t.score GROUP BY t.ev, t.score)
  SELECT doctor AS ev, CASE WHEN n = 1 THEN cand END AS cand, score, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM doc LEFT JOIN r ON r.ev = doc.doctor""")
def scored_identity(spark, sf_dir):
    d = doctors(spark, sf_dir).select("doctor", email_loose(F.col("email")).alias("email"), "phone", "rep")
    people = d.withColumnRenamed("doctor", "cand")
    return J.scored_matches(d.withColumnRenamed("doctor", "ev"), people, "ev", "cand", [(95, ["email"]), (95, ["phone", "rep"]), (90, ["phone"])])


DIMS = """ev AS (SELECT o_orderkey AS ev, o_custkey // 3 AS id, CAST(o_orderdate AS DATE) AS at_d FROM orders), dim AS (SELECT p_partkey AS dim, p_partkey // 3 AS id, DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) AS start_d, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 + 200 AS INTEGER) END AS end_d FROM part)"""


def _dims(spark, sf_dir):
    ev = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ev"), F.expr("o_custkey div 3").alias("id"), F.to_date("o_orderdate").alias("at"))
    p = table(spark, sf_dir, "part")
    day = (F.col("p_partkey") * 37 % 2400).cast("int")
    start = F.date_add(F.lit("1995-01-01").cast("date"), day)
    return ev, p.select(F.col("p_partkey").alias("dim"), F.expr("p_partkey div 3").alias("id"), start.alias("start_d"), F.when(F.col("p_partkey") % 5 != 0, F.date_add(start, 200)).alias("end_d"))


@query(f"""WITH {DIMS}, t AS (SELECT ev.*, dim, start_d, CASE WHEN start_d <= at_d AND (end_d IS NULL OR at_d <= end_d) THEN 0 WHEN start_d <= at_d THEN 1 ELSE 2 END AS tier FROM ev LEFT JOIN dim ON ev.id = dim.id)
  SELECT ev, dim, tier FROM (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY tier, CASE WHEN tier = 2 THEN start_d END, CASE WHEN tier < 2 THEN start_d END DESC, CASE WHEN tier = 2 THEN dim END, dim DESC) AS n FROM t) WHERE n = 1""")
def asof_dimension(spark, sf_dir):
    ev, dim = _dims(spark, sf_dir)
    return J.asof_dimension(ev, dim, "id", "ev", "at", "start_d", "end_d", "dim").select("ev", "dim", "tier")


@query(f"""WITH {DIMS} SELECT ev.ev, CASE WHEN count(DISTINCT dim) = 1 THEN min(dim) END AS dim, CASE count(DISTINCT dim) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS match FROM ev LEFT JOIN dim ON ev.id = dim.id AND start_d <= at_d AND (end_d IS NULL OR at_d <= end_d) GROUP BY ev.ev""")
def single_active_campaign(spark, sf_dir):
    ev, dim = _dims(spark, sf_dir)
    return J.single_active(ev, dim, ["id"], "ev", "at", "start_d", "end_d", "dim").select("ev", "dim", "match")


@query(f"""WITH {DIMS} SELECT ev.ev, dim.dim AS campaign FROM ev JOIN dim ON ev.id = dim.id WHERE start_d <= at_d AND (end_d IS NULL OR at_d <= end_d)""")
def login_campaigns(spark, sf_dir):
    ev, dim = _dims(spark, sf_dir)
    return ev.join(dim, "id").where((F.col("start_d") <= F.col("at")) & (F.col("end_d").isNull() | (F.col("at") <= F.col("end_d")))).select("ev", F.col("dim").alias("campaign"))


CLICK = ACT + """, buy AS (SELECT event_id, doctor, ts FROM act WHERE event_type = 'purchase'), clk AS (SELECT doctor, ts AS cts, 'K' || (k % 2) AS banner FROM act WHERE event_type <> 'purchase'),
m AS (SELECT b.event_id, min(banner) AS lo, max(banner) AS hi FROM buy b LEFT JOIN clk c ON c.doctor = b.doctor AND c.cts <= b.ts AND c.cts >= b.ts - INTERVAL 600 MINUTE GROUP BY b.event_id)"""


def _clicks(spark, sf_dir):
    a = activity(spark, sf_dir)
    buy = a.where("event_type = 'purchase'").select("event_id", "doctor", "campaign", "ts", "k")
    return a, buy, a.where("event_type <> 'purchase'").select("doctor", F.col("ts").alias("cts"), F.concat(F.lit("K"), (F.col("k") % 2).cast("string")).alias("banner"))


@query(f"WITH {CLICK} SELECT event_id, CASE WHEN lo = hi THEN lo END AS banner, CASE WHEN lo IS NULL THEN 'none' WHEN lo = hi THEN 'unique' ELSE 'ambiguous' END AS match FROM m")
def click_window(spark, sf_dir):
    _, buy, clk = _clicks(spark, sf_dir)
    return J.unique_within(buy, clk, ["doctor"], "event_id", "ts", "cts", "banner", 600).select("event_id", "banner", "match")


@query(f"""WITH {CLICK} SELECT b.event_id, CASE WHEN b.k < 20 THEN 'direct' WHEN m.lo IS NOT NULL AND m.lo <> m.hi THEN NULL WHEN m.lo IS NOT NULL THEN m.lo WHEN b.k < 60 THEN 'content' || (b.k % 4) END AS target,
  CASE WHEN b.k < 20 THEN 'source_uuid' WHEN m.lo IS NOT NULL AND m.lo <> m.hi THEN 'ambiguous_window' WHEN m.lo IS NOT NULL THEN 'click_window' WHEN b.k < 60 THEN 'content' ELSE 'unattributed' END AS basis FROM act b JOIN m ON m.event_id = b.event_id""")
def share_cascade(spark, sf_dir):
    _, buy, clk = _clicks(spark, sf_dir)
    m = J.unique_within(buy, clk, ["doctor"], "event_id", "ts", "cts", "banner", 600)
    # An ambiguous higher rule blocks the ones below it.
    rules = [(F.col("k") < 20, F.lit("direct"), "source_uuid"), (F.col("match") == "ambiguous", F.lit(None).cast("string"), "ambiguous_window"), (F.col("match") == "unique", F.col("banner"), "click_window"), (F.col("k") < 60, F.concat(F.lit("content"), (F.col("k") % 4).cast("string")), "content")]
    target, basis = F.lit(None).cast("string"), F.lit("unattributed")
    for cond, value, name in reversed(rules):
        target, basis = F.when(cond, value).otherwise(target), F.when(cond, name).otherwise(basis)
    return m.select("event_id", target.alias("target"), basis.alias("basis"))


@query("""WITH ev AS (SELECT l_orderkey * 10 + l_linenumber AS ev, min(o_custkey) AS doctor, CAST(min(l_shipdate) AS DATE) AS at_d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), sh AS (SELECT o_custkey AS doctor, CAST(o_orderdate AS DATE) AS sd, o_orderkey AS share FROM orders)
  SELECT e.ev, (SELECT share FROM sh WHERE sh.doctor = e.doctor AND sd <= at_d AND at_d - sd <= 7 ORDER BY sd DESC, share DESC LIMIT 1) AS share FROM ev e""")
def playback_asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doctor"), F.to_date("o_orderdate").alias("sd"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ev")).agg(F.to_date(F.min("l_shipdate")).alias("at"))
    ev = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "doctor"), "l_orderkey")
    return J.latest_within(ev.select("ev", "doctor", "at"), o.select("doctor", "sd", F.col("o_orderkey").alias("share")), ["doctor"], "ev", "at", "sd", "share", 7).select("ev", "share")


@query(f"""WITH {ACT}, {DOC} SELECT doctor, 'roster' AS origin FROM doc WHERE doctor % 3 = 0 UNION ALL SELECT DISTINCT doctor, 'activity' FROM act WHERE doctor NOT IN (SELECT doctor FROM doc WHERE doctor % 3 = 0)""")
def roster_backfill_anti(spark, sf_dir):
    roster = doctors(spark, sf_dir).where("doctor % 3 = 0").select("doctor")
    more = activity(spark, sf_dir).select("doctor").distinct().join(roster, "doctor", "left_anti")
    return roster.withColumn("origin", F.lit("roster")).unionByName(more.withColumn("origin", F.lit("activity")))


@query(f"""WITH {ACT}, e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS src FROM act WHERE event_type IN ('purchase', 'view')) SELECT campaign, collateral, doctor, event_id, src FROM (SELECT *, row_number() OVER (PARTITION BY campaign, collateral, doctor ORDER BY src, ts DESC, event_id DESC) AS n FROM e) WHERE n = 1""")
def evidence_latest(spark, sf_dir):
    e = activity(spark, sf_dir).where("event_type in ('purchase', 'view')").withColumn("src", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    return latest_by(e, ["campaign", "collateral", "doctor"], [F.col("src"), F.desc("ts"), F.desc("event_id")]).select("campaign", "collateral", "doctor", "event_id", "src")


BEST = ACT + ", c AS (SELECT event_id, 'R' || ((k * 7 + i) % 9) AS rep, (k + i) % 3 AS rank FROM act, (VALUES (0), (1), (3)) v(i))"


def _candidates(spark, sf_dir):
    a = activity(spark, sf_dir).select("event_id", "k", F.explode(F.array(*[F.lit(i) for i in (0, 1, 3)])).alias("i"))
    return a.select("event_id", F.concat(F.lit("R"), ((F.col("k") * 7 + F.col("i")) % 9).cast("string")).alias("rep"), ((F.col("k") + F.col("i")) % 3).alias("rank"))


@query(f"""WITH {BEST}, b AS (SELECT event_id, min(rank) AS rank FROM c GROUP BY event_id) SELECT c.event_id, min(rep) AS rep, any_value(c.rank) AS rank FROM c JOIN b ON b.event_id = c.event_id AND b.rank = c.rank GROUP BY c.event_id HAVING count(DISTINCT rep) = 1""")
def unambiguous_best_source(spark, sf_dir):
    return J.unambiguous_best_source(_candidates(spark, sf_dir), "event_id", "rep", "rank")


@query(f"""WITH {BEST}, b AS (SELECT event_id, min(rank) AS rank FROM c GROUP BY event_id), o AS (SELECT c.event_id, min(rep) AS rep FROM c JOIN b ON b.event_id = c.event_id AND b.rank = c.rank GROUP BY c.event_id HAVING count(DISTINCT rep) = 1)
  SELECT coalesce(rep, '__unmapped__') AS rep, count(*) AS n FROM act LEFT JOIN o ON o.event_id = act.event_id GROUP BY 1""")
def unmapped_bucket(spark, sf_dir):
    best = unambiguous_best_source(spark, sf_dir)
    return activity(spark, sf_dir).join(best, "event_id", "left").groupBy(F.coalesce("rep", F.lit("__unmapped__")).alias("rep")).agg(F.count("*").alias("n"))


@query(f"""WITH {ACT}, {DOC}, st AS (SELECT doctor, arg_max('NATION_' || (k % 25), (ts, event_id)) AS seen FROM act WHERE event_type = 'error' GROUP BY doctor)
  SELECT doc.doctor, coalesce(CASE WHEN doc.doctor % 3 = 0 THEN state END, seen, CASE WHEN rep = 'R1' THEN 'NATION_1' END, 'Unmapped') AS state FROM doc LEFT JOIN st ON st.doctor = doc.doctor""")
def state_priority(spark, sf_dir):
    st = activity(spark, sf_dir).where("event_type = 'error'").groupBy("doctor").agg(F.max_by(F.concat(F.lit("NATION_"), (F.col("k") % 25).cast("string")), F.struct("ts", "event_id")).alias("seen"))
    d = doctors(spark, sf_dir).join(st, "doctor", "left")
    return d.select("doctor", F.coalesce(F.when(F.col("doctor") % 3 == 0, F.col("state")), "seen", F.when(F.col("rep") == "R1", F.lit("NATION_1")), F.lit("Unmapped")).alias("state"))


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey // 2 = s_suppkey OR c_custkey = s_suppkey""")
def or_join(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").withColumn("half", F.expr("c_custkey div 2")), table(spark, sf_dir, "supplier")
    return J.union_of_joins(c, s, [("half", "s_suppkey"), ("c_custkey", "s_suppkey")], [F.col("c_custkey"), F.col("s_suppkey")])
