"""Visibility rules over a portal's tables: what is left of each, and what rules can be made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.operators.visibility import Ref, apply_rules, options, rule_value
from pulsefield.plans.base import DOC, doctors, query
from pulsefield.session import table

#: Which columns say what a row is about. Some are of other versions of a table and aren't there.
IDENTIFIERS = {
    "campaign": {"shares": ("campaign", "campaign_uuid"), "banners": ("campaign",)},
    "doctor": {"doctors": ("doctor", "email", "phone"), "shares": ("doctor_id", "recipient"), "banners": ("doctor_id",)},
    "field_rep": {"doctors": ("rep",), "reps": ("rep_id", "supplied_id")},
    "content": {"videos": ("id", "code"), "playbacks": ("video_code", "video_name")},
    "share": {"shares": ("share_id", "public_id"), "playbacks": ("share_id",)},
    "activity": {"banners": ("id",), "playbacks": ("id",)},
}
REFS = [Ref("shares", "doctor_id", "doctors", "doctor"), Ref("banners", "doctor_id", "doctors", "doctor"), Ref("playbacks", "share_id", "shares", "share_id"), Ref("playbacks", "video_code", "videos", "code")]


def portal(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o, li, e, s, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events", "supplier", "part"))
    campaign = lambda c, n: F.concat(F.lit("C-"), (F.col(c) % n).cast("string"))
    return {
        "doctors": doctors(spark, sf_dir).select(F.col("doctor").alias("id"), "doctor", "rep", "email", "phone"),
        "shares": o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("share_id"), F.col("o_custkey").alias("doctor_id"), campaign("o_orderkey", 7).alias("campaign"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("public_id")),
        "playbacks": li.select((F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("share_id"), F.concat(F.lit("V-"), F.col("l_partkey").cast("string")).alias("video_code")),
        "banners": e.select(F.col("event_id").alias("id"), F.col("user_id").alias("doctor_id"), campaign("user_id", 3).alias("campaign")),
        "reps": s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("rep_id"), F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("supplied_id")),
        "videos": p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("V-"), F.col("p_partkey").cast("string")).alias("code")),
    }


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the portal, one that isn't active and one of another system among them."""
    c, o, e, s, p = (table(spark, sf_dir, t) for t in ("customer", "orders", "events", "supplier", "part"))
    row = lambda df, entity, scope, mode, value, system="pe", active=True: df.select(F.lit(system).alias("system"), F.lit(entity).alias("entity"), F.lit(scope).cast("string").alias("scope"), F.lit(mode).alias("mode"), value.cast("string").alias("value"), F.lit(active).alias("active"))
    phone = F.concat(F.lit("919-"), F.lpad(F.expr("c_custkey div 3").cast("string"), 9, "0"))
    one = spark.range(1)
    parts = [
        row(c.where("c_acctbal < -900"), "doctor", None, "hide", phone),
        row(one, "campaign", None, "hide", F.lit(" c-2 ")),
        row(one, "field_rep", "doctors", "hide", F.lit("R3")),
        row(s.where("s_acctbal < 0"), "field_rep", "reps", "hide", F.concat(F.lit("f"), F.col("s_suppkey").cast("string"))),
        row(p.where("p_size = 50"), "content", "videos", "hide", F.col("p_partkey")),
        row(o.where("o_totalprice > 450000"), "share", None, "hide", F.col("o_orderkey")),
        row(e.where("event_type = 'error'"), "activity", "banners", "hide", F.col("event_id")),
        row(spark.range(6), "campaign", "shares", "keep_only", F.concat(F.lit("C"), F.col("id").cast("string"))),
        row(one, "campaign", None, "hide", F.lit("C-0"), active=False),
        row(one, "campaign", None, "hide", F.lit("C-1"), system="sapa"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"""WITH {DOC}, hp AS (SELECT DISTINCT c_custkey // 3 AS g FROM customer WHERE c_acctbal < -900),
d AS (SELECT doctor, (doctor // 3) IN (SELECT g FROM hp) OR rep = 'R3' AS hidden FROM doc),
s AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % 7 IN (2, 6) OR o_totalprice > 450000 OR coalesce(d.hidden, false) AS hidden FROM orders LEFT JOIN d ON d.doctor = o_custkey),
v AS (SELECT p_partkey AS id, p_size = 50 AS hidden FROM part),
k AS (SELECT l_orderkey * 100000 + l_partkey AS id, coalesce(s.hidden, false) OR coalesce(v.hidden, false) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) AS hidden FROM lineitem LEFT JOIN s ON s.id = l_orderkey LEFT JOIN v ON v.id = l_partkey),
b AS (SELECT event_id AS id, user_id % 3 = 2 OR event_type = 'error' OR coalesce(d.hidden, false) AS hidden FROM events LEFT JOIN d ON d.doctor = user_id)
SELECT 'doctors' AS part, doctor AS id FROM d WHERE NOT hidden UNION ALL SELECT 'shares', id FROM s WHERE NOT hidden UNION ALL SELECT 'videos', id FROM v WHERE NOT hidden
UNION ALL SELECT 'playbacks', id FROM k WHERE NOT hidden UNION ALL SELECT 'banners', id FROM b WHERE NOT hidden UNION ALL SELECT 'reps', s_suppkey FROM supplier WHERE NOT s_acctbal < 0""")
def visible_rows(spark, sf_dir):
    """The rows of all tables that the rules leave, hidden doctors, shares and videos taking what belongs to them along."""
    left = apply_rules(portal(spark, sf_dir), rule_rows(spark, sf_dir), IDENTIFIERS, REFS, "pe")
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("part"), "id") for name, df in left.items()])


@query("""SELECT entity, count(*) AS rules, count(DISTINCT v) AS identifiers FROM (
  SELECT 'doctor' AS entity, c_custkey // 3 AS v FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'campaign', unnest([-1, -2, -3, -4, -5, -6, -7]) UNION ALL SELECT 'field_rep', -1 UNION ALL SELECT 'field_rep', s_suppkey FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'content', p_partkey FROM part WHERE p_size = 50 UNION ALL SELECT 'share', o_orderkey FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT 'activity', event_id FROM events WHERE event_type = 'error') GROUP BY entity""")
def visibility_options(spark, sf_dir):
    """The active rules of each kind that some table of the portal has a column for, by the catalogue of options."""
    found = spark.createDataFrame(options(portal(spark, sf_dir), IDENTIFIERS, "pe"), "system string, part string, entity string, column string, present boolean")
    kinds = found.where("present").select("entity").distinct()
    rules = rule_rows(spark, sf_dir).where("system = 'pe' and active").join(kinds, "entity", "left_semi")
    # A campaign that is hidden everywhere and one that is kept in a table are two identifiers of their kind.
    named = F.concat_ws("|", F.coalesce("scope", F.lit("")), rule_value(F.col("value")))
    return rules.groupBy("entity").agg(F.count("*").alias("rules"), F.count_distinct(named).alias("identifiers"))
