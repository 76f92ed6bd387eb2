"""Ingest and publishing as runs: fall-backs, idempotent appends, logs, snapshots, campaign partitions and the published pointer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.functions.references import json_references
from pulsefield.operators import rows as R
from pulsefield.plans.base import ACT, activity, query
from pulsefield.session import table, work_folder
from pulsefield.sources import ingest as I
from pulsefield.sources import api, sinks, snapshots

SPECS = [
    I.Spec("people", ("people_v2", "customer"), {"c_custkey": "long", "c_name": "string", "c_city": "string"}, ("c_custkey",), bucket_digits=1),
    I.Spec("accounts", ("orders",), {"o_orderkey": "long", "o_custkey": "long", "o_orderdate": "date"}, ("o_orderkey",), watermark="o_orderdate", lookback_days=30, bucket_digits=1),
    I.Spec("purchases", ("events",), {"event_id": "long", "user_id": "long", "event_type": "string"}, ("event_id",), only={"event_type": "purchase"}, bucket_digits=1),
    I.Spec("visits", ("visits_v2",), {"id": "long"}, ("id",), required=False),
]


def _two_runs(spark: SparkSession, sf_dir: str) -> str:
    """The folder of two runs over the same sources; one source of people and all of visits can't be read."""
    root = work_folder(spark, "ingest")
    read = I.retried(lambda name: table(spark, sf_dir, name), times=1)
    for i, run in enumerate(("r1", "r2")):
        I.ingest(spark, SPECS, read, root, run, dt.datetime(2024, 1, 31, i))
    return root


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT 'people' AS step, (SELECT count(*) FROM customer) AS whole, (SELECT count(*) FROM customer) AS again
  UNION ALL SELECT 'accounts', (SELECT count(*) FROM o), (SELECT count(*) FROM o WHERE d >= (SELECT max(d) FROM o) - 30) UNION ALL SELECT 'purchases', (SELECT count(*) FROM events WHERE event_type = 'purchase'), (SELECT count(*) FROM events WHERE event_type = 'purchase'))
SELECT 'r1' AS run_id, step, 'SUCCESS' AS status, whole AS rows_read, whole AS rows_new, CAST(NULL AS BIGINT) AS previous_rows, whole = 0 AS is_stale FROM n
UNION ALL SELECT 'r2', step, 'SUCCESS', again, 0, whole, again = 0 OR again < 0.2 * whole FROM n UNION ALL SELECT unnest(['r1', 'r2']), 'visits', 'FAILED', 0, 0, NULL, true""")
def ingest_runs(spark, sf_dir):
    """The log of two runs: the second reads by watermark, brings nothing new and is measured against the first."""
    log = spark.read.parquet(f"{_two_runs(spark, sf_dir)}/log")
    return log.select("run_id", "step", "status", "rows_read", "rows_new", "previous_rows", "is_stale")


@query("""SELECT unnest(['r1', 'r2']) AS run, 'PARTIAL_SUCCESS' AS status, CAST(4 AS BIGINT) AS steps, CAST(1 AS BIGINT) AS failed""")
def ingest_status(spark, sf_dir):
    log, fine = spark.read.parquet(f"{_two_runs(spark, sf_dir)}/log"), F.col("status") == "SUCCESS"
    status = F.when(F.bool_and(fine), "SUCCESS").when(F.bool_or(fine), "PARTIAL_SUCCESS").otherwise("FAIL")
    return log.groupBy(F.col("run_id").alias("run")).agg(status.alias("status"), F.count("*").alias("steps"), F.count(F.when(~fine, 1)).alias("failed"))


@query("""SELECT event_id, 'r2' AS run_id, CAST(event_id AS VARCHAR) AS row_key FROM events WHERE event_type = 'purchase'""")
def current_snapshot(spark, sf_dir):
    """The raw rows whose key the latest snapshot of their source has."""
    root = _two_runs(spark, sf_dir)
    raw, snapshot = spark.read.parquet(f"{root}/raw/purchases"), snapshots.current(spark, f"{root}/snapshots/purchases")
    key = I.snapshot_key(("event_id",), ["event_id", "user_id", "event_type"])
    return raw.withColumn("row_key", key).join(snapshot.select("row_key", "run_id"), "row_key").select("event_id", "run_id", "row_key")


MOVING = I.Spec("moving", ("orders",), {"o_orderkey": "long", "o_custkey": "long", "o_orderdate": "date", "deleted": "boolean"}, ("o_orderkey",), watermark="o_orderdate", lookback_days=30, gone="deleted", bucket_digits=1)


def _moving_runs(spark: SparkSession, sf_dir: str) -> str:
    """A whole read and then one by watermark, in which the source says of every eleventh order that it is deleted."""
    root = work_folder(spark, "ingest")
    orders = table(spark, sf_dir, "orders")
    for i, (run, deleted) in enumerate((("r1", F.lit(False)), ("r2", F.col("o_orderkey") % 11 == 0))):
        I.ingest(spark, [MOVING], lambda name, d=deleted: orders.withColumn("deleted", d), root, run, dt.datetime(2024, 1, 31, i))
    return root


DELTA = """o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 30 AS again, 'b' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) AS bucket FROM orders)"""


@query(f"""WITH {DELTA} SELECT o_orderkey, CASE WHEN again THEN 'r2' ELSE 'r1' END AS run_id FROM o WHERE NOT (again AND o_orderkey % 11 = 0)""")
def snapshot_after_delta(spark, sf_dir):
    """The orders that are there after a delta of thirty days: all of the whole read, without those that the delta says are deleted."""
    root = _moving_runs(spark, sf_dir)
    return snapshots.current(spark, f"{root}/snapshots/moving").select(F.col("row_key").cast("long").alias("o_orderkey"), "run_id")


@query(f"""WITH {DELTA} SELECT bucket, CAST(count(*) FILTER (WHERE NOT (again AND o_orderkey % 11 = 0)) AS BIGINT) AS keys, bool_or(again) AS rewritten, CAST(1 AS BIGINT) AS writes FROM o GROUP BY bucket HAVING keys > 0""")
def snapshot_compaction(spark, sf_dir):
    """The buckets after compaction: their keys, whether they were rewritten, which only those that the delta touched are, and of how many writes they are made."""
    folder = f"{_moving_runs(spark, sf_dir)}/snapshots/moving"
    rewritten = snapshots.compact(spark, folder)
    made = [(b, b in set(rewritten), len(parts)) for b, parts in snapshots.manifest(spark, folder)["buckets"].items()]
    counts = snapshots.current(spark, folder).groupBy("bucket").agg(F.count("*").alias("keys"))
    return counts.join(spark.createDataFrame(made, "bucket string, rewritten boolean, writes long"), "bucket").select("bucket", "keys", "rewritten", "writes")


#: How an audience's pages are made of customers: the action, its entity, and the customers that the first pull and a later, broken one see.
PAGE = 100
REGISTRATIONS = I.Spec("webinar_registrations", ("webinar_registrations",), {"registration_id": "long", "full_name": "string", "segment": "string", "payload_json": "string"}, ("registration_id",), guarded=True, bucket_digits=1)


def _fixtures(spark: SparkSession, sf_dir: str, folder: str, where: str, fails: int) -> None:
    """Pages of a hundred customers; the answers to the first attempts at the second page are broken."""
    c = table(spark, sf_dir, "customer").where(where)
    last = c.agg((F.floor(F.max("c_custkey") / PAGE) + 1).alias("pages"), F.lit(1).alias("one"))
    item = F.to_json(F.struct(F.col("c_custkey").alias("registration_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment")))
    rows = c.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").select((F.floor(F.col("c_custkey") / PAGE) + 1).cast("int").alias("page"), "pages", item.alias("payload"))
    api.write_fixtures(rows, folder, "webinar_registrations")
    for attempt in range(fails):
        sinks.replace_file(spark, f"{folder}/webinar_registrations_2.failed{attempt}", "")


@query("""WITH n AS (SELECT count(*) AS n FROM customer), f AS (SELECT unnest(['r1', 'r2', 'r3', 'r4']) AS run_id)
SELECT run_id, CASE WHEN run_id IN ('r1', 'r4') THEN 'SUCCESS' ELSE 'FAILED' END AS status, CASE WHEN run_id IN ('r1', 'r4') THEN n ELSE 0 END AS rows_read, CASE WHEN run_id = 'r1' THEN n ELSE 0 END AS rows_new,
  CASE run_id WHEN 'r2' THEN 'stale' WHEN 'r3' THEN 'unreadable' ELSE 'none' END AS reason, n AS keys_after FROM f, n""")
def api_ingest(spark, sf_dir):
    """Four pulls of a paged source: one with broken answers that are asked for again, one far too small, one that stays broken, and a whole one.

    The second and third change nothing: raw rows and snapshot stay as they were.
    """
    root, keys = work_folder(spark, "api"), []
    pulls = (("r1", "true", 2), ("r2", f"c_custkey < {PAGE // 10}", 0), ("r3", "true", 9), ("r4", "true", 0))
    for i, (run, where, fails) in enumerate(pulls):
        _fixtures(spark, sf_dir, f"{root}/fixtures/{run}", where, fails)

        def read(action: str, run: str = run) -> DataFrame:
            return api.columns_of(api.read_api(spark, action, fixtures=f"{root}/fixtures/{run}", retries=3, wait=0.01), "registration_id long, full_name string, segment string")

        I.ingest(spark, [REGISTRATIONS], read, root, run, dt.datetime(2024, 1, 31, i))
        keys.append((run, snapshots.current(spark, f"{root}/snapshots/webinar_registrations").count()))
    reason = F.when(F.col("error").contains("look stale"), "stale").when(F.col("error").contains("can't be read"), "unreadable").otherwise("none")
    log = spark.read.parquet(f"{root}/log").select("run_id", "status", "rows_read", "rows_new", reason.alias("reason"))
    return log.join(spark.createDataFrame(keys, "run_id string, keys_after long"), "run_id")


@query(f"""WITH {ACT} SELECT lower(campaign) AS campaign_token, count(*) AS n, count(DISTINCT CASE doctor % 2 WHEN 0 THEN campaign ELSE lower(campaign) || '-' END) AS spellings FROM act WHERE campaign <> 'C2' GROUP BY 1""")
def published_campaigns(spark, sf_dir):
    """Two runs are published; the second lacks a campaign, of which nothing is left. Spellings of a campaign share a partition."""
    root = work_folder(spark, "gold")
    a = activity(spark, sf_dir).select("event_id", F.when(F.col("doctor") % 2 == 0, F.col("campaign")).otherwise(F.concat(F.lower("campaign"), F.lit("-"))).alias("campaign"))
    sinks.publish({"facts": a}, root, "r1")
    sinks.publish({"facts": a.where("lower(campaign) not like 'c2%'")}, root, "r2")
    back = sinks.published(spark, root, "facts")
    return back.groupBy("campaign_token").agg(F.count("*").alias("n"), F.count_distinct("campaign").alias("spellings"))


@query("""WITH u AS (SELECT c_custkey AS k, 0 AS source_rank, c_name AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, 2, min(o_orderpriority) FROM orders GROUP BY 1)
  SELECT k, source_rank, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_rank, v) AS n FROM u) WHERE n = 1""")
def first_source_wins(spark, sf_dir):
    c, o, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey").alias("k")
    sources = [c.where("c_custkey % 3 = 0").select(k, F.col("c_name").alias("v")), c.where("c_custkey % 2 = 0").select(k, F.col("c_mktsegment").alias("v")), o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("v"))]
    return R.first_source_wins(sources, ["k"], [F.col("v")]).select("k", "source_rank", "v")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents), a AS (SELECT doc_id FROM d WHERE r > 1 ORDER BY doc_id LIMIT 20000)
  SELECT (SELECT count(*) FROM d) AS before_rows, (SELECT count(*) FROM a) AS archived, (SELECT count(*) FROM d) - (SELECT count(*) FROM a) AS kept, true AS counts_match, (SELECT count(*) FROM d WHERE r > 1) - (SELECT count(*) FROM a) AS left_over""")
def archive_duplicates(spark, sf_dir):
    """One batch of exact duplicates moved to the archive, with the counts that must agree before anything is deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept, archived = R.archive_batch(docs, ["text"], "doc_id", 20_000)
    counts = {"before_rows": docs.count(), "archived": archived.count(), "kept": kept.count()}
    left = R.duplicate_stats(kept, ["text"]).first().duplicate_rows
    row = (*counts.values(), counts["before_rows"] == counts["archived"] + counts["kept"], left)
    return spark.createDataFrame([row], "before_rows long, archived long, kept long, counts_match boolean, left_over long")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'id=' || c_custkey WHEN 1 THEN 'name=' || c_name ELSE 'row=' || md5('["' || c_name || '","' || c_mktsegment || '"]') END AS preservation_key FROM customer""")
def preservation_keys(spark, sf_dir):
    """The first key that a row has, else a fingerprint of what it holds."""
    from pulsefield.functions.text import row_hash

    k, named = F.col("c_custkey"), lambda lead, c: F.concat(F.lit(f"{lead}="), c)
    c = table(spark, sf_dir, "customer").withColumns({"id": F.when(k % 3 == 0, k.cast("string")), "name": F.when(k % 3 == 1, F.col("c_name"))})
    return c.select("c_custkey", F.coalesce(named("id", F.col("id")), named("name", F.col("name")), named("row", row_hash(F.col("c_name"), F.col("c_mktsegment")))).alias("preservation_key"))


@query("""SELECT c_custkey, array_to_string(['campaign', c_name, c_mktsegment, 'nested', 'code', 'X' || (c_custkey + 1000)], '|') AS refs FROM customer""")
def json_reference_walk(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    code = F.concat(F.lit("X"), (F.col("c_custkey") + 1000).cast("string"))
    nested = F.struct(F.col("c_mktsegment").alias("items"), code.alias("code"))
    selection = F.to_json(F.struct(F.col("c_name").alias("campaign"), F.array("c_mktsegment", F.lit("en"), F.lit("abc")).alias("videos"), nested.alias("nested")))
    return c.select("c_custkey", F.array_join(json_references(selection), "|").alias("refs"))


@query("SELECT c_custkey, 'old' AS origin, c_name AS full_name FROM customer")
def compatibility_view(spark, sf_dir):
    """A table under its former name and column names."""
    customer: DataFrame = table(spark, sf_dir, "customer")
    I.compatibility_views({"people": customer}, {"old_people": ("people", {"person_id": "c_custkey", "full_name": "c_name"})})
    return spark.sql("SELECT person_id AS c_custkey, 'old' AS origin, full_name FROM old_people")
