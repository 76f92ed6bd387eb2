"""Cleaning rows out of a source after they were copied: a manifest, guards, and an append-only log of what became of each row.

A row's state is the last event of its key in the log; none is PENDING. An attempt takes the rows that are PENDING or FAILED and compares each with
the source as it is now: one that is gone is ALREADY_ABSENT, one whose guard changed since it was copied is GUARD_BLOCKED and stays, the others are deleted and DELETED, or
FAILED if the source refused. The guard is compared and the row deleted in one step (compare and set), so a change in between blocks. The other
states are final, so an attempt that is run again finds nothing to do. All of it is joins of keyed tables; no row goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.functions.text import trimmed

FINAL = ("DELETED", "ALREADY_ABSENT", "GUARD_BLOCKED")
EVENTS = "key string, attempt int, status string, error string"
#: Takes rows (key, guard) and deletes those that still have that guard; gives back key and error, null for those it deleted.
Delete = Callable[[DataFrame], DataFrame]


def manifest(sources: list[DataFrame]) -> DataFrame:
    """key and guard of the rows of several copies (key, guard): of a key in more than one, the last one's guard counts, of several there the greatest. Empty keys are left out."""
    tagged = [df.select(trimmed(F.col("key")).alias("key"), F.lit(i).alias("copy"), F.col("guard").cast("string").alias("guard")) for i, df in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged).where("key is not null")
    return rows.groupBy("key").agg(F.max(F.struct("copy", "guard")).alias("m")).select("key", "m.guard")


def states(rows: DataFrame, log: DataFrame) -> DataFrame:
    """key, guard, status, attempts and error of each row of a manifest, from its last event."""
    last = log.groupBy("key").agg(F.max(F.struct("attempt", "status", "error")).alias("e"), F.count("*").alias("attempts"))
    return rows.join(last, "key", "left").select("key", "guard", F.coalesce("e.status", F.lit("PENDING")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "e.error")


def attempt(rows: DataFrame, log: DataFrame, source: DataFrame, delete: Delete, number: int, guarded: bool = True) -> DataFrame:
    """The events of one attempt, for the log: source has key and guard as they are now. Without guards a row that is there is deleted whatever it holds."""
    open_ = states(rows, log).where(~F.col("status").isin(*FINAL)).select("key", "guard")
    now = source.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("guard").cast("string"), F.lit("")).alias("now"), F.lit(True).alias("there"))
    met = open_.join(now, "key", "left")
    same = F.coalesce("guard", F.lit("")) == F.col("now") if guarded else F.lit(True)
    first = F.when(F.col("there").isNull(), "ALREADY_ABSENT").when(same, "DELETE").otherwise("GUARD_BLOCKED")
    told = met.withColumn("status", first)
    done = delete(told.where("status = 'DELETE'").select("key", "guard")).select("key", "error")
    refused = F.when(F.col("error").isNull(), "DELETED").otherwise("FAILED")
    why = F.when(F.col("status") == "GUARD_BLOCKED", "the source row changed after it was copied")
    kept = told.where("status <> 'DELETE'").select("key", "status", why.alias("error"))
    events = kept.unionByName(done.select("key", refused.alias("status"), "error"))
    return events.select("key", F.lit(number).alias("attempt"), "status", F.col("error").cast("string").alias("error"))


def run_summary(state: DataFrame) -> DataFrame:
    """One row: the rows of each state and the status of the run. FAILED rows leave it partial or failed, blocked ones partial."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = state.agg(F.count("*").alias("copied"), *[count(s).alias(s.lower()) for s in ("DELETED", "ALREADY_ABSENT", "GUARD_BLOCKED", "FAILED", "PENDING")])
    fine = F.col("deleted") + F.col("already_absent")
    status = F.when((F.col("failed") > 0) & (fine == 0), "FAILED").when(F.col("failed") + F.col("guard_blocked") + F.col("pending") > 0, "PARTIAL_SUCCESS").otherwise("SUCCESS")
    return counts.withColumn("status", status)
