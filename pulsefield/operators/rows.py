"""Operators on rows of one relation: latest per key, survivors, overlays, duplicates, diffs and snapshots.

Order is always explicit: callers pass ordering columns that end in a unique one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.functions.text import row_hash


def latest_by(df: DataFrame, keys: list, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order. Spark limits each map task to n rows a key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def non_empty_key(*candidates: tuple[Column, ...], fallback: Column) -> Column:
    """The first tuple of columns that are all non-empty, joined; else the fallback (a payload hash)."""
    whole = lambda cols: reduce(lambda a, b: a & b, [F.coalesce(F.trim(c.cast("string")), F.lit("")) != "" for c in cols])
    return F.coalesce(*[F.when(whole(cols), F.concat_ws("\u001f", *[c.cast("string") for c in cols])) for cols in candidates], fallback)


def survivor_merge(df: DataFrame, keys: list[str], order: list[Column], fill: list[str], any_of: list[str] = (), least: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """One row per key: the first row's values, gaps filled from later rows, flags OR-ed, bounds widened."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = [F.first(F.nullif(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c), ignorenulls=True).over(whole).alias(c) for c in fill]
    bounds = [F.max(c).over(whole).alias(c) for c in (*any_of, *greatest)] + [F.min(c).over(whole).alias(c) for c in least]
    return df.select(*keys, *filled, *bounds, F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


def overlay_by_freshness(base: DataFrame, over: DataFrame, keys: list[str], columns: list[str], freshness: str) -> DataFrame:
    """A full outer merge: non-empty fields of ``over`` win where its row is at least as fresh, fill gaps elsewhere."""
    a, b = base.alias("a"), over.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    fresh = F.coalesce(F.col(f"b.{freshness}") >= F.col(f"a.{freshness}"), F.col(f"a.{freshness}").isNull())
    text = lambda side, c: F.nullif(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    picked = [F.when(fresh, F.coalesce(text("b", c), text("a", c))).otherwise(F.coalesce(text("a", c), text("b", c))).alias(c) for c in columns]
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *picked, F.greatest(f"a.{freshness}", f"b.{freshness}").alias(freshness))


def append_new_payloads(existing: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """The incoming rows, once each, whose payload hash isn't there yet: what an idempotent append adds."""
    hashed = incoming.withColumn("record_hash", row_hash(*[F.col(c) for c in columns]))
    known = existing.select(row_hash(*[F.col(c) for c in columns]).alias("record_hash"))
    return latest_by(hashed, ["record_hash"], [F.col(c) for c in columns]).join(known, "record_hash", "left_anti")


def active_rows(current: DataFrame, snapshot: DataFrame | None, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the latest snapshot has (all, if none was taken), then fallback rows for keys that are missing."""
    active = current if snapshot is None else current.join(snapshot.select(*keys).distinct(), keys, "left_semi")
    return active.unionByName(fallback.join(active.select(*keys).distinct(), keys, "left_anti"))


def first_source_wins(sources: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of several sources, tagged with their place in ``source_rank``; of each key those of the first source that has it.

    One shuffle for any number of sources.
    """
    tagged = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return latest_by(every, keys, [F.col("source_rank"), *order])


def order_by_existing(df: DataFrame, wanted: list[tuple[str, bool]]) -> list[Column]:
    """An ordering by those of the wanted columns (name, descending) that df has, nulls last, then by the whole row."""
    known = [(F.desc_nulls_last if down else F.asc_nulls_last)(name) for name, down in wanted if name in df.columns]
    return [*known, row_hash(*[F.col(c) for c in df.columns])]


def archive_batch(df: DataFrame, columns: list[str], key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): of rows with equal payloads all but the one of least key go to the archive, the ``most`` of least key in a batch."""
    archived = split_duplicates(df, columns, [F.col(key)]).where("rank > 1").drop("rank").orderBy(key).limit(most)
    return df.join(archived.select(key), key, "left_anti"), archived


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows replace existing ones with their key; others stay."""
    both = existing.withColumn("_p", F.lit(1)).unionByName(incoming.withColumn("_p", F.lit(0)))
    return latest_by(both, keys, [F.col("_p"), *order]).drop("_p")


def duplicate_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """total, unique, duplicate rows, duplicate groups and the largest group, in two levels of counting."""
    groups = df.groupBy(row_hash(*[F.col(c) for c in columns]).alias("h")).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"), F.count("*").alias("unique_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest_group"),
    )


def split_duplicates(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """Rows with their rank among equal payloads; rank 1 is kept, others go to the archive."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*columns).orderBy(*order)).cast("long"))


def preservation_diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of an earlier build that a new one lacks or has changed: keys and ``change`` (missing or changed)."""
    a = before.select(*keys, row_hash(*[F.col(c) for c in columns]).alias("old"))
    b = after.select(*keys, row_hash(*[F.col(c) for c in columns]).alias("new"))
    joined = a.join(b, keys, "left")
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, F.when(F.col("new").isNull(), "missing").otherwise("changed").alias("change"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """A full outer comparison of two snapshots: added, removed, changed or same."""
    joined = before.alias("a").join(after.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")) for m in measures])
    status = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(same, "same").otherwise("changed")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def excluded(df: DataFrame, entity: str, rules: list[tuple[str, str, str]]) -> Column:
    """Whether a rule (entity or *, field, value) names a row; rules are a small configuration."""
    hits = [F.lower(F.trim(F.col(f).cast("string"))) == v.strip().lower() for e, f, v in rules if e in ("*", entity) and f in df.columns]
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), hits, F.lit(False))
