"""Ingest runs: specifications of sources, read with fall-backs, appended once a payload, logged step by step.

A run keeps its state in a folder: ``raw/<name>`` (payloads by run), ``snapshots/<name>`` (the keys that the source holds now, see snapshots.py) and
``log`` (a row a step). All of it is Parquet; a step that is run again appends nothing new.

A source is read once a run: what it gave is written to ``staged/<run>/<name>``, and counts, new rows, keys and watermark are all taken from there, so a
source that moves meanwhile can't give them different answers. The write stands inside the retries, since a lazy read fails only then.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.functions.text import row_hash, trimmed
from pulsefield.sources import snapshots
from pulsefield.sources.sinks import remove
from pulsefield.sources.tables import audited, optional, projected, require_rows, since_watermark, source_chain, stale

LOG = "run_id string, step string, source string, status string, rows_read long, rows_new long, previous_rows long, is_stale boolean, watermark date, error string, at timestamp"


@dataclass(frozen=True)
class Spec:
    """What an entity is read from: the first source and its fall-backs, columns (name: type), keys, and what limits the rows.

    only: equalities that hold for the first source, a table of several kinds, and not for the others.
    guarded: a read that is too small beside the last one that succeeded fails, and changes nothing.
    gone: a column that marks rows which the source has deleted. With a watermark, only the first run reads the whole source; the others merge
    what they read into its snapshot. ``whole`` makes every run read all. bucket_digits: the snapshot has 16 to this power of buckets.
    """

    name: str
    sources: tuple[str, ...]
    columns: dict[str, str]
    keys: tuple[str, ...]
    watermark: str | None = None
    lookback_days: int = 30
    required: bool = True
    only: dict[str, str] = field(default_factory=dict)
    gone: str | None = None
    whole: bool = False
    bucket_digits: int = 2
    guarded: bool = False


Reader = Callable[[str], DataFrame]


FAILURES = (PySparkException, Py4JError, OSError)


def with_retries(action: Callable, times: int = 2, wait: float = 1.0, most: float = 5.0, sleep: Callable[[float], None] = time.sleep):
    """What an action gives; after a failure of the source it is tried again so many times, each time after twice the wait. What isn't there isn't tried again."""
    for attempt in range(times + 1):
        try:
            return action()
        except FAILURES as e:
            missing = isinstance(e, AnalysisException) and e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")
            if missing or attempt == times:
                raise
            sleep(min(wait * 2**attempt, most))
    raise AssertionError("unreachable")


def retried(read: Reader, times: int = 2, wait: float = 0.1) -> Reader:
    """A reader that tries again after a failure of the source, so many times."""
    return lambda name: with_retries(lambda: read(name), times, wait)


def extract(
    spec: Spec, read: Reader, last: dt.date | None = None, hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, attempt: Callable[[Callable], DataFrame] = lambda action: action()
) -> tuple[DataFrame, list[str]]:
    """The rows of all sources that can be read, tagged with their source, and what went wrong with the others.

    A source that fails or is empty leaves the entity to the next. Raises if no source has rows and one failed.
    hold: writes what a source gave and reads it back, so that it is read once. attempt: runs a read, again if it fails.
    """

    def given(i: int, name: str) -> DataFrame:
        df = read(name)
        for column, value in (spec.only if i == 0 else {}).items():
            df = df.where(F.col(column) == value)
        df = projected(df, spec.columns)
        return hold(since_watermark(df, spec.watermark, last, spec.lookback_days) if spec.watermark else df, name)

    usable, errors = {}, []
    for i, name in enumerate(spec.sources):
        try:
            df = attempt(lambda i=i, name=name: given(i, name))
            if df.isEmpty():
                errors.append(f"{name} has no rows")
            else:
                usable[name] = df
        except FAILURES as e:
            errors.append(f"{name}: {type(e).__name__}")
    if not usable:
        raise ValueError(f"{spec.name} can't be read: {' | '.join(errors)}")
    return source_chain(usable), errors


def snapshot_key(keys: tuple[str, ...], columns: list[str]) -> Column:
    """A row's key parts joined by the unit separator; of a row without any, a hash of the row."""
    parts = [trimmed(F.col(k)) for k in keys]
    joined = F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), joined).otherwise(F.concat(F.lit("hash:"), F.md5(F.to_json(F.struct(*columns)))))


def previous_rows(log: DataFrame, step: str, run_id: str) -> int | None:
    """How many rows the last run before this one that brought any brought."""
    before = log.where((F.col("step") == step) & (F.col("run_id") != run_id) & (F.col("rows_new") > 0))
    row = before.orderBy(F.desc("at"), F.desc("run_id")).select("rows_new").first()
    return row.rows_new if row else None


def last_rows_read(log: DataFrame, step: str) -> int | None:
    """How many rows the last read of a step that succeeded gave."""
    row = log.where((F.col("step") == step) & (F.col("status") == "SUCCESS")).orderBy(F.desc("at"), F.desc("run_id")).select("rows_read").first()
    return row.rows_read if row else None


def new_payloads(stored: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """The incoming rows, once each, whose payload and source aren't stored yet, with ``_append_hash``.

    Of what is stored only that hash is read, and it is met by the incoming hashes first, few of all: where they are small they are broadcast and
    the history isn't shuffled.
    """
    rows = incoming.withColumn("_append_hash", row_hash(*[F.col(c) for c in (*columns, "_source_table")])).dropDuplicates(["_append_hash"])
    seen = stored.select("_append_hash").join(rows.select("_append_hash"), "_append_hash", "left_semi").distinct()
    return rows.join(seen, "_append_hash", "left_anti").select(*columns, "_source_table", "_append_hash")


def ingest(spark: SparkSession, specs: list[Spec], read: Reader, root: str, run_id: str, at: dt.datetime, system: str = "portal", times: int = 0, wait: float = 1.0) -> DataFrame:
    """Ingest each entity and return the log of the run. Raises at the end if a required entity has no rows in any run.

    times: how often a read that fails is tried again, waits doubling from ``wait`` seconds.
    """
    steps, held = [], {}
    log_before = optional(lambda: spark.read.schema(LOG).parquet(f"{root}/log"), spark, LOG)
    fine = log_before.where("status = 'SUCCESS'")
    marks = dict(fine.groupBy("step").agg(F.max("watermark")).collect())  # a row a specification
    for spec in specs:
        path, snapshot, staged = f"{root}/raw/{spec.name}", f"{root}/snapshots/{spec.name}", f"{root}/staged/{run_id}/{spec.name}"
        columns = list(spec.columns)
        schema = ", ".join(f"{c} {t}" for c, t in spec.columns.items()) + ", _source_table string, _append_hash string, _record_hash string, _run_id string, _source_system string, _ingested_at timestamp"
        old = optional(lambda p=path, s=schema: spark.read.schema(s).parquet(p), spark, schema)
        known = snapshots.manifest(spark, snapshot) is not None
        last = marks.get(spec.name) if spec.watermark and known and not spec.whole else None

        def hold(df: DataFrame, name: str, staged: str = staged) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{staged}/{name}")
            return spark.read.schema(df.schema).parquet(f"{staged}/{name}")

        try:
            rows, errors = extract(spec, read, last, hold, lambda action: with_retries(action, times, wait))
            n = rows.count()
            if spec.guarded and stale(n, last_rows_read(log_before, spec.name)):
                raise ValueError(f"{spec.name}: {n} rows look stale beside the last read")
            audited(new_payloads(old, rows, columns), run_id, system, None, at).write.mode("append").parquet(path)
            gone = F.lower(trimmed(F.col(spec.gone).cast("string"))).isin("true", "1", "t", "yes", "y") if spec.gone else F.lit(False)
            keys = rows.select(snapshot_key(spec.keys, columns).alias("row_key"), F.col("_source_table").alias("source"), gone.alias("gone"))
            snapshots.replace(keys, snapshot, run_id, spec.bucket_digits) if last is None else snapshots.merge(keys, snapshot, run_id)
            raw = spark.read.schema(schema).parquet(path)
            before = previous_rows(log_before, spec.name, run_id)
            added = raw.where(F.col("_run_id") == run_id).count()
            mark = rows.agg(F.max(F.to_date(spec.watermark))).first()[0] if spec.watermark else None
            steps.append((run_id, spec.name, ",".join(spec.sources), "SUCCESS", n, added, before, stale(n, before), mark, " | ".join(errors) or None, at))
            held[spec.name] = raw.count()
        except (ValueError, PySparkException, Py4JError) as e:
            steps.append((run_id, spec.name, ",".join(spec.sources), "FAILED", 0, 0, None, True, None, str(e)[:500], at))
            held[spec.name] = old.count()
        remove(spark, staged)
    log = spark.createDataFrame(steps, LOG)
    log.coalesce(1).write.mode("append").parquet(f"{root}/log")
    require_rows({s.name: held[s.name] for s in specs if s.required})
    return log


def discover(spark: SparkSession, prefix: str = "raw_") -> list[str]:
    """The tables and views of the current catalog whose names start so, in order."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))


def compatibility_views(tables: dict[str, DataFrame], renamed: dict[str, tuple[str, dict[str, str]]]) -> list[str]:
    """Temporary views that show tables under old names: view to (table, {old column: new column})."""
    for view, (name, columns) in renamed.items():
        tables[name].select(*[F.col(new).alias(old) for old, new in columns.items()]).createOrReplaceTempView(view)
    return sorted(renamed)
