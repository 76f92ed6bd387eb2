"""Scans: projected and filtered reads, optional tables, source chains, watermarks, JDBC and JSON sources."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.functions.text import TRUE_WORDS, row_hash


def key_bounds(spark: SparkSession, url: str, relation: str, key: str, parts: int, bins: int = 256, **options: str) -> list[int]:
    """Values of a whole-number key at which ranges of about equal numbers of rows begin, without the first; fewer than parts - 1 if single keys hold more.

    The database counts the rows of ``bins`` equal spans of keys, and counts again inside each span that holds too many, so what comes here is some histograms
    and never the keys, however skewed they are.
    """
    source = spark.read.format("jdbc").options(url=url, **options)
    ends = source.option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT({key}) AS n FROM {relation}").load().first()
    lo, hi, total = (None if v is None else int(v) for v in ends)
    if lo is None or parts < 2:
        return []
    share, spans, done = total / parts, [(lo, hi, total)], []
    while spans:
        a, b, n = spans.pop()
        width = -(-(b - a + 1) // bins)
        if n <= share / 4 or a == b:
            done.append((a, n))
            continue
        sql = f"SELECT bin, COUNT(*) AS n FROM (SELECT FLOOR(({key} - {a}) / {width}) AS bin FROM {relation} WHERE {key} BETWEEN {a} AND {b}) x GROUP BY bin"
        for bin_, rows in source.option("query", sql).load().collect():  # at most bins rows
            start = a + int(bin_) * width
            spans.append((start, min(start + width - 1, b), int(rows)))
    bounds, held = [], 0
    for start, n in sorted(done):
        if held and held + n > share:
            bounds.append(start)
            held = 0
        held += n
    return bounds


def read_jdbc(spark: SparkSession, url: str, relation: str, split_by: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table; with a whole-number column to split by, in parallel ranges of about equal numbers of rows. Filters and columns are pushed down."""
    own = {"fetchsize": "1000"} | options
    if split_by is None or parts < 2:
        return spark.read.format("jdbc").options(url=url, dbtable=relation, **own).load()
    bounds = key_bounds(spark, url, relation, split_by, parts, **options)
    ranges = [f"{split_by} >= {a} AND {split_by} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    if not bounds:
        return spark.read.format("jdbc").options(url=url, dbtable=relation, **own).load()
    predicates = [f"{split_by} < {bounds[0]} OR {split_by} IS NULL", *ranges, f"{split_by} >= {bounds[-1]}"]
    return spark.read.jdbc(url, relation, predicates=predicates, properties=own)


def projected(df: DataFrame, columns: dict[str, str], watermark: str | None = None, start: dt.date | None = None, current: str | None = None) -> DataFrame:
    """The wanted columns (name: type), null where the source lacks one, of rows from a watermark on that are current."""
    if watermark and start is not None and watermark in df.columns:
        df = df.where(F.col(watermark) >= F.lit(start))
    if current and current in df.columns:
        df = df.where(F.lower(F.trim(F.col(current).cast("string"))).isin(*TRUE_WORDS))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def optional(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """The relation, or an empty one of that schema if it doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        return spark.createDataFrame([], schema)


def source_chain(sources: dict[str, DataFrame]) -> DataFrame:
    """Primary and fallback sources one after another, tagged with their name."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("_source_table", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no usable source")
    return out


def since_watermark(df: DataFrame, column: str, last: dt.date | None, lookback_days: int) -> DataFrame:
    """Rows from so many days before the last watermark; all, if there is none."""
    return df if last is None else df.where(F.col(column) >= F.lit(last - dt.timedelta(days=lookback_days)))


def next_watermark(df: DataFrame, column: str, previous: dt.date | None) -> dt.date | None:
    return df.agg(F.max(column)).first()[0] or previous


def audited(df: DataFrame, run_id: str, system: str, relation: str | None, at: dt.datetime) -> DataFrame:
    """With a payload hash and where and when the row was read. Columns that start with _ are about a run and not part of the hash.

    relation: None if the rows name their source themselves.
    """
    payload = [F.col(c) for c in df.columns if not c.startswith("_")]
    named = {} if relation is None else {"_source_table": F.lit(relation)}
    return df.withColumns({"_record_hash": row_hash(*payload), "_run_id": F.lit(run_id), "_source_system": F.lit(system), **named, "_ingested_at": F.lit(at)})


def stale(current: int, previous: int | None, least_share: float = 0.2) -> bool:
    """Whether a pull is too small to trust: empty, or under a fifth of the one before."""
    return current == 0 or (bool(previous) and current < least_share * previous)


def require_rows(counts: dict[str, int]) -> None:
    """Stop before anything is published if a required source gave no rows."""
    if missing := sorted(k for k, n in counts.items() if n == 0):
        raise ValueError(f"required sources without rows: {', '.join(missing)}")


def read_api_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved API responses, one JSON object a line or arrays over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
