"""Which spans cover a day, without meeting every span of a key: spans as blocks of days, days as the blocks around them.

Days are counted from the first that any event has. A block of level l is BASE**l days long and starts at a multiple of that. Every span is the union of
few whole blocks, at most 2 * (BASE - 1) a level, and a day lies in one block a level. So spans are dealt to their blocks and summed up there, one row a
key and block, and an event looks up as many rows as there are levels, which grows with the logarithm of the time the events span: two for a
month, four for ten years. What an event costs doesn't depend on how many spans its key has, and nothing needs the spans of a key in one
place or in order, so a key with much of the data is split like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 8
_EPOCH = "1970-01-01"


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit(_EPOCH)).cast("long")


def _power(level: Column) -> Column:
    return F.pow(F.lit(float(BASE)), level).cast("long")


def _run(a: Column, b: Column) -> Column:
    """a, a + 1, ..., b - 1; nothing if a isn't below b."""
    return F.when(a < b, F.sequence(a, F.greatest(b - 1, a))).otherwise(F.array().cast("array<bigint>"))


def _blocks(start: Column, end: Column, levels: Column) -> Column:
    """The blocks (level, block) that make up the days start..end, both included, both from 0."""
    first = lambda size: F.ceil(start / size)
    after = lambda size: F.floor((end + 1) / size)

    def of_level(level: Column) -> Column:
        size, above = _power(level), _power(level + 1)
        a, b, up, down = first(size), after(size), first(above) * BASE, after(above) * BASE
        whole = F.when((level == levels - 1) | (up >= down), _run(a, b)).otherwise(F.concat(_run(a, up), _run(down, b)))
        return F.transform(whole, lambda x: F.struct(level.alias("level"), x.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), levels - 1), of_level))


def covering(events: DataFrame, spans: DataFrame, keys: list[str], event_id: str, at: str, measures: dict[str, Column], start: str = "start", end: str = "end") -> DataFrame:
    """event_id and the measures over the spans of an event's keys that cover its day; events that none covers, or without a day, are left out.

    start, end: dates of the first and last day of a span, null where it is open. measures: F.min or F.max of a column of the spans, by name; they are taken of
    blocks first and then of an event's blocks, so no other aggregates will do.
    """
    dated = events.where(F.col(at).isNotNull()).select(*keys, event_id, _day(F.col(at)).alias("_day"))
    # One row, joined by a constant: the days between which anything can be asked.
    size = F.greatest(F.lit(1).cast("long"), (F.floor(F.log(F.col("_hi") - F.col("_lo") + 1.5) / F.log(F.lit(float(BASE)))) + 1).cast("long"))
    asked = dated.agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi")).where("_lo is not null").withColumn("_levels", size).withColumn("_one", F.lit(1))
    a, b = F.greatest(_day(F.col(start)) - F.col("_lo"), F.lit(0).cast("long")), F.least(_day(F.col(end)), F.col("_hi")) - F.col("_lo")
    placed = spans.withColumn("_one", F.lit(1)).join(F.broadcast(asked), "_one").withColumns({"_a": a, "_b": b})
    dealt = placed.where("_a <= _b").withColumn("_at", F.explode(_blocks(F.col("_a"), F.col("_b"), F.col("_levels"))))
    summed = dealt.groupBy(*keys, F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block")).agg(*[m.alias(name) for name, m in measures.items()])
    probes = dated.withColumn("_one", F.lit(1)).join(F.broadcast(asked), "_one").withColumn("_level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_levels") - 1)))
    probes = probes.withColumn("_block", F.floor((F.col("_day") - F.col("_lo")) / _power(F.col("_level"))))
    met = probes.select(*keys, event_id, "_level", "_block").join(summed, [*keys, "_level", "_block"])
    again = [(F.max if name.startswith("max_") else F.min)(name).alias(name) for name in measures]
    return met.groupBy(event_id).agg(*again)


def unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)
