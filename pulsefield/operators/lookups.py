"""A value by many steps of different strength, from one index: entities' keys and known values meet in one join, whatever the number of steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A way to find a value: the kind of keys in the index, and an entity's keys of that kind, best first."""

    name: str
    kind: str
    keys: tuple[str, ...]


def by_steps(entities: DataFrame, entity: str, steps: list[Step], index: DataFrame, value: str, valid: Column | None = None, otherwise: str | None = None) -> DataFrame:
    """Entities with ``value`` and ``via``, the name of the step it came from.

    index: kind, key and value, a row a key. Of a step the first of the entity's keys that the index has counts; if its value isn't ``valid`` (a condition on a
    column named as value) the step gives nothing, also if a later key would. The first step that gives a value decides. Empty keys find nothing.
    The keys of an entity become rows, few and of bounded number; they meet the index in one join and come back in one grouping.
    """
    asked = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(k).alias("rank"), F.lit(s.kind).alias("kind"), F.col(c).cast("string").alias("key")) for i, s in enumerate(steps) for k, c in enumerate(s.keys)])
    probes = entities.select(entity, F.explode(F.filter(asked, lambda x: F.coalesce(x["key"], F.lit("")) != "")).alias("x")).select(entity, "x.*")
    met = probes.join(index.select("kind", "key", F.col(value).alias("found")), ["kind", "key"])
    found = met.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("step", "rank", "found"))).alias("_c"))
    c = F.col("_c")
    firsts = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1)["step"] != x["step"]))
    kept = found.select(entity, F.explode(firsts).alias("_x"), F.col("_c")).select(entity, F.col("_x.step").alias("_step"), F.col("_x.found").alias(value))
    kept = kept.where(F.col(value).isNotNull() if valid is None else valid)
    # Grouped by the entity already, so this second grouping moves no rows.
    best = kept.groupBy(entity).agg(F.min(F.struct("_step", value)).alias("_b"))
    names = F.array(*[F.lit(s.name) for s in steps])
    out = entities.join(best, entity, "left")
    return out.select(*entities.columns, F.coalesce(F.col("_b")[value], F.lit(otherwise)).alias(value), F.coalesce(F.get(names, F.col("_b._step")), F.lit("none")).alias("via"))
