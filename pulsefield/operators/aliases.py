"""Alias columns from optional tables that are linked by any of several keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AliasSource:
    """A table whose rows give aliases, or None where there is no such table.

    links: pairs (column of the rows so far, column of the table), any of which links a row. aliases: name of the new column and the table's column.
    instead: names of new columns, with a column of the rows so far that stands in for each where the table is missing.
    """

    rows: DataFrame | None
    links: tuple[tuple[str, str], ...]
    aliases: dict[str, str]
    instead: dict[str, str]


def lookup_key(c: Column) -> Column:
    """The ASCII letters and digits of a value in lower case; nulls are empty."""
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^a-zA-Z0-9]", ""))


def alias_columns(base: DataFrame, sources: list[AliasSource]) -> DataFrame:
    """base with the alias columns of all sources, one after another, so later ones can link by earlier ones' aliases.

    A row comes once for every row of a source that it is linked to, and once with empty aliases if there is none; rows of a source with equal aliases count once. Empty keys link nothing. A link of a
    column that isn't there (its table is missing) links nothing. Keys become rows, so a source costs one join however many links it has.
    """
    out = base
    for source in sources:
        if source.rows is None:
            new = {name: lookup_key(F.col(source.instead[name])) if name in source.instead else F.lit("") for name in source.aliases}
            out = out.withColumns(new)
            continue
        links = [(a, b) for a, b in source.links if a in out.columns]
        places = [f"_k{i}" for i in range(len(links))]
        keyed = out.withColumns({p: lookup_key(F.col(a)) for p, (a, _) in zip(places, links, strict=True)})
        pairs = lambda cols: F.filter(F.array(*[F.struct(F.lit(i).alias("link"), c.alias("key")) for i, c in enumerate(cols)]), lambda x: x["key"] != "")
        row = F.struct(*[lookup_key(F.col(c)).alias(name) for name, c in source.aliases.items()])
        known = source.rows.select(row.alias("_row"), F.explode(pairs([lookup_key(F.col(b)) for _, b in links])).alias("_x")).select("_row", "_x.*").distinct()
        asked = keyed.select(*places).distinct().select(*places, F.explode(pairs([F.col(p) for p in places])).alias("_x")).select(*places, "_x.*")
        met = asked.join(known, ["link", "key"]).select(*places, "_row").distinct()
        new = {name: F.coalesce(F.col("_row")[name], F.lit("")) for name in source.aliases}
        out = keyed.join(met, places, "left").withColumns(new).drop("_row", *places)
    return out
