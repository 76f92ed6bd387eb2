"""Visibility rules as data: a table of rules is compiled to joins over whatever tables and columns there are, and carried from parents to children.

A rule says of an entity kind that rows with a value among their identifiers are hidden, or that only those are kept. It holds for one system, for all tables that know the
kind or for one of them, and only while it is active. Which columns identify a kind in which table stands in ``identifiers``; columns that a table lacks are passed over.
``refs`` say which child rows belong to which parent rows: where a parent row is hidden its children go with it, also if they carry another
identifier than the rule named. Children whose parent never was there stay.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "system string, entity string, scope string, mode string, value string, active boolean"
#: kind -> table -> the columns that identify a row's entity of that kind.
Identifiers = dict[str, dict[str, tuple[str, ...]]]


@dataclass(frozen=True)
class Ref:
    """Rows of a child table belong to the parent rows whose column equals theirs."""

    child: str
    child_column: str
    parent: str
    parent_column: str


def rule_value(c: Column) -> Column:
    """One spelling of an identifier: letters, digits and @ in lower case."""
    return F.nullif(F.lower(F.regexp_replace(c.cast("string"), "[^A-Za-z0-9@]", "")), F.lit(""))


def options(tables: dict[str, DataFrame], identifiers: Identifiers, system: str) -> list[tuple[str, str, str, str, bool]]:
    """What rules can be made of: system, table, entity kind, column, and whether the table has that column."""
    return [(system, t, kind, c, t in tables and c in tables[t].columns) for kind, of in identifiers.items() for t, columns in of.items() for c in columns]


def _marked(df: DataFrame, columns: Iterable[str], values: DataFrame, name: str) -> DataFrame:
    """df with a column that is true where any of the columns has one of the values."""
    hits = []
    for i, c in enumerate(columns):
        side = values.select(F.col("value").alias(f"_v{i}")).distinct()
        df = df.join(side, rule_value(F.col(c)) == F.col(f"_v{i}"), "left")
        hits.append(F.col(f"_v{i}"))
    hit = reduce(lambda a, b: a | b, [h.isNotNull() for h in hits], F.lit(False))
    return df.withColumn(name, hit).drop(*[f"_v{i}" for i in range(len(hits))])


def apply_rules(tables: dict[str, DataFrame], rules: DataFrame, identifiers: Identifiers, refs: list[Ref], system: str) -> dict[str, DataFrame]:
    """The visible rows of each table.

    Hiding and keeping add up: a row stays if no rule hides it and, for each kind and scope that has rules to keep, one of them keeps it. A table that lacks all columns
    that a kind is identified by isn't touched by that kind's rules.
    """
    mine = rules.where((F.lower("system") == system) & F.coalesce("active", F.lit(True))).withColumn("value", rule_value(F.col("value"))).where("value is not null")
    asked = {(r.entity, r.scope, r.mode) for r in mine.select("entity", "scope", "mode").distinct().collect()}  # at most kinds x tables x modes
    marked = {}
    for name, df in tables.items():
        bad = F.lit(False)
        out, marks = df, []
        for kind, scope, mode in sorted(asked, key=str):
            columns = [c for c in identifiers.get(kind, {}).get(name, ()) if c in df.columns]
            if not columns or scope not in (None, name):
                continue
            values = mine.where((F.col("entity") == kind) & F.col("scope").eqNullSafe(F.lit(scope)) & (F.col("mode") == mode)).select("value")
            mark = f"_m{len(marks)}"
            out = _marked(out, columns, values, mark)
            marks.append(mark)
            bad = bad | (F.col(mark) if mode == "hide" else ~F.col(mark))
        marked[name] = out.withColumn("_hidden", bad).drop(*marks)
    order = TopologicalSorter({name: {r.parent for r in refs if r.child == name} for name in tables}).static_order()
    for name in order:
        out = marked[name]
        for i, r in enumerate(x for x in refs if x.child == name and x.child_column in tables[name].columns):
            # A parent's value counts as hidden if all rows that have it are.
            lost = marked[r.parent].where(F.col(r.parent_column).isNotNull()).groupBy(F.col(r.parent_column).alias(f"_p{i}")).agg(F.bool_and("_hidden").alias(f"_h{i}")).where(f"_h{i}")
            out = out.join(lost, F.col(r.child_column) == F.col(f"_p{i}"), "left").withColumn("_hidden", F.col("_hidden") | F.coalesce(f"_h{i}", F.lit(False))).drop(f"_p{i}", f"_h{i}")
        marked[name] = out
    return {name: df.where("not _hidden").drop("_hidden") for name, df in marked.items()}
