"""Builds with shared parts: each made once, only what is needed, from written inputs."""

from graphlib import CycleError

import pytest

from pulsefield.operators.builds import Part, made
from pulsefield.plans import context


def test_each_part_is_made_once_and_only_if_needed(spark):
    calls, held = [], []

    def part(name, *needs, published=True):
        def make(*inputs):
            calls.append((name, len(inputs)))
            return spark.range(1 + sum(df.count() for df in inputs))

        return Part(name, needs, make, published)

    parts = [part("d", "b", "c"), part("b", "a"), part("c", "a"), part("a", published=False), part("unused", "a")]
    out = made(parts, ("d", "b"), lambda df, name: held.append(name) or df)
    assert sorted(calls) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)] and sorted(held) == ["a", "b", "c", "d"]
    assert out["d"].count() == 5 and "unused" not in out
    with pytest.raises(CycleError):
        made([part("x", "y"), part("y", "x")], ("x",), lambda df, name: df)


def test_the_report_reads_the_events_in_one_part(spark):
    parts = {p.name: p for p in context.graph(spark, "/nowhere")}
    assert [p.name for p in parts.values() if not p.needs] == ["activity"]
    shared = [n for n in parts if sum(n in p.needs for p in parts.values()) > 1]
    assert {"activity", "seen", "bases", "weekly_kpi"} <= set(shared)
