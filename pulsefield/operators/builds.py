"""Builds of tables that share parts: a graph in which each part is made once, written, and read by all that need it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Part:
    """A table of a build: the parts it is made of, by name, and how. Only those that are ``published`` are for readers."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    published: bool = True


def made(parts: list[Part], wanted: tuple[str, ...], hold: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
    """The wanted parts and all they need, each made once from the written form of its needs. A part that isn't needed isn't made; a cycle raises.

    hold: writes a table and reads it back.
    """
    known = {p.name: p for p in parts}
    needed, open_ = {}, list(wanted)
    while open_:
        name = open_.pop()
        if name not in needed:
            needed[name] = set(known[name].needs)
            open_ += known[name].needs
    out: dict[str, DataFrame] = {}
    for name in TopologicalSorter(needed).static_order():
        out[name] = hold(known[name].make(*[out[n] for n in known[name].needs]), name)
    return out
