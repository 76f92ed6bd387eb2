"""All queries over the campaign tables, and their SQL twins."""

from __future__ import annotations

from pulsefield.plans import aliases, attribution, base, cleanup, clinics, context, details, dimensions, facts, gold, identity, kpis, migration, people, records, reports, rollups, runs, visibility

MODULES = (kpis, people, records, dimensions, reports, facts, clinics, rollups, attribution, runs, details, gold, identity, migration, visibility, cleanup, context)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
