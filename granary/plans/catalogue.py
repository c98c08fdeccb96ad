"""All queries over the reference's operators and their SQL."""

from __future__ import annotations

from granary.plans import extras, files, functions, records, scorecards, selects

_parts = (scorecards.C, selects.C, records.C, functions.C, files.C, extras.C)


def queries() -> dict:
    return {k: f for c in _parts for k, f in c.queries.items()}


def oracle_sql() -> dict:
    return {k: s for c in _parts for k, s in c.sql.items()}
