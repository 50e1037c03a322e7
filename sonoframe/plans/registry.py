"""Names, queries and comparison SQL of all operators in this package."""

from __future__ import annotations

from sonoframe.plans import arrays, cases, display, joining, monitors, scalars, series, spanish, tracking, voices, vowels, waves  # noqa: F401


def queries() -> dict:
    return dict(cases.QUERIES)


def oracle_sql() -> dict:
    return dict(cases.SQL)
