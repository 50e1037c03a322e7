"""How a query and its comparison SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


#: Added before rounding, so that exact halves don't hang on the last bit.
NUDGE = 3.3e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders; minus zero as zero."""
    return df.select(*((F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def case(name: str, run: Callable, sql: str | None = None, doubles: str = "") -> None:
    """Register ``run(spark, sf_dir)``, its doubles rounded, and SQL with the named doubles rounded."""
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        swaps = ", ".join(f"CASE WHEN round({c} + {NUDGE}, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({c} AS DOUBLE) + {NUDGE}, 6) END AS {c}" for c in doubles.split())
        SQL[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if swaps else sql
