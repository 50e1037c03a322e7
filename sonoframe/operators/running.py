"""Running values along a key that no single task holds: within parts of the order, and over the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def met(rows: DataFrame, carried: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the columns of ``carried``, which has one row for each of the keys; keys may be null."""
    named = carried.select(*(F.col(k).alias("_of_" + k) for k in keys), *columns)
    same = [F.col(k).eqNullSafe(F.col("_of_" + k)) for k in keys]
    return rows.join(named, same).drop(*("_of_" + k for k in keys))


def running_total(rows: DataFrame, keys: list[str], order: list[str], part: Column, value: Column, name: str, own: bool = True) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the key's rows up to each one, itself included if ``own``; 0 before the first.

    ``part`` grows with ``order`` (a bin of time, say) and cuts a key into parts,
    each sorted by itself; only one sum a part meets by key. So a key that holds
    a third of all rows is many tasks. Null values count as 0; rows alike in
    ``order`` are taken in any order, so give a unique one.
    """
    rows = rows.withColumns({"_part": part, "_value": F.coalesce(value, F.lit(0))})
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return met(rows, carried, [*keys, "_part"], ["_carried"]).withColumn(name, F.col("_carried") + F.col("_within")).drop("_part", "_value", "_within", "_carried")


def last_before(rows: DataFrame, keys: list[str], order: list[str], part: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the last value that isn't null up to each row of its key, itself included; cut into parts as :func:`running_total`."""
    rows = rows.withColumns({"_part": part, "_value": value})
    place = F.struct(*order, F.col("_value").alias("_value"))
    ends = rows.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), place)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_part", F.last("_end", True).over(before).alias("_carried"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.last("_value", True).over(within))
    return met(rows, carried, [*keys, "_part"], ["_carried"]).withColumn(name, F.coalesce("_within", "_carried")).drop("_part", "_value", "_within", "_carried")
