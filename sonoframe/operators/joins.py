"""Joins in time and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float, columns: list[str]) -> DataFrame:
    """Each left row with the right row nearest in time within ``tolerance`` (earlier of equally near ones), and the signed gap.

    Both sides have ``t`` and ``seq``; a left row without such a right row stays,
    with nulls, as does one whose keys or time are null; repeated left rows stay
    too. Time is cut into bins as wide as the tolerance; a right row is offered
    to its bin and the two beside it. Each bin is passed over twice, forwards and
    backwards, for the last right row before and after each left row: no pairs
    are made, and no session is one task.
    """
    bin_of = lambda t: F.floor(t / tolerance)
    offer = F.struct(F.col("t").alias("t"), F.col("seq").alias("seq"), *(F.col(c).alias(c) for c in columns))
    offered = right.dropna(subset=[*keys, "t"]).select(*keys, "t", "seq", F.lit(0).alias("side"), offer.alias("offer"))
    offered = offered.withColumn("bin", F.explode(F.array(*(bin_of(F.col("t")) + i for i in (-1, 0, 1)))))
    asks = left.withColumns({"bin": bin_of(F.col("t")), "side": F.lit(1)})
    both = asks.unionByName(offered, allowMissingColumns=True)
    group = Window.partitionBy(*keys, "bin")
    held = lambda t: F.last("offer", True).over(group.orderBy(t, "side", F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"before": held(F.col("t").asc()), "after": held(F.col("t").desc())}).where("side = 1")
    gap = lambda c: F.when(F.abs(F.col("t") - F.col(c)["t"]) <= tolerance, F.abs(F.col("t") - F.col(c)["t"]))
    best = F.when(gap("before") <= F.coalesce(gap("after"), F.lit(tolerance)), F.col("before")).when(gap("after").isNotNull(), F.col("after"))
    both = both.withColumn("best", best)
    near = both.select(*left.columns, F.col("best.t").alias("t_right"), F.col("best.seq").alias("seq_right"), *(F.col(f"best.{c}").alias(c + "_right") for c in columns))
    return near.withColumn("gap", F.col("t_right") - F.col("t"))


def nearest_in_ring(left: DataFrame, right: DataFrame, keys: list[str], lag: float, size: int) -> DataFrame:
    """Each left row with the nearest in time of the last ``size`` right rows that have come ``lag`` after it; of equally near ones the earliest.

    Both sides have ``t`` and ``seq``; a left row before all right rows keeps
    nulls. The right rows carry the ring of those before them, a left row takes
    the last ring: one pass over the sorted rows of a key, no join.
    """
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    ring = F.collect_list(F.struct(F.col("t").alias("t_right"), F.col("seq").alias("seq_right"))).over(order.rowsBetween(1 - size, 0))
    held = right.select(*keys, "t", "seq", ring.alias("ring"), F.lit(0).alias("left"), F.lit(None).cast("double").alias("own"))
    asks = left.select(*keys, (F.col("t") + lag).alias("t"), "seq", F.lit(None).cast(held.schema["ring"].dataType).alias("ring"), F.lit(1).alias("left"), F.col("t").alias("own"))
    before = Window.partitionBy(*keys).orderBy("t", "left", "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = held.unionByName(asks).withColumn("ring", F.last("ring", True).over(before)).where("left = 1")
    best = F.array_min(F.transform("ring", lambda r: F.struct(F.abs(r["t_right"] - F.col("own")).alias("far"), r["t_right"].alias("t_right"), r["seq_right"].alias("seq_right"))))
    both = both.withColumn("best", best)
    return both.select(*keys, "seq", F.col("own").alias("t"), "best.t_right", "best.seq_right", (F.col("best.t_right") - F.col("own")).alias("gap"))


def inside(points: DataFrame, spans: DataFrame, at: Column, keys: list[str], width: float) -> DataFrame:
    """Each point with the first span (start, end, both included) that holds it.

    Spans are offered to every bin of ``width`` that they touch, points to one.
    """
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    points = points.withColumns({"at": at, "bin": F.floor(at / width)})
    held = points.join(spans, [*keys, "bin"]).where((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end")))
    order = Window.partitionBy(*keys, "seq").orderBy("start", "end")
    return held.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "bin")


def last_of_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Of rows with equal keys the values of the last one."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in columns))


def change(a: Column, b: Column) -> tuple[Column, Column]:
    """Difference b - a, and its percentage of a (0 from 0 to 0, null from 0 elsewhere)."""
    delta = b - a
    return delta, F.when(a != 0, delta / F.abs(a) * 100.0).when(delta == 0, 0.0)
