"""Connected components of an undirected graph by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """Component of each node that has an edge.

    ``edges`` has two bigint columns ``a`` and ``b``; loops, repeated rows and
    rows with a null are allowed and ignored. Returns ``node`` and
    ``component``, the smallest node that it reaches. An empty table gives an
    empty table.

    In each round every node joins the neighbour (or itself) of the lowest
    pseudo-random priority, drawn anew in each round, so that long chains
    shrink geometrically too. Edges between merged nodes become loops and go.
    Nothing is collected; a hub's edges are pre-aggregated, and the joins that
    relabel them are plain equi-joins, which Spark splits where they are skewed.
    """
    left = stash(_simple(edges), "edges")
    maps = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda x: F.struct(F.xxhash64(x, F.lit(len(maps))).alias("p"), F.col(x).alias("x"))  # noqa: E731, B023
        joined = stash(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("other"))
            .select(F.col("a").alias("node"), F.least(F.col("other"), rank("a"))["x"].alias("root")),
            "roots",
        )
        maps.append(joined)
        for side in ("a", "b"):
            left = left.join(joined.select(F.col("node").alias(side), F.col("root").alias("root_" + side)), side)
        left = stash(_simple(left.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        whole = whole.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    whole = stash(whole, "members")
    least = whole.groupBy("root").agg(F.min("node").alias("component"))
    return stash(whole.join(least, "root").select("node", "component"), "components")


def _simple(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
