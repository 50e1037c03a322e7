"""Conversations logged as growing snapshots: the longest of each is kept and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns with ``turn`` in one range of so many numbers share a window and an output part. One conversation may hold a third
#: of all rows: at 30 GB that is a text of 10 GB, while a row of Spark holds 2 GB at most, so a row for each part it is.
SPAN = 256


def _turns(chats: DataFrame) -> DataFrame:
    """Distinct turns with their ordinal in the conversation and the part they fall in."""
    rows = chats.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / SPAN))
    # a conversation of any length is never one group: ordinals run within parts, and over the parts' sizes
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    return rows.withColumn("at", F.row_number().over(inside)).join(sizes, ["conv_id", "part"]).withColumn("at", F.col("at") + F.col("before")).drop("before")


def _hash(seed: int) -> Column:
    """Hash of a turn at its place; a null role or text differs from any other."""
    return F.xxhash64(F.lit(seed), "at", F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit("")))


def maximal_conversations(chats: DataFrame) -> DataFrame:
    """Turns of the conversations that no longer one begins with: conv_id, part, at, turn, role, text.

    The hash of a prefix is the running exclusive-or of its turns' hashes, each
    taken with the turn's place, in two independent halves of 64 bits. A
    conversation whose whole hash, at its length, is the hash of a proper prefix
    of a longer one goes (anti-join); of equal conversations the smallest id
    stays. Prefix hashes are made distinct before the join, so a first turn that
    many share is one row.

    Turns are ordered by turn number (null first), then role and text; rows that
    repeat are one turn; rows without a conv_id are left out. Null and empty
    texts are different turns. Empty tables give empty tables; extra columns are
    dropped.
    """
    turns = _turns(chats)
    own = Window.partitionBy("conv_id", "part").orderBy("at")
    local = turns.select("conv_id", "part", "at", *(F.bit_xor(_hash(i)).over(own).alias(f"h{i}") for i in (0, 1)))
    parts = turns.groupBy("conv_id", "part").agg(*(F.bit_xor(_hash(i)).alias(f"p{i}") for i in (0, 1)), F.max("at").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    parts = parts.select(
        "conv_id", "part", *(F.coalesce(F.bit_xor(f"p{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (0, 1)),
        *(F.bit_xor(f"p{i}").over(whole).alias(f"w{i}") for i in (0, 1)), F.max("last").over(whole).alias("length"),
    )
    prefixes = (
        local.join(parts, ["conv_id", "part"])
        .where(F.col("at") < F.col("length"))
        .select(F.col("at").alias("length"), *((F.col(f"h{i}").bitwiseXOR(F.col(f"b{i}"))).alias(f"w{i}") for i in (0, 1)))
        .distinct()
    )
    longest = (
        parts.groupBy("length", "w0", "w1")
        .agg(F.min("conv_id").alias("conv_id"))
        .join(prefixes, ["length", "w0", "w1"], "left_anti")
        .select("conv_id")
    )
    return turns.join(longest, "conv_id", "left_semi").select("conv_id", "part", "at", "turn", "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """Text of each conversation: conv_id, part, n_turns, text.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``, null roles and texts as
    empty ones. Parts follow one another in order; a conversation whose turn
    numbers stay below ``SPAN`` is one part, so no row grows without bound.
    """
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    grouped = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return grouped.select("conv_id", "part", F.size("lines").cast("bigint").alias("n_turns"), F.array_join(F.col("lines.line"), "").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return render(maximal_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_SQL = r"""
WITH chat_rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM chat_rows),
prefixes AS (
  SELECT conv_id, pos AS length,
         string_agg(coalesce(length(role) || ':' || role, '-') || '/' || coalesce(length(text) || ':' || text, '-'), ',' ORDER BY pos)
           OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM turns),
whole AS (SELECT conv_id, max(length) AS length, arg_max(prefix, length) AS prefix FROM prefixes GROUP BY conv_id),
first_ids AS (SELECT prefix, length, min(conv_id) AS conv_id FROM whole GROUP BY prefix, length),
longest AS (
  SELECT f.conv_id FROM first_ids f
  WHERE NOT EXISTS (
    SELECT 1 FROM prefixes p JOIN whole w ON w.conv_id = p.conv_id
    WHERE p.prefix = f.prefix AND p.length = f.length AND w.length > p.length))
SELECT conv_id, CAST(floor(coalesce(turn, 0) / 256.0) AS BIGINT) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM turns JOIN longest USING (conv_id)
GROUP BY conv_id, part
"""
