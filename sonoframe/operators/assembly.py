"""Sound, pictures and messages of a session as one row for each frame of sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources of parts, in the order in which they count at one time.
ORDER = {"reset": 0, "video": 1, "warning": 2, "coaching": 2, "audio": 3}
FIELDS = "session_id bigint, us bigint, seq bigint, audio string, video_seq bigint, video string, gap double, warnings array<string>, coaching string"


def parts(rows: DataFrame, source: str) -> DataFrame:
    """Rows (session_id, ts, seq and others) as parts of one source: session_id, ts, seq, source, payload (the other columns as JSON)."""
    others = [c for c in rows.columns if c not in ("session_id", "ts", "seq")]
    held = F.to_json(F.struct(*others), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}) if others else F.lit("{}")
    return rows.select(F.col("session_id").cast("bigint"), "ts", F.col("seq").cast("bigint"), F.lit(source).alias("source"), held.alias("payload"))


def placed(rows: DataFrame, lag: float) -> DataFrame:
    """Parts with ``us`` (microseconds), ``at`` (when they count: sound ``lag`` seconds later) and ``rank``; without unknown sources and rows that lack session, time or ``seq``."""
    us = F.unix_micros("ts")
    later = F.when(F.col("source") == "audio", F.lit(round(lag * 1e6))).otherwise(F.lit(0))
    rank = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))[F.col("source")]
    return rows.withColumns({"us": us, "at": us + later, "rank": rank}).dropna(subset=["session_id", "us", "seq", "rank"])


def assembled(rows: DataFrame, lag: float, size: int) -> DataFrame:
    """Each part of sound with its picture, warnings and coaching: see ``FIELDS``.

    ``rows`` are :func:`parts` of the sources in ``ORDER``. The picture is the
    nearest in time (the earlier of equally near ones) of the last ``size`` that
    came since the last reset, up to ``lag`` seconds after the sound; ``gap`` is
    its time less that of the sound. If none came since, the last one before the
    reset counts, without a gap; a session without pictures has nulls. Warnings
    come with the next sound only, in order; of several coachings the last one
    counts. What comes behind the last sound of a session isn't delivered.
    Repeated rows stay; of equal sounds the first takes the messages.
    """
    is_a = lambda source: F.col("source") == source
    order = ["at", "rank", "seq", F.coalesce("payload", F.lit(""))]
    mine = Window.partitionBy("session_id").orderBy(*order)
    rows = placed(rows, lag).select("session_id", "source", "seq", "payload", "us", "at", "rank")
    rows = rows.withColumns({"epoch": F.count_if(is_a("reset")).over(mine.rowsBetween(Window.unboundedPreceding, 0)), "turn": F.count_if(is_a("audio")).over(mine.rowsBetween(Window.unboundedPreceding, -1))})
    picture = F.struct("us", "seq", "payload")
    since = Window.partitionBy("session_id", "epoch").orderBy(*order)
    pictures = rows.where(is_a("video")).withColumns({"ring": F.collect_list(picture).over(since.rowsBetween(1 - size, 0)), "latest": picture})
    both = pictures.unionByName(rows.where(~is_a("video")), allowMissingColumns=True)
    both = both.withColumns({"ring": F.last("ring", True).over(since.rowsBetween(Window.unboundedPreceding, 0)), "latest": F.last("latest", True).over(mine.rowsBetween(Window.unboundedPreceding, 0))})
    far = lambda r: F.abs(r["us"] - F.col("us"))
    best = F.array_min(F.transform("ring", lambda r: F.struct(far(r).alias("far"), r["us"].alias("us"), r["seq"].alias("seq"), r["payload"].alias("payload"))))
    both = both.withColumn("best", best)
    shown: dict[str, Column] = {
        "us": F.col("us"), "seq": F.col("seq"), "audio": F.col("payload"), "video_seq": F.coalesce("best.seq", "latest.seq"),
        "video": F.when(F.col("best").isNotNull(), F.col("best.payload")).otherwise(F.col("latest.payload")), "gap": (F.col("best.us") - F.col("us")) / 1e6,
    }
    message = F.struct("at", "seq", F.coalesce("payload", F.lit("")).alias("payload"))
    held = both.where(~is_a("video")).groupBy("session_id", "turn").agg(
        F.max(F.when(is_a("audio"), F.struct(*(e.alias(n) for n, e in shown.items())))).alias("frame"),
        F.sort_array(F.collect_list(F.when(is_a("warning"), message))).alias("w"), F.max(F.when(is_a("coaching"), message)).alias("c"),
    )
    return held.where("frame IS NOT NULL").select("session_id", "frame.*", F.col("w.payload").alias("warnings"), F.col("c.payload").alias("coaching"))
