"""Rules over trailing stretches of sessions: fatigue, posture, buffers and sample formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoframe.operators import folds
from sonoframe.plans.cases import case
from sonoframe.plans.series import ALERTS, BY_TYPE, DAY, GREEDY, TIRED
from sonoframe.sources.bindings import FRAMES, SPECTRA, frames, spectra

C = F.col
case(
    "fatigue_trend",
    lambda spark, d: folds.declines(frames(spark, d).where("f0 > 0 AND rms >= -60"), 15 * DAY, 1000, 20, 3.0, 1.0).select("session_id", "seq", "cause"),
    f"WITH {FRAMES}, {TIRED.format(table='frames')} SELECT session_id, seq, cause FROM tired WHERE cause IS NOT NULL",
)


def posture(rows):
    """A row for each frame and posture rule that it sets off."""
    elevation, asymmetry, forward, tension = F.abs((C("k") - 50) / 200.0), C("jitter") / 20.0, F.abs((C("shimmer") - 5.0) / 30.0), C("conf")
    rules = [("shoulder_elevation", "coaching", elevation > 0.15), ("shoulder_asymmetry", "info", asymmetry > 0.12), ("forward_head", "coaching", forward > 0.15), ("tension_high", "warning", tension > 0.7)]
    hit = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level"))) for kind, level, when in rules)))
    return rows.where("kind != 'error'").select("session_id", "seq", "t", F.explode(hit).alias("w")).select("session_id", "seq", "t", "w.type", "w.level")


POSTURE = "cand AS (" + " UNION ALL ".join(
    f"SELECT session_id, seq, t, '{kind}' AS type, '{level}' AS level FROM frames WHERE kind <> 'error' AND {when}"
    for kind, level, when in (
        ("shoulder_elevation", "coaching", "abs((k - 50) / 200.0) > 0.15"), ("shoulder_asymmetry", "info", "jitter / 20 > 0.12"),
        ("forward_head", "coaching", "abs((shimmer - 5) / 30) > 0.15"), ("tension_high", "warning", "conf > 0.7"),
    )
) + ")"
case(
    "posture_alerts",
    lambda spark, d: folds.cooled_down(posture(frames(spark, d)), ["session_id", "type"], 3 * DAY, ALERTS),
    f"WITH RECURSIVE {FRAMES}, {POSTURE}, {GREEDY.format(**BY_TYPE, gap=259200, never='false')} SELECT session_id, seq, t, type, level FROM walk WHERE kept",
    "t",
)


def last_values(spark, d, n: int = 8):
    """The last n levels at each frame, zeros where a session hasn't so many; their sum and the oldest."""
    back = Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(1 - n, 0)
    rows = frames(spark, d).withColumn("x", F.collect_list("rms").over(back))
    rows = rows.withColumn("x", F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size("x")), "x"))
    return rows.select("session_id", "seq", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"), C("x")[0].alias("oldest"))


case(
    "buffer_read",
    last_values,
    f"""WITH {FRAMES}, b AS (SELECT session_id, seq, list(rms) OVER (PARTITION BY session_id ORDER BY t, seq ROWS 7 PRECEDING) AS x FROM frames)
    SELECT session_id, seq, list_sum(x) AS total, CASE WHEN len(x) < 8 THEN CAST(0 AS DOUBLE) ELSE x[1] END AS oldest FROM b""",
    "total oldest",
)
case(
    "pcm_conversion",
    lambda spark, d: spectra(spark, d).select("id", F.transform("x", lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(v * 4 * 32768)))).alias("y")).select("id", F.array_min("y").alias("low"), F.array_max("y").alias("high"), F.aggregate("y", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total")),
    f"WITH {SPECTRA}, y AS (SELECT id, list_transform(x, lambda v: CAST(greatest(-32768, least(32767, floor(v * 4 * 32768))) AS BIGINT)) AS y FROM spectra) SELECT id, list_min(y) AS low, list_max(y) AS high, CAST(list_sum(y) AS BIGINT) AS total FROM y",
)


def clip(spark, d, gate: float = -40.0):
    """Each session from its first to its last frame above the gate, and one frame more at either end."""
    w = Window.partitionBy("session_id")
    rows = frames(spark, d).withColumn("i", F.row_number().over(w.orderBy("t", "seq")))
    active = F.when(C("rms") >= gate, C("i"))
    kept = rows.withColumns({"a": F.min(active).over(w), "b": F.max(active).over(w)}).where("i BETWEEN a - 1 AND b + 1")
    return kept.groupBy("session_id").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))


case(
    "clip_bounds",
    lambda spark, d: clip(spark, d).select("session_id", "n", F.round("start", 3).alias("start"), F.round("end", 3).alias("end")),
    f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i FROM frames),
    b AS (SELECT session_id, min(i) AS a, max(i) AS b FROM r WHERE rms >= -40 GROUP BY session_id)
    SELECT session_id, count(*) AS n, round(min(t), 3) AS start, round(max(t), 3) AS "end" FROM r JOIN b USING (session_id) WHERE i BETWEEN a - 1 AND b + 1 GROUP BY session_id""",
    'start "end"',
)
