"""Aggregates and windows over frames; a session is split into tasks by its id only where order needs it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions import acoustics as A
from sonoframe.functions.norms import ENGLISH, FEMALE_F1, MONOPHTHONGS


def voiced_vowels(frames: DataFrame, norms: tuple = ENGLISH) -> DataFrame:
    """Frames whose vowel is clear, with ``vowel`` and ``norm``, its place among the norms.

    The nearest norm is exploded out of an array of one, which keeps the
    optimiser from copying the long expression into filters and projections.
    """
    rows = frames.where((F.col("f1") > 0) & (F.col("f2") > 0))
    rows = rows.select("*", F.explode(F.array(A.nearest_norm(F.col("f1"), F.col("f2"), norms))).alias("nearest")).where(F.col("nearest.d") <= A.MAX_DISTANCE)
    return rows.select(*frames.columns, F.col("nearest.ord").alias("norm"), A.of_norm(F.col("nearest.ord"), norms, 0).alias("vowel"))


def per_vowel_z(frames: DataFrame) -> DataFrame:
    """Mean F1 and F4 of each labelled vowel and the z-score of F1 against women's norms."""
    named = F.create_map(*(F.lit(x) for v, n, *_ in FEMALE_F1 for x in (v, n)))
    rows = voiced_vowels(frames).withColumn("label", F.element_at(named, F.col("vowel"))).where("label IS NOT NULL")
    value = lambda place: F.element_at(F.create_map(*(F.lit(x) for _, n, *r in FEMALE_F1 for x in (n, r[place]))), F.col("label"))
    stats = rows.groupBy("session_id", "label").agg(
        F.avg("f1").alias("f1_mean"), F.avg(F.when(F.col("f4") > 0, F.col("f4"))).alias("f4_mean"), F.count("*").alias("n")
    )
    return stats.withColumn("f1_z", A.z_score(F.col("f1_mean"), value(0), value(1)))


def frame_mean_z(frames: DataFrame, norms: tuple) -> DataFrame:
    """Per session and formant the mean over frames of z against the frame's own vowel."""
    rows = voiced_vowels(frames, norms)
    z = lambda f, place: F.avg(A.z_score(F.col(f), A.of_norm(F.col("norm"), norms, place), A.of_norm(F.col("norm"), norms, place + 1)))
    return rows.groupBy("session_id").agg(z("f1", 1).alias("z1"), z("f2", 3).alias("z2"), z("f3", 5).alias("z3"), F.count("*").alias("n"))


def category_mean_z(frames: DataFrame, norms: tuple, at_least: int = 2, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """z of each vowel's mean formants (``at_least`` frames), averaged over vowels without weights."""
    means = voiced_vowels(frames, norms).groupBy(*by, "norm").agg(*(F.avg(f).alias(f) for f in ("f1", "f2", "f3")), F.count("*").alias("n"))
    z = lambda f, place: F.avg(A.z_score(F.col(f), A.of_norm(F.col("norm"), norms, place), A.of_norm(F.col("norm"), norms, place + 1)))
    return means.where(F.col("n") >= at_least).groupBy(*by).agg(
        z("f1", 1).alias("z1"), z("f2", 3).alias("z2"), z("f3", 5).alias("z3"), F.count("*").alias("n_vowels")
    )


def pitch_summary(frames: DataFrame) -> DataFrame:
    """Statistics of confident pitch and the share of voiced frames, by session."""
    ok = (F.col("conf") > 0.5) & (F.col("f0") > 0)
    f0 = F.when(ok, F.col("f0"))
    return frames.groupBy("session_id").agg(
        F.avg(f0).alias("mean"), F.median(f0).alias("median"), F.stddev_pop(f0).alias("std"), F.min(f0).alias("low"), F.max(f0).alias("high"),
        F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("voiced"),
    )


def percentile_trimmed(frames: DataFrame, columns: tuple[str, ...], low: float = 0.05, high: float = 0.95, at_least: int = 10) -> DataFrame:
    """Mean of each column between its own percentiles, by session; untrimmed below ``at_least`` values."""
    long = frames.select("session_id", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in columns))).alias("e"))
    long = long.select("session_id", "e.name", "e.x").where("x > 0")
    limits = long.groupBy("session_id", "name").agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("p"), F.count("*").alias("n"))
    kept = long.join(limits, ["session_id", "name"]).where((F.col("n") < at_least) | F.col("x").between(F.col("p")[0], F.col("p")[1]))
    return kept.groupBy("session_id", "name").agg(F.avg("x").alias("mean"), F.count("*").alias("n_kept"))


def mad_filtered(frames: DataFrame, columns: dict[str, float], factor: float = 3.5) -> DataFrame:
    """Rows within ``factor`` median absolute deviations on all columns; deviations are floored."""
    medians = frames.groupBy("session_id").agg(*(F.median(c).alias("m_" + c) for c in columns))
    rows = frames.join(medians, "session_id")
    spread = rows.groupBy("session_id").agg(*(F.greatest(F.median(F.abs(F.col(c) - F.col("m_" + c))), F.lit(floor)).alias("d_" + c) for c, floor in columns.items()))
    fits = [F.abs(F.col(c) - F.col("m_" + c)) < factor * F.col("d_" + c) for c in columns]
    kept = rows.join(spread, "session_id")
    for fit in fits:
        kept = kept.where(fit)
    return kept.select(frames.columns)


def vowel_purity(frames: DataFrame, vowel: str, norms: tuple) -> DataFrame:
    """Stability and placement of one vowel's formants over time, by session of at least 4 frames.

    Outliers go by median deviation, a sixth of the rest at either end is
    trimmed (unless fewer than 3 stay); drift is the slope times the length.
    """
    _, m1, s1, m2, s2, *_ = next(n for n in norms if n[0] == vowel)
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    whole = Window.partitionBy("session_id")
    enough = frames.withColumn("n_all", F.count("*").over(whole)).where("n_all >= 4").drop("n_all")
    clean = mad_filtered(enough, {"f1": 30.0, "f2": 50.0})
    ranked = clean.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(whole)})
    trim = F.greatest(F.lit(1), F.floor(F.col("n") / 6))
    trim = F.when(F.col("n") - 2 * trim < 3, 0).otherwise(trim)
    mid = ranked.where((F.col("i") > trim) & (F.col("i") <= F.col("n") - trim))
    stats = mid.groupBy("session_id").agg(
        F.count("*").alias("n"), *(F.coalesce(F.regr_slope(f, F.col("i").cast("double")), F.lit(0.0)).alias("slope_" + f) for f in ("f1", "f2")), F.avg("f1").alias("f1"), F.avg("f2").alias("f2")
    )
    d1, d2 = F.abs(F.col("slope_f1") * F.col("n")), F.abs(F.col("slope_f2") * F.col("n"))
    drift = 0.3 * d1 / s1 + 0.7 * d2 / s2
    away = F.sqrt(F.pow(F.abs(F.col("f1") - m1) / s1, 2) + F.pow(F.abs(F.col("f2") - m2) / s2, 2))
    stability, placement = A.clamp(1.0 - drift / 4.0, 0, 1), A.clamp(1.0 - away / 4.0, 0, 1)
    return stats.select(
        "session_id", "n", stability.alias("stability"), placement.alias("placement"), (0.5 * stability + 0.5 * placement).alias("purity"),
        (drift > 0.8).alias("diphthongized"), (away > 2.0).alias("misplaced"),
    )


def vowel_space(frames: DataFrame, at_least: int = 10) -> DataFrame:
    """Area between the 10th and 90th percentiles of both formants in Bark."""
    rows = frames.where("f1 > 0 AND f2 > 0")
    p = [F.percentile(A.bark(F.col(f)), F.array(F.lit(0.1), F.lit(0.9))) for f in ("f1", "f2")]
    stats = rows.groupBy("session_id").agg(p[0].alias("p1"), p[1].alias("p2"), F.count("*").alias("n"))
    return stats.where(F.col("n") >= at_least).select("session_id", ((F.col("p1")[1] - F.col("p1")[0]) * (F.col("p2")[1] - F.col("p2")[0])).alias("area"))


def prosody(frames: DataFrame, widest: int = 11) -> DataFrame:
    """Variation and range of voiced pitch, and rises and falls of its moving average, by session of 5 voiced frames or more."""
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    whole = Window.partitionBy("session_id")
    rows = frames.where("conf > 0.5 AND f0 > 0").withColumns({"i": F.row_number().over(order), "n": F.count("*").over(whole)}).where("n >= 5")
    width = F.least(F.lit(widest), F.floor(F.col("n") / 2) * 2 + 1)
    rows = rows.withColumn("w", width.cast("int"))
    # sums over the w rows up to this one, for each of the few odd widths; a width above n smooths to a flat line
    sums = [(w, F.sum("f0").over(order.rowsBetween(1 - w, 0)) / w) for w in range(5, widest + 1, 2)]
    smooth = F.when(F.lit(False), F.lit(0.0))
    for w, mean in sums:
        smooth = smooth.when((F.col("w") == w) & (F.col("i") >= w) & (F.col("w") <= F.col("n")), mean)
    rows = rows.withColumn("smooth", smooth)
    rows = rows.withColumn("step", F.round(F.col("smooth") - F.lag("smooth").over(order), 9))
    stats = rows.groupBy("session_id").agg(
        (F.stddev_pop("f0") / F.avg("f0")).alias("cv"), F.percentile("f0", F.array(F.lit(0.05), F.lit(0.95))).alias("p"),
        F.count_if(F.col("step") > 0).alias("n_rises"), F.count_if(F.col("step") < 0).alias("n_falls"),
    )
    return stats.select(
        "session_id", "cv", (12.0 * F.log2(F.col("p")[1] / F.col("p")[0])).alias("semitones"), "n_rises", "n_falls",
        (F.col("n_rises") / F.greatest(F.col("n_falls"), F.lit(1))).alias("ratio"),
    )


def track_score(frames: DataFrame, ceiling: Column, keys: list[str]) -> DataFrame:
    """Plausibility of formant tracks under a ceiling: smoothness, order, bandwidths, gaps and squeezing."""
    names = ["f1", "f2", "f3", "f4"]
    rows = frames.withColumn("ceiling", ceiling)
    order = Window.partitionBy(*keys).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"d_" + f: F.when(F.col(f) > 0, F.abs(F.col(f) - F.last(F.when(F.col(f) > 0, F.col(f)), True).over(order))) for f in names})
    here = F.col("f1") > 0
    for f in names[1:]:
        here &= F.col(f) > 0
    ordered = here & (F.col("f1") < F.col("f2")) & (F.col("f2") < F.col("f3")) & (F.col("f3") < F.col("f4"))
    fine = lambda b: F.when((F.col(b) > 0) & (F.col(b) < 500), 1.0).otherwise(0.0)
    gap = lambda f: F.when(F.col(f) <= 0, 1.0).otherwise(0.0)
    aggs = [F.max("ceiling").alias("ceiling"), F.count("*").alias("n")]
    for f in names:
        aggs += [F.avg("d_" + f).alias("d_" + f), F.avg(F.when(F.col(f) > 0, F.col(f))).alias("m_" + f)]
    aggs += [F.avg(F.when(here, F.when(ordered, 1.0).otherwise(0.0))).alias("ordered")]
    aggs += [F.avg((fine("bw1") + fine("bw2") + fine("bw3")) / 3.0).alias("fine"), F.avg((gap("f1") + gap("f2") + gap("f3") + gap("f4")) / 4.0).alias("gaps")]
    stats = rows.groupBy(*keys).agg(*aggs)
    smooth = sum((F.coalesce(1.0 - F.least(F.lit(1.0), F.col("d_" + f) / (F.col("m_" + f) * 0.1)), F.lit(0.0)) for f in names), F.lit(0.0))
    ratio = F.col("m_f4") / F.col("ceiling")
    squeeze = F.when(ratio > 0.85, F.least(F.lit(1.0), (ratio - 0.85) / 0.10)).otherwise(0.0)
    score = smooth + 2.0 * F.coalesce("ordered", F.lit(0.0)) + F.col("fine") - F.col("gaps") - squeeze
    return stats.select(*keys, F.when(F.col("n") < 2, 0.0).otherwise(score).alias("score"))


def _amplitude(db: float) -> float:
    try:
        return math.pow(10.0, db / 20.0)
    except OverflowError:
        return math.inf


@F.pandas_udf(T.DoubleType())
def amplitude(db: pd.Series) -> pd.Series:
    """10 to the power of a twentieth, by the C library's power, as engines in C have it.

    The JVM's is one bit off for some levels, which decides whether a frame
    exactly 20 dB below the peak is above a tenth of it.
    """
    return db.map(_amplitude)


def recording_quality(frames: DataFrame) -> DataFrame:
    """Share of clipped frames, level of the loudest over the softest quarter, share of voiced frames, by session."""
    rows = frames.select("session_id", "seq", F.when(F.col("rms").isNotNull(), amplitude("rms")).alias("level"))
    up, whole = Window.partitionBy("session_id").orderBy("level", "seq"), Window.partitionBy("session_id")
    rows = rows.withColumns({"soft": F.row_number().over(up), "n": F.count("*").over(whole), "peak": F.max("level").over(whole)})
    rows = rows.withColumn("loud", F.col("n") + 1 - F.col("soft"))  # ties have one level, so their order changes no mean
    q = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    stats = rows.groupBy("session_id").agg(
        F.max("n").alias("n"), F.avg(F.when(F.col("level") > 0.99, 1.0).otherwise(0.0)).alias("clipped"),
        F.avg(F.when(F.col("loud") <= q, F.col("level"))).alias("signal"), F.avg(F.when(F.col("soft") <= q, F.col("level"))).alias("noise"),
        F.avg(F.when(F.col("level") > 0.1 * F.col("peak"), 1.0).otherwise(0.0)).alias("voiced"),
    )
    snr = F.when(F.col("n") < 4, 0.0).when(F.col("noise") <= 0, 60.0).otherwise(20.0 * F.log10(F.col("signal") / F.col("noise")))
    out = stats.select("session_id", "clipped", snr.alias("snr"), "voiced")
    return out.withColumn("good", (F.col("clipped") < 0.01) & (F.col("snr") > 15) & (F.col("voiced") > 0.3))


def trailing(frames: DataFrame, seconds: float) -> DataFrame:
    """Vowel frames with what the trailing window of their session holds (its far end included)."""
    micros = F.round(F.col("t") * 1e6).cast("bigint")
    rows = voiced_vowels(frames).withColumn("us", micros)
    span = round(seconds * 1e6)
    same = Window.partitionBy("session_id", "vowel").orderBy("us").rangeBetween(-span, 0)
    return rows.select(
        "session_id", "seq", "t", "vowel", F.avg(F.coalesce("f4", F.lit(0.0))).over(same).alias("f4_mean"),
        F.coalesce(F.stddev_samp(F.coalesce("f4", F.lit(0.0))).over(same), F.lit(0.0)).alias("f4_std"),
        F.avg("f1").over(same).alias("f1_mean"), F.avg("f2").over(same).alias("f2_mean"), F.count("*").over(same).alias("n"),
    )


def accumulated(frames: DataFrame) -> DataFrame:
    """By session: means of what is there, variation of F4 over monophthongs, and confidence in resonance."""
    rows = voiced_vowels(frames)
    plain = F.col("vowel").isin(*MONOPHTHONGS)
    by = rows.groupBy("session_id", "vowel").agg(
        F.count("*").alias("n"), F.avg("f4").alias("m"), F.stddev_samp("f4").alias("s"),
        *(F.sum(F.when(F.col(c) > 0, F.col(c))).alias("sum_" + c) for c in ("f0", "f1", "f2")), *(F.count(F.when(F.col(c) > 0, F.col(c))).alias("n_" + c) for c in ("f0", "f1", "f2")),
    )
    cv = F.avg(F.when(plain & (F.col("n") >= 5) & (F.col("m") > 0), F.col("s") / F.col("m")))
    n = F.sum(F.when(plain, F.col("n")).otherwise(0))
    kinds = F.count_if(plain & (F.col("n") >= 3))
    return by.groupBy("session_id").agg(
        cv.alias("f4_cv"), F.sqrt(F.least(F.lit(1.0), n / 30.0) * F.least(F.lit(1.0), kinds / 3.0)).alias("confidence"),
        *(F.coalesce(F.sum("sum_" + c) / F.sum("n_" + c), F.lit(0.0)).alias("mean_" + c) for c in ("f0", "f1", "f2")), F.sum("n").alias("n"),
    )


def runs(frames: DataFrame, flag: Column, keys: tuple[str, ...] = ("session_id",), order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """Runs of frames for which ``flag`` holds: keys, first and last position, start, end, n, and whether it ends the session."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = frames.withColumns({"flag": flag, "i": F.row_number().over(w), "n_all": F.count("*").over(Window.partitionBy(*keys))}).where("flag")
    rows = rows.withColumn("island", F.col("i") - F.row_number().over(w))
    return rows.groupBy(*keys, "island").agg(
        F.min("i").cast("bigint").alias("first"), F.max("i").cast("bigint").alias("last"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"),
        (F.max("i") == F.max("n_all")).alias("is_last"),
    ).drop("island")


def segments(frames: DataFrame, quiet_db: float, shortest_pause: float, shortest: float, longest: float) -> DataFrame:
    """Sessions cut at the middles of their pauses; short parts go, long ones are split evenly; one whole if nothing stays."""
    peak = F.max("rms").over(Window.partitionBy("session_id"))
    rows = frames.withColumn("rel", F.col("rms") - peak)
    pauses = runs(rows, F.col("rel") < quiet_db).where(~F.col("is_last") & (F.col("end") - F.col("start") >= shortest_pause))
    cuts = pauses.select("session_id", ((F.col("start") + F.col("end")) / 2).alias("cut"))
    ends = frames.groupBy("session_id").agg(F.min("t").alias("begin"), F.max("t").alias("stop"))
    marks = cuts.unionByName(ends.select("session_id", F.col("begin").alias("cut"))).unionByName(ends.select("session_id", F.col("stop").alias("cut")))
    order = Window.partitionBy("session_id").orderBy("cut")
    parts = marks.distinct().withColumn("until", F.lead("cut").over(order)).where("until IS NOT NULL").where(F.col("until") - F.col("cut") >= shortest)
    pieces = F.ceil((F.col("until") - F.col("cut")) / longest).cast("int")
    parts = parts.withColumn("pieces", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    width = (F.col("until") - F.col("cut")) / F.col("pieces")
    split = parts.select("session_id", (F.col("cut") + F.col("k") * width).alias("start"), (F.col("cut") + (F.col("k") + 1) * width).alias("end"))
    whole = ends.join(split, "session_id", "left_anti").where(F.col("stop") - F.col("begin") >= shortest / 2)
    return split.unionByName(whole.select("session_id", F.col("begin").alias("start"), F.col("stop").alias("end")))


def slips(frames: DataFrame, rise: float = 100.0, drop: float = 200.0) -> DataFrame:
    """Frames where pitch jumps up while the fourth formant falls, against the frame before that has both."""
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    rows = frames.where("f0 > 0 AND rms >= -60").withColumns({"f0_before": F.lag("f0").over(order), "f4_before": F.lag("f4").over(order)})
    return rows.where((F.col("f0") - F.col("f0_before") > rise) & (F.col("f4_before") - F.col("f4") > drop))


def split_trend(frames: DataFrame, column: str, parts: int, at_least: int) -> DataFrame:
    """Mean of the last part of a session less that of the first, of ``parts`` equal parts (two: all frames)."""
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    rows = frames.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("session_id"))})
    size = F.floor(F.col("n") / parts)
    late = F.col("i") > (size if parts == 2 else F.col("n") - size)
    stats = rows.where(F.col("n") >= at_least).groupBy("session_id").agg(
        F.avg(F.when(F.col("i") <= size, F.col(column))).alias("early"), F.avg(F.when(late, F.col(column))).alias("late")
    )
    return stats.withColumn("change", F.col("late") - F.col("early"))


def local_jitter(frames: DataFrame) -> DataFrame:
    """Difference to the period before over the mean of the three periods around each voiced frame."""
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    rows = frames.where("f0 > 0").withColumn("p", 1.0 / F.col("f0"))
    rows = rows.withColumns({"before": F.lag("p").over(order), "after": F.lead("p").over(order)})
    return rows.where("before IS NOT NULL AND after IS NOT NULL").withColumn("local", F.abs(F.col("p") - F.col("before")) / ((F.col("before") + F.col("p") + F.col("after")) / 3.0))


def noise_floor(frames: DataFrame, margin: float = 12.0, ceiling: float = -20.0, at_least: int = 10) -> DataFrame:
    """Threshold for voice by session: the level a quarter up the sorted ones and a margin, capped."""
    order = Window.partitionBy("session_id").orderBy("rms", "seq")
    rows = frames.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("session_id"))})
    low = rows.where((F.col("n") >= at_least) & (F.col("i") == F.floor(F.col("n") * 0.25) + 1))
    return low.select("session_id", F.col("rms").alias("p25"), F.least(F.col("rms") + margin, F.lit(ceiling)).alias("threshold"))
