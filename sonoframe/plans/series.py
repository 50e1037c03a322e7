"""Windows, runs, trends and folds along sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoframe.functions import acoustics as A
from sonoframe.operators import folds
from sonoframe.operators import frames as O
from sonoframe.operators.running import running_total
from sonoframe.plans.cases import case
from sonoframe.plans.vowels import DELTA
from sonoframe.sources.bindings import FRAMES, frames

#: Events lie about half a day apart, so windows and pauses are days.
DAY = 86_400.0

case(
    "pitch_summary",
    lambda spark, d: O.pitch_summary(frames(spark, d)),
    f"""WITH {FRAMES}, v AS (SELECT *, CASE WHEN conf > 0.5 AND f0 > 0 THEN f0 END AS x FROM frames)
    SELECT session_id, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, min(x) AS low, max(x) AS high, avg((x IS NOT NULL)::INT) AS voiced FROM v GROUP BY session_id""",
    "mean median std low high voiced",
)
case(
    "percentile_trim",
    lambda spark, d: O.percentile_trimmed(frames(spark, d), ("f1", "f2", "f4")),
    f"""WITH {FRAMES}, long AS (SELECT session_id, 'f1' AS name, f1 AS x FROM frames UNION ALL SELECT session_id, 'f2', f2 FROM frames UNION ALL SELECT session_id, 'f4', f4 FROM frames),
    p AS (SELECT session_id, name, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi, count(*) AS n FROM long WHERE x > 0 GROUP BY ALL)
    SELECT session_id, name, avg(x) AS mean, count(*) AS n_kept FROM long JOIN p USING (session_id, name) WHERE x > 0 AND (n < 10 OR x BETWEEN lo AND hi) GROUP BY session_id, name""",
    "mean",
)
case(
    "mad_filter",
    lambda spark, d: O.mad_filtered(frames(spark, d), {"f1": 30.0, "f2": 50.0}).select("seq"),
    f"""WITH {FRAMES}, med AS (SELECT session_id, median(f1) AS x1, median(f2) AS x2 FROM frames GROUP BY session_id),
    mad AS (SELECT session_id, greatest(median(abs(f1 - x1)), 30) AS y1, greatest(median(abs(f2 - x2)), 50) AS y2 FROM frames JOIN med USING (session_id) GROUP BY session_id)
    SELECT seq FROM frames JOIN med USING (session_id) JOIN mad USING (session_id) WHERE abs(f1 - x1) < 3.5 * y1 AND abs(f2 - x2) < 3.5 * y2""",
)
case(
    "bark_vowel_space",
    lambda spark, d: O.vowel_space(frames(spark, d)),
    f"""WITH {FRAMES}, b AS (SELECT session_id, 13 * atan(0.00076 * f1) + 3.5 * atan(pow(f1 / 7500, 2)) AS x, 13 * atan(0.00076 * f2) + 3.5 * atan(pow(f2 / 7500, 2)) AS y FROM frames WHERE f1 > 0 AND f2 > 0)
    SELECT session_id, (quantile_cont(x, 0.9) - quantile_cont(x, 0.1)) * (quantile_cont(y, 0.9) - quantile_cont(y, 0.1)) AS area FROM b GROUP BY session_id HAVING count(*) >= 10""",
    "area",
)
case(
    "prosody",
    lambda spark, d: O.prosody(frames(spark, d)),
    f"""WITH {FRAMES}, v AS (SELECT session_id, f0, row_number() OVER w AS i, count(*) OVER (PARTITION BY session_id) AS n FROM frames WHERE conf > 0.5 AND f0 > 0 WINDOW w AS (PARTITION BY session_id ORDER BY t, seq)),
    k AS (SELECT *, least(11, n // 2 * 2 + 1) AS width FROM v WHERE n >= 5),
    sm AS (SELECT a.session_id, a.i, avg(b.f0) AS x FROM k a JOIN k b ON a.session_id = b.session_id AND b.i BETWEEN a.i - a.width + 1 AND a.i WHERE a.i >= a.width AND a.width <= a.n GROUP BY a.session_id, a.i),
    st AS (SELECT session_id, round(x - lag(x) OVER (PARTITION BY session_id ORDER BY i), 9) AS step FROM sm),
    c AS (SELECT session_id, count(*) FILTER (step > 0) AS n_rises, count(*) FILTER (step < 0) AS n_falls FROM st GROUP BY session_id)
    SELECT session_id, stddev_pop(f0) / avg(f0) AS cv, 12 * log2(quantile_cont(f0, 0.95) / quantile_cont(f0, 0.05)) AS semitones,
      coalesce(any_value(n_rises), 0) AS n_rises, coalesce(any_value(n_falls), 0) AS n_falls, coalesce(any_value(n_rises), 0) / greatest(coalesce(any_value(n_falls), 0), 1) AS ratio
    FROM k LEFT JOIN c USING (session_id) GROUP BY session_id""",
    "cv semitones ratio",
)
case(
    "recording_quality",
    lambda spark, d: O.recording_quality(frames(spark, d)),
    f"""WITH {FRAMES}, l AS (SELECT session_id, seq, pow(10, rms / 20) AS level FROM frames),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY level, seq) AS soft, row_number() OVER (PARTITION BY session_id ORDER BY level DESC, seq) AS loud, count(*) OVER (PARTITION BY session_id) AS n, max(level) OVER (PARTITION BY session_id) AS peak FROM l),
    s AS (SELECT session_id, max(n) AS n, avg((level > 0.99)::INT) AS clipped, avg(level) FILTER (loud <= greatest(1, n // 4)) AS signal, avg(level) FILTER (soft <= greatest(1, n // 4)) AS noise, avg((level > 0.1 * peak)::INT) AS voiced FROM r GROUP BY session_id),
    q AS (SELECT session_id, clipped, CASE WHEN n < 4 THEN 0 WHEN noise <= 0 THEN 60 ELSE 20 * log10(signal / noise) END AS snr, voiced FROM s)
    SELECT *, clipped < 0.01 AND snr > 15 AND voiced > 0.3 AS good FROM q""",
    "clipped snr voiced",
)
SCORED = """pairs AS (SELECT {keys}, ceiling, name, x, abs(x - lag(x) OVER (PARTITION BY {keys}, name ORDER BY t, seq)) AS step FROM
    (SELECT {keys}, ceiling, t, seq, unnest(['f1', 'f2', 'f3', 'f4']) AS name, unnest([f1, f2, f3, f4]) AS x FROM cand) WHERE x > 0),
  smooth AS (SELECT {keys}, sum(s) AS s, max(CASE WHEN name = 'f4' THEN m END) AS m4 FROM (SELECT {keys}, name, coalesce(1 - least(1, avg(step) / (avg(x) * 0.1)), 0) AS s, avg(x) AS m FROM pairs GROUP BY {keys}, name) GROUP BY {keys}),
  rest AS (SELECT {keys}, max(ceiling) AS ceiling, count(*) AS n, coalesce(avg((f1 < f2 AND f2 < f3 AND f3 < f4)::INT) FILTER (f1 > 0 AND f2 > 0 AND f3 > 0 AND f4 > 0), 0) AS ordered,
    avg(((bw1 > 0 AND bw1 < 500)::INT + (bw2 > 0 AND bw2 < 500)::INT + (bw3 > 0 AND bw3 < 500)::INT) / 3) AS fine, avg(((f1 <= 0)::INT + (f2 <= 0)::INT + (f3 <= 0)::INT + (f4 <= 0)::INT) / 4) AS gaps FROM cand GROUP BY {keys}),
  scored AS (SELECT {keys}, CASE WHEN n < 2 THEN 0 ELSE s + 2 * ordered + fine - gaps - CASE WHEN m4 / ceiling > 0.85 THEN least(1, (m4 / ceiling - 0.85) / 0.10) ELSE 0 END END AS score FROM rest JOIN smooth USING ({keys}))"""
case(
    "formant_track_score",
    lambda spark, d: O.track_score(frames(spark, d), F.lit(4000.0), ["session_id"]),
    f"WITH {FRAMES}, cand AS (SELECT *, CAST(4000 AS DOUBLE) AS ceiling FROM frames), {SCORED.format(keys='session_id')} SELECT * FROM scored",
    "score",
)


def _ceilings(spark, d):
    rows = frames(spark, d)
    pitch = rows.groupBy("session_id").agg(F.avg(F.when((F.col("conf") > 0.5) & (F.col("f0") > 0), F.col("f0"))).alias("mean"))
    few = F.when(F.col("mean") > 200, F.array(F.lit(5500.0))).when(F.col("mean") > 160, F.array(*map(F.lit, (5000.0, 5200.0, 5500.0))))
    candidates = pitch.select("session_id", F.explode(few.otherwise(F.array(*map(F.lit, (4500.0, 4800.0, 5000.0, 5200.0, 5500.0))))).alias("hz"))
    tried = rows.join(candidates, "session_id").withColumn("f4", F.col("f4") * F.col("hz") / 5500.0)
    scores = O.track_score(tried, F.col("hz"), ["session_id", "hz"])
    best = F.max(F.struct(F.round("score", 6).alias("score"), "hz")).alias("best")  # of equal scores the higher ceiling, which comes last
    return scores.groupBy("session_id").agg(best).select("session_id", F.col("best.hz").alias("ceiling"))


case(
    "ceiling_select",
    _ceilings,
    f"""WITH {FRAMES}, pitch AS (SELECT session_id, avg(f0) FILTER (conf > 0.5 AND f0 > 0) AS mean FROM frames GROUP BY session_id),
    tries AS (SELECT session_id, unnest(CASE WHEN mean > 200 THEN [5500] WHEN mean > 160 THEN [5000, 5200, 5500] ELSE [4500, 4800, 5000, 5200, 5500] END) AS hz FROM pitch),
    cand AS (SELECT frames.* REPLACE (f4 * hz / 5500 AS f4), CAST(hz AS DOUBLE) AS hz, CAST(hz AS DOUBLE) AS ceiling FROM frames JOIN tries USING (session_id)), {SCORED.format(keys='session_id, hz')}
    SELECT session_id, hz AS ceiling FROM scored QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(score, 6) DESC, hz DESC) = 1""",
)


def _correlations(spark, d):
    rows = frames(spark, d)
    pair = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a)), lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(b))
    one = lambda a, b: F.when((F.count(pair[0](a, b)) >= 10) & (F.stddev_pop(pair[0](a, b)) > 0) & (F.stddev_pop(pair[1](a, b)) > 0), F.corr(pair[0](a, b), pair[1](a, b)))
    return rows.groupBy("session_id").agg(one("f1", "f2").alias("f1_f2"), one("f0", "f1").alias("f0_f1"), one("f0", "f2").alias("f0_f2"))


CORR = "CASE WHEN count(*) FILTER ({a} > 0 AND {b} > 0) >= 10 AND stddev_pop({a}) FILTER ({a} > 0 AND {b} > 0) > 0 AND stddev_pop({b}) FILTER ({a} > 0 AND {b} > 0) > 0 THEN corr({a}, {b}) FILTER ({a} > 0 AND {b} > 0) END AS {a}_{b}"
case(
    "contour_correlation",
    _correlations,
    f"WITH {FRAMES} SELECT session_id, {CORR.format(a='f1', b='f2')}, {CORR.format(a='f0', b='f1')}, {CORR.format(a='f0', b='f2')} FROM frames GROUP BY session_id",
    "f1_f2 f0_f1 f0_f2",
)
RUNS = """ordered AS (SELECT *, {flag} AS flag, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY session_id) AS n_all FROM {rows}),
  islands AS (SELECT *, i - row_number() OVER (PARTITION BY session_id ORDER BY i) AS island FROM ordered WHERE flag),
  runs AS (SELECT session_id, min(i) AS "first", max(i) AS "last", min(t) AS start, max(t) AS "end", count(*) AS n, max(i) = max(n_all) AS is_last FROM islands GROUP BY session_id, island)"""
QUIET = "rel AS (SELECT *, rms - max(rms) OVER (PARTITION BY session_id) AS rel FROM frames)"


def _relative(spark, d):
    return frames(spark, d).withColumn("rel", F.col("rms") - F.max("rms").over(Window.partitionBy("session_id")))


case(
    "silence_segments",
    lambda spark, d: O.runs(_relative(spark, d), F.col("rel") < -35).where("n >= 2"),
    f"WITH {FRAMES}, {QUIET}, {RUNS.format(flag='rel < -35', rows='rel')} SELECT * FROM runs WHERE n >= 2",
    'start "end"',
)
case(
    "segment_split",
    lambda spark, d: O.segments(frames(spark, d), -25.0, DAY, 2 * DAY, 5 * DAY).select("session_id", *(F.round(c, 3).alias(c) for c in ("start", "end"))),
    f"""WITH {FRAMES}, {QUIET}, {RUNS.format(flag='rel < -25', rows='rel')},
    ends AS (SELECT session_id, min(t) AS b, max(t) AS e FROM frames GROUP BY session_id),
    marks AS (SELECT session_id, (start + "end") / 2 AS cut FROM runs WHERE NOT is_last AND "end" - start >= 86400 UNION SELECT session_id, b FROM ends UNION SELECT session_id, e FROM ends),
    parts AS (SELECT session_id, cut, lead(cut) OVER (PARTITION BY session_id ORDER BY cut) AS nxt FROM marks),
    kept AS (SELECT *, CAST(ceil((nxt - cut) / 432000) AS BIGINT) AS pieces FROM parts WHERE nxt - cut >= 172800),
    split AS (SELECT session_id, cut, (nxt - cut) / pieces AS width, unnest(range(pieces)) AS k FROM kept)
    SELECT session_id, round(cut + k * width, 3) AS start, round(cut + (k + 1) * width, 3) AS "end" FROM split
    UNION ALL SELECT session_id, round(b, 3), round(e, 3) FROM ends WHERE e - b >= 86400 AND session_id NOT IN (SELECT session_id FROM kept)""",
    'start "end"',
)
case(
    "longest_closure",
    lambda spark, d: O.runs(_relative(spark, d), F.col("rel") < -20).groupBy("session_id").agg(F.max("n").alias("longest"), F.count("*").alias("n_runs")).withColumn("tap", F.col("longest").between(2, 8)),
    f"WITH {FRAMES}, {QUIET}, {RUNS.format(flag='rel < -20', rows='rel')} SELECT session_id, max(n) AS longest, count(*) AS n_runs, max(n) BETWEEN 2 AND 8 AS tap FROM runs GROUP BY session_id",
)
case(
    "min_runs",
    lambda spark, d: O.runs(frames(spark, d), (F.col("f0") < 200) & (F.col("jitter") > 0.5)).where("n >= 3").groupBy("session_id").agg(F.sum("n").alias("n_frames"), F.count("*").alias("n_runs")),
    f"WITH {FRAMES}, {RUNS.format(flag='f0 < 200 AND jitter > 0.5', rows='frames')} SELECT session_id, CAST(sum(n) AS BIGINT) AS n_frames, count(*) AS n_runs FROM runs WHERE n >= 3 GROUP BY session_id",
)
case(
    "local_jitter",
    lambda spark, d: O.local_jitter(frames(spark, d)).groupBy("session_id").agg(F.avg("local").alias("mean"), F.max("local").alias("most")),
    f"""WITH {FRAMES}, p AS (SELECT session_id, 1 / f0 AS p, lag(1 / f0) OVER w AS b, lead(1 / f0) OVER w AS a FROM frames WHERE f0 > 0 WINDOW w AS (PARTITION BY session_id ORDER BY t, seq))
    SELECT session_id, avg(abs(p - b) / ((b + p + a) / 3)) AS mean, max(abs(p - b) / ((b + p + a) / 3)) AS most FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY session_id""",
    "mean most",
)
case(
    "falsetto_slip",
    lambda spark, d: O.slips(frames(spark, d)).select("session_id", "seq"),
    f"""WITH {FRAMES}, b AS (SELECT *, lag(f0) OVER w AS p0, lag(f4) OVER w AS p4 FROM frames WHERE f0 > 0 AND rms >= -60 WINDOW w AS (PARTITION BY session_id ORDER BY t, seq))
    SELECT session_id, seq FROM b WHERE f0 - p0 > 100 AND p4 - f4 > 200""",
)
TREND = """WITH {frames}, r AS (SELECT session_id, {c} AS x, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM frames),
    s AS (SELECT session_id, avg(x) FILTER (i <= n // {p}) AS early, avg(x) FILTER (i > {late}) AS late FROM r WHERE n >= {least} GROUP BY session_id)
    SELECT session_id, early, late, late - early AS change FROM s"""
case("trend_half_split", lambda spark, d: O.split_trend(frames(spark, d), "hnr", 2, 20), TREND.format(frames=FRAMES, c="hnr", p=2, late="n // 2", least=20), "early late change")
case("trend_quarter_split", lambda spark, d: O.split_trend(frames(spark, d), "jitter", 4, 40), TREND.format(frames=FRAMES, c="jitter", p=4, late="n - n // 4", least=40), "early late change")
case(
    "spectral_tilt_regression",
    lambda spark, d: frames(spark, d).where("f0 > 0").groupBy("session_id").agg(F.regr_slope("a1", F.log2("f0")).alias("slope"), F.count("*").alias("n")),
    f"WITH {FRAMES} SELECT session_id, regr_slope(a1, log2(f0)) AS slope, count(*) AS n FROM frames WHERE f0 > 0 GROUP BY session_id",
    "slope",
)
case(
    "last_valid",
    lambda spark, d: frames(spark, d).where("conf > 0.5").groupBy("session_id", "kind").agg(F.max(F.struct("t", "seq", "f0")).alias("r")).select("session_id", "kind", "r.seq", "r.f0"),
    f"WITH {FRAMES} SELECT session_id, kind, seq, f0 FROM frames WHERE conf > 0.5 QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY t DESC, seq DESC) = 1",
    "f0",
)
case(
    "latest_snapshot",
    lambda spark, d: frames(spark, d).groupBy("session_id").agg(*(F.max(F.when(F.col("kind") == k, F.struct("t", "seq", "value")))["value"].alias(k) for k in ("click", "view", "error"))),
    f"WITH {FRAMES} SELECT session_id, " + ", ".join(f"arg_max(value, struct_pack(t := t, seq := seq)) FILTER (kind = '{k}') AS {k}" for k in ("click", "view", "error")) + " FROM frames GROUP BY session_id",
    "click view error",
)
case(
    "session_clock",
    lambda spark, d: running_total(frames(spark, d).select("session_id", "seq", "t", "k"), ["session_id"], ["t", "seq"], F.floor(F.col("t") / DAY), F.col("k"), "total").select("session_id", "seq", (F.col("total") / 48.0).alias("session_t")),
    f"WITH {FRAMES} SELECT session_id, seq, sum(k) OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) / CAST(48 AS DOUBLE) AS session_t FROM frames",
    "session_t",
)
case(
    "baseline_capture",
    lambda spark, d: frames(spark, d).withColumn("begin", F.min("t").over(Window.partitionBy("session_id"))).withColumn("delta_f", A.delta_f(*(F.col(f"f{i}") for i in (1, 2, 3, 4))))
    .where((F.col("t") >= F.col("begin") + 3 * DAY) & (F.col("delta_f") > 0)).groupBy("session_id").agg(F.min(F.struct("t", "seq", "delta_f")).alias("r")).select("session_id", "r.seq", "r.delta_f"),
    f"""WITH {FRAMES}, b AS (SELECT *, min(t) OVER (PARTITION BY session_id) AS b, {DELTA} AS delta_f FROM frames)
    SELECT session_id, seq, delta_f FROM b WHERE t >= b + 259200 AND delta_f > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t, seq) = 1""",
    "delta_f",
)
case(
    "sparkline",
    lambda spark, d: frames(spark, d).where("f0 > 0 AND conf >= 0.3").select("session_id", "seq", F.avg("f0").over(Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(-59, 0)).alias("mean_60"), F.min("f0").over(Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(-59, 0)).alias("low_60")),
    f"WITH {FRAMES} SELECT session_id, seq, avg(f0) OVER w AS mean_60, min(f0) OVER w AS low_60 FROM frames WHERE f0 > 0 AND conf >= 0.3 WINDOW w AS (PARTITION BY session_id ORDER BY t, seq ROWS 59 PRECEDING)",
    "mean_60 low_60",
)
case(
    "calibration_p25",
    lambda spark, d: O.noise_floor(frames(spark, d)),
    f"""WITH {FRAMES}, r AS (SELECT session_id, rms, row_number() OVER (PARTITION BY session_id ORDER BY rms, seq) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM frames)
    SELECT session_id, rms AS p25, least(rms + 12, -20) AS threshold FROM r WHERE n >= 10 AND i = CAST(floor(n * 0.25) AS BIGINT) + 1""",
    "p25 threshold",
)
case(
    "calibration_mean",
    lambda spark, d: frames(spark, d).withColumn("begin", F.min("t").over(Window.partitionBy("session_id"))).where(F.col("t") - F.col("begin") <= 2 * DAY).groupBy("session_id").agg(F.avg("rms").alias("floor"), F.avg(F.when(F.col("f1") > 0, F.col("f1"))).alias("reference")),
    f"""WITH {FRAMES}, b AS (SELECT *, min(t) OVER (PARTITION BY session_id) AS b FROM frames) SELECT session_id, avg(rms) AS floor, avg(CASE WHEN f1 > 0 THEN f1 END) AS reference FROM b WHERE t - b <= 172800 GROUP BY session_id""",
    "floor reference",
)


#: Limits of the rules for a voice's safety.
LIMITS = {
    "constriction_f1": 800.0, "constriction_hnr": 12.0, "jitter_concern": 1.5, "shimmer_concern": 5.0, "hnr_warning": 12.0, "breathy_h1_h2": 8.0, "hnr_concern": 16.0,
    "hnr_alert": 7.0, "jitter_warning": 2.5, "shimmer_warning": 8.0, "interference": 0.8, "high_f0": 300.0, "some_interference": 0.5,
}


def speech(spark, d):
    """Frames of the rules: with first formants up to where voices squeeze, and pitch up to 380 Hz."""
    rows = frames(spark, d)
    return rows.withColumns({"f1": F.when(F.col("f1") > 0, F.col("f1") + F.col("seq") % 7 * 100).otherwise(0.0), "f0": F.when(F.col("f0") > 0, F.col("f0") + F.col("k")).otherwise(0.0)})


SPEECH = f"{FRAMES}, speech AS (SELECT * REPLACE (CASE WHEN f1 > 0 THEN f1 + seq % 7 * 100 ELSE 0 END AS f1, CASE WHEN f0 > 0 THEN f0 + k ELSE 0 END AS f0) FROM frames)"


def candidates(rows, limits=LIMITS):
    """A row for each voiced frame and rule that it sets off: session_id, seq, t, type, level, once.

    Missing measures set off nothing; ``once`` marks the milder rule for pitch
    near the first formant, which speaks only if that type hasn't spoken yet.
    """
    x, c = limits, F.col
    ratio = c("f0") / c("f1")
    unsteady = (F.coalesce("jitter", F.lit(0.0)) > x["jitter_concern"]) | (F.coalesce("shimmer", F.lit(0.0)) > x["shimmer_concern"])
    worn = (F.coalesce("jitter", F.lit(0.0)) > x["jitter_warning"]) & (F.coalesce("shimmer", F.lit(0.0)) > x["shimmer_warning"])
    rules = [
        ("constriction", "warning", False, (c("f1") > x["constriction_f1"]) & (c("hnr") < x["constriction_hnr"]) & (unsteady | (c("hnr") < x["hnr_warning"]))),
        ("breathiness_masking", "coaching", False, (c("h1_h2") > x["breathy_h1_h2"]) & (c("hnr") < x["hnr_concern"])),
        ("vocal_strain", "alert", False, c("hnr") < x["hnr_alert"]),
        ("vocal_strain", "warning", False, (c("hnr") >= x["hnr_alert"]) & worn),
        ("f0_interference", "info", False, (c("f1") > 0) & (ratio > x["interference"])),
        ("f0_interference", "info", True, (c("f1") > 0) & (ratio <= x["interference"]) & (ratio > x["some_interference"]) & (c("f0") > x["high_f0"])),
    ]
    hit = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level"), F.lit(once).alias("once"))) for kind, level, once, when in rules)))
    voiced = rows.where("f0 > 0 AND rms >= -60")
    return voiced.select("session_id", "seq", "t", F.explode(hit).alias("w")).select("session_id", "seq", "t", "w.*")


def safety(rows, days=15.0):
    """All candidates: those of single frames, falsetto slips, and fatigue once a session is as old as its window."""
    single = candidates(rows)
    slip = O.slips(rows).select("session_id", "seq", "t", F.lit("falsetto_slip").alias("type"), F.lit("warning").alias("level"), F.lit(False).alias("once"))
    tired = folds.declines(rows.where("f0 > 0 AND rms >= -60"), days * DAY, 1000, 20, 3.0, 1.0)
    tired = tired.select("session_id", "seq", "t", F.lit("session_fatigue").alias("type"), F.lit("coaching").alias("level"), F.lit(False).alias("once"))
    return single.unionByName(slip).unionByName(tired)


#: Halves of trailing samples in SQL: list the samples of the window, keep the last 1000.
TIRED = """voiced AS (SELECT *, CAST(round(t * 1e6) AS BIGINT) AS us, min(t) OVER (PARTITION BY session_id) AS begin FROM {table} WHERE f0 > 0 AND rms >= -60),
  lists AS (SELECT session_id, seq, t, begin, list(hnr) FILTER (hnr <> 0) OVER w AS h, list(jitter) FILTER (jitter <> 0) OVER w AS j FROM voiced
    WINDOW w AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN 1296000000000 PRECEDING AND CURRENT ROW)),
  halves AS (SELECT session_id, seq, t, begin, h[-1000:] AS h, j[-1000:] AS j FROM lists),
  tired AS (SELECT session_id, seq, t,
      CASE WHEN len(h) >= 20 AND round(list_avg(h[1:len(h) // 2]) - list_avg(h[len(h) // 2 + 1:]), 9) >= 3 THEN 'hnr'
           WHEN len(j) >= 20 AND round(list_avg(j[len(j) // 2 + 1:]) - list_avg(j[1:len(j) // 2]), 9) >= 1 THEN 'jitter' END AS cause
    FROM halves WHERE t - begin >= 1296000)"""
VOICED = "FROM speech WHERE f0 > 0 AND rms >= -60 AND"
RULES = f"""{TIRED.format(table='speech')},
  steps AS (SELECT *, lag(f0) OVER w AS f0_before, lag(f4) OVER w AS f4_before FROM speech WHERE f0 > 0 AND rms >= -60 WINDOW w AS (PARTITION BY session_id ORDER BY t, seq)),
  cand AS (
  SELECT session_id, seq, t, 'constriction' AS type, 'warning' AS level, false AS once {VOICED} f1 > 800 AND hnr < 12
  UNION ALL SELECT session_id, seq, t, 'breathiness_masking', 'coaching', false {VOICED} h1_h2 > 8 AND hnr < 16
  UNION ALL SELECT session_id, seq, t, 'vocal_strain', CASE WHEN hnr < 7 THEN 'alert' ELSE 'warning' END, false {VOICED} (hnr < 7 OR (jitter > 2.5 AND shimmer > 8))
  UNION ALL SELECT session_id, seq, t, 'f0_interference', 'info', f0 / f1 <= 0.8 {VOICED} f1 > 0 AND (f0 / f1 > 0.8 OR (f0 > 300 AND f0 / f1 > 0.5))
  UNION ALL SELECT session_id, seq, t, 'falsetto_slip', 'warning', false FROM steps WHERE f0 - f0_before > 100 AND f4_before - f4 > 200
  UNION ALL SELECT session_id, seq, t, 'session_fatigue', 'coaching', false FROM tired WHERE cause IS NOT NULL)"""
GREEDY = """numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, seq) AS i FROM cand),
  walk AS (SELECT {keys}, seq, t, level, i, t AS last, true AS kept FROM numbered WHERE i = 1
    UNION ALL SELECT {nkeys}, n.seq, n.t, n.level, n.i, CASE WHEN n.t - w.last < {gap} OR {never} THEN w.last ELSE n.t END, NOT (n.t - w.last < {gap} OR {never}) FROM walk w JOIN numbered n ON {on} AND n.i = w.i + 1)"""
BY_TYPE = {"keys": "session_id, type", "nkeys": "n.session_id, n.type", "on": "n.session_id = w.session_id AND n.type = w.type"}
ALERTS = "session_id bigint, seq bigint, t double, type string, level string"
case(
    "cooldown_alerts",
    lambda spark, d: folds.cooled_down(safety(speech(spark, d)), ["session_id", "type"], 2 * DAY, ALERTS, once="once"),
    f"WITH RECURSIVE {SPEECH}, {RULES}, {GREEDY.format(**BY_TYPE, gap=172800, never='n.once')} SELECT session_id, seq, t, type, level FROM walk WHERE kept",
    "t",
)


def _status(spark, d):
    """Of each session: minutes since its first voiced frame, active warnings by type with their last level, and samples kept."""
    rows = speech(spark, d).where("f0 > 0 AND rms >= -60")
    alerts = folds.cooled_down(safety(rows), ["session_id", "type"], 2 * DAY, ALERTS, once="once")
    last = alerts.groupBy("session_id", "type").agg(F.max(F.struct("t", "seq", "level"))["level"].alias("level"))
    active = last.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "type", "level"))), ",").alias("active"))
    kept = lambda c: F.least(F.count(F.when(F.col(c) != 0, 1)), F.lit(1000)).alias(c + "_samples")
    base = rows.groupBy("session_id").agg(((F.max("t") - F.min("t")) / 60.0).alias("minutes"), kept("hnr"), kept("jitter"))
    return base.join(active, "session_id", "left").withColumn("active", F.coalesce("active", F.lit("")))


case(
    "monitor_status",
    _status,
    f"""WITH RECURSIVE {SPEECH}, {RULES}, {GREEDY.format(**BY_TYPE, gap=172800, never='n.once')},
    latest AS (SELECT session_id, type, level FROM walk WHERE kept QUALIFY row_number() OVER (PARTITION BY session_id, type ORDER BY t DESC, seq DESC) = 1),
    active AS (SELECT session_id, string_agg(type || ':' || level, ',' ORDER BY type || ':' || level) AS active FROM latest GROUP BY session_id),
    base_of AS (SELECT session_id, (max(t) - min(t)) / 60 AS minutes, least(count(*) FILTER (hnr <> 0), 1000) AS hnr_samples, least(count(*) FILTER (jitter <> 0), 1000) AS jitter_samples FROM speech WHERE f0 > 0 AND rms >= -60 GROUP BY session_id)
    SELECT session_id, minutes, hnr_samples, jitter_samples, coalesce(active, '') AS active FROM base_of LEFT JOIN active USING (session_id)""",
    "minutes",
)
case(
    "telemetry_sample",
    lambda spark, d: folds.cooled_in_parts(frames(spark, d).select("session_id", "seq", "t", F.col("kind").alias("level")), ["session_id"], DAY, 10 * DAY, "session_id bigint, seq bigint, t double, level string"),
    f"WITH RECURSIVE {FRAMES}, cand AS (SELECT session_id, seq, t, kind AS level FROM frames), {GREEDY.format(keys='session_id', nkeys='n.session_id', on='n.session_id = w.session_id', gap=86400, never='false')} SELECT session_id, seq, t, level FROM walk WHERE kept",
    "t",
)
case(
    "vad_timer",
    lambda spark, d: folds.voice_by_timer(frames(spark, d), -45.0, DAY / 8, DAY / 4),
    f"""WITH RECURSIVE {FRAMES}, n AS (SELECT session_id, seq, t, rms, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i FROM frames),
    w AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS t, true AS armed, false AS speaking, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, CAST(NULL AS VARCHAR) AS event FROM n WHERE i = 1
      UNION ALL
      SELECT n.session_id, n.i, n.seq, n.t,
        NOT (n.rms < -45 AND w.speaking AND n.t - coalesce(w.down, n.t) >= 21600),
        CASE WHEN n.rms >= -45 THEN w.speaking OR n.t - coalesce(w.up, n.t) >= 10800 ELSE w.speaking END,
        CASE WHEN n.rms >= -45 AND NOT w.speaking AND n.t - coalesce(w.up, n.t) < 10800 THEN coalesce(w.up, n.t) END,
        CASE WHEN n.rms < -45 AND w.speaking THEN coalesce(w.down, n.t) END,
        CASE WHEN n.rms >= -45 AND NOT w.speaking AND n.t - coalesce(w.up, n.t) >= 10800 THEN 'voice' WHEN n.rms < -45 AND w.speaking AND n.t - coalesce(w.down, n.t) >= 21600 THEN 'silence' END
      FROM w JOIN n ON n.session_id = w.session_id AND n.i = w.i + 1 WHERE w.armed)
    SELECT session_id, seq, t, event FROM w WHERE event IS NOT NULL""",
    "t",
)
case(
    "vad_adaptive",
    lambda spark, d: folds.voice_by_floor(frames(spark, d), -50.0, DAY, DAY / 4),
    f"""WITH RECURSIVE {FRAMES}, n AS (SELECT session_id, seq, t, rms, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i FROM frames),
    w AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS t, CAST(-50 AS DOUBLE) AS floor, CAST(0 AS BIGINT) AS c, CAST(NULL AS DOUBLE) AS began, CAST(NULL AS DOUBLE) AS quiet, false AS done FROM n WHERE i = 1
      UNION ALL
      SELECT n.session_id, n.i, n.seq, n.t,
        CASE WHEN n.rms > w.floor + 10 THEN w.floor ELSE CAST(0.05 AS DOUBLE) * least(greatest(n.rms, -60), -20) + CAST(0.95 AS DOUBLE) * w.floor END,
        CASE WHEN n.rms > w.floor + 10 THEN w.c + 1 WHEN w.began IS NOT NULL THEN 0 ELSE w.c END,
        CASE WHEN n.rms > w.floor + 10 AND w.began IS NULL AND w.c + 1 >= 3 THEN n.t ELSE w.began END,
        CASE WHEN NOT n.rms > w.floor + 10 AND w.began IS NOT NULL THEN coalesce(w.quiet, n.t) END,
        NOT n.rms > w.floor + 10 AND w.began IS NOT NULL AND n.t - w.began >= 86400 AND n.t - coalesce(w.quiet, n.t) >= 21600
      FROM w JOIN n ON n.session_id = w.session_id AND n.i = w.i + 1 WHERE NOT w.done)
    SELECT session_id, seq, t, floor FROM w WHERE done""",
    "t floor",
)
case(
    "greedy_once",
    lambda spark, d: candidates(speech(spark, d)).withColumn("i", F.row_number().over(Window.partitionBy("session_id", "type").orderBy("t", "seq"))).where("i = 1").select("session_id", "type", "seq"),
    f"WITH {SPEECH}, {RULES} SELECT session_id, type, seq FROM cand WHERE type NOT IN ('falsetto_slip', 'session_fatigue') QUALIFY row_number() OVER (PARTITION BY session_id, type ORDER BY t, seq) = 1",
)
