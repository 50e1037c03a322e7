"""What a live display shows for each frame, and what differs between results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions import acoustics as A
from sonoframe.functions.norms import ENGLISH, MONOPHTHONGS
from sonoframe.plans.cases import case
from sonoframe.plans.series import DAY
from sonoframe.plans.vowels import CAVITY, DELTA, LARYNX, PLAIN, TONGUE, VOWELS
from sonoframe.sources import recordings
from sonoframe.sources.bindings import FRAMES, frames

C = F.col
#: Zones of formant dispersion in Hz, and warnings under which no score is shown.
ZONES = [(0.0, "masc"), (1050.0, "andro"), (1130.0, "fem")]
SUPPRESSING = ("breathiness_masking", "vocal_strain")


def display_frames(rows: DataFrame, window: float, warnings, score) -> DataFrame:
    """For each frame what the vowel frames of the trailing ``window`` seconds up to the last one say, with fallbacks to the frame itself.

    Only frames with a clear vowel add to the window, which ends at the last of
    them. Bars take the means of the window if it has any; stability is the
    variation of F4 over vowels with 5 frames or more; the trend compares the
    halves of its pitch (6 frames at least, 10 Hz); a score is shown if the least
    confidence is 0.5 and no warning suppresses it.
    """
    near = F.when((C("f1") > 0) & (C("f2") > 0), A.nearest_norm(C("f1"), C("f2")))
    rows = rows.select("*", F.explode(F.array(near)).alias("near"))
    norm = F.when(C("near.d") <= A.MAX_DISTANCE, C("near.ord"))
    rows = rows.withColumns({"norm": norm, "us": F.round(C("t") * 1e6).cast("bigint"), "raw_delta": A.delta_f(*(C(f"f{i}") for i in (1, 2, 3, 4)))}).drop("near")
    heard = C("norm").isNotNull()
    back = Window.partitionBy("session_id").orderBy("us").rangeBetween(-round(window * 1e6), 0)
    aggs = {f"mean_{n}": F.avg(F.when(heard, C(c))).over(back) for n, c in (("delta", "raw_delta"), ("f1", "f1"), ("f2", "f2"), ("h1_h2", "h1_h2"))}
    aggs |= {"pitches": F.collect_list(F.when(heard, C("f0"))).over(back), "voiced": F.count_if(heard & (C("f0") > 0)).over(back)}
    for i, (vowel, *_) in enumerate(ENGLISH):
        mine = C("norm") == i
        aggs[f"n_{i}"] = F.count_if(mine).over(back)
        if vowel in MONOPHTHONGS:
            f4 = F.when(mine, C("f4"))
            aggs |= {f"m_{i}": F.avg(f4).over(back), f"s_{i}": F.stddev_samp(f4).over(back)}
    rows = rows.withColumns(aggs)
    last = Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("w", F.last(F.when(heard, F.struct(*aggs)), True).over(last))
    w = lambda name: C("w." + name)
    plain = [i for i, (vowel, *_) in enumerate(ENGLISH) if vowel in MONOPHTHONGS]
    count = lambda i: F.coalesce(w(f"n_{i}"), F.lit(0))
    total = lambda terms: sum(terms[1:], terms[0])
    ratios = F.array_compact(F.array(*(F.when((count(i) >= 5) & (w(f"m_{i}") > 0), w(f"s_{i}") / w(f"m_{i}")) for i in plain)))
    cv = F.when(F.size(ratios) > 0, F.aggregate(ratios, F.lit(0.0), lambda s, x: s + x) / F.size(ratios))
    resonance = F.sqrt(F.least(F.lit(1.0), total([count(i) for i in plain]) / 30.0) * F.least(F.lit(1.0), total([(count(i) >= 3).cast("int") for i in plain]) / 3.0))
    pitch = F.least(F.lit(1.0), F.coalesce(w("voiced"), F.lit(0)) / 30.0)
    composite = F.least(resonance, pitch)
    half = F.floor(F.size(w("pitches")) / 2).cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)
    change = F.when(F.size(w("pitches")) >= 6, F.round(mean(F.slice(w("pitches"), half + 1, F.size(w("pitches")) - half)) - mean(F.slice(w("pitches"), 1, F.greatest(half, F.lit(1)))), 9))
    either = lambda name, own: F.when(w("mean_" + name) > 0, w("mean_" + name)).otherwise(own)
    delta = either("delta", C("raw_delta"))
    larynx, cavity, tongue = A.gesture_bars(delta, either("f1", C("f1")), either("f2", C("f2")))
    weight = A.weight_factor(F.coalesce(w("mean_h1_h2"), F.lit(0.0)))
    reason = A.suppressed(F.round(composite, 9), warnings, F.array(*map(F.lit, SUPPRESSING)))
    names = sorted((vowel, i) for i, (vowel, *_) in enumerate(ENGLISH))
    counts = F.concat_ws(",", *(F.when(count(i) > 0, F.concat(F.lit(vowel + ":"), count(i).cast("string"))) for vowel, i in names))
    shown = {
        "delta_f_hz": delta, "delta_f_zone": A.zone_of(F.round(delta, 9), ZONES), "h1_h2_db": C("h1_h2"), "f0_hz": C("f0"), "f0_confidence": C("conf"), "larynx": larynx, "cavity": cavity,
        "tongue": tongue, "thinness": weight, "lightness": weight, "stability_pct": A.stability_percent(cv), "trend_resonance": F.when(change > 10, "up").when(change < -10, "down").otherwise("stable"),
        "trend_weight": F.lit("stable"), "score": F.when(reason.isNull(), score), "resonance": resonance, "pitch": pitch, "vocal_weight": pitch, "prosody": pitch, "composite": composite,
        "vowel_counts": counts, "display_mode": F.lit("default"), "suppression_reason": reason,
    }
    return rows.select("session_id", "seq", *(e.alias(n) for n, e in shown.items()))


def warned():
    return F.array_compact(F.array(F.when(C("h1_h2") > 8, F.lit("breathiness_masking")), F.when(C("hnr") < 7, F.lit("vocal_strain")), F.when(C("jitter") > 3, F.lit("unsteady"))))


case(
    "display_frames",
    lambda spark, d: display_frames(frames(spark, d), 15 * DAY, warned(), C("conf") * 100),
    f"""WITH {VOWELS}, v AS (SELECT *, CAST(round(t * 1e6) AS BIGINT) AS us, {DELTA} AS raw_delta FROM vowels),
    pairs AS (SELECT a.session_id, a.seq AS last, b.vowel, b.f0, b.f1, b.f2, b.f4, b.h1_h2, b.raw_delta, row_number() OVER w AS i, count(*) OVER (PARTITION BY a.session_id, a.seq) AS n
      FROM v a JOIN v b ON a.session_id = b.session_id AND b.us BETWEEN a.us - 1296000000000 AND a.us WINDOW w AS (PARTITION BY a.session_id, a.seq ORDER BY b.us, b.seq)),
    by_vowel AS (SELECT session_id, last, vowel, count(*) AS n, avg(f4) AS m, stddev_samp(f4) AS s FROM pairs GROUP BY ALL),
    of_vowels AS (SELECT session_id, last, avg(CASE WHEN vowel IN ({PLAIN}) AND n >= 5 AND m > 0 THEN s / m END) AS cv, string_agg(vowel || ':' || n, ',' ORDER BY vowel) AS vowel_counts,
      sqrt(least(1, coalesce(sum(n) FILTER (vowel IN ({PLAIN})), 0) / 30.0) * least(1, count(*) FILTER (vowel IN ({PLAIN}) AND n >= 3) / 3.0)) AS resonance FROM by_vowel GROUP BY session_id, last),
    means AS (SELECT session_id, last, avg(raw_delta) AS ad, avg(f1) AS mf1, avg(f2) AS mf2, avg(h1_h2) AS ah, any_value(n) AS n, avg(f0) FILTER (i <= n // 2) AS early, avg(f0) FILTER (i > n // 2) AS late, least(1, count(*) FILTER (f0 > 0) / 30.0) AS pitch FROM pairs GROUP BY session_id, last),
    marked AS (SELECT f.*, {DELTA} AS raw_delta, last_value(v_seq IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS last
      FROM (SELECT frames.*, v.seq AS v_seq FROM frames LEFT JOIN (SELECT seq FROM v) v USING (seq)) f),
    joined AS (SELECT m.session_id, m.seq, m.f0, m.conf, m.h1_h2, m.hnr, CASE WHEN ad > 0 THEN ad ELSE raw_delta END AS delta_f, CASE WHEN mf1 > 0 THEN mf1 ELSE f1 END AS f1, CASE WHEN mf2 > 0 THEN mf2 ELSE f2 END AS f2, coalesce(ah, 0) AS ah,
      cv, coalesce(vowel_counts, '') AS vowel_counts, coalesce(resonance, 0) AS resonance, coalesce(pitch, 0) AS pitch, CASE WHEN n >= 6 THEN round(late - early, 9) END AS change
      FROM marked m LEFT JOIN means USING (session_id, last) LEFT JOIN of_vowels USING (session_id, last)),
    told AS (SELECT *, least(resonance, pitch) AS composite, CASE WHEN round(least(resonance, pitch), 9) < 0.5 THEN 'low_confidence' ELSE nullif(concat_ws(',', CASE WHEN h1_h2 > 8 THEN 'breathiness_masking' END, CASE WHEN hnr < 7 THEN 'vocal_strain' END), '') END AS suppression_reason FROM joined)
    SELECT session_id, seq, delta_f AS delta_f_hz, CASE WHEN round(delta_f, 9) >= 1130 THEN 'fem' WHEN round(delta_f, 9) >= 1050 THEN 'andro' ELSE 'masc' END AS delta_f_zone, h1_h2 AS h1_h2_db, f0 AS f0_hz, conf AS f0_confidence,
      {LARYNX} AS larynx, {CAVITY} AS cavity, {TONGUE} AS tongue, greatest(0, least(1, (ah + 10) / 20)) AS thinness, greatest(0, least(1, (ah + 10) / 20)) AS lightness, CASE WHEN cv IS NOT NULL THEN greatest(0, least(100, (1 - cv / 0.10) * 100)) END AS stability_pct,
      CASE WHEN change > 10 THEN 'up' WHEN change < -10 THEN 'down' ELSE 'stable' END AS trend_resonance, 'stable' AS trend_weight, CASE WHEN suppression_reason IS NULL THEN conf * 100 END AS score,
      resonance, pitch, pitch AS vocal_weight, pitch AS prosody, composite, vowel_counts, 'default' AS display_mode, suppression_reason FROM told""",
    "delta_f_hz h1_h2_db f0_hz f0_confidence larynx cavity tongue thinness lightness stability_pct score resonance pitch vocal_weight prosody composite",
)


def results(spark, d):
    """A nested result for each session and half of the month; parts that aren't compared, flags and counts included."""
    rows = frames(spark, d).withColumn("late", C("t") >= 1705363200.0)
    return rows.groupBy("session_id", "late").agg(
        F.struct(F.avg("f0").alias("mean"), F.struct(F.avg("conf").alias("conf")).alias("extra")).alias("pitch"), F.struct(F.avg("f1").alias("f1"), F.avg("f2").alias("f2")).alias("formants"),
        F.struct(F.min("hnr").alias("hnr"), (F.min("hnr") > 4).alias("clean")).alias("voice_quality"), F.count("*").alias("frames"),
    )


LEAVES = {"formants.f1": "avg(f1)", "formants.f2": "avg(f2)", "frames": "count(*)", "pitch.mean": "avg(f0)", "voice_quality.hnr": "min(hnr)"}
OF_RESULTS = "halves AS (SELECT *, t >= 1705363200 AS late FROM frames), leaves AS (" + " UNION ALL ".join(f"SELECT session_id, late, '{p}' AS path, CAST({e} AS DOUBLE) AS value FROM halves GROUP BY session_id, late" for p, e in LEAVES.items()) + ")"
case("numeric_leaves", lambda spark, d: recordings.numeric_leaves(results(spark, d), ["session_id", "late"]), f"WITH {FRAMES}, {OF_RESULTS} SELECT * FROM leaves", "value")


def document_diff(spark, d):
    """What changed in a session's result from the earlier to the later half: difference to four places, percentage to two (infinite from 0)."""
    leaves = recordings.numeric_leaves(results(spark, d), ["session_id", "late"])
    one = lambda late, name: leaves.where(C("late") == late).select("session_id", "path", C("value").alias(name))
    both = one(False, "a").join(one(True, "b"), ["session_id", "path"])
    delta = C("b") - C("a")
    percent = F.when(C("a") != 0, F.round(delta / F.abs("a") * 100 + 3.3e-8, 2)).when(delta == 0, 0.0).otherwise(F.lit(float("inf")))
    return both.select("session_id", "path", F.round(delta + 3.3e-8, 4).alias("delta"), F.when(percent != float("inf"), percent).alias("percent"), (percent == float("inf")).alias("from_zero"))


case(
    "document_diff",
    document_diff,
    f"""WITH {FRAMES}, {OF_RESULTS}, d AS (SELECT a.session_id, a.path, a.value AS a, b.value - a.value AS delta FROM leaves a JOIN leaves b USING (session_id, path) WHERE NOT a.late AND b.late)
    SELECT session_id, path, round(delta + 3.3e-8, 4) AS delta, CASE WHEN a <> 0 THEN round(delta / abs(a) * 100 + 3.3e-8, 2) WHEN delta = 0 THEN 0 END AS percent, a = 0 AND delta <> 0 AS from_zero FROM d""",
    "delta percent",
)
