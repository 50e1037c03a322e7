"""Vowel classification, z-scores and statistics by vowel."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions import acoustics as A
from sonoframe.functions import norms as N
from sonoframe.operators import frames as O
from sonoframe.plans.cases import case
from sonoframe.sources.bindings import FRAMES, frames


def near(table: str = "norms", limit: float = 2.25) -> str:
    distance = "pow((f1 - m1) / 500, 2) + pow((f2 - m2) / 1000, 2)"
    return (
        f"near AS (SELECT seq, vowel, m1, s1, m2, s2, m3, s3 FROM (SELECT seq, {table}.*, {distance} AS d, row_number() OVER (PARTITION BY seq ORDER BY {distance}, ord) AS best "
        f"FROM frames, {table}) WHERE best = 1 AND d <= {limit})"
    )


VOWELS = f"{FRAMES}, {N.sql('norms', N.ENGLISH)}, {near()}, vowels AS (SELECT frames.*, vowel, m1, s1, m2, s2, m3, s3 FROM frames JOIN near USING (seq) WHERE f1 > 0 AND f2 > 0)"

case(
    "vowel_classify",
    lambda spark, d: frames(spark, d).select("seq", A.nearest_vowel(F.col("f1"), F.col("f2")).alias("vowel")),
    f"WITH {FRAMES}, {N.sql('norms', N.ENGLISH)}, {near()} SELECT seq, vowel FROM frames LEFT JOIN near USING (seq)",
)
case(
    "vowel_classify_spanish",
    lambda spark, d: frames(spark, d).select("seq", A.nearest_vowel(F.col("f1"), F.col("f2"), N.SPANISH).alias("vowel")),
    f"WITH {FRAMES}, {N.sql('norms', N.SPANISH)}, {near()} SELECT seq, vowel FROM frames LEFT JOIN near USING (seq)",
)
case(
    "vowel_gate",
    lambda spark, d: frames(spark, d).select(
        "seq", F.when(A.vowel_gate(F.col("f0"), F.col("rms"), F.col("f1"), F.col("f2"), F.col("bw1")), A.nearest_vowel(F.col("f1"), F.col("f2"))).alias("vowel")
    ),
    f"WITH {FRAMES}, {N.sql('norms', N.ENGLISH)}, {near()} SELECT seq, CASE WHEN f0 > 80 AND rms > -35 AND f1 > 200 AND f2 > 500 AND bw1 > 0 AND bw1 < 200 THEN vowel END AS vowel FROM frames LEFT JOIN near USING (seq)",
)
case(
    "per_vowel_zscore",
    lambda spark, d: O.per_vowel_z(frames(spark, d)),
    f"""WITH {VOWELS}, {N.FEMALE_SQL}
    SELECT session_id, label, avg(f1) AS f1_mean, avg(CASE WHEN f4 > 0 THEN f4 END) AS f4_mean, count(*) AS n, (avg(f1) - any_value(mean)) / any_value(std) AS f1_z
    FROM vowels JOIN female USING (vowel) GROUP BY session_id, label""",
    "f1_mean f4_mean f1_z",
)
case(
    "gesture_zscore_frame_mean",
    lambda spark, d: O.frame_mean_z(frames(spark, d), N.ENGLISH),
    f"WITH {VOWELS} SELECT session_id, avg((f1 - m1) / s1) AS z1, avg((f2 - m2) / s2) AS z2, avg((f3 - m3) / s3) AS z3, count(*) AS n FROM vowels GROUP BY session_id",
    "z1 z2 z3",
)
CATEGORY = """means AS (SELECT {by}, vowel, avg(f1) AS f1, avg(f2) AS f2, avg(f3) AS f3, any_value(m1) AS m1, any_value(s1) AS s1, any_value(m2) AS m2, any_value(s2) AS s2,
  any_value(m3) AS m3, any_value(s3) AS s3 FROM {rows} GROUP BY {by}, vowel HAVING count(*) >= 2),
  z AS (SELECT {by}, avg((f1 - m1) / s1) AS z1, avg((f2 - m2) / s2) AS z2, avg((f3 - m3) / s3) AS z3, count(*) AS n_vowels FROM means GROUP BY {by})"""
case(
    "gesture_zscore_category_mean",
    lambda spark, d: O.category_mean_z(frames(spark, d), N.ENGLISH),
    f"WITH {VOWELS}, {CATEGORY.format(by='session_id', rows='vowels')} SELECT * FROM z",
    "z1 z2 z3",
)


def _compare(spark, d):
    rows = frames(spark, d).withColumn("late", (F.col("t") >= F.lit(1705363200.0)).cast("int"))
    z = O.category_mean_z(rows, N.ENGLISH, by=("session_id", "late"))
    one = lambda late, name: z.where(F.col("late") == late).select("session_id", *(F.col(f"z{i}").alias(f"{name}{i}") for i in (1, 2, 3)))
    both = one(0, "a").join(one(1, "b"), "session_id")
    low = F.array(*(F.when(F.col(f"b{i}") < limit, F.lit(f"f{i}")) for i, limit in ((1, 0.3), (2, 0.5), (3, 0.0))))
    label = lambda x: F.when(x > 0.8, "strong").when(x > 0.3, "some").when(x < -0.8, "reversed").when(x < -0.3, "weaker").otherwise("even")
    return both.select(
        "session_id", *((F.col(f"b{i}") - F.col(f"a{i}")).alias(f"d{i}") for i in (1, 2, 3)),
        F.array_join(F.filter(low, lambda x: x.isNotNull()), ",").alias("priorities"), label(F.round(F.col("b1"), 6)).alias("openness"),
    )


case(
    "gesture_compare",
    _compare,
    f"""WITH {VOWELS}, halves AS (SELECT *, CAST(t >= 1705363200 AS INTEGER) AS late FROM vowels), {CATEGORY.format(by='session_id, late', rows='halves')}
    SELECT a.session_id, b.z1 - a.z1 AS d1, b.z2 - a.z2 AS d2, b.z3 - a.z3 AS d3,
      concat_ws(',', CASE WHEN b.z1 < 0.3 THEN 'f1' END, CASE WHEN b.z2 < 0.5 THEN 'f2' END, CASE WHEN b.z3 < 0 THEN 'f3' END) AS priorities,
      CASE WHEN round(b.z1, 6) > 0.8 THEN 'strong' WHEN round(b.z1, 6) > 0.3 THEN 'some' WHEN round(b.z1, 6) < -0.8 THEN 'reversed' WHEN round(b.z1, 6) < -0.3 THEN 'weaker' ELSE 'even' END AS openness
    FROM z a JOIN z b ON a.session_id = b.session_id AND a.late = 0 AND b.late = 1""",
    "d1 d2 d3",
)

#: The word for a mean score, or for a change of it, above each limit; for changes, the middle word holds strictly within 0.3.
WORDS_OF_SCORES = {
    "opc": ([(0.3, "engaged"), (-0.3, "minimal")], "wide (wrong direction)"),
    "tongue_fronting": ([(0.8, "strong fronting"), (0.3, "moderate fronting"), (-0.3, "minimal")], "retracted (wrong direction)"),
    "lip_spread": ([(0.3, "spreading"), (-0.3, "neutral")], "rounding (darkening)"),
}
WORDS_OF_CHANGES = {
    "opc": ([(0.3, "engaging"), (-0.3, "minimal change")], "disengaging"),
    "tongue": ([(0.8, "strong fronting"), (0.3, "moderate fronting"), (-0.3, "minimal change")], "retracting"),
    "lips": ([(0.3, "spreading"), (-0.3, "neutral")], "rounding"),
}


def _worded(x, steps, rest, within):
    """The word of the first limit that ``x`` exceeds; with ``within`` the last one needs its size below the limit."""
    out = F.when(x.isNull(), None)
    for i, (limit, word) in enumerate(steps):
        out = out.when(F.abs(x) < -limit if within and i == len(steps) - 1 else x > limit, word)
    return out.otherwise(rest)


def _worded_sql(x, steps, rest, within):
    arms = [f"WHEN abs({x}) < {-limit} THEN '{word}'" if within and i == len(steps) - 1 else f"WHEN {x} > {limit} THEN '{word}'" for i, (limit, word) in enumerate(steps)]
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(arms)} ELSE '{rest}' END"


def _interpreted(spark, d):
    z = O.category_mean_z(frames(spark, d), N.ENGLISH)
    return z.select("session_id", *(_worded(F.round(f"z{i}", 6), *words, False).alias(name) for i, (name, words) in enumerate(WORDS_OF_SCORES.items(), 1)))


case(
    "gesture_interpretation",
    _interpreted,
    f"WITH {VOWELS}, {CATEGORY.format(by='session_id', rows='vowels')} SELECT session_id, "
    + ", ".join(f"{_worded_sql(f'round(z{i}, 6)', *words, False)} AS {name}" for i, (name, words) in enumerate(WORDS_OF_SCORES.items(), 1)) + " FROM z",
)
case(
    "gesture_change_interpretation",
    lambda spark, d: _compare(spark, d).select("session_id", *(_worded(F.round(f"d{i}", 6), *words, True).alias(name) for i, (name, words) in enumerate(WORDS_OF_CHANGES.items(), 1))),
    f"WITH {VOWELS}, halves AS (SELECT *, CAST(t >= 1705363200 AS INTEGER) AS late FROM vowels), {CATEGORY.format(by='session_id, late', rows='halves')}, "
    "change AS (SELECT a.session_id, b.z1 - a.z1 AS d1, b.z2 - a.z2 AS d2, b.z3 - a.z3 AS d3 FROM z a JOIN z b ON a.session_id = b.session_id AND a.late = 0 AND b.late = 1) SELECT session_id, "
    + ", ".join(f"{_worded_sql(f'round(d{i}, 6)', *words, True)} AS {name}" for i, (name, words) in enumerate(WORDS_OF_CHANGES.items(), 1)) + " FROM change",
)
case(
    "vowel_purity",
    lambda spark, d: O.vowel_purity(O.voiced_vowels(frames(spark, d), N.SPANISH).where("vowel = 'E'"), "E", N.SPANISH),
    f"""WITH {FRAMES}, {N.sql('norms', N.SPANISH)}, {near()}, allrows AS (SELECT frames.*, count(*) OVER (PARTITION BY session_id) AS n_all FROM frames JOIN near USING (seq) WHERE f1 > 0 AND f2 > 0 AND vowel = 'E'), enough AS (SELECT * FROM allrows WHERE n_all >= 4),
    med AS (SELECT session_id, median(f1) AS x1, median(f2) AS x2 FROM enough GROUP BY session_id),
    mad AS (SELECT session_id, greatest(median(abs(f1 - x1)), 30) AS y1, greatest(median(abs(f2 - x2)), 50) AS y2 FROM enough JOIN med USING (session_id) GROUP BY session_id),
    clean AS (SELECT enough.* FROM enough JOIN med USING (session_id) JOIN mad USING (session_id) WHERE abs(f1 - x1) < 3.5 * y1 AND abs(f2 - x2) < 3.5 * y2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY session_id) AS m FROM clean),
    cut AS (SELECT *, CASE WHEN m - 2 * greatest(1, m // 6) < 3 THEN 0 ELSE greatest(1, m // 6) END AS trim FROM ranked),
    mid AS (SELECT session_id, count(*) AS n, coalesce(regr_slope(f1, i), 0) AS b1, coalesce(regr_slope(f2, i), 0) AS b2, avg(f1) AS f1, avg(f2) AS f2 FROM cut WHERE i > trim AND i <= m - trim GROUP BY session_id),
    s AS (SELECT session_id, n, 0.3 * abs(b1 * n) / 80 + 0.7 * abs(b2 * n) / 200 AS drift, sqrt(pow(abs(f1 - 450) / 80, 2) + pow(abs(f2 - 1900) / 200, 2)) AS away FROM mid)
    SELECT session_id, n, greatest(0, least(1, 1 - drift / 4)) AS stability, greatest(0, least(1, 1 - away / 4)) AS placement,
      0.5 * greatest(0, least(1, 1 - drift / 4)) + 0.5 * greatest(0, least(1, 1 - away / 4)) AS purity, drift > 0.8 AS diphthongized, away > 2 AS misplaced FROM s""",
    "stability placement purity",
)
case(
    "trailing_vowel_stats",
    lambda spark, d: O.trailing(frames(spark, d), 432_000.0),
    f"""WITH {VOWELS}, v AS (SELECT *, CAST(round(t * 1e6) AS BIGINT) AS us FROM vowels)
    SELECT session_id, seq, t, vowel, avg(coalesce(f4, 0)) OVER w AS f4_mean, coalesce(stddev_samp(coalesce(f4, 0)) OVER w, 0) AS f4_std, avg(f1) OVER w AS f1_mean, avg(f2) OVER w AS f2_mean, count(*) OVER w AS n
    FROM v WINDOW w AS (PARTITION BY session_id, vowel ORDER BY us RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW)""",
    "t f4_mean f4_std f1_mean f2_mean",
)
PLAIN = ", ".join(f"'{v}'" for v in N.MONOPHTHONGS)
ACCUMULATED = f"""WITH {VOWELS}, g AS (SELECT session_id, vowel, count(*) AS n, avg(f4) AS m, stddev_samp(f4) AS s FROM vowels GROUP BY session_id, vowel),
    c AS (SELECT session_id, avg(CASE WHEN vowel IN ({PLAIN}) AND n >= 5 AND m > 0 THEN s / m END) AS f4_cv,
      sqrt(least(1, coalesce(sum(n) FILTER (vowel IN ({PLAIN})), 0) / 30.0) * least(1, count(*) FILTER (vowel IN ({PLAIN}) AND n >= 3) / 3.0)) AS confidence FROM g GROUP BY session_id),
    a AS (SELECT session_id, coalesce(avg(CASE WHEN f0 > 0 THEN f0 END), 0) AS mean_f0, coalesce(avg(CASE WHEN f1 > 0 THEN f1 END), 0) AS mean_f1, coalesce(avg(CASE WHEN f2 > 0 THEN f2 END), 0) AS mean_f2, count(*) AS n FROM vowels GROUP BY session_id)"""
case("resonance_confidence", lambda spark, d: O.accumulated(frames(spark, d)).select("session_id", "confidence"), f"{ACCUMULATED} SELECT session_id, confidence FROM c", "confidence")
case(
    "f4_cv",
    lambda spark, d: O.accumulated(frames(spark, d)).select("session_id", "f4_cv", A.stability_percent(F.col("f4_cv")).alias("stability")),
    f"{ACCUMULATED} SELECT session_id, f4_cv, CASE WHEN f4_cv IS NOT NULL THEN greatest(0, least(100, (1 - f4_cv / 0.10) * 100)) END AS stability FROM c",
    "f4_cv stability",
)
case(
    "accumulated_means",
    lambda spark, d: O.accumulated(frames(spark, d)).select("session_id", "mean_f0", "mean_f1", "mean_f2", "n"),
    f"{ACCUMULATED} SELECT session_id, mean_f0, mean_f1, mean_f2, n FROM a",
    "mean_f0 mean_f1 mean_f2",
)


def _display(spark, d):
    rows = frames(spark, d)
    stats = O.accumulated(rows)
    delta = A.delta_f(*(F.col(f) for f in ("f1", "f2", "f3", "f4")))
    larynx, cavity, tongue = A.gesture_bars(delta, F.col("f1"), F.col("f2"))
    last = rows.groupBy("session_id").agg(F.max(F.struct("t", "seq", "f1", "f2", "f3", "f4", "h1_h2", "rms")).alias("r")).select("session_id", "r.*")
    return last.join(stats, "session_id", "left").select(
        "session_id", "seq", delta.alias("delta_f"), larynx.alias("larynx"), cavity.alias("cavity"), tongue.alias("tongue"),
        A.weight_factor(F.col("h1_h2")).alias("weight"), A.stability_percent(F.col("f4_cv")).alias("stability"), "confidence", "rms",
    )


DELTA = (
    "(CASE WHEN (f1 > 0)::INT + (f2 > 0)::INT + (f3 > 0)::INT + (f4 > 0)::INT >= 3 THEN (SELECT 2 * regr_slope(y, x) FROM (VALUES (1, f1), (3, f2), (5, f3), (7, f4)) s(x, y) WHERE y > 0) ELSE 0 END)"
)
LARYNX = "greatest(0, least(100, (delta_f - 1029) / 178 * 50 + 50))"
CAVITY = "CASE WHEN delta_f > 0 THEN greatest(0, least(100, (f1 / delta_f - 0.35) / 0.30 * 100)) ELSE 50 END"
TONGUE = "greatest(0, least(100, (f2 - 1800) / 400 * 50 + 50))"
case(
    "display_frame",
    _display,
    f"""{ACCUMULATED}, last AS (SELECT *, {DELTA} AS delta_f FROM frames QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, seq DESC) = 1)
    SELECT session_id, seq, delta_f, {LARYNX} AS larynx, {CAVITY} AS cavity, {TONGUE} AS tongue, greatest(0, least(1, (h1_h2 + 10) / 20)) AS weight,
      CASE WHEN f4_cv IS NOT NULL THEN greatest(0, least(100, (1 - f4_cv / 0.10) * 100)) END AS stability, confidence, rms FROM last LEFT JOIN c USING (session_id)""",
    "delta_f larynx cavity tongue weight stability confidence rms",
)
