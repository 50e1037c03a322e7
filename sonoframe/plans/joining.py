"""Joins, comparisons of results, and reports over stored analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoframe.operators import assembly
from sonoframe.operators import joins as J
from sonoframe.plans.cases import case
from sonoframe.sources.bindings import FRAMES, frames, turns

DAY = 86_400.0
C = F.col


def _asof(spark, d):
    rows = frames(spark, d)
    found = J.nearest_in_time(rows.where("kind = 'click'").select("session_id", "seq", "t"), rows.where("kind = 'view'"), ["session_id"], DAY, [])
    return found.select("session_id", "seq", "seq_right", "gap")


case(
    "nearest_asof_sync",
    _asof,
    f"""WITH {FRAMES} SELECT a.session_id, a.seq, b.seq AS seq_right, b.t - a.t AS gap FROM frames a LEFT JOIN frames b ON a.session_id = b.session_id AND abs(a.t - b.t) <= 86400 AND b.kind = 'view'
    WHERE a.kind = 'click' QUALIFY row_number() OVER (PARTITION BY a.session_id, a.seq ORDER BY abs(a.t - b.t), b.t, b.seq) = 1""",
    "gap",
)


def _ring(spark, d):
    rows = frames(spark, d)
    return J.nearest_in_ring(rows.where("kind = 'click'").select("session_id", "seq", "t"), rows.where("kind = 'view'"), ["session_id"], DAY, 30).select("session_id", "seq", "seq_right", "gap")


case(
    "video_sync",
    _ring,
    f"""WITH {FRAMES}, seen AS (SELECT a.session_id, a.seq, a.t, b.seq AS seq_right, b.t AS t_right, row_number() OVER (PARTITION BY a.session_id, a.seq ORDER BY b.t DESC, b.seq DESC) AS back
      FROM frames a LEFT JOIN frames b ON a.session_id = b.session_id AND b.kind = 'view' AND b.t <= a.t + 86400 WHERE a.kind = 'click')
    SELECT session_id, seq, seq_right, t_right - t AS gap FROM seen WHERE back <= 30 QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY abs(t_right - t), t_right, seq_right) = 1""",
    "gap",
)


def _assembled(spark, d):
    """Clicks as sound with the views as pictures (those of a day later included), errors as warnings and sign-ups as coaching; every seventh purchase resets."""
    source = F.when(C("kind") == "click", "audio").when(C("kind") == "view", "video").when(C("kind") == "error", "warning").when(C("kind") == "signup", "coaching").when(C("seq") % 7 == 0, "reset")
    rows = frames(spark, d).select("session_id", F.timestamp_micros(F.round(C("t") * 1e6).cast("bigint")).alias("ts"), "seq", source.alias("source"), C("seq").cast("string").alias("payload"))
    return assembly.assembled(rows, DAY, 30).select("session_id", "seq", "video_seq", "video", "gap", F.concat_ws(",", "warnings").alias("warnings"), "coaching")


case(
    "assembled_frames",
    _assembled,
    f"""WITH {FRAMES}, parts AS (SELECT session_id, seq, CAST(round(t * 1e6) AS BIGINT) AS us, CASE WHEN kind = 'click' THEN 'audio' WHEN kind = 'view' THEN 'video' WHEN kind = 'error' THEN 'warning' WHEN kind = 'signup' THEN 'coaching' WHEN seq % 7 = 0 THEN 'reset' END AS source FROM frames),
    timed AS (SELECT *, CASE WHEN source = 'audio' THEN us + 86400000000 ELSE us END AS due, CASE source WHEN 'reset' THEN 0 WHEN 'video' THEN 1 WHEN 'audio' THEN 3 ELSE 2 END AS rank FROM parts WHERE source IS NOT NULL),
    numbered AS (SELECT *, count(*) FILTER (source = 'reset') OVER (w ROWS UNBOUNDED PRECEDING) AS epoch, count(*) FILTER (source = 'audio') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM timed WINDOW w AS (PARTITION BY session_id ORDER BY due, rank, seq)),
    pairs AS (SELECT a.session_id, a.turn, a.us, a.seq, a.epoch, b.seq AS video_seq, b.us AS video_us, b.epoch AS video_epoch, row_number() OVER (PARTITION BY a.session_id, a.seq ORDER BY b.due DESC, b.seq DESC) AS back
      FROM numbered a LEFT JOIN numbered b ON a.session_id = b.session_id AND b.source = 'video' AND b.due <= a.due WHERE a.source = 'audio'),
    shown AS (SELECT session_id, turn, seq, video_seq, CASE WHEN epoch = video_epoch THEN (video_us - us) / 1e6 END AS gap FROM pairs WHERE back = 1 OR (back <= 30 AND epoch = video_epoch)
      QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY epoch <> video_epoch, abs(video_us - us), video_us, video_seq) = 1),
    told AS (SELECT session_id, turn, string_agg(seq::VARCHAR, ',' ORDER BY due, seq) FILTER (source = 'warning') AS warnings, max_by(seq::VARCHAR, (due, seq)) FILTER (source = 'coaching') AS coaching FROM numbered GROUP BY session_id, turn)
    SELECT session_id, seq, video_seq, CAST(video_seq AS VARCHAR) AS video, gap, coalesce(warnings, '') AS warnings, coaching FROM shown JOIN told USING (session_id, turn)""",
    "gap",
)


def _index(spark, d):
    rows = frames(spark, d)
    w = Window.partitionBy("session_id").orderBy("t", "seq")
    tracks = rows.withColumn("i", F.row_number().over(w) - 1).select("session_id", "i", "f2")
    probes = rows.select("session_id", "seq", F.bround(C("k") / 2.0).cast("int").alias("i"))
    return probes.join(tracks, ["session_id", "i"]).select("session_id", "seq", C("i").cast("bigint").alias("i"), "f2")


case(
    "nearest_index_join",
    _index,
    f"""WITH {FRAMES}, tracks AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) - 1 AS i, f2 FROM frames),
    probes AS (SELECT session_id, seq, CAST(round_even(k / 2.0, 0) AS BIGINT) AS i FROM frames) SELECT session_id, seq, i, tracks.f2 FROM probes JOIN tracks USING (session_id, i)""",
    "f2",
)


def _inside(spark, d):
    rows = frames(spark, d)
    spans = rows.where("kind = 'purchase'").select("session_id", C("seq").alias("span"), (C("t") - DAY).alias("start"), (C("t") + DAY / 2).alias("end"))
    return J.inside(rows.where("kind = 'view'").select("session_id", "seq", "t"), spans, C("t"), ["session_id"], DAY).select("session_id", "seq", "span")


case(
    "interval_containment",
    _inside,
    f"""WITH {FRAMES} SELECT a.session_id, a.seq, b.seq AS span FROM frames a JOIN frames b ON a.session_id = b.session_id AND a.t >= b.t - 86400 AND a.t <= b.t + 43200
    WHERE a.kind = 'view' AND b.kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY a.session_id, a.seq ORDER BY b.t - 86400, b.t + 43200) = 1""",
)


def _lookup(spark, d):
    rows = frames(spark, d)
    last = J.last_of_key(rows.where("kind = 'view'"), ["session_id", "k"], ["t", "seq"], ["value"])
    targets = rows.where("kind = 'click'").select("session_id", "seq", "k")
    status = F.when(C("value").isNull(), "not_found").when(C("value") < 3, "too_short").otherwise("ok")
    return targets.join(last, ["session_id", "k"], "left").select("session_id", "seq", "value", status.alias("status"))


case(
    "target_lookup",
    _lookup,
    f"""WITH {FRAMES}, last AS (SELECT session_id, k, value FROM frames WHERE kind = 'view' QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY t DESC, seq DESC) = 1)
    SELECT session_id, seq, last.value, CASE WHEN last.value IS NULL THEN 'not_found' WHEN last.value < 3 THEN 'too_short' ELSE 'ok' END AS status
    FROM (SELECT session_id, seq, k FROM frames WHERE kind = 'click') LEFT JOIN last USING (session_id, k)""",
    "value",
)
case(
    "exclude_frames",
    lambda spark, d: frames(spark, d).join(frames(spark, d).where("jitter > 3").select("session_id", "k").distinct(), ["session_id", "k"], "left_anti").groupBy("session_id").agg(F.count("*").alias("n"), F.avg("hnr").alias("hnr")),
    f"WITH {FRAMES} SELECT session_id, count(*) AS n, avg(hnr) AS hnr FROM frames f WHERE NOT EXISTS (SELECT 1 FROM frames x WHERE x.session_id = f.session_id AND x.k = f.k AND x.jitter > 3) GROUP BY session_id",
    "hnr",
)
CATEGORIES = {"pitch": "f0 / 4", "resonance": "conf * 100", "vocal_weight": "jitter * 20", "voice_quality": "hnr * 4"}


def _scores(spark, d):
    """Scores of sessions' weeks: session_id, seg, category, cat, score."""
    rows = frames(spark, d).withColumn("seg", F.floor((C("t") - 1704067200.0) / (7 * DAY)))
    wide = rows.groupBy("session_id", "seg").agg(*(F.avg(F.expr(e)).alias(n) for n, e in CATEGORIES.items()))
    each = F.array(*(F.struct(F.lit(i).alias("cat"), F.lit(n).alias("category"), C(n).alias("score")) for i, n in enumerate(CATEGORIES)))
    return wide.select("session_id", "seg", F.explode(each).alias("e")).select("session_id", "seg", "e.*")


SCORES = (
    "wide AS (SELECT session_id, CAST(floor((t - 1704067200) / 604800) AS BIGINT) AS seg, " + ", ".join(f"avg({e}) AS {n}" for n, e in CATEGORIES.items()) + " FROM frames GROUP BY ALL), "
    "scores AS (" + " UNION ALL ".join(f"SELECT session_id, seg, CAST({i} AS INTEGER) AS cat, '{n}' AS category, {n} AS score FROM wide" for i, n in enumerate(CATEGORIES)) + ")"
)


def _notable(spark, d):
    before = F.lag("score").over(Window.partitionBy("session_id", "cat").orderBy("seg"))
    moved = _scores(spark, d).withColumn("delta", F.round(C("score") - before + 3.3e-8, 1)).where(F.abs("delta") >= 15)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.abs("delta")), "seg", "cat"))
    words = F.format_string("%s %s by %.1f", "category", F.when(C("delta") > 0, "rose").otherwise("fell"), F.abs("delta"))
    return moved.select("session_id", "seg", "category", "delta", place.alias("place"), words.alias("text"))


case(
    "notable_changes",
    _notable,
    f"""WITH {FRAMES}, {SCORES}, m AS (SELECT *, round(score - lag(score) OVER (PARTITION BY session_id, cat ORDER BY seg) + 3.3e-8, 1) AS delta FROM scores)
    SELECT session_id, seg, category, delta, CAST(row_number() OVER (PARTITION BY session_id ORDER BY abs(delta) DESC, seg, cat) AS INTEGER) AS place,
      category || CASE WHEN delta > 0 THEN ' rose by ' ELSE ' fell by ' END || format('{{:.1f}}', abs(delta)) AS text FROM m WHERE abs(delta) >= 15""",
    "delta",
)


def _summary(spark, d):
    scores = _scores(spark, d)
    by = scores.groupBy("session_id", "category").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"))
    whole = scores.groupBy("session_id", "seg").agg(F.round(F.avg("score"), 6).alias("composite"))
    ends = whole.groupBy("session_id").agg(F.max(F.struct("composite", -C("seg")))["col2"].alias("b"), F.min(F.struct("composite", "seg"))["seg"].alias("worst"))
    return by.join(ends.select("session_id", (-C("b")).alias("best"), "worst"), "session_id").withColumn("range", C("high") - C("low"))


case(
    "segment_summary",
    _summary,
    f"""WITH {FRAMES}, {SCORES}, w AS (SELECT session_id, seg, round(avg(score), 6) AS c FROM scores GROUP BY ALL),
    best AS (SELECT session_id, seg AS best FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c DESC, seg) = 1), worst AS (SELECT session_id, seg AS worst FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c, seg) = 1)
    SELECT session_id, category, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS low, max(score) AS high, any_value(best) AS best, any_value(worst) AS worst, max(score) - min(score) AS range
    FROM scores JOIN best USING (session_id) JOIN worst USING (session_id) GROUP BY session_id, category""",
    "mean std low high range",
)


def _diff(spark, d):
    """Change of each score from one of a session's weeks to the next that it has."""
    before = F.lag("score").over(Window.partitionBy("session_id", "cat").orderBy("seg"))
    both = _scores(spark, d).withColumn("before", before).where("before IS NOT NULL")
    delta, percent = J.change(C("before"), C("score"))
    return both.select("session_id", "seg", "category", delta.alias("delta"), percent.alias("percent"))


DIFF = """steps AS (SELECT *, lag(score) OVER (PARTITION BY session_id, cat ORDER BY seg) AS prior FROM scores),
    d AS (SELECT session_id, seg, category, score - prior AS delta, CASE WHEN prior <> 0 THEN (score - prior) / abs(prior) * 100 WHEN score = prior THEN 0 END AS percent FROM steps WHERE prior IS NOT NULL)"""
case("result_diff", _diff, f"WITH {FRAMES}, {SCORES}, {DIFF} SELECT * FROM d", "delta percent")
case(
    "largest_change",
    lambda spark, d: _diff(spark, d).withColumns({"p": F.round(F.abs(F.coalesce("percent", F.lit(0.0))), 6)}).withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("p"), "seg", "category"))).where("i <= 2").select("session_id", "i", "seg", "category", "percent"),
    f"WITH {FRAMES}, {SCORES}, {DIFF} SELECT session_id, CAST(row_number() OVER w AS INTEGER) AS i, seg, category, percent FROM d WINDOW w AS (PARTITION BY session_id ORDER BY round(abs(coalesce(percent, 0)), 6) DESC, seg, category) QUALIFY row_number() OVER w <= 2",
    "percent",
)
case(
    "top_deltas",
    lambda spark, d: _diff(spark, d).withColumn("size", F.round(F.abs(F.coalesce("percent", F.lit(0.0))), 6)).orderBy(F.desc("size"), "session_id", "seg", "category").limit(20),
    f"WITH {FRAMES}, {SCORES}, {DIFF} SELECT *, round(abs(coalesce(percent, 0)), 6) AS size FROM d ORDER BY size DESC, session_id, seg, category LIMIT 20",
    "delta percent size",
)
case(
    "latest_analysis",
    lambda spark, d: frames(spark, d).groupBy("session_id", "kind").agg(F.max(F.struct("t", "seq", "value")).alias("r"), F.count("*").alias("n")).select("session_id", "kind", "r.seq", "r.value", "n"),
    f"WITH {FRAMES} SELECT session_id, kind, seq, value, n FROM (SELECT *, count(*) OVER (PARTITION BY session_id, kind) AS n FROM frames) QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY t DESC, seq DESC) = 1",
    "value",
)
case(
    "list_analyses",
    lambda spark, d: frames(spark, d).where("kind = 'error'").withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("t", "seq"))).select("session_id", "place", "seq"),
    f"WITH {FRAMES} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS INTEGER) AS place, seq FROM frames WHERE kind = 'error'",
)
case(
    "progress_summary",
    lambda spark, d: frames(spark, d).groupBy("session_id").agg(F.min(F.struct("t", "seq", "value")).alias("a"), F.max(F.struct("t", "seq", "value")).alias("b"), F.count("*").alias("n")).where("n >= 2").select("session_id", C("b.value").alias("latest"), (C("b.value") - C("a.value")).alias("gain"), "n"),
    f"WITH {FRAMES} SELECT session_id, arg_max(value, struct_pack(t := t, seq := seq)) AS latest, arg_max(value, struct_pack(t := t, seq := seq)) - arg_min(value, struct_pack(t := t, seq := seq)) AS gain, count(*) AS n FROM frames GROUP BY session_id HAVING count(*) >= 2",
    "latest gain",
)
case(
    "delete_cascade",
    lambda spark, d: frames(spark, d).join(frames(spark, d).where("value > 300 OR session_id % 3 = 0").select("session_id").distinct(), "session_id", "left_anti").select("session_id", "seq"),
    f"WITH {FRAMES} SELECT session_id, seq FROM frames WHERE session_id NOT IN (SELECT session_id FROM frames WHERE value > 300 OR session_id % 3 = 0)",
)


def _history(spark, d, kept=40):
    rows = turns(spark, d)
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    system = rows.where("role = 'system'").select("conv_id", "turn", "role", F.lit(0).alias("part"))
    last = rows.where("role != 'system'").withColumn("back", back).where(C("back") <= kept).select("conv_id", "turn", "role", F.lit(1).alias("part"))
    return system.unionByName(last)


case(
    "history_window",
    _history,
    """SELECT conv_id, turn, role, CAST(0 AS INTEGER) AS part FROM conversations WHERE role = 'system' UNION ALL
    SELECT conv_id, turn, role, CAST(1 AS INTEGER) FROM (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 40)""",
)
case(
    "strip_reasoning",
    lambda spark, d: turns(spark, d).select("conv_id", "turn", F.trim(F.regexp_replace(F.concat(F.lit("<think>a\nb</think> "), "text", F.lit(" <think>c</think>")), r"(?s)<think>.*?</think>", "")).alias("text")),
    r"SELECT conv_id, turn, trim(regexp_replace('<think>a' || chr(10) || 'b</think> ' || text || ' <think>c</think>', '(?s)<think>.*?</think>', '', 'g')) AS text FROM conversations",
)
case(
    "turn_counts",
    lambda spark, d: turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(C("role") == "user").alias("n_user"), F.max("turn").alias("last")),
    "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, max(turn) AS last FROM conversations GROUP BY conv_id",
)


def _of_recordings(spark, d):
    """How many analyses each recording has, and the value of the latest; analyses are summed up before they are joined."""
    rows = frames(spark, d)
    clicks = rows.where("kind = 'click'").groupBy("session_id", "k").agg(F.count("*").alias("n"), F.max(F.struct("seq", "value")).alias("r"))
    views = rows.where("kind = 'view'").select("session_id", C("seq").alias("recording"), "k").join(clicks, ["session_id", "k"], "left")
    return views.groupBy("session_id", "recording").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("r")["value"].alias("latest"))


case(
    "session_recording_analysis",
    _of_recordings,
    f"""WITH {FRAMES}, r AS (SELECT session_id, seq AS recording, k FROM frames WHERE kind = 'view'), a AS (SELECT session_id, k, seq AS analysis, value FROM frames WHERE kind = 'click')
    SELECT session_id, recording, count(analysis) AS n, arg_max(value, analysis) AS latest FROM r LEFT JOIN a USING (session_id, k) GROUP BY session_id, recording""",
    "latest",
)
case(
    "confidence_means",
    lambda spark, d: frames(spark, d).groupBy("session_id").agg(F.avg(F.when(C("kind") == "click", C("conf"))).alias("clicks"), F.avg(F.when((C("kind") == "error") & (C("conf") > 0.9), C("conf"))).alias("sure_errors"), F.avg(F.when(C("f0") > 0, F.when(C("f0") > 200, 1.0).otherwise(0.0))).alias("high")),
    f"WITH {FRAMES} SELECT session_id, avg(conf) FILTER (kind = 'click') AS clicks, avg(conf) FILTER (kind = 'error' AND conf > 0.9) AS sure_errors, avg((f0 > 200)::INT) FILTER (f0 > 0) AS high FROM frames GROUP BY session_id",
    "clicks sure_errors high",
)
case(
    "voiced_display",
    lambda spark, d: frames(spark, d).where("f0 > 0 AND conf >= 0.3").select("session_id", "seq", "f0"),
    f"WITH {FRAMES} SELECT session_id, seq, f0 FROM frames WHERE f0 > 0 AND conf >= 0.3",
    "f0",
)
case(
    "long_intervals",
    lambda spark, d: frames(spark, d).withColumn("until", F.lead("t").over(Window.partitionBy("session_id").orderBy("t", "seq"))).where(C("until") - C("t") >= 3 * 3600).select("session_id", "seq", (C("until") - C("t")).alias("length")),
    f"WITH {FRAMES}, n AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, seq) - t AS length FROM frames) SELECT session_id, seq, length FROM n WHERE length >= 10800",
    "length",
)


def _matched(spark, d):
    rows = turns(spark, d)
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.length("text").alias("asked"))
    replies = rows.where("role = 'assistant'").select("conv_id", (C("turn") - 1).alias("turn"), F.length("text").alias("n"))
    replies = replies.groupBy("conv_id", "turn").agg(F.max("n").alias("replied"))
    return asked.join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", C("asked").cast("bigint").alias("asked"), C("replied").cast("bigint").alias("replied"), F.when(C("replied").isNull(), "pending").otherwise("done").alias("status"))


case(
    "turn_result_match",
    _matched,
    """WITH r AS (SELECT conv_id, turn - 1 AS turn, max(length(text)) AS replied FROM conversations WHERE role = 'assistant' GROUP BY ALL)
    SELECT conv_id, turn, length(text) AS asked, replied, CASE WHEN replied IS NULL THEN 'pending' ELSE 'done' END AS status FROM conversations LEFT JOIN r USING (conv_id, turn) WHERE role = 'user'""",
)
