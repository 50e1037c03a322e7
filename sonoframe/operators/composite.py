"""Whole analyses: each recording as one nested document, and its phrases with scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.functions import acoustics as A
from sonoframe.functions import signals
from sonoframe.operators import frames as O
from sonoframe.operators import tracks
from sonoframe.sources import recordings as R

KEY = ["session_id"]
#: What a recording needs to be fit for analysis (dB of signal over noise, share of clipped samples, share of loud frames).
SIGNAL, CLIPPED, LOUD = 15.0, 0.01, 0.3
#: A clipped sample, seconds of a frame of its level, and the share of the highest level that makes a frame loud.
FULL, LEVEL_FRAME, OF_PEAK = 0.99, 0.025, 0.1
#: Samples of a frame and between two in the search for pauses, dB below the loudest frame, seconds of a pause.
PAUSE_FRAME, PAUSE_HOP, PAUSE_DB, PAUSE = 2048, 512, -35.0, 0.3
#: Seconds of a phrase at least and at most, of a recording that is one phrase, and the change of a score that is told.
SHORTEST, LONGEST, WHOLE, NOTABLE = 2.0, 5.0, 1.0, 15.0


def quality_of(x: np.ndarray, rate: int) -> dict[str, float]:
    """Signal over noise (the loudest over the softest quarter of frames), clipped samples and loud frames of one recording."""
    size = int(rate * LEVEL_FRAME)
    level = np.sort(np.sqrt((signals.frame(x, size, max(1, size // 2)) ** 2).mean(axis=1)))
    q = max(1, len(level) // 4)
    signal, noise = (level[-q:].mean(), level[:q].mean()) if len(level) >= 4 else (1.0, 1.0)
    return {
        "snr_db": float(20 * np.log10(signal / noise)) if noise > 0 else 60.0,
        "clipping_fraction": float((np.abs(x) > FULL).mean()),
        "voiced_fraction": float((level > OF_PEAK * level[-1]).mean()) if len(level) else 0.0,
    }


def phrases_of(x: np.ndarray, rate: int, shortest: float = SHORTEST, longest: float = LONGEST) -> list[tuple[float, float]]:
    """Starts and ends in seconds of one recording's phrases.

    Pauses that end before the recording does divide it in their middle. Parts
    shorter than ``shortest`` go; parts above ``longest`` are cut every so many
    seconds, and what is left of them stays if it is long enough. Without any a
    recording of a second or more is one phrase.
    """
    n = len(x) / rate
    level = np.sqrt((signals.frame(np.pad(x, PAUSE_FRAME // 2), PAUSE_FRAME, PAUSE_HOP) ** 2).mean(axis=1))
    loud = np.maximum(level, 1e-5) >= 10 ** (PAUSE_DB / 20) * max(level.max(initial=0.0), 1e-5)
    edge = np.diff(np.concatenate([[1], loud.astype(np.int8)]))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    begins = begins[: len(ends)]  # a pause at the end divides nothing
    long = (ends - begins) * PAUSE_HOP / rate >= PAUSE
    marks = np.concatenate([[0.0], (begins[long] + ends[long]) / 2 * PAUSE_HOP / rate, [n]])
    found = []
    for a, b in zip(marks, marks[1:], strict=False):
        if b - a < shortest:
            continue
        if b - a <= longest:
            found.append((float(a), float(b)))
            continue
        at = float(a)
        while at < b:
            end = min(at + longest, float(b))
            if end - at >= shortest:
                found.append((round(at, 3), round(end, 3)))
            at = end
    return found or ([(0.0, n)] if n >= WHOLE else [])


def _fine(x) -> bool:
    return x is not None and len(x) > 0 and bool(np.isfinite(x).all())


def sample_quality(recordings: DataFrame, rate: int) -> DataFrame:
    """session_id, duration_s, snr_db, clipping_fraction, voiced_fraction, quality_ok of recordings (session_id, ``x``); nulls where there is no sound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{"duration_s": len(x) / rate} | quality_of(np.asarray(x, float), rate) if _fine(x) else {} for x in batch["x"]]
            yield batch[KEY].assign(**{n: pd.array([f.get(n) for f in found], "Float64") for n in ("duration_s", "snr_db", "clipping_fraction", "voiced_fraction")})

    kind = dict(recordings.dtypes)["session_id"]
    made = recordings.select(*KEY, "x").mapInPandas(run, f"session_id {kind}, duration_s double, snr_db double, clipping_fraction double, voiced_fraction double")
    return made.withColumn("quality_ok", (F.col("snr_db") > SIGNAL) & (F.col("clipping_fraction") < CLIPPED) & (F.col("voiced_fraction") > LOUD))


def phrases(recordings: DataFrame, rate: int, shortest: float = SHORTEST, longest: float = LONGEST) -> DataFrame:
    """Phrases of recordings (session_id, ``x``), see :func:`phrases_of`: session_id, segment_id, start_s, end_s, duration_s, x (its samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, x in zip(batch["session_id"], batch["x"], strict=True):
                x = np.asarray(x, float) if _fine(x) else np.zeros(0)
                found = phrases_of(x, rate, shortest, longest) if len(x) else []
                for i in range(0, len(found), 64):
                    part = found[i : i + 64]
                    yield pd.DataFrame({"session_id": [key] * len(part), "i": range(i, i + len(part)), "start_s": [a for a, _ in part], "end_s": [b for _, b in part], "x": [x[int(a * rate) : int(b * rate)] for a, b in part]})

    kind = dict(recordings.dtypes)["session_id"]
    made = recordings.select(*KEY, "x").mapInPandas(run, f"session_id {kind}, i int, start_s double, end_s double, x array<double>")
    return made.select("session_id", F.format_string("seg_%03d", "i").alias("segment_id"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "x")


def analysed(recordings: DataFrame, rate: int) -> DataFrame:
    """A nested document for each recording (session_id, unique, and ``x``, samples at ``rate``).

    session_id, sample_rate, duration_s, formant_ceiling_used_hz, and the parts
    quality, pitch, formants, voice_quality, articulation, prosody and
    lpc_envelope. Recordings are dealt out once and kept; chunks of the tracks
    and whole recordings are read from there. A recording without sound, or too
    short for a measure, has nulls there; it keeps its document. ``pitch`` and
    ``lpc_envelope`` hold contours; see :func:`without_contours`.
    """
    rows = tracks.kept(recordings.select(*KEY, "x"))
    pitch = tracks.kept(tracks.pitch_track(rows, KEY, rate))
    mean = tracks.mean_pitch(pitch, KEY)
    resonances = tracks.kept(tracks.best_formants(rows, KEY, rate, mean))
    voice = F.when(F.col("f0") > 0, F.col("f0"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    contour = F.sort_array(F.collect_list(F.struct("frame", "f0", "t")))
    pitches = pitch.groupBy(*KEY).agg(
        zero(F.avg(voice)).alias("f0_mean_hz"), zero(F.percentile(voice, 0.5)).alias("f0_median_hz"), zero(F.stddev_pop(voice)).alias("f0_std_hz"), zero(F.min(voice)).alias("f0_min_hz"),
        zero(F.max(voice)).alias("f0_max_hz"), F.avg(F.when(F.col("f0") > 0, 1.0).otherwise(0.0)).alias("voiced_fraction"), contour.alias("c"),
    ).select(*KEY, "f0_mean_hz", "f0_median_hz", "f0_std_hz", "f0_min_hz", "f0_max_hz", "voiced_fraction", F.col("c.f0").alias("f0_contour_hz"), F.col("c.t").alias("f0_contour_time_s"))
    measured = ["f1", "f2", "f3", "f4", "bw1", "bw2", "bw3"]
    trimmed = O.percentile_trimmed(resonances, tuple(measured))
    means = trimmed.groupBy(*KEY).agg(*(zero(F.max(F.when(F.col("name") == n, F.col("mean")))).alias(f"{n}_mean_hz") for n in measured))
    means = means.withColumn("delta_f_hz", A.delta_f(*(F.col(f"f{i}_mean_hz") for i in (1, 2, 3, 4))))
    ceiling = resonances.groupBy(*KEY).agg(F.max("hz").alias("formant_ceiling_used_hz"))
    space = O.vowel_space(resonances).withColumnRenamed("area", "vowel_space_bark")
    melody = O.prosody(pitch.withColumns({"seq": F.col("frame"), "conf": F.when(F.col("f0") > 0, 1.0).otherwise(0.0)}))
    held = tracks.contact_frames(rows, KEY, rate, pitch)
    contact = held.groupBy(*KEY).agg(F.avg(A.contact_quotient(F.col("h1"), F.col("h2"), F.col("h4"))).alias("contact_quotient"))
    whole = signals.recording_measures(rows, rate)
    envelope = signals.lpc_envelopes(rows, rate)
    quality = sample_quality(rows, rate)
    parts: dict[str, DataFrame] = {"pitch": pitches, "formants": means.join(space, KEY, "left"), "prosody": melody}
    out = quality.select(*KEY, "duration_s", F.struct("snr_db", "clipping_fraction", "voiced_fraction", "quality_ok").alias("quality"))
    for name, part in parts.items():
        out = out.join(part.select(*KEY, F.struct(*(c for c in part.columns if c not in KEY)).alias(name)), KEY, "left")
    out = out.join(ceiling, KEY, "left").join(whole, KEY, "left").join(contact, KEY, "left").join(envelope, KEY, "left")
    return out.select(
        *KEY, F.lit(rate).alias("sample_rate"), "duration_s", "formant_ceiling_used_hz", "quality", "pitch", "formants",
        F.struct("hnr_db", "jitter", "shimmer", "cpp_db", "tilt_db", "contact_quotient", "rms_db").alias("voice_quality"),
        F.struct("s_centroid_hz", "syllables_per_s", "consonant", "consonant_confidence", "high_share").alias("articulation"),
        "prosody", F.struct("f1_prominence_db", "envelope_db").alias("lpc_envelope"),
    )


def without_contours(documents: DataFrame) -> DataFrame:
    """Documents with the lengths of their arrays in place of them."""
    cut = lambda part, names: F.col(part).withField(names[0] + "_frames", F.size(f"{part}.{names[0]}")).dropFields(*names)
    return documents.withColumns({"pitch": cut("pitch", ["f0_contour_hz", "f0_contour_time_s"]), "lpc_envelope": cut("lpc_envelope", ["envelope_db"])})


def analyse_folder(spark: SparkSession, folder: str, rate: int = 16_000) -> DataFrame:
    """Documents (:func:`analysed`, with ``source_file`` for session_id) of the WAV files of a folder, read once, raised if quiet, at one rate."""
    rows = R.read_wav(spark, folder, rate=rate).select(F.col("path").alias("session_id"), "x")
    return analysed(rows, rate).withColumnRenamed("session_id", "source_file")


def scored_phrases(recordings: DataFrame, rate: int, score: Callable[[Column], Column] | None = None, shortest: float = SHORTEST, longest: float = LONGEST) -> DataFrame:
    """Every phrase of recordings (session_id, ``x``) with its document and scores: session_id, segment_id, start_s, end_s, duration_s, analysis, scores.

    ``score`` makes a struct of doubles from a document: a column expression, or
    a pandas UDF, which takes a frame of documents. Without it scores are null.
    """
    cut = tracks.kept(phrases(recordings, rate, shortest, longest))
    name = F.concat_ws("#", F.col("session_id").cast("string"), "segment_id")
    found = analysed(cut.select(name.alias("session_id"), "x"), rate)
    found = found.select(F.col("session_id").alias("phrase"), F.struct(*(c for c in found.columns if c != "session_id")).alias("analysis"))
    both = cut.drop("x").withColumn("phrase", name).join(found, "phrase").drop("phrase")
    return both.withColumn("scores", score(F.col("analysis")) if score else F.lit(None).cast("struct<composite:double>"))


def phrase_scores(segments: DataFrame) -> DataFrame:
    """The scores of phrases one by one: session_id, segment_id, category, score; those that are null left out."""
    names = segments.schema["scores"].dataType.names
    each = F.array(*(F.struct(F.lit(n).alias("category"), F.col(f"scores.{n}").cast("double").alias("score")) for n in names))
    return segments.select("session_id", "segment_id", F.explode(each).alias("e")).select("session_id", "segment_id", "e.category", "e.score").where("score IS NOT NULL")


def notable_changes(scores: DataFrame, least: float = NOTABLE) -> DataFrame:
    """Where a category's score moves by ``least`` or more from one phrase to the next: session_id, segment_id, category, delta (one place)."""
    before = F.lag("score").over(Window.partitionBy("session_id", "category").orderBy("segment_id"))
    moved = scores.withColumn("delta", F.round(F.col("score") - before, 1))
    return moved.where(F.abs("delta") >= least).select("session_id", "segment_id", "category", "delta")


def score_summary(scores: DataFrame) -> DataFrame:
    """Of each category's scores: session_id, category, mean, std, low, high, range, best and worst phrase (the first of equal ones)."""
    by = scores.groupBy("session_id", "category").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"),
        F.min(F.struct(-F.col("score"), F.col("segment_id").alias("id")))["id"].alias("best"), F.min(F.struct("score", F.col("segment_id").alias("id")))["id"].alias("worst"),
    )
    return by.withColumn("range", F.col("high") - F.col("low"))
