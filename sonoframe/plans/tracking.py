"""Tracks over the sound of recordings, and what is summed up from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions.acoustics import contact_quotient
from sonoframe.operators import tracks
from sonoframe.plans.cases import case
from sonoframe.sources.bindings import RATE, dealt_parts, recordings, sounds_of

KEYS = ["session_id", "part"]


def pitch(spark, d):
    return tracks.pitch_track(recordings(spark, d), KEYS, int(RATE))


def formants(spark, d):
    return tracks.sound_formants(dealt_parts(spark, d), KEYS, int(RATE), sound=sounds_of)


def summary(spark, d):
    """Mean, median, deviation and range of the voiced frames, and their share, by recording."""
    voice = F.when(F.col("f0") > 0, F.col("f0"))
    return pitch(spark, d).groupBy(*KEYS).agg(
        F.coalesce(F.avg(voice), F.lit(0.0)).alias("f0_mean"), F.coalesce(F.percentile(voice, 0.5), F.lit(0.0)).alias("f0_median"),
        F.coalesce(F.stddev_pop(voice), F.lit(0.0)).alias("f0_std"), F.coalesce(F.min(voice), F.lit(0.0)).alias("f0_min"),
        F.coalesce(F.max(voice), F.lit(0.0)).alias("f0_max"), F.avg(F.when(F.col("f0") > 0, 1.0).otherwise(0.0)).alias("voiced_fraction"),
    )


def contact(spark, d):
    """Mean contact quotient of the frames with voice, from the balance of their harmonics, by recording."""
    found = tracks.sound_contact(recordings(spark, d), KEYS, int(RATE))
    return found.groupBy(*KEYS).agg(F.avg(contact_quotient(F.col("h1"), F.col("h2"), F.col("h4"))).alias("contact_quotient"), F.count("*").alias("n"))


case("pitch_track", pitch)
case("sound_contact_quotient", contact)
case("sound_pitch_summary", summary)
case("formant_track", formants)
