"""Stress of spoken words: syllables in time, joined with tracks of pitch and level, or met by them where the sound is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import spanish as S
from sonoframe.functions.tracks import Pitch, best_pitches, grid
from sonoframe.operators import tracks

#: Seconds between two looks at the pitch of a syllable, and of one bin of the join in time; looks that one numpy step holds.
LOOK, BIN, LOOKS = 0.005, 0.5, 1 << 18


def timed_syllables(words: DataFrame, keys: list[str]) -> DataFrame:
    """Syllables of words (keys, word, start, end) of two or more: keys, word, start, end, n, expected, i, syllable, begin, until.

    A word's time is cut by the lengths of its syllables. Repeated rows count
    once; words without a start, an end or a second syllable, and those that end
    before they start, have no rows.
    """
    parts = words.select(*keys, "word", "start", "end", S.syllabify("word").alias("s")).where((F.size("s") >= 2) & (F.col("end") >= F.col("start"))).distinct()
    each = parts.select(*keys, "word", "start", "end", "s", S.expected_stress(F.col("s")).alias("expected"), F.posexplode("s").alias("i", "syllable"))
    letters = lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + F.length(x))
    at = lambda n: F.col("start") + (F.col("end") - F.col("start")) * n / letters(F.col("s"))
    timed = each.withColumns({"begin": at(letters(F.expr("slice(s, 1, i)"))), "until": at(letters(F.expr("slice(s, 1, i + 1)"))), "n": F.size("s")})
    return timed.drop("s")


def near_frames(syllables: DataFrame, track: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Pairs of a syllable and a frame of its recording from ``reach`` before it to ``reach`` after it.

    Both meet in bins of half a second, so a long recording is many groups. The
    bins of a syllable are those that its recording has: a frame names its own
    and a syllable that spans more than 64 bins is joined by its recording alone.
    """
    own = track.withColumn("bin", F.floor(F.col("t") / BIN))
    low, high = F.col("begin") - reach, F.col("until") + reach
    bins = F.floor(high / BIN) - F.floor(low / BIN)
    inside = lambda joined: joined.where((F.col("t") >= low) & (F.col("t") <= high))
    short = syllables.where(bins <= 64).withColumn("bin", F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))))
    return inside(short.join(own, [*keys, "bin"])).drop("bin").unionByName(inside(syllables.where(bins > 64).join(own.drop("bin"), keys)))


def syllable_pitch(syllables: DataFrame, track: DataFrame, keys: list[str], hop: float) -> DataFrame:
    """Mean pitch of each syllable: keys, word, start, end, i, f0 (syllables without voice have no row).

    Pitch is looked at every 5 ms from the syllable's begin, between the two
    frames beside: without voice where the nearer one has none, the nearer one's
    where only the farther has none, in proportion to the distances else.
    ``track`` has frames every ``hop`` with the pitch that follows: keys, frame, t,
    f0, f0_next. A frame answers the looks up to the next one, the first also
    those before it, so a pair is one sum and no look is a row.
    """
    own = [*keys, "word", "start", "end", "i"]
    pairs = near_frames(syllables, track.select(*keys, "frame", "t", "f0", "f0_next"), keys, hop)
    look = lambda t: (t - F.col("begin")) / LOOK
    since = F.when(F.col("frame") == 0, F.col("t") - hop).otherwise(F.col("t"))
    first = F.greatest(F.lit(0), F.ceil(look(since) - 1e-6))
    last = F.least(F.floor((F.col("until") - F.col("begin")) / LOOK + 1e-9), F.floor(look(F.col("t") + hop) + 1e-6))

    def value(j: Column) -> Column:
        at = F.round(F.col("begin") + j * LOOK - F.col("t"), 9)  # seconds behind this frame
        far, there = F.abs(at), (at < hop) & (at > F.when(F.col("frame") == 0, F.lit(-hop)).otherwise(F.lit(-1e-9)))
        ahead = F.round(hop - at, 9)
        alone = (at <= 0) | F.col("f0_next").isNull()
        here = alone | (far <= ahead)
        near, other = F.when(here, F.col("f0")).otherwise(F.col("f0_next")), F.when(alone, F.col("f0")).when(here, F.col("f0_next")).otherwise(F.col("f0"))
        nearest = F.when(here, far).otherwise(ahead)
        return F.when(there & (near > 0) & (nearest <= hop / 2 + 1e-9), F.when(other > 0, near + (other - near) * nearest / hop).otherwise(near))

    heard = F.filter(F.transform(F.sequence(first, last), value), lambda v: v.isNotNull())
    sums = pairs.where(first <= last).withColumn("heard", heard).select(*own, F.aggregate("heard", F.lit(0.0), lambda s, v: s + v).alias("s"), F.size("heard").alias("n"))
    return sums.groupBy(*own).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("f0")).where("f0 IS NOT NULL")


def syllable_level(syllables: DataFrame, track: DataFrame, keys: list[str]) -> DataFrame:
    """Mean level of the frames in each syllable, both ends included: keys, word, start, end, i, level."""
    return near_frames(syllables, track.select(*keys, "t", "level"), keys, 0.0).groupBy(*keys, "word", "start", "end", "i").agg(F.avg("level").alias("level"))


def standing_out(means: DataFrame, own: list[str], word: Column) -> DataFrame:
    """Which syllable of each word stands out, from ``own``, i, expected, f0 and level of its syllables: see :func:`most_prominent`."""
    each = means.groupBy(*own).agg(F.max("expected").alias("expected"), F.collect_list(F.struct("i", "f0", "level")).alias("syllables"))
    return most_prominent(each, own, word)


def most_prominent(words: DataFrame, own: list[str], word: Column) -> DataFrame:
    """Which syllable of each word stands out, from ``own``, expected, and ``syllables``, an array of i, f0 and level, in any order.

    Pitch and level, each from least to greatest within the word, are halved and
    added; if the margin to the next syllable is below 0.15 of the greatest, the
    expected one is taken. A row has all of a word, so none is shuffled.
    """
    ends = [f(F.col("syllables")[x]).alias(f"{end}_{x}") for x in ("f0", "level") for end, f in (("low", F.array_min), ("high", F.array_max))]
    share = lambda s, x: F.when(F.col("high_" + x) > F.col("low_" + x), (s[x] - F.col("low_" + x)) / (F.col("high_" + x) - F.col("low_" + x))).otherwise(0.0)
    score = lambda s: F.struct(F.round(0.5 * share(s, "f0") + 0.5 * share(s, "level") + 3.3e-8, 3).alias("score"), (-s["i"]).alias("at"))
    top = words.select(*own, "expected", "syllables", *ends).select(*own, "expected", F.sort_array(F.transform("syllables", score), False).alias("r"))
    best, next_ = F.col("r")[0], F.get("r", F.lit(1))
    gap = F.round(F.when(best["score"] > 0, (best["score"] - next_["score"]) / best["score"]).otherwise(0.0) + 3.3e-8, 3)
    top = top.select(*own, "expected", (-best["at"]).alias("first"), gap.alias("confidence"), F.size("r").alias("n_syllables"))
    found = F.when(F.col("confidence") < 0.15, F.col("expected")).otherwise(F.col("first"))
    return top.select(*own, F.col("expected").alias("expected_syllable"), found.alias("detected_syllable"), (found == F.col("expected")).alias("correct"), "confidence", S.vos_form(word).alias("is_vos"), "n_syllables")


#: Doubles as :func:`spoken_stress` compares them.
TENTH = lambda x: F.coalesce(F.round(x, 1), F.lit(0.0))


def spoken_stress(recordings: DataFrame, words: DataFrame, keys: list[str], rate: int, how: Pitch = Pitch()) -> DataFrame:
    """Stress of words (keys, word, start, end in seconds) spoken in recordings (keys, x): expected and detected syllable, whether they agree, confidence.

    Tracks of pitch and level over whole recordings meet the words' syllables in
    bins of time. A syllable without voice has pitch 0, one without a frame level
    0, as have words of recordings that aren't there or whose keys are null.
    Words of one syllable have no row.
    """
    syllables = timed_syllables(words, keys)
    pitch = syllable_pitch(syllables, tracks.pitch_track(recordings, keys, rate, how, following=True), keys, how.hop(rate) / rate)
    level = syllable_level(syllables, tracks.intensity_track(recordings, keys, rate), keys)
    own = [*keys, "word", "start", "end"]
    means = syllables.join(pitch, [*own, "i"], "left").join(level, [*own, "i"], "left")
    return standing_out(means.select(*own, "i", "expected", TENTH("f0").alias("f0"), TENTH("level").alias("level")), own, F.col("word"))


def pitch_within(begin: np.ndarray, until: np.ndarray, t: np.ndarray, f0: np.ndarray, hop: float) -> np.ndarray:
    """Mean pitch of spans of time, 0 without voice, from the frames of one track, as :func:`syllable_pitch` has it.

    Looks are worked out ``LOOKS`` at a time, or those of one span; none lies
    beyond the track, so a span has at most as many as the recording is long.
    """
    out = np.zeros(len(begin))
    if not len(t):
        return out
    first = np.maximum(0, np.ceil((t[0] - hop - begin) / LOOK - 1e-6)).astype(np.int64)
    last = np.minimum(np.floor((until - begin) / LOOK + 1e-9), np.floor((t[-1] + hop - begin) / LOOK + 1e-6)).astype(np.int64)
    counts = np.maximum(0, last - first + 1)
    following = np.append(f0[1:], 0.0)
    for spans in _in_slices(counts, LOOKS):
        many = counts[spans]
        of = np.repeat(np.arange(len(many)), many)
        j = np.repeat(first[spans] - np.cumsum(many) + many, many) + np.arange(len(of))
        look = np.repeat(begin[spans], many) + j * LOOK
        frame = np.maximum(np.searchsorted(t, look + 5e-10, "right") - 1, 0)
        at = np.round(look - t[frame], 9)  # seconds behind this frame, which answers up to the next one, the first also before it
        far, ahead = np.abs(at), np.round(hop - at, 9)
        alone = (at <= 0) | (frame == len(t) - 1)
        here = alone | (far <= ahead)
        near, other = np.where(here, f0[frame], following[frame]), np.where(alone | ~here, f0[frame], following[frame])
        nearest = np.where(here, far, ahead)
        heard = (far < hop) & (near > 0) & (nearest <= hop / 2 + 1e-9)
        value = np.where(other > 0, near + (other - near) * nearest / hop, near)
        total, n = np.bincount(of[heard], value[heard], len(many)), np.bincount(of[heard], minlength=len(many))
        out[spans] = np.divide(total, n, out=np.zeros(len(many)), where=n > 0)
    return out


def level_within(begin: np.ndarray, until: np.ndarray, t: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Mean level of the frames in spans of time, both ends included; 0 without any."""
    low, high = np.searchsorted(t, begin, "left"), np.searchsorted(t, until, "right")
    total, n = np.concatenate([[0.0], np.cumsum(level)]), np.maximum(high - low, 0)
    return np.divide(total[np.maximum(high, low)] - total[low], n, out=np.zeros(len(begin)), where=n > 0)


def _in_slices(counts: np.ndarray, limit: int) -> Iterator[slice]:
    """Ranges whose counts add up to at most the limit, or of one."""
    ends, first = np.cumsum(counts), 0
    while first < len(counts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(first, last)
        first = last


def heard_stress(recordings: DataFrame, keys: list[str], rate: int, how: Pitch = Pitch(), sound: tracks.Sound | None = None) -> DataFrame:
    """What :func:`spoken_stress` gives of recordings that bring their words: tracks meet syllables in a recording's task, and nothing is shuffled.

    Recordings have ``x``, or what ``sound`` makes it from, and arrays of their
    words' ``word``, ``start``, ``end``, ``expected`` (place of the stress) and
    ``letters`` (an array of each syllable's length). A word that they name twice has two rows.
    """
    lists = ["word", "start", "end", "expected", "letters"]
    hop, (level_window, level_hop) = how.hop(rate) / rate, tracks.level_grid(rate)

    def measured(x: np.ndarray, pitch: np.ndarray, begin: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = lambda window, step: (lambda n, start: (start + np.arange(n) * step + window / 2) / rate)(*grid(len(x), window, step))
        f0 = pitch_within(begin, until, at(how.window(rate), how.hop(rate)), pitch, hop)
        return f0, level_within(begin, until, at(level_window, level_hop), tracks.levels(x, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, tracks.MADE):
                batch = whole.slice(start, tracks.MADE)
                made = batch.select([c for c in batch.schema.names if c not in lists]).to_pandas()
                x = [np.zeros(0) if v is None else np.asarray(v, float) for v in (sound(made) if sound else made["x"])]
                x = [v if np.isfinite(v).all() else v[:0] for v in x]
                pitch = best_pitches(x, rate, how)
                word, expected, letters = (batch.column(c).flatten() for c in ("word", "expected", "letters"))
                began, ended = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("start", "end"))
                of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column("word")), 0).to_numpy(zero_copy_only=False))
                n = pc.fill_null(pc.list_value_length(letters), 0).to_numpy(zero_copy_only=False)
                said = (n >= 2) & (ended >= began)  # NaN for null: no
                size = letters.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(n)), n)
                size, owner = size[said[owner]], owner[said[owner]]
                place, n = np.cumsum(said) - 1, n[said]
                own = place[owner]
                first = np.cumsum(n) - n
                after = np.cumsum(size)
                base = (after[first] - size[first])[own] if len(n) else after
                total = np.bincount(own, size, len(n))[own].astype(np.int64)
                wide = (ended - began)[owner]
                begin, until = (began[owner] + wide * v / total for v in (after - size - base, after - base))
                f0, level = np.zeros(len(owner)), np.zeros(len(owner))
                ends = np.searchsorted(of[owner], np.arange(batch.num_rows + 1))
                for i, v in enumerate(x):
                    if len(v) and ends[i] < ends[i + 1]:
                        part = slice(ends[i], ends[i + 1])
                        f0[part], level[part] = measured(v, pitch[i][0], begin[part], until[part])
                rows = np.flatnonzero(said)
                inside = pa.StructArray.from_arrays([pa.array((np.arange(len(own)) - first[own]).astype(np.int32)), pa.array(f0), pa.array(level)], ["i", "f0", "level"])
                syllables = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), inside)
                found = [batch.column(k).take(pa.array(of[rows])) for k in keys]
                yield pa.RecordBatch.from_arrays([*found, word.take(pa.array(rows)), pa.array(began[rows]), pa.array(ended[rows]), expected.take(pa.array(rows)), syllables], [*keys, "word", "start", "end", "expected", "syllables"])

    made = recordings if sound else recordings.select(*keys, "x", *lists)
    kinds = dict(made.dtypes)
    means = made.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", word string, start double, end double, expected int, syllables array<struct<i: int, f0: double, level: double>>")
    tenths = F.transform("syllables", lambda s: F.struct(s["i"].alias("i"), TENTH(s["f0"]).alias("f0"), TENTH(s["level"]).alias("level")))
    return most_prominent(means.withColumn("syllables", tenths), [*keys, "word", "start", "end"], F.col("word"))
