"""Tracks over recordings of any length: chunks of frames are tasks of their own, their partial results are joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import tracks
from sonoframe.functions.tracks import Pitch
from sonoframe.operators import frames as O

#: Frames of one chunk, samples of all frames that one numpy step holds, samples of the recordings that are measured together, and rows of one result.
CHUNK, HELD, SOUND, ROWS = 256, 2_000_000, 1 << 20, 65_536

#: What makes the sound of some recordings from what it is made of, and of how many at once.
Sound, MADE = Callable[[pd.DataFrame], list[np.ndarray]], 32


def kept(df: DataFrame) -> DataFrame:
    """A result that is used twice: written to the checkpoint folder where one is set, else worked out twice."""
    set_ = df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if set_ else df


def _fields(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def cuts(x: np.ndarray, count: int, origin: int, window: int, hop: int, chunk: int, halo: int = 0, align: int = 1) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """A recording's chunks as :func:`chunked` has them: first, count, begin, x."""
    for first in range(0, count, chunk):
        n = min(chunk, count - first)
        begin = (origin + first * hop - halo) // align * align
        end = origin + (first + n - 1) * hop + window + halo
        yield first, n, begin, np.pad(x[max(begin, 0) : end], (max(-begin, 0), max(end - max(len(x), begin), 0)))


def chunked(recordings: DataFrame, keys: list[str], window: int, hop: int, halo: int = 0, align: int = 1, more: tuple[str, ...] = (), start: int | None = None) -> DataFrame:
    """Recordings (keys, ``x``) in chunks of ``CHUNK`` frames: keys, chunk, first, count, origin, begin, peak, x, and the columns ``more``.

    ``first`` is the chunk's first frame and ``count`` its number of frames, of
    ``window`` samples every ``hop``, centred in the recording or from sample
    ``start`` on; ``origin`` is where the recording's first frame begins. A chunk's samples begin at
    ``begin``, a multiple of ``align``, at least ``halo`` before its first frame,
    and go on for as long behind its last; beyond the recording they are 0.
    ``peak`` is the recording's highest distance from its mean, which is taken
    off.

    Missing, empty or non-finite recordings, and those shorter than a frame,
    have no chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x = row.pop("x")
                x = np.zeros(0) if x is None else np.asarray(x, float)
                count, origin = tracks.grid(len(x), window, hop) if start is None else (max(0, (len(x) - start - window) // hop + 1), start)
                if not count or not np.isfinite(x).all():
                    continue
                x = x - x.mean()
                peak = float(np.abs(x).max())
                out = []
                for chunk, (first, n, begin, part) in enumerate(cuts(x, count, origin, window, hop, CHUNK, halo, align)):
                    out.append({**row, "chunk": chunk, "first": first, "count": n, "origin": origin, "begin": begin, "peak": peak, "x": part})
                    if len(out) == 64:
                        yield pd.DataFrame(out)
                        out = []
                if out:
                    yield pd.DataFrame(out)

    rows = recordings.select(*keys, *more, "x")
    return rows.mapInPandas(run, f"{_fields(rows, [*keys, *more])}, chunk int, first bigint, count int, origin bigint, begin bigint, peak double, x array<double>")


def together(batches: Iterator[pd.DataFrame], sound: Sound | None = None) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows with finite sound and that sound, up to ``SOUND`` samples at a time, or one longer recording.

    Rows bring their sound as ``x``, or ``sound`` makes it, of ``MADE`` of them at a time.
    """
    for batch in batches:
        for first in range(0, len(batch), MADE if sound else max(1, len(batch))):
            whole = batch.iloc[first : first + MADE] if sound else batch
            some, held, n = [], [], 0
            for i, x in enumerate(sound(whole) if sound else whole["x"]):
                if x is None or not len(x):
                    continue
                x = np.asarray(x, float)
                if not np.isfinite(x).all():
                    continue
                if some and n + len(x) > SOUND:
                    yield whole.iloc[some], held
                    some, held, n = [], [], 0
                some.append(i)
                held.append(x)
                n += len(x)
            if some:
                yield whole.iloc[some], held


def _beside(rows: pd.DataFrame, counts: list[int], **columns: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows, repeated so many times each beside columns, a bounded number at a time."""
    at = np.repeat(np.arange(len(rows)), counts)
    for i in range(0, len(at), ROWS):
        yield rows.iloc[at[i : i + ROWS]].reset_index(drop=True).assign(**{name: v[i : i + ROWS] for name, v in columns.items()})


def _alike(batch: pd.DataFrame, columns: list[str], room: int) -> Iterator[pd.DataFrame]:
    """Rows with the same values of the columns and lengths of ``x``, a bounded number at a time."""
    sizes = batch["x"].map(len) if "x" in batch else 0
    for _, part in batch.groupby([sizes, *columns] if "x" in batch else columns, sort=False):
        for i in range(0, len(part), room):
            yield part.iloc[i : i + room]


def pitch_track(recordings: DataFrame, keys: list[str], rate: int, how: Pitch = Pitch(), following: bool = False) -> DataFrame:
    """Pitch of every frame: keys, frame, t (seconds, its middle), f0 (0 without voice), strength.

    The path is that which is best over the whole recording. A recording is a
    row, so it is in one task anyway: its candidates, a quarter of its size at 8
    kHz, stay there, and neither they nor its sound are shuffled or written.

    Missing, empty or non-finite recordings, and those shorter than a frame, have
    no rows. With ``following``, rows have the next frame's pitch too, ``f0_next``,
    null for the last.
    """
    window, hop = how.window(rate), how.hop(rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sounds in together(batches):
            found = tracks.best_pitches(sounds, rate, how)
            counts = [len(f0) for f0, _ in found]
            frame = np.concatenate([np.arange(n) for n in counts])
            origin = np.repeat([tracks.grid(len(x), window, hop)[1] for x in sounds], counts)
            f0, strength = (np.concatenate(v) for v in zip(*found, strict=True))
            more = {"f0_next": np.concatenate([np.append(v[1:], np.nan)[: len(v)] for v, _ in found])} if following else {}
            yield from _beside(part[keys], counts, frame=frame, t=(origin + frame * hop + window / 2) / rate, f0=f0, strength=strength, **more)

    rows = recordings.select(*keys, "x")
    made = rows.mapInPandas(run, f"{_fields(rows, keys)}, frame bigint, t double, f0 double, strength double" + ", f0_next double" * following)
    return made.withColumn("f0_next", F.when(~F.isnan("f0_next"), F.col("f0_next"))) if following else made


def mean_pitch(track: DataFrame, keys: list[str]) -> DataFrame:
    """Mean pitch of voiced frames and their share, by recording: keys, mean (null without any), voiced."""
    voice = F.when(F.col("f0") > 0, F.col("f0"))
    return track.groupBy(*keys).agg(F.avg(voice).alias("mean"), F.avg(F.when(F.col("f0") > 0, 1.0).otherwise(0.0)).alias("voiced"))


def level_grid(rate: int, lowest: float = 100.0, step: float = 0.01) -> tuple[int, int]:
    """Samples of a frame of level, 6.4 periods of the ``lowest`` pitch, and from one to the next."""
    return int(6.4 / lowest * rate), max(1, int(step * rate))


def levels(x: np.ndarray, rate: int, lowest: float = 100.0, step: float = 0.01) -> np.ndarray:
    """Levels of one recording's frames, see :func:`intensity_track`; none if it is shorter than a frame."""
    window, hop = level_grid(rate, lowest, step)
    weight = np.kaiser(window, 2 * np.pi**2 + 0.5)
    weight = weight / weight.sum()
    count, origin = tracks.grid(len(x), window, hop)
    out = np.empty(count)
    if count:
        for first, n, _, part in cuts(x - x.mean(), count, origin, window, hop, CHUNK):
            y = tracks.framed(part[None], window, hop)[0, :n]
            y = y - y.mean(axis=1, keepdims=True)
            out[first : first + n] = np.maximum(-300.0, 10 * np.log10(np.maximum((y * y) @ weight, 1e-300) / 4e-10))
    return out


def intensity_track(recordings: DataFrame, keys: list[str], rate: int, lowest: float = 100.0, step: float = 0.01) -> DataFrame:
    """Level of every frame in dB above 20 micropascals: keys, frame, t (seconds, its middle), level.

    Frames of 6.4 periods of the ``lowest`` pitch under a Kaiser window, their
    own mean taken off; silence is at -300 dB. Chunks are matrices, as for pitch.
    """
    window, hop = level_grid(rate, lowest, step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sounds in together(batches):
            grids = [tracks.grid(len(x), window, hop) for x in sounds]
            counts = [n for n, _ in grids]
            if any(counts):
                frame = np.concatenate([np.arange(n) for n in counts])
                level = np.concatenate([levels(x, rate, lowest, step) for x in sounds])
                t = (np.repeat([start for _, start in grids], counts) + frame * hop + window / 2) / rate
                yield from _beside(part[keys], counts, frame=frame, t=t, level=level)

    rows = recordings.select(*keys, "x")
    return rows.mapInPandas(run, f"{_fields(rows, keys)}, frame bigint, t double, level double")


def ceilings(mean: Column) -> Column:
    """The ceilings in Hz that are tried for a mean pitch."""
    tried = lambda *hz: F.array(*(F.lit(x) for x in hz))
    return F.when(mean > 200, tried(5500)).when(mean > 160, tried(5000, 5200, 5500)).otherwise(tried(4500, 4800, 5000, 5200, 5500))


def tried_for(mean: float | None) -> tuple[int, ...]:
    """The same of a number."""
    mean = mean or 0
    return (5500,) if mean > 200 else (5000, 5200, 5500) if mean > 160 else TRIED


#: All of them, for the alignment of chunks.
TRIED = (4500, 4800, 5000, 5200, 5500)


def formant_tracks(recordings: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Resonances of every frame under each of the recording's ``ceilings``: keys, hz, frame, t, f1 to f4, bw1 to bw4.

    Frames of 50 ms every 6.25 ms, Burg's predictor of ten coefficients at twice
    the ceiling, whole chunks as matrices. A resonance that isn't there is 0.
    Chunks hold enough of their neighbours for the filter, so the result is that
    of the whole recording.
    """
    window, hop = int(tracks.FORMANT_WINDOW * rate), max(1, int(tracks.FORMANT_STEP * rate))
    align = lcm(*(rate // gcd(rate, 2 * c) for c in TRIED))
    parts = chunked(recordings, keys, window, hop, 128, align, ("ceilings",))
    names = ["f1", "f2", "f3", "f4", "bw1", "bw2", "bw3", "bw4"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(lead=batch["origin"] + batch["first"] * hop - batch["begin"], tried=batch["ceilings"].map(tuple))
            for part in _alike(batch, ["count", "lead", "tried"], max(1, HELD // (CHUNK * window * 2))):
                n, lead = int(part["count"].iloc[0]), int(part["lead"].iloc[0])
                middle = lead + np.arange(n) * hop + window / 2
                frame = part["first"].to_numpy()[:, None] + np.arange(n)
                t = (part["origin"].to_numpy()[:, None] + frame * hop + window / 2) / rate
                x = np.stack(part["x"].to_numpy())
                for hz in part["tried"].iloc[0]:
                    f, width = tracks.formant_frames(x, rate, hz, np.floor(middle * 2 * hz / rate).astype(int))
                    out = part[keys].loc[part.index.repeat(n)].reset_index(drop=True).assign(hz=float(hz), frame=frame.ravel(), t=t.ravel())
                    yield out.assign(**dict(zip(names, np.concatenate([f, width], axis=2).reshape(-1, 8).T, strict=True)))

    return parts.mapInPandas(run, f"{_fields(parts, keys)}, hz double, frame bigint, t double, " + ", ".join(f"{x} double" for x in names))


def best_formants(recordings: DataFrame, keys: list[str], rate: int, pitch: DataFrame) -> DataFrame:
    """Each recording's resonances under the ceiling whose tracks are most plausible; of equal ones the highest.

    ``pitch`` (:func:`mean_pitch`) settles which ceilings are tried; without a
    mean all are.
    """
    sound = recordings.hint("merge")  # its size is guessed by its columns' widths, which says nothing of arrays: never broadcast
    same = [sound[c].eqNullSafe(pitch[c]) for c in keys]
    rows = sound.join(pitch, same, "left").select(*(sound[c] for c in keys), ceilings(F.col("mean")).alias("ceilings"), sound["x"])
    tried = kept(formant_tracks(rows, keys, rate))
    scores = O.track_score(tried.withColumn("seq", F.col("frame")), F.col("hz"), [*keys, "hz"])
    best = scores.groupBy(*keys).agg(F.max(F.struct(F.round("score", 6).alias("score"), "hz")).alias("best"))
    best = best.select(*(F.col(k).alias("best_" + k) for k in keys), F.col("best.hz").alias("best_hz"))
    chosen = F.col("hz") == F.col("best_hz")
    for k in keys:
        chosen &= F.col(k).eqNullSafe(F.col("best_" + k))
    return tried.join(best, chosen).select(*tried.columns)


def sound_formants(recordings: DataFrame, keys: list[str], rate: int, how: Pitch = Pitch(), sound: Sound | None = None) -> DataFrame:
    """What :func:`best_formants` gives by the pitch of the same recordings, without a shuffle: keys, hz, frame, t, f1 to f4, bw1 to bw4.

    A recording's pitch, the tracks under each ceiling and their scores stay in
    its task; only the rows of the ceiling that is chosen leave it. Poles of the
    recordings that are measured together are sought together. With ``sound``,
    rows have no ``x``: it makes theirs, where it is measured.
    """
    window, hop = int(tracks.FORMANT_WINDOW * rate), max(1, int(tracks.FORMANT_STEP * rate))
    align = lcm(*(rate // gcd(rate, 2 * c) for c in TRIED))
    names = ["f1", "f2", "f3", "f4", "bw1", "bw2", "bw3", "bw4"]

    def predictors(x: np.ndarray, hz: int, count: int, origin: int) -> Iterator[np.ndarray]:
        for first, n, begin, part in cuts(x - x.mean(), count, origin, window, hop, CHUNK, 128, align):
            middle = origin + first * hop - begin + np.arange(n) * hop + window / 2
            yield tracks.formant_predictors(part[None], rate, hz, np.floor(middle * 2 * hz / rate).astype(int))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sounds in together(batches, sound):
            grids = [tracks.grid(len(x), window, hop) for x in sounds]
            tried = [tried_for(f0[f0 > 0].mean() if (f0 > 0).any() else None) for f0, _ in tracks.best_pitches(sounds, rate, how)]
            best: dict[int, tuple] = {}
            for hz in TRIED:
                some = [i for i, at in enumerate(grids) if at[0] and hz in tried[i]]
                if not some:
                    continue
                found = np.concatenate(tracks.poles(np.concatenate([a for i in some for a in predictors(sounds[i], hz, *grids[i])]), 2 * hz), axis=1)
                for i, own in zip(some, np.split(found, np.cumsum([grids[i][0] for i in some])[:-1]), strict=True):
                    score = round(tracks.track_score(own[:, :4], own[:, 4:], hz), 6)
                    if i not in best or score >= best[i][0]:  # ceilings rise, so of equal ones the highest
                        best[i] = score, float(hz), own
            if best:
                which, (_, hz, found) = sorted(best), zip(*(best[i] for i in sorted(best)), strict=True)
                counts = [grids[i][0] for i in which]
                frame = np.concatenate([np.arange(n) for n in counts])
                t = (np.repeat([grids[i][1] for i in which], counts) + frame * hop + window / 2) / rate
                yield from _beside(part.iloc[which][keys], counts, hz=np.repeat(hz, counts), frame=frame, t=t, **dict(zip(names, np.concatenate(found).T, strict=True)))

    rows = recordings if sound else recordings.select(*keys, "x")
    return rows.mapInPandas(run, f"{_fields(rows, keys)}, hz double, frame bigint, t double, " + ", ".join(f"{x} double" for x in names))


#: Seconds between the frames of the contact quotient, and of one; the harmonics it weighs, and how wide they are.
CONTACT_STEP, CONTACT_WINDOW, HARMONICS, HARMONIC_WIDTH = 0.02, 0.05, (1, 2, 4), 0.1


def contact_frames(recordings: DataFrame, keys: list[str], rate: int, track: DataFrame, how: Pitch = Pitch()) -> DataFrame:
    """Levels of the first, second and fourth harmonic of voiced frames of 50 ms every 20 ms: keys, frame, t, f0, h1, h2, h4 (dB).

    Pitch is read from ``track`` (:func:`pitch_track` of the same recordings):
    between two voiced frames on the line between them, else that of the nearer
    frame, if it is voiced. Each chunk of sound meets the part of the track that
    it spans, so neither side of a recording is gathered whole. A frame without
    energy in one of the bands has no row.
    """
    window, hop = int(CONTACT_WINDOW * rate), max(1, int(CONTACT_STEP * rate))
    step = how.hop(rate) / rate
    start = (-(window - hop) // 2) % hop  # frame i is around sample (i + 0.5) * hop, for the first i that fits
    late = (start + (window - hop) // 2) // hop
    parts = chunked(recordings, keys, window, hop, start=start).hint("merge")  # sound is never broadcast, see best_formants
    span = CHUNK * hop / rate  # seconds from one chunk's first frame to the next's
    first = (start + window / 2) / rate
    low, high = (F.floor((F.col("t") + side * (step + 1e-6) - first) / span).cast("int") for side in (-1, 1))
    near = track.select(*keys, F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))).alias("at_chunk"), F.struct("t", "f0").alias("p"))
    near = near.groupBy(*keys, "at_chunk").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a chunk's share of the track, never all of it
    same = [parts[k].eqNullSafe(near[k]) for k in keys]
    both = parts.join(near, [*same, parts["chunk"] == near["at_chunk"]]).select(*(parts[k] for k in keys), "first", "count", parts["x"], F.col("p.t").alias("ts"), F.col("p.f0").alias("fs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                found = harmonics(np.asarray(row["x"], float), row["first"] + late, int(row["count"]), np.asarray(row["ts"]), np.asarray(row["fs"]), rate, step)
                if found:
                    yield pd.DataFrame({k: [row[k]] * len(found["frame"]) for k in keys}).assign(**found)

    return both.mapInPandas(run, f"{_fields(parts, keys)}, frame bigint, t double, f0 double, h1 double, h2 double, h4 double")


def harmonics(x: np.ndarray, first: int, count: int, times: np.ndarray, pitch: np.ndarray, rate: int, step: float) -> dict[str, np.ndarray]:
    """Columns of :func:`contact_frames` for frames ``first`` and on, whose sound ``x`` begins with the first of them, from a track's times and pitch; {} if none has voice."""
    window, hop = int(CONTACT_WINDOW * rate), max(1, int(CONTACT_STEP * rate))
    size = 1 << (4 * window).bit_length()
    frame = first + np.arange(count)
    t = (frame + 0.5) * hop / rate
    f0 = pitch_at(t, times, pitch, step)
    sounding = np.flatnonzero(f0 > 0)
    if not len(sounding):
        return {}
    rows = tracks.framed(x[None], window, hop)[0, sounding]
    power = np.cumsum(np.abs(np.fft.rfft(rows * np.hamming(window), size)) ** 2, axis=1)
    power = np.concatenate([np.zeros((len(rows), 1)), power], axis=1)
    f0 = f0[sounding]
    at = np.arange(len(rows))
    edge = lambda hz, up: np.clip((np.floor if up else np.ceil)(hz * size / rate).astype(int) + up, 0, power.shape[1] - 1)
    bands = [np.maximum(power[at, edge(h * f0 * (1 + HARMONIC_WIDTH), 1)] - power[at, edge(h * f0 * (1 - HARMONIC_WIDTH), 0)], 0) for h in HARMONICS]
    good = np.min(bands, axis=0) > 0
    return {"frame": frame[sounding][good], "t": t[sounding][good], "f0": f0[good]} | {f"h{h}": 10 * np.log10(b[good]) for h, b in zip(HARMONICS, bands, strict=True)}


def sound_contact(recordings: DataFrame, keys: list[str], rate: int, how: Pitch = Pitch()) -> DataFrame:
    """What :func:`contact_frames` gives by the pitch of the same recordings, without a shuffle: each recording meets its track in its own task."""
    window, hop = int(CONTACT_WINDOW * rate), max(1, int(CONTACT_STEP * rate))
    start = (-(window - hop) // 2) % hop
    late = (start + (window - hop) // 2) // hop
    wide, step = how.window(rate), how.hop(rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sounds in together(batches):
            for i, (x, (f0, _)) in enumerate(zip(sounds, tracks.best_pitches(sounds, rate, how), strict=True)):
                count = max(0, (len(x) - start - window) // hop + 1)
                if not count or not len(f0):
                    continue
                x = x - x.mean()
                t = (tracks.grid(len(x), wide, step)[1] + np.arange(len(f0)) * step + wide / 2) / rate
                for first, n, _, sound in cuts(x, count, start, window, hop, CHUNK):
                    found = harmonics(sound, first + late, n, t, f0, rate, step / rate)
                    if found:
                        yield from _beside(part.iloc[[i]][keys], [len(found["frame"])], **found)

    rows = recordings.select(*keys, "x")
    return rows.mapInPandas(run, f"{_fields(rows, keys)}, frame bigint, t double, f0 double, h1 double, h2 double, h4 double")


def pitch_at(t: np.ndarray, times: np.ndarray, f0: np.ndarray, step: float) -> np.ndarray:
    """Pitch at times of a track's frames in order; 0 without voice, or more than half a step beyond its frames."""
    right = np.clip(np.searchsorted(times, t), 0, len(times) - 1)
    left = np.clip(right - 1, 0, len(times) - 1)
    right = np.where(t <= times[0], 0, right)
    left = np.where(t >= times[-1], len(times) - 1, left)
    right = np.maximum(left, right)
    a, b = f0[left], f0[right]
    share = np.divide(t - times[left], times[right] - times[left], out=np.zeros(len(t)), where=right > left)
    nearer = np.where(share <= 0.5, a, b)
    inside = (t >= times[0] - step / 2) & (t <= times[-1] + step / 2)
    return np.where(inside, np.where((a > 0) & (b > 0), a + share * (b - a), nearer), 0.0)
