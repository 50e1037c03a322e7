"""Measures of short waveforms, batch by batch in numpy; Spark deals the rows out."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.tracks import Pitch, best_pitch, best_pitches, resampled  # noqa: F401


def frame(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames as rows; a shorter signal has none."""
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def power_frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Power spectra, a row for each frame: Hann windows of ``size`` centred on every ``hop``-th sample, zeros beyond the ends."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(frame(np.pad(x, size // 2), size, hop) * window)) ** 2


def power_spectrum(x: np.ndarray) -> np.ndarray:
    """Power of the Hann-windowed signal at the frequencies of the real transform."""
    return np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2


def centroid(x: np.ndarray, rate: float) -> float:
    power = power_spectrum(x)
    total = power.sum()
    return float((np.fft.rfftfreq(len(x), 1 / rate) * power).sum() / total) if total > 0 else 0.0


def tilt(x: np.ndarray, rate: float, low: float, high: float) -> float:
    """Slope of level in dB over octaves between two frequencies; 0 if fewer than two bins."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    some = (f >= low) & (f <= high) & (f > 0)
    if some.sum() < 2:
        return 0.0
    level = 10 * np.log10(np.maximum(power_spectrum(x)[some], 1e-12))
    octave = np.log2(f[some])
    octave = octave - octave.mean()
    return float((octave * level).sum() / (octave**2).sum())


def predictor(x: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction coefficients (1, a1, ...) by the Levinson recursion on the autocorrelation."""
    n = len(x)
    full = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2)[: order + 1]
    a, error = np.zeros(order + 1), full[0]
    a[0] = 1.0
    if error <= 0:
        return a
    for i in range(1, order + 1):
        k = -(full[i] + a[1:i] @ full[i - 1 : 0 : -1]) / error
        a[1 : i + 1] = a[1 : i + 1] + k * np.append(a[i - 1 : 0 : -1], 1.0)
        error *= 1 - k * k
    return a


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction coefficients that minimise forward and backward errors together (Burg)."""
    a, f, b = np.ones(1), x[1:], x[:-1]
    for _ in range(order):
        power = f @ f + b @ b
        k = -2 * (f @ b) / power if power > 0 else 0.0
        a = np.append(a, 0.0) + k * np.append(0.0, a[::-1])
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def envelope(x: np.ndarray, order: int, bins: int, emphasis: float = 0.97) -> np.ndarray:
    """Level in dB of the predictor's spectrum at evenly spaced frequencies up to half the rate."""
    y = np.append(x[0], x[1:] - emphasis * x[:-1]) * np.hamming(len(x))
    return -20 * np.log10(np.maximum(np.abs(np.fft.rfft(predictor(y, order), 2 * bins))[:bins], 1e-10))


def resonances(x: np.ndarray, rate: float, order: int, widest: float = 700.0) -> list[tuple[float, float]]:
    """(frequency, bandwidth) of the predictor's poles between 50 Hz and half the rate less 50 Hz."""
    roots = np.roots(burg(x, order))
    roots = roots[roots.imag > 0]
    f, b = np.angle(roots) * rate / (2 * np.pi), -np.log(np.maximum(np.abs(roots), 1e-12)) * rate / np.pi
    return sorted((float(x), float(y)) for x, y in zip(f, b, strict=True) if 50 < x < rate / 2 - 50 and y < widest)


def pitch(x: np.ndarray, rate: float, low: float = 50.0, high: float = 550.0) -> tuple[float, float]:
    """Frequency of the highest peak of the window-corrected autocorrelation, and its height; 0 if there is none."""
    n = len(x)
    window = np.hanning(n)
    of = lambda v: np.fft.irfft(np.abs(np.fft.rfft(v, 2 * n)) ** 2)[:n]
    r, w = of((x - x.mean()) * window), of(window)
    if r[0] <= 0:
        return 0.0, 0.0
    r = (r / r[0]) / np.maximum(w / w[0], 1e-3)
    lags = np.arange(max(2, int(rate / high)), min(n // 2, int(rate / low) + 1))
    if not len(lags):
        return 0.0, 0.0
    best = int(lags[np.argmax(r[lags] - 0.05 * np.log2(lags / lags[0]))])  # of like peaks the shortest period
    a, b, c = r[best - 1], r[best], r[min(best + 1, n - 1)]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return float(rate / (best + shift)), float(min(b, 1.0))


def harmonicity(height: float) -> float:
    """Harmonics-to-noise ratio in dB of an autocorrelation peak."""
    height = min(max(height, 1e-6), 1 - 1e-6)
    return float(10 * np.log10(height / (1 - height)))


def cepstral_prominence(x: np.ndarray, rate: float, low: float = 60.0, high: float = 333.0) -> float:
    """Height of the cepstrum's peak over its regression line, in dB."""
    level = 10 * np.log10(np.maximum(power_spectrum(x), 1e-12))
    cepstrum = 20 * np.log10(np.maximum(np.abs(np.fft.irfft(level)), 1e-12))
    q = np.arange(len(cepstrum)) / rate
    some = np.flatnonzero((q >= 1 / high) & (q <= 1 / low) & (np.arange(len(q)) < len(q) // 2))
    if len(some) < 3:
        return 0.0
    line = np.polyfit(q[some], cepstrum[some], 1)
    best = some[np.argmax(cepstrum[some])]
    return float(cepstrum[best] - np.polyval(line, q[best]))


def cepstral_prominences(x: np.ndarray, rate: float, low: float = 60.0, high: float = 333.0) -> np.ndarray:
    """The same of rows of one length."""
    n = x.shape[1]
    level = 10 * np.log10(np.maximum(np.abs(np.fft.rfft(x * np.hanning(n))) ** 2, 1e-12))
    cepstrum = 20 * np.log10(np.maximum(np.abs(np.fft.irfft(level)), 1e-12))
    q = np.arange(cepstrum.shape[1]) / rate
    some = np.flatnonzero((q >= 1 / high) & (q <= 1 / low) & (np.arange(len(q)) < len(q) // 2))
    if len(some) < 3 or not len(x):
        return np.zeros(len(x))
    part, at = cepstrum[:, some], q[some] - q[some].mean()
    over = part - part.mean(axis=1, keepdims=True) - (part @ at / (at @ at))[:, None] * at
    return np.take_along_axis(over, part.argmax(axis=1)[:, None], axis=1)[:, 0]


def warped(x: np.ndarray, factor: float) -> np.ndarray:
    """Envelope stretched along frequency by a factor: cubic interpolation between bins, the ends held."""
    at = np.clip(np.arange(len(x)) / factor, 0, len(x) - 1)
    i = np.clip(np.floor(at).astype(int), 0, max(len(x) - 2, 0))
    u = at - i
    y = lambda k: x[np.clip(i + k, 0, len(x) - 1)]
    a, b, c, d = y(-1), y(0), y(1), y(2)
    return b + 0.5 * u * (c - a + u * (2 * a - 5 * b + 4 * c - d + u * (3 * (b - c) + d - a)))


def decode_wav(data: bytes, start: float = 0.0, end: float | None = None, normalise: bool = True) -> tuple[np.ndarray, int] | None:
    """Mono samples from -1 to 1 between two times, and the rate, of PCM with 8, 16, 24 or 32 bits; None if it can't be read.

    Only the frames asked for are decoded. Quiet recordings (peak below 0.5) are
    raised to -3 dB if ``normalise``.
    """
    try:
        with wave.open(io.BytesIO(data)) as file:
            rate, width, channels, n = file.getframerate(), file.getsampwidth(), file.getnchannels(), file.getnframes()
            first = min(max(int(start * rate), 0), n)
            last = n if end is None else min(max(int(end * rate), first), n)
            file.setpos(first)
            raw = np.frombuffer(file.readframes(last - first), np.uint8)
    except (wave.Error, EOFError):
        return None
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = raw.astype(np.float64) - 128
    else:  # little-endian; the highest byte carries the sign
        parts = raw.reshape(-1, width).astype(np.int64)
        x = (parts << (8 * np.arange(width))).sum(axis=1).astype(np.float64)
        x[parts[:, -1] > 127] -= 2.0 ** (8 * width)
    x = x.reshape(-1, channels).mean(axis=1) / 2.0 ** (8 * width - 1)
    peak = np.abs(x).max(initial=0)
    return (x * (10 ** (-3 / 20) / peak) if normalise and 0 < peak < 0.5 else x), rate


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM of samples from -1 to 1; those beyond are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.clip(x * 32768, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def prepared(x: np.ndarray, rate: int, shortest: float = 0.5, quiet: float = 1e-4, fade: float = 0.005, peak_db: float = -3.0) -> np.ndarray | None:
    """A recording as it is saved: leading silence cut, a short fade in, peak at a level; None if shorter than ``shortest`` seconds."""
    if len(x) < rate * shortest:
        return None
    loud = np.flatnonzero(np.abs(x) > quiet)
    x = x[loud[0] :].copy() if len(loud) else x.copy()
    n = min(int(rate * fade), len(x))
    x[:n] *= np.linspace(0, 1, n)
    peak = np.abs(x).max(initial=0)
    return x * (10 ** (peak_db / 20) / peak) if peak > 0 else x


def gated(x: np.ndarray, rate: int, gate_db: float = -40.0, width: float = 0.02, shortest: float = 0.5, shortest_after: float = 0.3) -> np.ndarray | None:
    """A clip without the quiet at its ends: one window of padding beside the first and last that are above the gate."""
    if len(x) < rate * shortest:
        return None
    size = int(width * rate)
    hop = size // 2
    level = np.sqrt((frame(x[: len(x) - 1], size, hop) ** 2).mean(axis=1)) if len(x) > size else np.zeros(0)
    above = np.flatnonzero(level > 10 ** (gate_db / 20))
    if len(above):
        x = x[max(0, above[0] * hop - size) : min(len(x), (above[-1] + 1) * hop + size)]
    return x if len(x) >= rate * shortest_after else None


def decibels_of(x: np.ndarray) -> np.ndarray:
    """Level of the amplitude spectrum of Hamming-windowed rows."""
    return 20 * np.log10(np.abs(np.fft.rfft(x * np.hamming(x.shape[1]))) + 1e-10)


def highest(level: np.ndarray, f: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest level of each row between two frequencies of its own; nan where no bin lies there."""
    inside = (f >= low[:, None]) & (f <= high[:, None])
    return np.where(inside.any(axis=1), np.where(inside, level, -np.inf).max(axis=1), np.nan)


def resonance_gain(f: np.ndarray, centers: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Level in dB that each row's resonances add at a frequency of its own."""
    f, c, b = f[:, None], centers, widths
    with np.errstate(divide="ignore", invalid="ignore"):
        at = 10 * np.log10(np.maximum((c * c + b * b) ** 2 / ((f * f - c * c) ** 2 + (f * b) ** 2), 1e-10))
        low = 10 * np.log10(np.maximum((c * c + b * b) ** 2 / (b * b * c * c), 1e-10))
    return np.where((c > 0) & (b > 0), at - low, 0.0).sum(axis=1)


def harmonic_levels(x: np.ndarray, rate: float, f0: np.ndarray, formants: np.ndarray, widths: np.ndarray) -> dict[str, np.ndarray]:
    """Of rows of one length: first harmonic over the second and over the third formant's region, as they are and without the resonances.

    Peaks are the highest bins within half the pitch; nan where there is no pitch.
    """
    level, f = decibels_of(x), np.fft.rfftfreq(x.shape[1], 1 / rate)
    f0 = np.where(f0 > 0, f0, np.nan)
    f3 = np.where(formants[:, 2] > 0, formants[:, 2], np.nan)
    h1, h2, a3 = (highest(level, f, c - f0 / 2, c + f0 / 2) for c in (f0, 2 * f0, f3))
    gain = lambda c: resonance_gain(c, formants[:, :3], widths)
    return {"h1_h2": h1 - h2, "h1_h2_corrected": h1 - gain(f0) - (h2 - gain(2 * f0)), "h1_a3": h1 - a3, "h1_a3_corrected": h1 - gain(f0) - (a3 - gain(f3))}


def live_levels(x: np.ndarray, rate: float, f0: np.ndarray, formants: np.ndarray, widths: np.ndarray) -> dict[str, np.ndarray]:
    """The same as a live display has them: peaks within a tenth of each harmonic, the harmonic nearest the third formant, and the tilt of the first ten.

    Pitch below 50 Hz, or a row without sound, gives nan; tilt needs three harmonics, else it is 0.
    """
    level, f = decibels_of(x), np.fft.rfftfreq(x.shape[1], 1 / rate)
    f0 = np.where((f0 >= 50) & (np.abs(x).max(axis=1) >= 1e-5), f0, np.nan)
    near = lambda c: highest(level, f, c * 0.9, c * 1.1)
    known = (formants[:, :3] > 0).all(axis=1) & (widths[:, 0] > 0)
    gain = lambda c: np.where(known, resonance_gain(c, formants[:, :3], widths), 0.0)
    third = np.round(formants[:, 2] / f0) * f0
    h1, h2 = near(f0), near(2 * f0)
    h1_a3 = np.where(known & (third > 0), h1 - gain(f0) - (near(third) - gain(third)), 0.0)
    octave = np.log2(np.outer(f0, np.arange(1, 11)))
    peaks = np.stack([np.where(k * f0 <= rate / 2, near(k * f0), np.nan) for k in range(1, 11)], axis=1)
    some = ~np.isnan(peaks)
    n = some.sum(axis=1)
    mean = lambda v: np.where(some, v, 0).sum(axis=1) / np.maximum(n, 1)
    dx, dy = octave - mean(octave)[:, None], peaks - mean(peaks)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(some, dx * dy, 0).sum(axis=1) / np.where(some, dx * dx, 0).sum(axis=1)
    there = ~np.isnan(h1 - h2)
    return {
        "live_h1_h2": h1 - h2, "live_h1_h2_corrected": h1 - gain(f0) - (h2 - gain(2 * f0)),
        "live_h1_a3": np.where(there & ~np.isnan(h1_a3), h1_a3, np.where(there, 0.0, np.nan)), "live_tilt": np.where(there, np.where(n >= 3, slope, 0.0), np.nan),
    }


def formant_amplitudes(x: np.ndarray, rate: float, formants: np.ndarray) -> dict[str, np.ndarray]:
    """Energy in dB around each formant (5 % or 50 Hz to either side), and how far the first stands above the way to the second.

    Rows without the first two formants have nan; so has a later formant that isn't there.
    """
    power, f = np.abs(np.fft.rfft(x * np.hamming(x.shape[1]))) ** 2, np.fft.rfftfreq(x.shape[1], 1 / rate)
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(power, axis=1)], axis=1) * (rate / x.shape[1]) / rate**2
    ok = (formants[:, 0] > 0) & (formants[:, 1] > 0)

    def around(c):
        wide = np.maximum(50.0, c * 0.05)
        a, b = np.searchsorted(f, c - wide), np.searchsorted(f, c + wide, "right")
        row = np.arange(len(x))
        return np.where(ok & (c > 0), 10 * np.log10(np.maximum(total[row, b] - total[row, a], 1e-20)), np.nan)

    f1, f2 = formants[:, 0], formants[:, 1]
    out = {f"a{i + 1}": around(formants[:, i]) for i in range(4)}
    probes = np.stack([out["a1"], *(around(f1 + (f2 - f1) / 2 * k / 5) for k in range(1, 6))])
    return out | {"prominence": out["a1"] - probes.min(axis=0)}


#: Waveforms that one numpy step of :func:`levels` holds.
ROWS = 1024


def levels(rows: DataFrame, rate: float, quiet: float = 0.0, sound: Callable[[pd.DataFrame], np.ndarray] | None = None) -> DataFrame:
    """All columns of ``rows`` but ``x``, and the levels of each waveform: see :func:`harmonic_levels`, :func:`live_levels`, :func:`formant_amplitudes`.

    ``x`` is an array of doubles; pitch ``f0``, formants ``f1`` to ``f4`` and
    widths ``bw1`` to ``bw3`` are columns. Rows of one length are one matrix. A
    missing, empty or non-finite waveform has nulls; rows whose samples all stay
    below ``quiet`` are left out, if it is above 0. With ``sound``, rows have no
    ``x``: it gives that of some of them, a row each, where it is measured.
    """
    names = ["h1_h2", "h1_h2_corrected", "h1_a3", "h1_a3_corrected", "live_h1_h2", "live_h1_h2_corrected", "live_h1_a3", "live_tilt", "a1", "a2", "a3", "a4", "prominence", "intensity"]
    kept = [f for f in rows.schema.fields if f.name != "x" and f.name not in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + ROWS] for whole in batches for i in range(0, len(whole), ROWS)):
            if sound:
                batch = batch.assign(x=list(sound(batch)))
            if quiet > 0:
                batch = batch[[x is None or np.abs(x).max(initial=0) >= quiet for x in batch["x"]]]
            out = pd.DataFrame(np.nan, index=batch.index, columns=names)
            lengths = batch["x"].map(lambda v: 0 if v is None else len(v)).to_numpy()
            for n in np.unique(lengths[lengths > 1]):
                at = np.flatnonzero(lengths == n)
                x = np.stack(batch["x"].to_numpy()[at])
                fine = np.isfinite(x).all(axis=1)
                at, x = at[fine], x[fine]
                if not len(at):
                    continue
                part = batch.iloc[at]
                f0, formants, widths = part["f0"].to_numpy(float), part[["f1", "f2", "f3", "f4"]].to_numpy(float), part[["bw1", "bw2", "bw3"]].to_numpy(float)
                found = harmonic_levels(x, rate, f0, formants, widths) | live_levels(x, rate, f0, formants, widths) | formant_amplitudes(x, rate, formants)
                found["intensity"] = 10 * np.log10(np.maximum((x * x).mean(axis=1), 1e-20) / 4e-10)
                for name in names:
                    out.iloc[at, out.columns.get_loc(name)] = found[name]
            yield pd.concat([batch[[f.name for f in kept]], out], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names)])
    made = rows.drop(*names).mapInPandas(run, schema)
    return made.select(*(f.name for f in kept), *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))


def sibilant_centroid(x: np.ndarray, rate: float, size: int, hop: int, split: float = 3000.0, ratio: float = 0.6, at_least: int = 3) -> float:
    """Mean centroid above ``split`` of the frames that have most of their energy there; 0 if fewer than ``at_least``."""
    power, f = power_frames(x, size, hop), np.fft.rfftfreq(size, 1 / rate)
    high, low = f >= split, (f >= 100) & (f < split)
    up, down = power[:, high].sum(axis=1), power[:, low].sum(axis=1)
    some = np.sqrt(power[up / (up + down + 1e-10) > ratio][:, high])
    total = some.sum(axis=1)
    if len(some) < at_least or not (total > 0).any():
        return 0.0
    return float(((some * f[high]).sum(axis=1)[total > 0] / total[total > 0]).mean())


#: What makes a consonant "sheismo" or "yeismo" (centroid in Hz, share of energy from 2.5 kHz), how sure that
#: is for a share, and the shortest consonant in seconds. The first line that holds counts.
CONSONANTS = {
    "sheismo": (lambda hz, share: ((hz > 4000) & (share > 0.25)) | ((share > 0.4) & (hz > 2500)), lambda share: 1.5 * share),
    "yeismo": (lambda hz, share: (share < 0.2) | (hz < 1500), lambda share: 1.2 * (1 - share)),
    "intermediate": (lambda hz, share: np.full(len(hz), True), lambda share: np.full(len(share), 0.5)),
}
SHORTEST_CONSONANT = 0.03


def consonants(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Of rows of one length: consonant (a glide, a fricative, between them, or unknown if too short), how sure, centroid in Hz, share of energy from 2.5 kHz."""
    if x.shape[1] / rate < SHORTEST_CONSONANT:
        none = np.zeros(len(x))
        return {"consonant": np.full(len(x), "unknown"), "consonant_confidence": none, "centroid_hz": none, "high_share": none}
    size = min(2048, x.shape[1])
    power = np.stack([power_frames(row, size, size // 4) for row in x])
    f = np.fft.rfftfreq(size, 1 / rate)
    energy = power.sum(axis=1)
    high, low = energy[:, f >= 2500].sum(axis=1), energy[:, (f >= 100) & (f < 2500)].sum(axis=1)
    share = high / (high + low + 1e-10)
    amplitude = np.sqrt(power)
    weight = amplitude.sum(axis=2)
    hz = np.divide(amplitude @ f, weight, out=np.zeros_like(weight), where=weight > 0).mean(axis=1)
    holds = [rule(hz, share) for rule, _ in CONSONANTS.values()]
    sure = np.select(holds, [np.minimum(1.0, of(share)) for _, of in CONSONANTS.values()])
    return {"consonant": np.select(holds, list(CONSONANTS), ""), "consonant_confidence": sure.round(3), "centroid_hz": hz.round(1), "high_share": share.round(3)}


def speech_rate(x: np.ndarray, rate: float, size: int, hop: int, shortest: float = 0.5) -> float:
    """Onsets a second: peaks of the rise in log power; 0 for less than half a second or two onsets."""
    if len(x) / rate < shortest:
        return 0.0
    level = 10 * np.log10(np.maximum(power_frames(x, size, hop), 1e-10))
    level = np.maximum(level, level.max(initial=-100) - 80)
    rise = np.concatenate([[0.0], np.maximum(np.diff(level, axis=0), 0).mean(axis=1)])
    if rise.max() <= 0:
        return 0.0
    rise = rise / rise.max()
    padded = np.pad(rise, 3, constant_values=-1.0)
    top = rise >= np.lib.stride_tricks.sliding_window_view(padded, 7).max(axis=1)
    around = np.convolve(np.pad(rise, 5, mode="edge"), np.ones(11) / 11, "valid")
    onsets, last = 0, -10
    for i in np.flatnonzero(top & (rise >= around + 0.07)).tolist():
        if i - last > 3:
            onsets, last = onsets + 1, i
    return onsets / (len(x) / rate) if onsets >= 2 else 0.0


#: Where the first resonance is looked for, how far the valley behind it may lie (Hz), and the least peak (dB).
FIRST, VALLEY, LEAST_PEAK = (200, 800), 1500, -30


def first_prominence(level: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of rows of envelopes in dB: the highest peak in ``FIRST`` over the least value from there to ``VALLEY``; 0 without one."""
    peak = np.zeros(level.shape, bool)
    peak[:, 1:-1] = (level[:, 1:-1] > level[:, :-2]) & (level[:, 1:-1] > level[:, 2:]) & (level[:, 1:-1] >= LEAST_PEAK)
    inside = np.flatnonzero((f >= FIRST[0]) & (f <= FIRST[1]))
    peak[:, np.setdiff1d(np.arange(len(f)), inside[1:-1])] = False
    top = np.where(peak, level, -np.inf).argmax(axis=1)
    behind = (f > f[top][:, None]) & (f <= VALLEY)
    found = peak.any(axis=1) & behind.any(axis=1)
    height = level[np.arange(len(level)), top] - np.where(behind, level, np.inf).min(axis=1)
    return np.where(found, height, 0.0).round(2)


def middle_envelopes(x: np.ndarray, rate: float, order: int = 14, bins: int = 1025, seconds: float = 1.5) -> np.ndarray:
    """Of rows of one length: the predictor's spectrum of the middle ``seconds``, in dB below its peak, at ``bins`` frequencies below half the rate."""
    n = min(x.shape[1], int(seconds * rate))
    start = (x.shape[1] - n) // 2
    y = x[:, start : start + n]
    y = np.concatenate([y[:, :1], y[:, 1:] - 0.97 * y[:, :-1]], axis=1)
    level = np.stack([-20 * np.log10(np.maximum(np.abs(np.fft.rfft(predictor(row, order), 2 * bins))[:bins], 1e-20)) for row in y])
    return level - level.max(axis=1, keepdims=True)


def pulses(x: np.ndarray, rate: float, f0: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and heights of one maximum in each period, from the highest on to both sides."""
    if f0 <= 0 or len(x) < 3:
        return np.zeros(0), np.zeros(0)
    period = rate / f0
    start = int(np.argmax(x))
    found = [start]
    for sign in (1, -1):
        at = start
        while True:
            a, b = sorted((at + sign * 0.8 * period, at + sign * 1.25 * period))
            a, b = int(np.ceil(a)), int(np.floor(b))
            if a < 1 or b > len(x) - 2 or a > b:
                break
            at = a + int(np.argmax(x[a : b + 1]))
            found.append(at)
    at = np.array(sorted(i for i in found if 0 < i < len(x) - 1))
    if not len(at):
        return np.zeros(0), np.zeros(0)
    a, b, c = x[at - 1], x[at], x[at + 1]
    bend = a - 2 * b + c
    shift = np.where(bend < 0, 0.5 * (a - c) / np.where(bend < 0, bend, 1), 0.0)
    return (at + shift) / rate, b - 0.25 * (a - c) * shift


def perturbation(x: np.ndarray, rate: float, f0: float) -> tuple[float, float]:
    """Jitter and shimmer (local): mean step between successive periods, and heights, over their mean, in per cent.

    Periods count from 0.1 to 20 ms; steps count between periods of a ratio up
    to 1.3 and heights up to 1.6.
    """
    t, height = pulses(x, rate, f0)
    period = np.diff(t)
    fine = (period >= 1e-4) & (period <= 0.02)

    def local(v, ok, most):
        ok = ok & (np.maximum(v[1:], v[:-1]) <= most * np.minimum(v[1:], v[:-1]))
        mean = v.mean() if len(v) else 0.0
        return float(np.abs(np.diff(v))[ok].mean() / mean * 100) if ok.any() and mean > 0 else 0.0

    return local(period, fine[1:] & fine[:-1], 1.3), local(height, (height[1:] > 0) & (height[:-1] > 0), 1.6)


def middle_formants(x: np.ndarray, rate: float, order: int, shortest: float = 0.03) -> list[float | None]:
    """First three resonances around the middle of a vowel, 25 ms or a quarter to either side; None if it is shorter or lacks one."""
    half = int(min(0.025, len(x) / rate / 4) * rate)
    part = x[len(x) // 2 - half : len(x) // 2 + half]
    if len(x) / rate < shortest or len(part) <= 2 * order:
        return [None] * 3
    found = [f for f, _ in resonances(part * np.hamming(len(part)), rate, order)][:3]
    return found if len(found) == 3 else [None] * 3


def voices_of(signals: list[np.ndarray], rate: float) -> list[tuple[float, float]]:
    """Of each recording: mean pitch of its voiced frames, on the best path over all of it, and their mean harmonics-to-noise ratio; 0 without voice."""
    how, out = Pitch(), []
    for f0, strength in best_pitches(signals, rate, how):
        voiced = f0 > 0
        if not voiced.any():
            out.append((0.0, 0.0))
            continue
        height = np.clip(strength[voiced] + how.octave * np.log2(how.low / f0[voiced]), 1e-6, 1 - 1e-6)
        out.append((float(f0[voiced].mean()), float((10 * np.log10(height / (1 - height))).mean())))
    return out


def voice_of(x: np.ndarray, rate: float) -> tuple[float, float]:
    """The same of one recording."""
    return voices_of([x], rate)[0]


def mean_prominence(x: np.ndarray, rate: float, size: int = 2048) -> float:
    """Cepstral prominence, the mean over frames of the whole recording; one frame if it is shorter than two."""
    frames = frame(x, size, size // 2) if len(x) > size else x[None]
    return sum(float(cepstral_prominences(frames[i : i + 256], rate).sum()) for i in range(0, len(frames), 256)) / len(frames)


def recording_measures(rows: DataFrame, rate: float, order: int = 10, size: int = 512) -> DataFrame:
    """The keys of ``rows`` and measures of each recording ``x``: level, tilt, sibilants, consonant class, rate of speech, voice and resonances.

    All of a recording counts, but for the envelope, which is that of its middle
    1.5 seconds (:func:`middle_envelopes`), and the resonances around its middle.
    Recordings without sound (the highest sample below 1e-5), empty or not finite
    ones have nulls. Recordings of one length are one matrix.
    """
    keys = [f for f in rows.schema.fields if f.name != "x"]
    f = np.fft.rfftfreq(size, 1 / rate)
    some = (f >= 100) & (f <= 5000)

    def matrix(x: np.ndarray, voice: np.ndarray) -> dict:
        power = np.stack([power_frames(row, size, size // 4).mean(axis=0) for row in x])
        kind = consonants(x, rate)
        rough = np.array([perturbation(row, rate, f0) for row, f0 in zip(x, voice[:, 0], strict=True)])
        middle = [middle_formants(row, rate, order) for row in x]
        envelopes = middle_envelopes(x, rate)
        return {
            "rms_db": 20 * np.log10(np.maximum(np.sqrt((x * x).mean(axis=1)), 1e-10)),
            "tilt_db": np.polyfit(np.log2(f[some]), 10 * np.log10(power[:, some] + 1e-10).T, 1)[0],
            "s_centroid_hz": [sibilant_centroid(row, rate, size, size // 4) for row in x],
            "consonant": kind["consonant"], "consonant_confidence": kind["consonant_confidence"], "high_share": kind["high_share"],
            "syllables_per_s": [speech_rate(row, rate, size, size // 4) for row in x],
            "f0_hz": voice[:, 0], "hnr_db": voice[:, 1], "jitter": rough[:, 0], "shimmer": rough[:, 1],
            "cpp_db": [mean_prominence(row, rate) for row in x],
            "f1_prominence_db": first_prominence(envelopes, np.arange(envelopes.shape[1]) * rate / 2 / envelopes.shape[1]),
        } | {f"f{i + 1}_mid": [m[i] for m in middle] for i in range(3)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["x"].map(lambda v: 0 if v is None else len(v)).to_numpy()
            sounds = [np.asarray(x, float) if n >= size else None for x, n in zip(batch["x"], lengths, strict=True)]
            loud = np.array([x is not None and bool(np.isfinite(x).all()) and bool(np.abs(x).max() >= 1e-5) for x in sounds])
            voice = np.zeros((len(batch), 2))
            if loud.any():
                voice[loud] = voices_of([sounds[i] for i in np.flatnonzero(loud)], rate)
            for n in np.unique(lengths).tolist():
                alike = np.flatnonzero(lengths == n)
                for i in range(0, len(alike), max(1, (1 << 20) // max(n, 1))):
                    part = batch.iloc[alike[i : i + max(1, (1 << 20) // max(n, 1))]]
                    found = pd.DataFrame(None, index=part.index, columns=list(RECORDED), dtype=object)
                    at = alike[i : i + len(part)]
                    at = at[loud[at]]
                    if len(at):
                        found.loc[batch.index[at]] = pd.DataFrame(matrix(np.stack([sounds[j] for j in at]), voice[at]), index=batch.index[at])[list(RECORDED)].astype(object)
                    found = found.astype({c: float for c, kind in RECORDED.items() if kind == "double"})
                    yield pd.concat([part[[f.name for f in keys]], found], axis=1)

    made = rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), *(f"{n} {t}" for n, t in RECORDED.items())]))
    return made.select(*(f.name for f in keys), *(F.when(~F.isnan(n), F.col(n)).alias(n) if t == "double" else n for n, t in RECORDED.items()))


def lpc_envelopes(rows: DataFrame, rate: float) -> DataFrame:
    """The keys of ``rows`` and ``envelope_db`` of each recording ``x``, see :func:`middle_envelopes`; null for a missing, empty or non-finite one."""
    keys = [f for f in rows.schema.fields if f.name != "x"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [None if x is None or not len(x) or not np.isfinite(x).all() else middle_envelopes(np.asarray(x, float)[None], rate)[0] for x in batch["x"]]
            yield batch[[f.name for f in keys]].assign(envelope_db=found)

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "envelope_db array<double>"]))


RECORDED = dict.fromkeys("rms_db tilt_db s_centroid_hz".split(), "double") | {"consonant": "string"} | dict.fromkeys(
    "consonant_confidence high_share syllables_per_s f0_hz hnr_db jitter shimmer cpp_db f1_prominence_db f1_mid f2_mid f3_mid".split(), "double"
)


def measures(rows: DataFrame, rate: float, order: int = 8) -> DataFrame:
    """id, centroid_hz, tilt_db, f0_hz, hnr_db, cpp_db, f1_hz, lpc_peak_db for each series ``x``; null or short series have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, x in zip(batch["id"], batch["x"], strict=True):
                x = None if x is None else np.asarray(x, float)
                if x is None or len(x) < 4 * order or not np.isfinite(x).all():
                    out.append((i, *[None] * 7))
                    continue
                f0, height = pitch(x, rate)
                poles = resonances(x, rate, order)
                out.append((i, centroid(x, rate), tilt(x, rate, 100, rate / 2), f0, harmonicity(height), cepstral_prominence(x, rate), poles[0][0] if poles else None, float(envelope(x, order, 64).max())))
            yield pd.DataFrame(out, columns=NAMES)

    return rows.select("id", "x").mapInPandas(run, "id bigint, centroid_hz double, tilt_db double, f0_hz double, hnr_db double, cpp_db double, f1_hz double, lpc_peak_db double")


NAMES = ["id", "centroid_hz", "tilt_db", "f0_hz", "hnr_db", "cpp_db", "f1_hz", "lpc_peak_db"]
