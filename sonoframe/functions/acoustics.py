"""Column functions over formants, pitch and levels; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.functions.norms import ENGLISH

SPEED_OF_SOUND = 34_300.0
MAX_DISTANCE = 2.25


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def nearest_norm(f1: Column, f2: Column, norms: tuple = ENGLISH) -> Column:
    """Squared distance ``d`` to the norm whose mean formants are nearest, and its place ``ord``, the first of equally near ones.

    The few norms are unrolled into one expression, so there is no join.
    """
    near = lambda n: F.pow((f1 - n[1]) / 500.0, 2) + F.pow((f2 - n[3]) / 1000.0, 2)
    return F.least(*(F.struct(near(n).alias("d"), F.lit(i).alias("ord")) for i, n in enumerate(norms)))


def nearest_vowel(f1: Column, f2: Column, norms: tuple = ENGLISH, limit: float = MAX_DISTANCE) -> Column:
    """The vowel of the nearest norm; null beyond ``limit``."""
    best = nearest_norm(f1, f2, norms)
    return F.when(best["d"] <= limit, of_norm(best["ord"], norms, 0))


def of_norm(place: Column, norms: tuple, field: int) -> Column:
    """A field of the norm at a place: 0 for its vowel, 1 to 6 for mean and std of F1, F2, F3."""
    return F.element_at(F.array(*(F.lit(n[field]) for n in norms)), place + 1)


def vowel_gate(f0: Column, rms: Column, f1: Column, f2: Column, bw1: Column) -> Column:
    """Whether a frame is voiced and clear enough for its vowel to be classified."""
    return (f0 > 80) & (rms > -35) & (f1 > 200) & (f2 > 500) & (bw1 > 0) & (bw1 < 200)


def delta_f(*formants: Column) -> Column:
    """Formant dispersion: twice the slope of the formants over 1, 3, 5, 7, those above 0; 0 for less than three."""
    there = [F.when(f > 0, F.lit(1.0)).otherwise(0.0) for f in formants]
    n = sum(there[1:], there[0])
    total = lambda term: sum((t * term(2.0 * i + 1, f) for i, (t, f) in enumerate(zip(there, formants, strict=True))), F.lit(0.0))
    sx, sy = total(lambda x, f: F.lit(x)), total(lambda x, f: f)
    sxy, sxx = total(lambda x, f: x * f), total(lambda x, f: F.lit(x * x))
    return F.when(n >= 3, 2.0 * (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(0.0)


def vocal_tract_length(*formants: Column) -> Column:
    """Mean of (2n - 1) c / 4 F over the formants above 0, numbered anew; 0 for less than three; cm."""
    there = F.filter(F.array(*formants), lambda f: f > 0)
    each = F.transform(there, lambda f, i: (2.0 * i + 1.0) * SPEED_OF_SOUND / (4.0 * f))
    return F.when(F.size(there) >= 3, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(there)).otherwise(0.0)


def spacing(low: Column, high: Column) -> Column:
    return F.when((low != 0) & (high != 0), high - low).otherwise(0.0)


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std)


def formant_correction(f: Column, formants: list[Column], bandwidths: list[Column]) -> Column:
    """Level that the given formants add at frequency f, in dB."""

    def one(c: Column, b: Column) -> Column:
        num = F.pow(c * c + b * b, 2)
        at = F.pow(f * f - c * c, 2) + F.pow(f * b, 2)
        low = b * b * c * c
        return F.when((c > 0) & (b > 0), 10 * F.log10(F.greatest(num / at, F.lit(1e-10))) - 10 * F.log10(F.greatest(num / low, F.lit(1e-10)))).otherwise(0.0)

    return sum((one(c, b) for c, b in zip(formants, bandwidths, strict=True)), F.lit(0.0))


def pitch_interference(f0: Column, f1: Column) -> tuple[Column, Column]:
    """Whether pitch disturbs formants, and how much from 0 to 1."""
    ratio = F.when(f1 > 0, f0 / f1).otherwise(0.0)
    return ratio > 0.5, clamp((ratio - 0.3) / 0.4, 0, 1)


def fullness_residual(tilt: Column, delta: Column) -> Column:
    return F.when((delta > 0) & (tilt != 0), tilt - (-0.015 * delta + 11.0))


def amplitude_constriction(delta: Column, a1: Column, a4: Column, prominence: Column) -> Column:
    return (delta > 1200) & (a4 - a1 < -15) & (prominence > 25)


def gesture_bars(delta: Column, f1: Column, f2: Column) -> tuple[Column, Column, Column]:
    """Larynx, oral cavity and tongue from 0 to 100."""
    larynx = clamp((delta - 1029.0) / 178.0 * 50.0 + 50.0, 0, 100)
    cavity = F.when(delta > 0, clamp((f1 / delta - 0.35) / 0.30 * 100.0, 0, 100)).otherwise(50.0)
    return larynx, cavity, clamp((f2 - 1800.0) / 400.0 * 50.0 + 50.0, 0, 100)


def weight_factor(h1_h2: Column) -> Column:
    return clamp((h1_h2 + 10.0) / 20.0, 0, 1)


def stability_percent(cv: Column) -> Column:
    return F.when(cv.isNotNull(), clamp((1.0 - cv / 0.10) * 100.0, 0, 100))


def bark(f: Column) -> Column:
    return 13.0 * F.atan(0.00076 * f) + 3.5 * F.atan(F.pow(f / 7500.0, 2))


def decibels(rms: Column) -> Column:
    return 20.0 * F.log10(F.greatest(rms, F.lit(1e-10)))


def contact_quotient(h1: Column, h2: Column, h4: Column) -> Column:
    balance = (h2 + h4) / 2.0 - h1
    return clamp(0.45 + 0.15 * (2.0 / (1.0 + F.exp(-balance / 3.0)) - 1.0), 0.2, 0.8)


def level_zone(rms: Column) -> Column:
    return F.when(rms < -40, "too quiet").when(rms < -30, "quiet").when(rms <= -6, "good").otherwise("hot")


def gauge_percent(x: Column, low: float, high: float) -> Column:
    return clamp((x - low) / (high - low) * 100.0, 0, 100)


def score_badge(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 40, "mid").otherwise("low")


def zone_of(x: Column, zones: list[tuple[float, str]]) -> Column:
    """Name of the highest zone whose boundary is at most x; the first zone below all."""
    out = F.lit(zones[0][1])
    for boundary, name in zones[1:]:
        out = F.when(x >= boundary, name).otherwise(out)
    return out


def suppressed(composite: Column, warnings: Column, suppressing: Column) -> Column:
    """Why scores aren't shown, or null: low confidence, else the warnings that suppress them in order."""
    both = F.array_join(F.array_sort(F.array_intersect(warnings, suppressing)), ",")
    return F.when(composite < 0.5, "low_confidence").when(both != "", both)


def pitch_shifted(f0: Column, semitones: float) -> Column:
    """Contour moved by semitones where it is voiced."""
    return F.transform(f0, lambda x: F.when(x > 0, x * 2 ** (semitones / 12.0)).otherwise(x))


def pitch_moved(f0: Column, hertz: float) -> Column:
    """Contour moved by Hz where it is voiced, not below 50."""
    return F.transform(f0, lambda x: F.when(x > 0, F.greatest(F.lit(50.0), x + hertz)).otherwise(x))


def tilted(spectrum: Column, step_hz: float, tilt: float) -> Column:
    """Power of bins at multiples of ``step_hz`` with ``tilt`` dB an octave around 1 kHz; bin 0 as it is."""
    gain = lambda i: F.pow(F.lit(10.0), tilt * F.log2(i * step_hz / 1000.0) / 10.0)
    return F.transform(spectrum, lambda v, i: F.when(i == 0, v).otherwise(v * gain(i)))


def aperiodicity_shifted(ap: Column, step_hz: float, delta: float, center: float, width: float = 2000.0) -> Column:
    bell = lambda i: F.exp(-0.5 * F.pow((i * step_hz - center) / width, 2))
    return F.transform(ap, lambda v, i: clamp(v + delta * bell(i), 0, 1))


def peak_normalised(samples: Column, level_db: float = -3.0) -> Column:
    peak = F.array_max(F.transform(samples, F.abs))
    gain = 10 ** (level_db / 20)
    return F.when(peak > 0, F.transform(samples, lambda x: x * (gain / peak))).otherwise(samples)


def valley_depth(envelope: Column, low: Column, high: Column) -> Column:
    """How far the envelope dips between two of its places: mean of the ends less the least value, 0 at least."""
    part = F.slice(envelope, low + 1, F.greatest(high - low + 1, F.lit(0)))
    ends = (F.element_at(envelope, low + 1) + F.element_at(envelope, high + 1)) / 2.0
    return F.when((low >= 0) & (low < high), F.greatest(F.lit(0.0), ends - F.array_min(part))).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """Between two points (x, y)."""
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
