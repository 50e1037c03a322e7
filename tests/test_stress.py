"""Stress from sound and the level track against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import spanish as S
from sonoframe.operators import stress, tracks

RATE = 8000


def voice(f0, loud, n):
    """A hum whose pitch and loudness change from syllable to syllable, n samples each; pitch 0 is silence."""
    parts, turn = [], 0.0
    for f, a in zip(f0, loud, strict=True):
        phase = turn + 2 * np.pi * f * np.arange(n) / RATE
        parts.append(a * sum(np.sin(h * phase) / h for h in range(1, 6)) * (f > 0))
        turn = phase[-1]
    return np.concatenate(parts)


def plain_level(x):
    window, hop = int(0.064 * RATE), 80
    count = (len(x) - window) // hop + 1
    origin = (len(x) - window - (count - 1) * hop) // 2
    u = np.linspace(-1, 1, window)
    w = np.i0((2 * np.pi**2 + 0.5) * np.sqrt(np.maximum(0, 1 - u * u)))
    out = []
    for i in range(count):
        y = x[origin + i * hop : origin + i * hop + window]
        y = y - y.mean()
        power = (w * y * y).sum() / w.sum()
        out.append((i, (origin + i * hop + window / 2) / RATE, max(-300.0, 10 * math.log10(max(power, 1e-300) / 4e-10))))
    return out


def plain_stress(syllables, start, end, pitch, level, hop):
    """Scores of one word by a walk through its syllables; pitch and level are lists of (time, value)."""
    total, at, rows = sum(map(len, syllables)), 0, []
    for s in syllables:
        a, b = start + (end - start) * at / total, start + (end - start) * (at + len(s)) / total
        at += len(s)
        values = []
        for j in range(math.floor((b - a) / 0.005 + 1e-9) + 1):
            t = a + j * 0.005
            near = sorted((round(abs(t - x), 9), x, f) for x, f in pitch if round(abs(t - x), 9) < hop)
            if near and near[0][2] > 0 and near[0][0] <= hop / 2 + 1e-9:
                f, g = near[0][2], near[-1][2]
                values.append(f + (g - f) * near[0][0] / hop if g > 0 else f)
        heard = [v for x, v in level if a <= x <= b]
        rows.append((round(np.mean(values), 1) if values else 0.0, round(np.mean(heard), 1) if heard else 0.0))
    share = [[(x - min(c)) / (max(c) - min(c)) if max(c) > min(c) else 0.0 for x in c] for c in zip(*rows, strict=True)]
    score = [round(0.5 * a + 0.5 * b, 3) for a, b in zip(*share, strict=True)]
    first, second = sorted(score, reverse=True)[:2]
    return score.index(first), (first - second) / first if first > 0 else 0.0


@pytest.fixture(scope="module")
def said(spark):
    rng = np.random.default_rng(8)
    sound = [("a", voice([120, 180, 130, 120], [0.2, 0.6, 0.2, 0.1], 2400)), ("b", voice([0, 200, 0, 150, 110], [0.1, 0.3, 0.5, 0.5, 0.2], 1900)), ("c", 0.01 * rng.normal(size=9000)), ("d", np.zeros(300))]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in sound] + [("e", None)], "id string, x array<double>")
    words = [("a", "paloma", 0.1, 1.0), ("a", "teléfono", 0.0, 1.2), ("a", "sol", 0.0, 0.3), ("b", "camino", 0.2, 1.1), ("b", "mesa", 0.4, 0.41), ("b", "mesa", 0.4, 0.41), ("c", "árbol", 0.2, 0.9)]
    words += [("c", "casa", 0.5, 1e7), ("d", "libro", 0.0, 0.03), ("e", "perro", 0.0, 1.0), ("none", "gato", 0.0, 1.0), (None, "vaca", 0.0, 1.0), ("a", None, 0.0, 1.0), ("a", "noche", 1.0, 0.5), ("a", "tarde", None, 1.0), ("a", "", 0.0, 1.0)]
    return dict(sound), rows, spark.createDataFrame(words, "id string, word string, start double, end double")


def test_level_track(said):
    sound, rows, _ = said
    got = {}
    for r in tracks.intensity_track(rows, ["id"], RATE).orderBy("id", "frame").collect():
        got.setdefault(r.id, []).append((r.frame, r.t, r.level))
    assert set(got) == {"a", "b", "c"}  # the others are shorter than a frame
    for k, track in got.items():
        assert np.allclose(track, plain_level(sound[k]), atol=1e-6)


def test_long_recordings_are_cut(spark):
    x = voice([100, 140] * 4, [0.1, 0.5] * 4, 4000)
    got = tracks.intensity_track(spark.createDataFrame([(1, x.tolist())], "id int, x array<double>"), ["id"], RATE).orderBy("frame").collect()
    assert len(got) > tracks.CHUNK
    assert np.allclose([tuple(r)[1:] for r in got], plain_level(x - x.mean()), atol=1e-6)


def test_stress_equals_a_walk(spark, said):
    _, rows, words = said
    pitch, level = {}, {}
    for r in tracks.pitch_track(rows, ["id"], RATE).collect():
        pitch.setdefault(r.id, []).append((r.t, r.f0))
    for r in tracks.intensity_track(rows, ["id"], RATE).collect():
        level.setdefault(r.id, []).append((r.t, r.level))
    got = {(r.id, r.word): r for r in stress.spoken_stress(rows, words, ["id"], RATE).collect()}
    split = {r.word: r.s for r in words.select("word", S.syllabify("word").alias("s")).where("word != ''").collect()}
    want = {(r.id, r.word): r for r in words.collect() if r.word and r.start is not None and r.end >= r.start and len(split[r.word]) > 1}
    assert set(got) == set(want) and len(got) == 10
    for k, w in want.items():
        if w.end > 100:
            continue  # a walk of 5 ms would take days; checked below
        place, gap = plain_stress(split[w.word], w.start, w.end, pitch.get(w.id, []), level.get(w.id, []), 0.01)
        assert got[k].confidence == pytest.approx(gap, abs=2e-3), k
        assert got[k].detected_syllable == (got[k].expected_syllable if got[k].confidence < 0.15 else place), k
        assert got[k].correct == (got[k].detected_syllable == got[k].expected_syllable)
    assert got["a", "paloma"].detected_syllable == 1 and got["a", "paloma"].confidence > 0.3
    assert got["none", "gato"].confidence == got[None, "vaca"].confidence == 0.0
    assert got["c", "casa"].n_syllables == 2
    assert stress.spoken_stress(rows, words.limit(0), ["id"], RATE).count() == 0
    assert stress.spoken_stress(rows.where(F.lit(False)), words, ["id"], RATE).count() == 10
