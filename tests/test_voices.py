"""Levels of waveforms against plain loops; recordings and alignments as files."""

import cmath
import json
import math

import numpy as np
import pytest

from sonoframe.functions import signals as S
from sonoframe.operators import folds
from sonoframe.operators import joins as J
from sonoframe.plans import registry, series
from sonoframe.sources import recordings as R
from sonoframe.sources.bindings import RATE, voices

SF = "/root/testdata/sf0.001"


def transform(x):
    """Amplitudes of the discrete Fourier transform, one by one."""
    n = len(x)
    window = [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    return [abs(sum(v * w * cmath.exp(-2j * math.pi * k * i / n) for i, (v, w) in enumerate(zip(x, window, strict=True)))) for k in range(n // 2 + 1)]


def gain(f, row):
    total = 0.0
    for i in (1, 2, 3):
        c, b = row[f"f{i}"], row[f"bw{i}"]
        if c > 0 and b > 0:
            num = (c * c + b * b) ** 2
            total += 10 * math.log10(max(num / ((f * f - c * c) ** 2 + f * f * b * b), 1e-10)) - 10 * math.log10(max(num / (b * b * c * c), 1e-10))
    return total


def plain_levels(row):
    amplitude = transform(row["x"])
    step = RATE / len(row["x"])
    db = [20 * math.log10(a + 1e-10) for a in amplitude]
    peak = lambda lo, hi: max((v for k, v in enumerate(db) if lo <= k * step <= hi), default=None)
    out = {}
    f0, f3 = row["f0"], row["f3"]
    if f0 > 0:
        h1, h2, a3 = peak(f0 / 2, 1.5 * f0), peak(1.5 * f0, 2.5 * f0), peak(f3 - f0 / 2, f3 + f0 / 2)
        out |= {"h1_h2": h1 - h2, "h1_h2_corrected": h1 - gain(f0, row) - h2 + gain(2 * f0, row), "h1_a3": h1 - a3, "h1_a3_corrected": h1 - gain(f0, row) - a3 + gain(f3, row)}
        h1, h2 = peak(0.9 * f0, 1.1 * f0), peak(1.8 * f0, 2.2 * f0)
        out["live_h1_h2"] = h1 - h2
        xs, ys = zip(*((math.log2(k * f0), peak(0.9 * k * f0, 1.1 * k * f0)) for k in range(1, 11) if k * f0 <= RATE / 2), strict=True)
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        out["live_tilt"] = sum((a - mx) * (b - my) for a, b in zip(xs, ys, strict=True)) / sum((a - mx) ** 2 for a in xs)
    if row["f1"] > 0 and row["f2"] > 0:
        def around(c):
            wide = max(50, c * 0.05)
            return 10 * math.log10(max(sum((a / RATE) ** 2 * step for k, a in enumerate(amplitude) if c - wide <= k * step <= c + wide), 1e-20))

        out |= {f"a{i}": around(row[f"f{i}"]) for i in (1, 2, 3, 4) if row[f"f{i}"] > 0}
        out["prominence"] = out["a1"] - min([out["a1"], *(around(row["f1"] + (row["f2"] - row["f1"]) / 2 * k / 5) for k in range(1, 6))])
    return out


def test_levels(spark):
    rows = voices(spark, SF).orderBy("seq").limit(12)
    plain = {r["seq"]: plain_levels(r) for r in rows.collect()}
    got = {r["seq"]: r for r in S.levels(rows, RATE).collect()}
    assert got.keys() == plain.keys()
    for seq, want in plain.items():
        for name in ("h1_h2", "h1_h2_corrected", "h1_a3", "h1_a3_corrected", "live_h1_h2", "live_tilt", "a1", "a2", "a3", "a4", "prominence"):
            found = got[seq][name]
            assert (found is None) == (name not in want), (seq, name)
            assert found is None or found == pytest.approx(want[name], abs=1e-5), (seq, name)


def test_levels_edges(spark):
    ones = "1D AS f0, 1D AS f1, 1D AS f2, 1D AS f3, 1D AS f4, 1D AS bw1, 1D AS bw2, 1D AS bw3"
    rows = spark.createDataFrame([(1, None), (2, []), (3, [float("nan")] * 8), (4, [0.0] * 8), (5, [1.0, -1.0] * 4), (5, [1.0, -1.0] * 4)], "id bigint, x array<double>").selectExpr("*", *ones.split(", "))
    got = S.levels(rows, RATE).collect()
    assert len(got) == 6 and all(r["intensity"] is None for r in got if r["id"] < 4) and all(r["intensity"] is not None for r in got if r["id"] > 3)
    assert [r["id"] for r in S.levels(rows.where("id > 3"), RATE, 1e-5).collect()] == [5, 5] and S.levels(rows.limit(0), RATE).count() == 0


def test_recordings(spark):
    rows = registry.queries()["recording_measures"](spark, SF).collect()
    assert rows and all(r.consonant in ("sheismo", "yeismo", "intermediate") for r in rows if r.rms_db is not None)


def test_consonants_and_rate():
    rng, t = np.random.default_rng(1), np.arange(16_000) / 16_000
    hiss = np.diff(rng.standard_normal(16_001))  # energy rises with frequency
    both = S.consonants(np.stack([hiss, np.sin(2 * np.pi * 300 * t), 2 * np.sin(2 * np.pi * 300 * t) + 1.5 * np.sin(2 * np.pi * 3500 * t)]), 16_000)
    assert both["consonant"].tolist() == ["sheismo", "yeismo", "intermediate"] and both["consonant_confidence"][2] == 0.5
    share = (np.abs(np.fft.rfft(hiss)) ** 2)[2500:].sum() / (np.abs(np.fft.rfft(hiss)) ** 2)[100:].sum()
    assert both["high_share"][0] == pytest.approx(share, abs=0.02) and both["consonant_confidence"][0] == 1.0 and both["centroid_hz"][1] < 600
    assert {k: v.tolist() for k, v in S.consonants(hiss[None, :100], 16_000).items()} == {"consonant": ["unknown"], "consonant_confidence": [0.0], "centroid_hz": [0.0], "high_share": [0.0]}
    assert S.sibilant_centroid(hiss, 16_000, 512, 128) > 4500 and S.sibilant_centroid(np.sin(2 * np.pi * 300 * t), 16_000, 512, 128) == 0
    beats = np.sin(2 * np.pi * 220 * t) * np.exp(-5 * (2.5 * t % 1))  # sharp beginnings, slow ends
    assert S.speech_rate(np.tile(beats[:12_800], 4), 16_000, 512, 128) == pytest.approx(2.5, abs=0.5) and S.speech_rate(beats[:4000], 16_000, 512, 128) == 0


def test_perturbation():
    rate, times, heights = 16_000, [], []
    rng, at = np.random.default_rng(2), 0.005
    while at < 0.5:
        times.append(at)
        heights.append(1 + 0.05 * rng.standard_normal())
        at += 0.005 * (1 + 0.02 * rng.standard_normal())
    t = np.arange(int(0.5 * rate)) / rate
    x = sum(h * np.exp(-(((t - p) / 0.0004) ** 2)) for p, h in zip(times, heights, strict=True))
    period = np.diff(times)
    jitter, shimmer = S.perturbation(x, rate, 200)
    assert jitter == pytest.approx(np.abs(np.diff(period)).mean() / period.mean() * 100, rel=0.15)
    assert shimmer == pytest.approx(np.abs(np.diff(heights)).mean() / np.mean(heights) * 100, rel=0.15)
    assert S.perturbation(np.zeros(100), rate, 0) == (0.0, 0.0)


def test_prominence_and_power():
    f = np.arange(0, 4000, 20.0)
    envelope = -0.01 * np.abs(f - 500) + 10 * np.exp(-(((f - 1400) / 200) ** 2))
    top = envelope[(f >= 200) & (f <= 800)].max()
    both = S.first_prominence(np.stack([envelope, -40 + 0 * f, 0.01 * f]), f)
    assert both.tolist() == [pytest.approx(top - envelope[(f > 500) & (f <= 1500)].min(), abs=0.01), 0.0, 0.0]
    x = np.random.default_rng(0).standard_normal(1000)
    power = S.power_frames(x, 64, 16)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    assert power.shape == (63, 33) and power[10] == pytest.approx(np.abs(np.fft.rfft(np.pad(x, 32)[160:224] * window)) ** 2)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_widths(spark, tmp_path, width):
    import io
    import wave

    values = np.array([0, 0.25, -0.25, 0.75, -1.0])
    whole = np.round(values * 2 ** (8 * width - 1)).astype(np.int64) + (128 if width == 1 else 0)
    raw = b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in np.clip(whole, None, 255 if width == 1 else None).tolist())
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setparams((1, width, 10, 0, "NONE", ""))
        file.writeframes(raw)
    x, rate = S.decode_wav(out.getvalue())
    assert rate == 10 and x == pytest.approx(values, abs=0.01)
    assert S.decode_wav(out.getvalue(), 0.1, 0.3)[0] == pytest.approx(values[1:3] * (10 ** (-3 / 20) / 0.25), abs=0.02)
    assert S.decode_wav(out.getvalue(), 0.1, 0.3, False)[0] == pytest.approx(values[1:3], abs=0.01) and S.decode_wav(b"RIFF") is None


def test_saved_recordings(spark, tmp_path):
    rate = 1000
    x = np.concatenate([np.zeros(100), 0.2 * np.sin(np.arange(900) / 3)])
    rows = spark.createDataFrame([("a", rate, x.tolist()), ("short", rate, x[:300].tolist()), ("none", rate, None)], "name string, rate int, x array<double>")
    R.write_wav(rows, str(tmp_path / "out"), "name")
    (tmp_path / "out" / "bad.wav").write_bytes(b"no sound")
    got = {r.path.rsplit("/", 1)[1]: r for r in R.read_wav(spark, str(tmp_path / "out"), normalise=False).collect()}
    assert set(got) == {"a.wav", "bad.wav"} and got["bad.wav"].x is None
    y = np.array(got["a.wav"].x)
    assert len(y) in (899, 900) and np.abs(y).max() == pytest.approx(10 ** (-3 / 20), abs=1e-3) and abs(y[0]) < 1e-3
    clip = S.gated(np.concatenate([np.zeros(300), x[100:], np.zeros(300)]), rate)
    assert 900 <= len(clip) <= 960 and S.gated(x[:300], rate) is None
    assert R.read_wav(spark, str(tmp_path / "out"), rate=500).where("path LIKE '%a.wav'").first().rate == 500


def test_both_forms_of_alignments():
    long = """File type = "ooTextFile"
    xmin = 0\nxmax = 1\ntiers? <exists>\nsize = 2\nitem []:\n item [1]:\n class = "IntervalTier"\n name = "words"\n xmin = 0\n xmax = 1\n intervals: size = 2
    intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "a ""b"" 7"\n intervals [2]:\n xmin = 0.5\n xmax = 1\n text = ""
    item [2]:\n class = "TextTier"\n name = "points"\n xmin = 0\n xmax = 1\n points: size = 1\n points [1]:\n number = 0.3\n mark = "x"
    item [3]:\n class = "IntervalTier"\n name = "phones"\n xmin = 0\n xmax = 1\n intervals: size = 1\n intervals [1]:\n xmin = 0\n xmax = 1e0\n text = "sil\""""
    short = '"ooTextFile" 0 1 <exists> 3 "IntervalTier" "words" 0 1 2 0 0.5 "a ""b"" 7" 0.5 1 "" "TextTier" "points" 0 1 1 0.3 "x" "IntervalTier" "phones" 0 1 1 0 1 "sil"'
    want = [("words", 'a "b" 7', 0.0, 0.5), ("words", "", 0.5, 1.0), ("phones", "sil", 0.0, 1.0)]
    assert list(R.intervals(long)) == want and list(R.intervals(short)) == want and list(R.intervals("no tiers 3")) == []


def test_results_and_segments(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.7), (2, 1, 0.1)], "recording bigint, segment_id int, composite double")
    R.write_segments(rows, ["recording"], str(tmp_path / "s"))
    found = {r.recording: r for r in R.read_results(spark, str(tmp_path / "s"), lines=True).collect()}
    assert [x.segment_id for x in found[1].segments] == [1, 2] and found[2].n_segments == 1
    (tmp_path / "one.json").write_text(json.dumps({"pitch": {"mean": 1.5, "ok": True, "extra": {"x": 1}}, "n": 3}, indent=1))
    leaves = R.numeric_leaves(R.read_results(spark, str(tmp_path / "one.json")), [])
    assert {(r.path, r.value) for r in leaves.collect()} == {("pitch.mean", 1.5), ("n", 3.0)}
    first = R.once_written(rows, str(tmp_path / "kept"))
    assert R.once_written(rows.limit(0), str(tmp_path / "kept")).count() == first.count() == 3


def test_once_only_rules(spark):
    t = np.array([0.0, 3.0, 10.0, 12.0, 25.0])
    assert folds.let_through(t, None, 10.0, np.array([True, False, True, False, True]))[0] == [0, 3]
    assert folds.let_through(t, 5.0, 10.0, np.array([False] * 5))[0] == [4] and folds.let_through(t[:0], None, 1.0)[0] == []
    base = {"session_id": 1, "f0": 200.0, "rms": -20.0, "f1": 500.0, "f4": 3500.0, "hnr": 20.0, "h1_h2": 0.0, "jitter": 0.5, "shimmer": 1.0}
    cases = [{}, {"f1": 801.0, "hnr": 11.9}, {"f1": 800.0, "hnr": 11.9}, {"hnr": 6.9}, {"jitter": 2.6, "shimmer": 8.1}, {"f0": 310.0, "f1": 600.0}, {"f0": 450.0}, {"h1_h2": 8.1, "hnr": 15.9}, {"rms": -61.0, "hnr": 1.0}, {"hnr": None}]
    rows = spark.createDataFrame([base | {"seq": i, "t": float(i)} | c for i, c in enumerate(cases)], "session_id bigint, seq bigint, t double, f0 double, rms double, f1 double, f4 double, hnr double, h1_h2 double, jitter double, shimmer double")
    got = {(r.seq, r.type, r.level, r.once) for r in series.candidates(rows).collect()}
    assert got == {
        (1, "constriction", "warning", False), (3, "vocal_strain", "alert", False), (4, "vocal_strain", "warning", False),
        (5, "f0_interference", "info", True), (6, "f0_interference", "info", False), (7, "breathiness_masking", "coaching", False),
    }


def test_rows_without_a_neighbour_stay(spark):
    left = spark.createDataFrame([(1, 1, 0.0), (1, 2, 100.0), (2, 3, 5.0)], "s bigint, seq bigint, t double")
    right = spark.createDataFrame([(1, 9, 1.0), (1, 10, -1.0)], "s bigint, seq bigint, t double")
    assert {(r.seq, r.seq_right) for r in J.nearest_in_time(left, right, ["s"], 10.0, []).collect()} == {(1, 10), (2, None), (3, None)}
    assert {(r.seq, r.seq_right) for r in J.nearest_in_ring(left, right, ["s"], 0.0, 30).collect()} == {(1, 10), (2, 9), (3, None)}
