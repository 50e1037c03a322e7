"""Tracks held against plain dynamic programming, plain loops and whole recordings."""

import itertools
import math

import numpy as np
import pytest

from sonoframe.functions import signals as S
from sonoframe.functions import tracks as T
from sonoframe.operators import tracks as O

RATE = 8000
HOW = T.Pitch()


def sung(seconds, f0, rate=RATE, seed=0):
    """A gliding voice with silence and noise in it."""
    t = np.arange(int(seconds * rate)) / rate
    phase = 2 * np.pi * np.cumsum(f0 * (1 + 0.3 * np.sin(2 * np.pi * 0.7 * t))) / rate
    x = sum(np.sin(h * phase) / h for h in range(1, 9)) * (np.sin(2 * np.pi * 1.1 * t) > -0.6)
    return x + 0.03 * np.random.default_rng(seed).standard_normal(len(t))


def plain_path(f, s):
    """Viterbi in plain loops: one whole recording."""
    scale = 0.01 * RATE / HOW.hop(RATE)

    def cost(p, q):
        return scale * (HOW.jump * abs(math.log2(p / q)) if p > 0 and q > 0 else HOW.change if (p > 0) != (q > 0) else 0.0)

    score, back = list(s[0]), []
    for t in range(1, len(f)):
        before = [max(range(len(f[0])), key=lambda a: score[a] - cost(f[t - 1][a], q)) for q in f[t]]  # noqa: B023
        back.append(before)
        score = [score[a] - cost(f[t - 1][a], q) + s[t][b] for b, (a, q) in enumerate(zip(before, f[t], strict=True))]
    path = [max(range(len(score)), key=score.__getitem__)]
    for before in reversed(back):
        path.append(before[path[-1]])
    return path[::-1], max(score)


def test_candidates_of_plain_loops():
    x = sung(0.4, 170)
    f, s = T.pitch_candidates(x[None], RATE, np.array([np.abs(x).max()]), HOW)
    window, hop = HOW.window(RATE), HOW.hop(RATE)
    for i in (0, 7, 20):
        part = x[i * hop : i * hop + window] - x[i * hop : i * hop + window].mean()
        shade = np.array([0.5 - 0.5 * math.cos(2 * math.pi * (j + 0.5) / window) for j in range(window)])
        auto = lambda v, lag: sum(v[: len(v) - lag] * v[lag:])
        r = [auto(part * shade, k) / auto(part * shade, 0) / (auto(shade, k) / auto(shade, 0)) for k in range(163)]
        found = []
        for k in range(1, 162):
            if r[k] > r[k - 1] and r[k] >= r[k + 1] and r[k] > 0.225:
                shift = 0.5 * (r[k - 1] - r[k + 1]) / (r[k - 1] - 2 * r[k] + r[k + 1])
                hz = RATE / (k + shift)
                if 50 <= hz <= 550:
                    found.append((min(1.0, r[k] - 0.25 * (r[k - 1] - r[k + 1]) * shift) - 0.01 * math.log2(50 / hz), hz))
        found = sorted(found, reverse=True)[:14]
        assert f[0, i, 0] == 0 and f[0, i, 1 : len(found) + 1] == pytest.approx([hz for _, hz in found])
        assert s[0, i, 1 : len(found) + 1] == pytest.approx([v for v, _ in found]) and np.isinf(s[0, i, len(found) + 1 :]).all()
        assert s[0, i, 0] == pytest.approx(0.45 + max(0, 2 - np.abs(part).max() / np.abs(x).max() / (0.03 / 1.45)))


@pytest.mark.parametrize("cuts", [(), (20,), (1, 2, 3, 40), tuple(range(1, 60))])
def test_joined_parts_equal_one_pass(cuts):
    x = sung(1.2, 150)
    f, s = T.pitch_candidates(x[None], RATE, np.array([np.abs(x).max()]), HOW)
    want, best = plain_path(f[0].tolist(), s[0].tolist())
    bounds = [0, *(c for c in cuts if c < f.shape[1]), f.shape[1]]
    parts = [(f[:, a:b], s[:, a:b]) for a, b in itertools.pairwise(bounds)]
    whole = [T.through(p, q, RATE, HOW)[0] for p, q in parts]
    ends = T.joined([p[0, 0] for p, _ in parts], [p[0, -1] for p, _ in parts], whole, RATE, HOW)
    path = np.concatenate([T.between(p, q, np.array([a]), np.array([b]), RATE, HOW)[0] for (p, q), (a, b) in zip(parts, ends, strict=True)])
    got = sum(s[0, t, k] for t, k in enumerate(path)) - sum(T.step_cost(f[0, t, path[t]][None], f[0, t + 1, path[t + 1]][None], RATE, HOW)[0, 0] for t in range(len(path) - 1))
    assert got == pytest.approx(best) and f[0, np.arange(len(path)), path] == pytest.approx([f[0, t, k] for t, k in enumerate(want)])


def test_pitch_of_known_voice():
    x = sung(2, 200)
    f0, _ = T.best_pitch(x, RATE)
    count, start = T.grid(len(x), HOW.window(RATE), HOW.hop(RATE))
    t = (start + np.arange(count) * HOW.hop(RATE) + HOW.window(RATE) / 2) / RATE
    true = 200 * (1 + 0.3 * np.sin(2 * np.pi * 0.7 * t))
    sounding = np.sin(2 * np.pi * 1.1 * t)
    assert (np.abs(f0 - true) < 0.03 * true)[sounding > -0.3].mean() > 0.97 and (f0[sounding < -0.8] == 0).all()


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "a", sung(3, 130).tolist(), 7), (1, None, sung(2.3, 240, seed=1).tolist(), 7), (None, "b", sung(0.061, 180).tolist(), 7), (2, "none", None, 7), (2, "empty", [], 7)]
    rows += [(2, "short", [0.1] * 300, 7), (2, "nan", [float("nan")] * 9000, 7), (3, "silent", [0.0] * 9000, 7)]
    return spark.createDataFrame(rows, "id bigint, name string, x array<double>, frame int")


def by_key(rows, *names):
    out = {}
    for r in sorted(rows, key=lambda r: r["frame"]):
        out.setdefault((r["id"], r["name"]), []).append([r[n] for n in names])
    return out


@pytest.mark.parametrize("chunk", [256, 7])
def test_pitch_track_equals_whole_recordings(table, monkeypatch, chunk):
    monkeypatch.setattr(O, "CHUNK", chunk)
    got = by_key(O.pitch_track(table, ["id", "name"], RATE).collect(), "f0", "strength")
    whole = {(r["id"], r["name"]): np.array(r["x"]) for r in table.collect() if r["x"] and len(r["x"]) >= 480 and np.isfinite(r["x"]).all()}
    assert set(got) == set(whole)
    for key, x in whole.items():
        f0, strength = T.best_pitch(x, RATE)
        assert np.array(got[key]) == pytest.approx(np.stack([f0, strength], axis=1))
    assert all(f0 == 0 for f0, _ in got[3, "silent"])


@pytest.mark.parametrize("chunk", [256, 11])
def test_formant_tracks_equal_whole_recordings(spark, table, monkeypatch, chunk):
    monkeypatch.setattr(O, "CHUNK", chunk)
    rows = table.selectExpr("*", "CASE WHEN name = 'a' THEN array(5000, 5500) ELSE array(4800) END AS ceilings")
    got = {}
    for r in O.formant_tracks(rows, ["id", "name"], RATE).collect():
        got.setdefault((r["id"], r["name"], r["hz"]), {})[r["frame"]] = ([r[f"f{i}"] for i in range(1, 5)], [r[f"bw{i}"] for i in range(1, 5)])
    for r in table.where("id = 1").collect():
        x = np.array(r["x"]) - np.mean(r["x"])
        count, origin = T.grid(len(x), 400, 50)
        for hz in (5000, 5500) if r["name"] == "a" else (4800,):
            f, width = T.formant_frames(x[None], RATE, hz, np.floor((origin + np.arange(count) * 50 + 200) * 2 * hz / RATE).astype(int))
            mine = got[r["id"], r["name"], hz]
            assert sorted(mine) == list(range(count))
            assert np.array([mine[i][0] for i in range(count)]) == pytest.approx(f[0], abs=1e-6)
            assert np.array([mine[i][1] for i in range(count)]) == pytest.approx(width[0], abs=1e-6)


def test_matrices_equal_single_frames():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6, 300))
    x[0] = 0
    a = T.burg_rows(x, 8)
    f, width = T.poles(a, RATE)
    for row, coefficients, own, wide in zip(x, a, f, width, strict=True):
        assert coefficients == pytest.approx(S.burg(row, 8))
        want = S.resonances(row, RATE, 8, widest=np.inf)[:4]
        assert own[: len(want)] == pytest.approx([p for p, _ in want]) and wide[: len(want)] == pytest.approx([q for _, q in want]) and not own[len(want) :].any()


@pytest.mark.parametrize("rate,target", [(8000, 11000), (44100, 16000), (16000, 8000), (7, 5)])
def test_resampling_by_phases(rate, target):
    """Each sample from its own filter, in plain loops."""
    x = np.random.default_rng(1).standard_normal(200)
    got = T.resampled(x, rate, target)
    assert len(got) == 200 * target // rate and T.resampled(np.stack([x, -x]), rate, target)[1] == pytest.approx(-got)
    cut = min(1.0, target / rate)
    for i in (0, 1, len(got) // 2, len(got) - 1):
        at = i * rate / target
        want = 0.0
        for j in range(200):
            d = at - j
            if -32 <= j - math.floor(at) <= 32:
                want += x[j] * cut * np.sinc(cut * d) * (0.5 + 0.5 * math.cos(math.pi * d / 33))
        assert got[i] == pytest.approx(want)


def test_ceiling_choice(spark, table):
    pitch = O.mean_pitch(O.pitch_track(table, ["id", "name"], RATE), ["id", "name"])
    means = {(r["id"], r["name"]): r["mean"] for r in pitch.collect()}
    chosen = O.best_formants(table, ["id", "name"], RATE, pitch).groupBy("id", "name").agg({"hz": "min", "*": "count"}).collect()
    tried = lambda m: (5500,) if m and m > 200 else (5000, 5200, 5500) if m and m > 160 else (4500, 4800, 5000, 5200, 5500)
    assert {(r["id"], r["name"]) for r in chosen} == set(means)
    assert all(r["min(hz)"] in tried(means[r["id"], r["name"]]) for r in chosen)
    assert means[3, "silent"] is None and O.best_formants(table.limit(0), ["id", "name"], RATE, pitch).count() == 0


def plain_measures(x):
    """Every measure of one recording in plain loops or other algebra."""
    size, hop = 512, 128
    shade = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.pad(x, size // 2)
    power = np.mean([np.abs(np.fft.rfft(padded[i : i + size] * shade)) ** 2 for i in range(0, len(padded) - size + 1, hop)], axis=0)
    f = np.arange(size // 2 + 1) * RATE / size
    some = (f >= 100) & (f <= 5000)
    design = np.stack([np.log2(f[some]), np.ones(some.sum())], axis=1)
    tilt = np.linalg.lstsq(design, 10 * np.log10(power[some] + 1e-10), rcond=None)[0][0]
    n = min(len(x), 12_000)
    y = x[(len(x) - n) // 2 : (len(x) - n) // 2 + n]
    y = np.array([y[0], *(y[i] - 0.97 * y[i - 1] for i in range(1, n))])
    r = [y[: n - k] @ y[k:] for k in range(15)]
    a = np.linalg.solve([[r[abs(i - j)] for j in range(14)] for i in range(14)], [-v for v in r[1:]])
    g = np.arange(1025) * RATE / 2 / 1025
    level = -20 * np.log10(np.abs(1 + sum(c * np.exp(-2j * np.pi * g / RATE * (k + 1)) for k, c in enumerate(a))))
    level -= level.max()
    inside = [i for i in range(1025) if 200 <= g[i] <= 800]
    peaks = [i for i in inside[1:-1] if level[i] > level[i - 1] and level[i] > level[i + 1] and level[i] >= -30]
    prominence = 0.0
    if peaks:
        top = max(peaks, key=lambda i: level[i])
        prominence = level[top] - min(level[i] for i in range(1025) if g[top] < g[i] <= 1500)
    f0, strength = T.best_pitch(x, RATE)
    voiced = [(hz, v + 0.01 * math.log2(50 / hz)) for hz, v in zip(f0, strength, strict=True) if hz > 0]
    frames = [x[i : i + 2048] for i in range(0, len(x) - 2047, 1024)] if len(x) > 2048 else [x]
    return {
        "rms_db": 20 * math.log10(math.sqrt(sum(v * v for v in x) / len(x))), "tilt_db": tilt, "f1_prominence_db": round(prominence, 2),
        "f0_hz": sum(hz for hz, _ in voiced) / len(voiced) if voiced else 0.0,
        "hnr_db": sum(10 * math.log10(min(h, 1 - 1e-6) / (1 - min(h, 1 - 1e-6))) for _, h in voiced) / len(voiced) if voiced else 0.0,
        "cpp_db": sum(S.cepstral_prominence(v, RATE) for v in frames) / len(frames),
    }, level


def test_recording_measures_are_of_whole_recordings(spark):
    late = np.concatenate([0.001 * np.random.default_rng(3).standard_normal(RATE), sung(2, 210)])  # the voice begins after a second
    known = {1: sung(2, 120), 2: sung(2, 260, seed=2), 3: late, 4: sung(0.2, 140), 5: np.random.default_rng(5).standard_normal(RATE)}
    rows = [(i, x.tolist(), "kept") for i, x in known.items()] + [(6, None, "kept"), (7, [], "kept"), (8, [0.0] * 900, "kept"), (9, [float("nan")] * 900, "kept"), (10, [0.5] * 100, "kept")]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, note string")
    got = {r["id"]: r for r in S.recording_measures(df, RATE).collect()}
    envelopes = {r["id"]: r["envelope_db"] for r in S.lpc_envelopes(df, RATE).collect()}
    assert set(got) == set(range(1, 11)) and all(r["note"] == "kept" for r in got.values())
    for i, x in known.items():
        want, level = plain_measures(x)
        assert envelopes[i] == pytest.approx(level.tolist(), abs=1e-6)
        for name, value in want.items():
            assert got[i][name] == pytest.approx(value, abs=0.011 if name == "f1_prominence_db" else 1e-6), (i, name)
        kind = S.consonants(x[None], RATE)
        assert got[i]["consonant"] == kind["consonant"][0] and got[i]["high_share"] == kind["high_share"][0]
        assert got[i]["s_centroid_hz"] == S.sibilant_centroid(x, RATE, 512, 128) and got[i]["syllables_per_s"] == S.speech_rate(x, RATE, 512, 128)
        assert (got[i]["jitter"], got[i]["shimmer"]) == pytest.approx(S.perturbation(x, RATE, got[i]["f0_hz"]))
    assert got[3]["f0_hz"] == pytest.approx(210, rel=0.1)
    assert all(got[i]["rms_db"] is None and got[i]["consonant"] is None for i in range(6, 11))
    assert envelopes[6] is None and envelopes[7] is None and envelopes[9] is None and set(envelopes[8]) == {0.0}


def test_contact_quotient(spark, table, monkeypatch):
    """Against plain loops over whole recordings; chunks of any size give the same."""
    keys = ["id", "name"]
    track = O.pitch_track(table, keys, RATE)
    contours = {}
    for r in track.orderBy("frame").collect():
        contours.setdefault((r["id"], r["name"]), []).append((r["t"], r["f0"]))
    want = {}
    for r in table.where("id = 1").collect():
        x, contour = np.array(r["x"]) - np.mean(r["x"]), contours[r["id"], r["name"]]
        for i in range(len(x) // 160):
            t = (i + 0.5) * 0.02
            a, b = max((p for p in contour if p[0] <= t), default=None), min((p for p in contour if p[0] >= t), default=None)
            if a is None or b is None:
                near = a or b
                f0 = near[1] if abs(near[0] - t) <= 0.0075 else 0
            elif a[1] > 0 and b[1] > 0:
                f0 = a[1] if a == b else a[1] + (b[1] - a[1]) * (t - a[0]) / (b[0] - a[0])
            else:
                f0 = a[1] if t - a[0] <= b[0] - t else b[1]
            begin = round(t * RATE) - 200
            if f0 > 0 and begin >= 0 and begin + 400 <= len(x):
                power = np.abs(np.fft.rfft(x[begin : begin + 400] * np.hamming(400), 2048)) ** 2
                f = np.arange(1025) * RATE / 2048
                want[r["name"], i] = [10 * math.log10(power[(f >= 0.9 * h * f0) & (f <= 1.1 * h * f0)].sum()) for h in (1, 2, 4)]
    for chunk in (256, 9):
        monkeypatch.setattr(O, "CHUNK", chunk)
        got = {(r["name"], r["frame"]): [r["h1"], r["h2"], r["h4"]] for r in O.contact_frames(table, keys, RATE, track).where("id = 1").collect()}
        assert set(got) == set(want) and len(got) > 100
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
