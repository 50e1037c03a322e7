"""Sound is made where it is used: what is shuffled and held doesn't grow with the samples."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import signals as S
from sonoframe.functions import tracks as T
from sonoframe.operators import exclusion, stress, tracks
from sonoframe.operators import frames as O
from sonoframe.plans import registry, spanish, voices
from sonoframe.sources import bindings

SF, RATE = "/root/testdata/sf0.001", 8000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sounds(seed=0):
    """Voices of many lengths, none, a frame, silence and noise among them."""
    rng = np.random.default_rng(seed)
    out = []
    for n in (25_600, 400, 480, 900, 0, 20_011, 12_345, 31_000, 9000, 3000):
        t = np.arange(n) / RATE
        x = sum(np.sin(2 * np.pi * h * rng.uniform(90, 300) * (1 + 0.1 * np.sin(5 * t)) * t) / h for h in range(1, 5)) * (np.sin(7 * t) > -0.5)
        out.append(x + 0.02 * rng.standard_normal(n) if n != 9000 else np.zeros(n))
    return out


@pytest.fixture(scope="module")
def heard(spark):
    rows = [(i, "a" if i % 3 else None, x.tolist()) for i, x in enumerate(sounds())] + [(90, "none", None), (91, "nan", [float("nan")] * 900)]
    return spark.createDataFrame(rows, "id bigint, name string, x array<double>").repartition(2)


def test_sound_of_recordings_is_never_shuffled(spark):
    for name in ("lpc_envelope", "recording_measures"):
        text = plan(registry.queries()[name](spark, SF))
        made = text.rindex("InPandas") if "ArrowEvalPython" not in text else text.rindex("ArrowEvalPython")
        assert "Exchange" not in text[:made], name
    frame = next(iter(bindings.voices(spark, SF).where("seq = 7").toLocalIterator()))
    assert any(np.array_equal(np.array(r.x)[i : i + 400], frame.x) for r in bindings.recordings(spark, SF).where(F.col("session_id") == frame.session_id).collect() for i in range(0, len(r.x), 400))


def test_pitch_of_many_equals_one_by_one():
    some = sounds(1)
    for (f0, strength), x in zip(T.best_pitches(some, RATE), some, strict=True):
        want, sure = T.best_pitch(x, RATE)
        assert np.array_equal(f0, want) and strength == pytest.approx(sure)


def test_pitch_needs_no_shuffle(spark, heard):
    text = plan(tracks.pitch_track(bindings.recordings(spark, SF), ["session_id", "part"], RATE))
    assert "Exchange" not in text[: text.rindex("InPandas")] and "Join" not in text
    got = tracks.pitch_track(heard, ["id", "name"], RATE).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {i: T.grid(len(x), 480, 120)[0] for i, x in enumerate(sounds()) if len(x) >= 480}


def test_contact_in_one_pass(spark, heard):
    """The same as sound joined with its track, and sound is on no side of a broadcast."""
    keys = ["id", "name"]
    joined = tracks.contact_frames(heard, keys, RATE, tracks.pitch_track(heard, keys, RATE))
    assert "Broadcast" not in plan(joined) and "Join" not in plan(registry.queries()["sound_contact_quotient"](spark, SF))
    of = lambda df: {(r.id, r.name, r.frame): tuple(r)[3:] for r in df.collect()}
    got, want = of(tracks.sound_contact(heard, keys, RATE)), of(joined)
    assert set(got) == set(want) and len(got) > 300 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("chunk", [256, 50])
def test_formants_in_one_pass(spark, heard, monkeypatch, chunk):
    """The same as tracks under all ceilings, scored and joined; only the chosen rows leave a task."""
    keys = ["id", "name"]
    want = {tuple(r)[:4]: tuple(r)[4:] for r in tracks.best_formants(heard, keys, RATE, tracks.mean_pitch(tracks.pitch_track(heard, keys, RATE), keys)).collect()}
    monkeypatch.setattr(tracks, "CHUNK", chunk)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in tracks.sound_formants(heard, keys, RATE).collect()}
    assert set(got) == set(want) and len(got) > 1000 and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    text = plan(registry.queries()["formant_track"](spark, SF))
    assert "Join" not in text and "Window" not in text[: text.rindex("InPandas")]


def test_voices_of_many_equal_one_by_one():
    some = [x for x in sounds(2) if len(x) > 512]
    assert S.voices_of(some, RATE) == [pytest.approx(S.voice_of(x, RATE)) for x in some]
    for x in some[:3]:
        frames = S.frame(x, 2048, 1024) if len(x) > 2048 else x[None]
        assert S.mean_prominence(x, RATE) == pytest.approx(np.mean([S.cepstral_prominence(v, RATE) for v in frames]))


def test_a_tenth_of_the_peak(spark):
    """Frames 20 dB below the peak: the power's last bit decides, and is that of the comparison SQL's engine."""
    levels = [float(-i) for i in range(1, 100)]
    rows = spark.createDataFrame([(i, i * 1000 + j, v) for i, top in enumerate(levels) for j, v in enumerate([top, top - 20, top - 20, None])], "session_id bigint, seq bigint, rms double")
    got = {r.session_id: r.voiced for r in O.recording_quality(rows).collect()}
    want = {i: duckdb.sql(f"SELECT pow(10, CAST({top - 20} AS DOUBLE) / 20) > 0.1 * pow(10, CAST({top} AS DOUBLE) / 20)").fetchall()[0][0] for i, top in enumerate(levels)}
    assert {i: v == 0.75 for i, v in got.items()} == want and set(got.values()) <= {0.25, 0.75}


def test_levels_hold_few_waveforms(monkeypatch):
    """A batch of 10,000 waveforms is measured, and made, a bounded number at a time."""

    class Rows:
        schema = type("", (), {"fields": []})()

        def drop(self, *_):
            return self

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            self.run = run
            return self

    rng, seen, rows, real = np.random.default_rng(0), [], Rows(), S.harmonic_levels
    monkeypatch.setattr(S, "harmonic_levels", lambda x, *a: seen.append(len(x)) or real(x, *a))
    monkeypatch.setattr(S.F, "when", lambda *_: S.F)
    monkeypatch.setattr(S.F, "otherwise", lambda *_: S.F, raising=False)
    monkeypatch.setattr(S.F, "alias", lambda *_: S.F, raising=False)
    monkeypatch.setattr(S.F, "isnan", lambda *_: True)
    monkeypatch.setattr(S.F, "col", lambda *_: True)
    S.levels(rows, RATE)
    names = ["f0", "f1", "f2", "f3", "f4", "bw1", "bw2", "bw3"]
    batch = pd.DataFrame(rng.uniform(50, 300, (5000, 8)), columns=names).assign(x=list(rng.standard_normal((5000, 40))))
    made = list(rows.run(iter([batch])))
    assert sum(map(len, made)) == sum(seen) == 5000 and max(seen) <= 1024
    columns = [rng.integers(90, 300, 8000).astype(float) for _ in bindings.VOICE]
    tracemalloc.start()
    x = bindings.waves(*columns)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * x.nbytes and np.array_equal(x[4000:4001], bindings.waves(*(c[4000:4001] for c in columns)))


def test_source_by_vowel_shuffles_no_sound(spark, monkeypatch):
    """No exchange carries samples or bins, and sums in any number of parts give the same slope."""
    text = plan(registry.queries()["per_vowel_source"](spark, SF))
    assert "Generate posexplode" not in text and "ArrowEvalPython" not in text
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i % 3, rng.standard_normal(50 + i % 7).tolist()) for i in range(90)], "k int, x array<double>")
    of = lambda n: {r.k: r.tilt_db_oct for r in exclusion.mean_spectrum_tilt(rows.repartition(n), ["k"], RATE).collect()}
    want = of(1)
    monkeypatch.setattr(exclusion, "ROWS", 4)
    assert of(5) == pytest.approx(want, abs=1e-9) and len(want) == 3


def test_voices_bring_no_sound(spark):
    """Levels of sound made where it is measured are those of sound that rows bring."""
    assert "ArrowEvalPython" not in plan(registry.queries()["voice_levels"](spark, SF))
    of = lambda rows: sorted(tuple(r) for r in voices.heard(rows).select("seq", F.coalesce("h1_h2", F.lit(0.0)), F.coalesce("a1", F.lit(0.0)), "intensity").collect())
    assert np.allclose(of(voices.silent(spark, SF)), of(bindings.voices(spark, SF)), atol=1e-9)


def test_stress_has_no_row_for_a_look(spark, heard):
    """Looks at the pitch are no rows; pitch by syllable is that of a walk over all frames."""
    text = plan(spanish.spoken_words(spark, SF))
    assert "InPandas" not in text and "ArrowEvalPython" not in text  # words need the length of sound, so none is made for them
    track = tracks.pitch_track(heard, ["id"], RATE, following=True)
    frames = {}
    for r in track.collect():
        frames.setdefault(r.id, []).append((r.t, r.f0))
    rng = np.random.default_rng(4)
    spans = [(i, f"w{j}", float(a), float(a + 1), 0, float(a), float(a + w)) for i in frames for j, (a, w) in enumerate(zip(rng.uniform(-0.1, 2, 12).round(3), rng.uniform(0, 0.6, 12).round(3), strict=True))]
    syllables = spark.createDataFrame(spans, "id bigint, word string, start double, end double, i int, begin double, until double")
    got = {(r.id, r.word): r.f0 for r in stress.syllable_pitch(syllables, track, ["id"], 0.015).collect()}
    want = {}
    for i, word, *_, a, b in spans:
        values = []
        for j in range(int(np.floor((b - a) / 0.005 + 1e-9)) + 1):
            near = sorted((d, t, f) for t, f in frames[i] if (d := round(abs(a + j * 0.005 - t), 9)) < 0.015)
            if near and near[0][2] > 0 and near[0][0] <= 0.0075 + 1e-9:
                f, g = near[0][2], near[-1][2]
                values.append(f + (g - f) * near[0][0] / 0.015 if g > 0 else f)
        if values:
            want[i, word] = np.mean(values)
    assert got == pytest.approx(want) and len(want) > 30


def test_roots_of_many_polynomials(monkeypatch):
    """Roots of rows at once equal those of one after the other, odd rows included; only odd rows are solved as eigenvalues."""
    rng, solved, real = np.random.default_rng(5), [], np.linalg.eigvals
    monkeypatch.setattr(np.linalg, "eigvals", lambda m: solved.append(len(m)) or real(m))
    monkeypatch.setattr(T, "PREDICTED", 7)
    rows = rng.standard_normal((3000, 200)) * np.hanning(200)
    a = T.burg_rows(rows, 10)
    assert all(own == pytest.approx(S.burg(row, 10)) for row, own in zip(rows[:20], a[:20], strict=True))
    odd = np.zeros((6, 11))
    for row, z in zip(odd, ([0] * 10, [0.5] * 10, [0.9, 0.9, -0.9, -0.9, 0.3, 0.3, 0, 0, 0, 0.1], [0.5j, -0.5j] * 5, np.exp(2j * np.pi * np.arange(10) / 10), [0.99 * np.exp(1j), 0.99 * np.exp(-1j)] + [0.2] * 8), strict=True):
        row[:] = np.poly(z).real
    found = T.roots(np.concatenate([odd, a]))
    assert sum(solved) < 100
    for own, z in zip(np.concatenate([odd, a])[:200], found, strict=False):
        assert np.poly(z) == pytest.approx(own, abs=1e-9)
    for own, z in zip(a, found[6:], strict=True):
        assert np.sort(np.abs(z)) == pytest.approx(np.sort(np.abs(np.roots(own))), abs=1e-7)
    assert not found[0].any() and T.roots(np.zeros((0, 11))).shape == (0, 10) and T.roots(np.array([[1.0, -0.5]])) == pytest.approx(0.5)


def test_formants_make_their_sound(spark):
    """Sound is made in the task that measures it, not passed on to it."""
    text = plan(registry.queries()["formant_track"](spark, SF))
    assert text.count("InPandas") == 1 and "ArrowEvalPython" not in text
    keys = ["session_id", "part"]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in tracks.sound_formants(bindings.dealt_parts(spark, SF), keys, RATE, sound=bindings.sounds_of).collect()}
    want = {tuple(r)[:4]: tuple(r)[4:] for r in tracks.sound_formants(bindings.recordings(spark, SF), keys, RATE).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_stress_without_a_shuffle(spark, heard, monkeypatch):
    """Words that recordings bring give what words joined with tracks give, and nothing is shuffled behind the sound."""
    text = plan(registry.queries()["sound_stress"](spark, SF))
    assert text.count("MapInArrow") == 1 and "InPandas" not in text
    assert "Exchange" not in text[: text.index("MapInArrow")] and "Join" not in text[: text.index("MapInArrow")] and "Window" not in text[: text.index("MapInArrow")]
    rng = np.random.default_rng(6)
    names = ["paloma", "teléfono", "sol", "camino", "mesa", "árbol", "perro", "noche", "murciélago"]
    spans = [(i, names[rng.integers(len(names))], float(a), float(a + w)) for i in [*range(10), 90, 91] for a, w in zip(rng.uniform(-0.2, 4, 15).round(3), rng.uniform(0, 2, 15).round(3), strict=True)]
    spans += [(0, "casa", 0.5, 1e7), (5, "libro", 1.0, 1.0), (7, "vaca", -1e6, -1e5), (7, "tarde", None, 1.0), (7, "gato", 1.0, 0.5), (0, "", 0.0, 1.0)]
    words = spark.createDataFrame(spans, "id bigint, word string, start double, end double").distinct()
    each = words.withColumn("s", spanish.S.syllabify("word")).select("id", F.struct("word", "start", "end", spanish.S.expected_stress(F.col("s")).alias("expected"), F.transform("s", F.length).alias("letters")).alias("w"))
    lists = [F.col("w")[c].alias(c) for c in ("word", "start", "end", "expected", "letters")]
    brought = heard.drop("name").join(each.groupBy("id").agg(F.collect_list("w").alias("w")), "id", "left").select("id", "x", *lists)
    of = lambda df: {tuple(r)[:4]: tuple(r)[4:] for r in df.collect()}
    got, want = of(stress.heard_stress(brought, ["id"], RATE)), of(stress.spoken_stress(heard.drop("name"), words, ["id"], RATE))
    assert len(got) > 120 and set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-3) for k in want)
    t, f0 = 0.03 + 0.015 * np.arange(300), rng.choice([0.0, 120.0, 180.0], 300)
    begin, until = (a := rng.uniform(-1, 5, 200)), a + rng.uniform(0, 5, 200)
    whole = stress.pitch_within(begin, until, t, f0, 0.015)
    monkeypatch.setattr(stress, "LOOKS", 100)
    assert np.array_equal(stress.pitch_within(begin, until, t, f0, 0.015), whole) and whole.any()


def test_recordings_bring_the_words_they_say(spark):
    """In order and in time as rows have them."""
    rows = spanish.recordings_with_words(spark, SF)
    got = {(r.session_id, r.part, w): (a, b) for r in rows.select("session_id", "part", "word", "start", "end", "letters").collect() for w, a, b, n in zip(r.word, r.start, r.end, r.letters, strict=True) if sum(n) == len(w)}
    want = {(r.session_id, r.part, r.word): (r.start, r.end) for r in spanish.spoken_words(spark, SF).collect()}
    assert got == want and len(want) > 50
