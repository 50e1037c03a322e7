"""Spans taken out of sound, and what is measured on the rest, against plain loops over whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import signals as S
from sonoframe.operators import exclusion as E
from sonoframe.operators import running
from sonoframe.plans import registry
from sonoframe.plans import voices as V
from sonoframe.sources.bindings import voices

RATE = 8000


def plain_prominence(x):
    window, hop = int(E.CEPSTRAL * RATE), int(E.CEPSTRAL_STEP * RATE)
    found = [S.cepstral_prominence(x[i : i + window], RATE) for i in range(0, len(x) - window + 1, hop) if np.any(x[i : i + window]) and np.isfinite(x[i : i + window]).all()]
    return (float(np.mean(found)) if found else None), len(found)


@pytest.fixture(scope="module")
def sounds():
    rng = np.random.default_rng(4)
    t = np.arange(60_000) / RATE
    buzz = sum(np.sin(2 * np.pi * 130 * k * t) / k for k in range(1, 12)) + 0.05 * rng.standard_normal(len(t))
    return {"a": buzz, "b": rng.standard_normal(20_000), "short": buzz[:100], "one": buzz[: E.PIECE]}


SPANS = [("a", 100, 900), ("a", 500, 1200), ("a", 1200, 1300), ("a", 16_000, 50_000), ("a", 16_380, 16_400), ("a", 59_990, 70_000), ("a", -5, 3), ("b", 0, 90_000), ("one", 5, 5), ("one", 9, 7), ("none", 1, 5), ("a", None, 4), (None, 1, 40)]


def table(spark, sounds):
    more = [("null", None), ("empty", []), (None, sounds["a"][:400].tolist())]
    return spark.createDataFrame([(k, x.tolist()) for k, x in sounds.items()] + more, "key string, x array<double>").repartition(3)


def mask(n, key):
    keep = np.ones(n, bool)
    for k, a, b in SPANS:
        if k == key and a is not None and b > a:
            keep[max(a, 0) : b] = False
    return keep


def test_cut_and_silenced(spark, sounds):
    rows, spans = table(spark, sounds), spark.createDataFrame(SPANS + SPANS[:1], "key string, start bigint, end bigint")
    all_of = sounds | {None: sounds["a"][:400]}
    for how, left in ((E.cut_out, lambda x, k: x[k]), (E.silenced, lambda x, k: np.where(k, x, 0.0))):
        got = {}
        for r in how(rows, spans, ["key"]).orderBy("begin").collect():
            got.setdefault(r.key, []).append((r.begin, np.array(r.x)))
        for key, x in all_of.items():
            keep = mask(len(x), key)
            mine = got.get(key, [])
            assert np.array_equal(np.concatenate([p for _, p in mine] or [np.zeros(0)]), left(x, keep)), key
            assert how is E.silenced or all(b == np.flatnonzero(keep)[0] for b, _ in mine[:1])
        assert set(got) <= set(all_of)
    assert E.cut_out(rows, spans.limit(0), ["key"]).agg(F.sum(F.size("x"))).first()[0] == sum(map(len, all_of.values()))
    assert E.cut_out(rows.limit(0), spans, ["key"]).count() == 0
    frames = E.frame_spans(spark.createDataFrame([(0.0,), (0.5,)], "t double"), RATE, 0.01).orderBy("t").collect()
    assert [(r.start, r.end) for r in frames] == [(0, 40), (3960, 4040)]


def test_prominence_of_the_rest(spark, sounds):
    rows, spans = table(spark, sounds), spark.createDataFrame(SPANS, "key string, start bigint, end bigint")
    assert S.cepstral_prominences(np.stack([sounds["a"][:320], sounds["b"][:320]]), RATE) == pytest.approx([S.cepstral_prominence(sounds[k][:320], RATE) for k in "ab"])
    for how, left in ((E.cut_out, lambda x, k: x[k]), (E.silenced, lambda x, k: np.where(k, x, 0.0))):
        got = {r.key: (r.cpp_db, r.cepstral_frames) for r in E.prominence(how(rows, spans, ["key"]), ["key"], RATE).collect()}
        for key, x in (sounds | {None: sounds["a"][:400]}).items():
            keep = mask(len(x), key)
            want = plain_prominence(left(x, keep))
            if want[1] or key in got:
                assert got[key][1] == want[1] and (want[0] is None) == (got[key][0] is None) and (want[0] is None or got[key][0] == pytest.approx(want[0], abs=1e-9)), key


def test_tilt_of_the_mean_spectrum(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), None if i % 2 else "x", np.cumsum(rng.standard_normal(160 if i % 5 else 3000)).tolist()) for i in range(60)]
    odd = [(0, "x", None), (0, "x", []), (0, "x", [float("nan")] * 4), (9, "y", [0.0] * 200)]
    got = {(r.a, r.b): r.tilt_db_oct for r in E.mean_spectrum_tilt(spark.createDataFrame(rows + odd, "a bigint, b string, x array<double>").repartition(4), ["a", "b"], RATE).collect()}
    f = np.fft.rfftfreq(2048, 1 / RATE)
    inside = (f >= 100) & (f <= 5000)
    for key in {r[:2] for r in rows}:
        power = np.mean([np.abs(np.fft.rfft(np.pad(r[2], (0, 4096))[:2048] * np.hanning(2048))) ** 2 for r in rows if r[:2] == key], axis=0)
        assert got[key] == pytest.approx(np.polyfit(np.log2(f[inside]), 10 * np.log10(power[inside] + 1e-20), 1)[0], abs=1e-6)
    assert set(got) == {r[:2] for r in rows}


def test_running_values(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 3)) or None, i, float(rng.integers(0, 500)), None if rng.random() < 0.4 else int(rng.integers(-9, 9))) for i in range(400)]
    rows += [(7, 1000 + i, float(i), i) for i in range(600)]  # more than half of all rows have one key
    df = spark.createDataFrame(rows, "k bigint, seq bigint, t double, v bigint").repartition(5)
    part = F.floor(F.col("t") / 50)
    total = running.running_total(df, ["k"], ["t", "seq"], part, F.col("v"), "total")
    both = running.last_before(running.running_total(total, ["k"], ["t", "seq"], part, F.col("v"), "before", own=False), ["k"], ["t", "seq"], part, F.col("v"), "last")
    got = {r.seq: (r.total, r.before, r.last) for r in both.collect()}
    assert len(got) == len(rows) and both.columns == ["k", "seq", "t", "v", "total", "before", "last"]
    for k in {r[0] for r in rows}:
        total, last = 0, None
        for _, seq, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            before, total, last = total, total + (v or 0), last if v is None else v
            assert got[seq] == (total, before, last)
    assert running.running_total(df.limit(0), ["k"], ["t"], part, F.col("v"), "total").count() == 0


def test_source_by_vowel(spark):
    sf = "/root/testdata/sf0.001"
    groups = {}
    for r in V.heard(V.labelled(voices(spark, sf)).withColumn("wave", F.col("x"))).where("h1_h2 IS NOT NULL").collect():
        groups.setdefault((r.session_id, r.label), []).append((r.t, r.seq, r.h1_h2, np.array(r.wave)[120:280]))
    got = {(r.session_id, r.label): r for r in registry.queries()["per_vowel_source"](spark, sf).collect()}
    assert set(got) == set(groups) and any(len(g) >= 10 for g in groups.values())
    f = np.fft.rfftfreq(2048, 1 / RATE)
    inside = (f >= 100) & (f <= 5000)
    for key, rows in groups.items():
        rows = sorted(rows, key=lambda r: r[:2])
        power = np.mean([np.abs(np.fft.rfft(np.pad(w, (0, 2048 - 160)) * np.hanning(2048))) ** 2 for *_, w in rows], axis=0)
        assert got[key].n == len(rows) and got[key].h1_h2 == pytest.approx(np.mean([r[2] for r in rows]), abs=1e-5)
        assert got[key].tilt == pytest.approx(np.polyfit(np.log2(f[inside]), 10 * np.log10(power[inside] + 1e-20), 1)[0], abs=1e-5)
        want = plain_prominence(np.concatenate([r[3] for r in rows]))[0] if len(rows) >= 10 else None
        assert (got[key].cpp is None) == (want is None) and (want is None or got[key].cpp == pytest.approx(want, abs=1e-5))
