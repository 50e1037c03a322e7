"""A folder of recordings as documents and scored phrases, against values worked by hand and the measures one by one."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import signals as S
from sonoframe.operators import composite as C
from sonoframe.operators import tracks
from sonoframe.sources import recordings as R

RATE = 16_000


def voiced(hz, seconds):
    t = np.arange(int(seconds * RATE)) / RATE
    return 0.3 * sum(np.sin(2 * np.pi * hz * k * t) / k for k in range(1, 14)) / 2


@pytest.fixture(scope="module")
def sounds():
    rng = np.random.default_rng(8)
    quiet = np.zeros(int(0.6 * RATE))
    return {"a": np.concatenate([voiced(125, 3.0), quiet, voiced(200, 2.5)]), "b": 0.2 * rng.standard_normal(2 * RATE), "long": voiced(160, 12.5)}


def test_phrases_by_hand(sounds):
    (a, b), (c, d) = C.phrases_of(sounds["a"], RATE)
    assert a == 0 and b == c == pytest.approx(3.3, abs=0.05) and d == pytest.approx(6.1)
    assert C.phrases_of(sounds["long"], RATE) == [(0.0, 5.0), (5.0, 10.0), (10.0, 12.5)]
    assert C.phrases_of(sounds["long"][: 11 * RATE], RATE) == [(0.0, 5.0), (5.0, 10.0)]  # the last second is too short
    assert C.phrases_of(sounds["b"][: RATE + 1], RATE) == [(0.0, 1 + 1 / RATE)] and C.phrases_of(sounds["b"][:500], RATE) == []
    pause_at_end = np.concatenate([voiced(125, 3.0), np.zeros(RATE)])
    assert C.phrases_of(pause_at_end, RATE) == [(0.0, 4.0)]


def test_quality_by_hand(spark):
    loud, soft = np.full(RATE, 0.5), np.full(RATE, 0.005)
    got = C.quality_of(np.concatenate([loud, soft]), RATE)
    assert got["snr_db"] == pytest.approx(40.0) and got["clipping_fraction"] == 0 and got["voiced_fraction"] == pytest.approx(0.5, abs=0.01)
    clipped = np.concatenate([np.ones(100), soft[:300]])
    assert C.quality_of(clipped, RATE) == {"snr_db": 0.0, "clipping_fraction": 0.25, "voiced_fraction": 1.0} and C.quality_of(np.zeros(RATE), RATE)["snr_db"] == 60.0
    rows = spark.createDataFrame([(1, np.concatenate([loud, soft]).tolist()), (2, None), (3, []), (4, [float("nan")] * 9)], "session_id bigint, x array<double>")
    found = {r.session_id: r for r in C.sample_quality(rows, RATE).collect()}
    assert found[1].quality_ok and found[1].duration_s == 2.0 and all(found[i].snr_db is None and found[i].quality_ok is None for i in (2, 3, 4))


def test_folder_to_documents_and_scores(spark, sounds, tmp_path):
    for name, x in sounds.items():
        (tmp_path / f"{name}.wav").write_bytes(S.encode_wav(x, RATE))
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    documents = {r.source_file.rsplit("/", 1)[1]: r.asDict(True) for r in C.analyse_folder(spark, str(tmp_path)).collect()}
    assert set(documents) == {"a.wav", "b.wav", "long.wav", "bad.wav"}
    bad, a, long = documents["bad.wav"], documents["a.wav"], documents["long.wav"]
    assert bad["duration_s"] is None and bad["pitch"] is None and bad["voice_quality"]["hnr_db"] is None
    assert a["duration_s"] == pytest.approx(6.1) and a["sample_rate"] == RATE and 125 < a["pitch"]["f0_mean_hz"] < 200 and long["pitch"]["f0_median_hz"] == pytest.approx(160, abs=1)
    x = S.decode_wav((tmp_path / "a.wav").read_bytes())[0]
    f0, _ = tracks.tracks.best_pitch(x, RATE)
    assert a["pitch"]["f0_contour_hz"] == pytest.approx(f0.tolist()) and a["pitch"]["f0_mean_hz"] == pytest.approx(f0[f0 > 0].mean()) and a["pitch"]["voiced_fraction"] == pytest.approx((f0 > 0).mean())
    assert a["quality"] | {"quality_ok": None} == {k: pytest.approx(v) for k, v in C.quality_of(x, RATE).items()} | {"quality_ok": None}
    assert a["quality"]["snr_db"] == pytest.approx(20 * np.log10(1 / 0.6), abs=0.3) and a["quality"]["quality_ok"] is False  # a tenth is silent, so more than half of the softest quarter isn't
    assert a["lpc_envelope"]["envelope_db"] == pytest.approx(S.middle_envelopes(x[None], RATE)[0].tolist()) and a["voice_quality"]["cpp_db"] == pytest.approx(S.mean_prominence(x, RATE))
    assert a["formant_ceiling_used_hz"] in tracks.TRIED and a["formants"]["f1_mean_hz"] > 0 and a["prosody"]["cv"] == pytest.approx(f0[f0 > 0].std() / f0[f0 > 0].mean())

    written = str(tmp_path / "documents")
    short = C.without_contours(C.analyse_folder(spark, str(tmp_path)))
    R.write_results(short.where("pitch IS NOT NULL"), written)
    read = R.read_results(spark, written, lines=True)
    assert read.where("source_file LIKE '%a.wav'").first().pitch.f0_contour_hz_frames == len(f0) and "envelope_db" not in read.schema["lpc_envelope"].dataType.names
    leaves = {(r.source_file.rsplit("/", 1)[1], r.path): r.value for r in R.numeric_leaves(read, ["source_file"]).collect()}
    assert leaves["a.wav", "pitch.f0_mean_hz"] == pytest.approx(a["pitch"]["f0_mean_hz"]) and ("b.wav", "voice_quality.cpp_db") in leaves

    @F.pandas_udf("pitch double, level double")
    def score(documents: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pitch": [p["f0_mean_hz"] for p in documents["pitch"]], "level": [v["rms_db"] for v in documents["voice_quality"]]})

    rows = R.read_wav(spark, str(tmp_path), rate=RATE).select(F.regexp_extract("path", r"(\w+)\.wav$", 1).alias("session_id"), "x")
    segments = tracks.kept(C.scored_phrases(rows.where("session_id != 'b'"), RATE, score))
    found = {(r.session_id, r.segment_id): r for r in segments.collect()}
    assert set(found) == {("a", "seg_000"), ("a", "seg_001"), *(("long", f"seg_00{i}") for i in range(3))}
    assert found["a", "seg_000"].scores.pitch == pytest.approx(125, abs=1) and found["a", "seg_001"].scores.pitch == pytest.approx(200, abs=1)
    scores = C.phrase_scores(segments)
    moved = [tuple(r) for r in C.notable_changes(scores).collect()]
    assert [m[:3] for m in moved] == [("a", "seg_001", "pitch")] and moved[0][3] == pytest.approx(75, abs=1)
    summary = {(r.session_id, r.category): r for r in C.score_summary(scores).collect()}
    assert summary["a", "pitch"].best == "seg_001" and summary["a", "pitch"].worst == "seg_000" and summary["a", "pitch"].range == pytest.approx(75, abs=1) and summary["long", "pitch"].std < 1
    R.write_segments(segments.drop("analysis"), ["session_id"], str(tmp_path / "segments"))
    assert {json.loads(line)["n_segments"] for f in (tmp_path / "segments").glob("*.json") for line in f.read_text().splitlines()} == {2, 3}
    assert C.scored_phrases(rows.limit(0), RATE).count() == 0
