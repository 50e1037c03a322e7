"""Signal measures on tones of known pitch and resonance; streams against batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import signals as S
from sonoframe.operators import folds
from sonoframe.sources import recordings
from sonoframe.sources.bindings import frames
from sonoframe.streaming import live

RATE = 16_000
T = np.arange(RATE) / RATE


def test_pitch_and_harmonicity():
    x = sum(np.sin(2 * np.pi * 150 * h * T) / h for h in range(1, 10))
    f0, height = S.pitch(x[:2048], RATE)
    assert f0 == pytest.approx(150, abs=1) and S.harmonicity(height) > 20
    noise = np.random.default_rng(0).standard_normal(2048)
    assert S.harmonicity(S.pitch(noise, RATE)[1]) < 5
    assert S.cepstral_prominence(x[:2048], RATE) > S.cepstral_prominence(noise, RATE)


def test_resonances():
    rng, poles = np.random.default_rng(1), [(700, 80), (1200, 100), (2600, 150)]
    a = np.array([1.0])
    for f, b in poles:
        r = np.exp(-np.pi * b / RATE)
        a = np.convolve(a, [1, -2 * r * np.cos(2 * np.pi * f / RATE), r * r])
    x = np.zeros(RATE)
    for n, e in enumerate(rng.standard_normal(RATE)):
        x[n] = e - sum(a[k] * x[n - k] for k in range(1, len(a)) if n >= k)
    found = [f for f, _ in S.resonances(x, RATE, 6)]
    assert found == pytest.approx([f for f, _ in poles], rel=0.05)


def test_tilt_centroid_and_resampling():
    tone = np.sin(2 * np.pi * 1000 * T)
    assert S.centroid(tone, RATE) == pytest.approx(1000, abs=5)
    assert len(S.resampled(tone, RATE, 8000)) == 8000
    assert S.centroid(S.resampled(tone, RATE, 8000), 8000) == pytest.approx(1000, abs=5)
    assert S.tilt(np.cumsum(np.random.default_rng(0).standard_normal(RATE)), RATE, 100, 5000) == pytest.approx(-6, abs=1)
    assert S.frame(T, 400, 200).shape == (79, 400)


def test_wav_round_trip(spark, tmp_path):
    x = 0.1 * np.sin(2 * np.pi * 200 * T[:800])
    (tmp_path / "a.wav").write_bytes(S.encode_wav(x, RATE))
    (tmp_path / "b.txt").write_text("no sound")
    row = recordings.read_wav(spark, str(tmp_path)).first()
    assert row.rate == RATE and len(row.x) == 800 and max(map(abs, row.x)) == pytest.approx(10 ** (-3 / 20), abs=1e-3)
    assert len(recordings.part_of(recordings.read_wav(spark, str(tmp_path)), 0.01, 0.02).first().x) == 160


def test_alignments(spark, tmp_path):
    span = 'xmin = {} xmax = {} text = "{}"'
    tiers = 'name = "words" ' + span.format(0, 0.5, "hola") + span.format(0.5, 1, "<eps>") + ' name = "phones" ' + span.format(0, 0.2, "o") + span.format(0.2, 0.3, "sil")
    (tmp_path / "a.TextGrid").write_text(tiers)
    rows = recordings.read_alignments(spark, str(tmp_path)).collect()
    assert sorted((r.tier, r.label, r.start, r.end) for r in rows) == [("phones", "o", 0, 0.2), ("words", "hola", 0, 0.5)]


def test_stream_equals_batch(spark, tmp_path):
    rows = frames(spark, "/root/testdata/sf0.001").where("hnr < 10").select("session_id", F.lit("low").alias("type"), F.timestamp_seconds("t").alias("ts"), "seq", "t")
    ordered = rows.orderBy("ts").toPandas()
    for i, part in enumerate(np.array_split(ordered, 3)):
        spark.createDataFrame(part).select("session_id", "type", "ts", "seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id bigint, type string, ts timestamp, seq bigint").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    query = live.cooled_down(stream, 86_400.0, "60 days").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(r.seq for r in spark.table("kept").collect())
    want = folds.cooled_down(rows, ["session_id", "type"], 86_400.0, "session_id bigint, type string, seq bigint, t double")
    assert got == sorted(r.seq for r in want.collect())


def test_stream_pairs_with_the_nearest(spark, tmp_path):
    rows = frames(spark, "/root/testdata/sf0.001").where("session_id < 12").select("session_id", F.timestamp_seconds("t").alias("ts"), "seq").orderBy("ts").toPandas()
    audio, video = rows[::2], rows[1::2]
    end = rows["ts"].max() + np.timedelta64(90, "D")  # moves the watermark past all rows
    for name, part in (("a", audio), ("v", video)):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / name))
        spark.createDataFrame([(-1, end.to_pydatetime(), -1)], "session_id bigint, ts timestamp, seq bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema("session_id bigint, ts timestamp, seq bigint").parquet(str(tmp_path / name))
    out = live.paired(read("a"), read("v"), "12 HOURS")
    query = out.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.seq, r.video_seq, round(r.gap, 3)) for r in spark.table("pairs").where("session_id >= 0").collect())
    want = []
    for s, ts, seq in audio[["session_id", "ts", "seq"]].itertuples(index=False):
        of = [(abs(g), g, q) for p, u, q in video[["session_id", "ts", "seq"]].itertuples(index=False) if p == s and abs(g := (u - ts).total_seconds()) <= 43_200]
        if of:
            want.append((seq, min(of)[2], round(min(of)[1], 3)))
    assert got == sorted(want) and want
