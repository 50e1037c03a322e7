"""The splitting source of sound: whole reads, ranges, odd files and a file of 3 GB."""

import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from sonoframe.functions import signals as S
from sonoframe.sources import sound


def whole(data, size, hop, tail=False):
    """Frames of one read of the whole file."""
    x, rate = S.decode_wav(data, normalise=False)
    size, hop = round(size * rate), round(hop * rate)
    return [x[i : i + size] for i in range(0, len(x), hop) if tail or i + size <= len(x)]


def wav(path, raw, rate=8000, width=2, channels=1):
    with wave.open(str(path), "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes(raw)


@pytest.mark.parametrize(("width", "channels", "tail"), [(1, 1, False), (2, 1, True), (2, 2, False), (3, 2, True), (4, 3, False)])
def test_ranges_equal_one_read(spark, tmp_path, width, channels, tail):
    rng = np.random.default_rng(width)
    for name, n in (("a", 5003), ("b", 7), ("c", 0), ("d", 1700)):
        wav(tmp_path / f"{name}.wav", rng.bytes(n * width * channels), 8000, width, channels)
    (tmp_path / "notes.txt").write_text("no sound")
    rows = sound.sound_frames(spark, str(tmp_path), 0.01, 0.004, 997, tail)
    assert rows.rdd.getNumPartitions() > 5
    got = {}
    for r in rows.orderBy("path", "frame").collect():
        assert r.rate == 8000 and r.t == pytest.approx(r.frame * 0.004)
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.frame, r.x))
    for name in "abcd":
        want = whole((tmp_path / f"{name}.wav").read_bytes(), 0.01, 0.004, tail)
        some = got.get(f"{name}.wav", [])
        assert [i for i, _ in some] == list(range(len(want)))
        assert all(np.allclose(x, y, atol=1e-12) for (_, x), y in zip(some, want, strict=True))


def test_odd_files(spark, tmp_path):
    wav(tmp_path / "good.wav", bytes(3200))
    good = (tmp_path / "good.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(good[:1000])  # says more than it holds
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "float.wav").write_bytes(good[:20] + struct.pack("<H", 3) + good[22:])
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"  # chunks of odd length are padded
    (tmp_path / "extra.wav").write_bytes(good[:36] + extra + good[36:])
    long = b"RF64" + b"\xff" * 4 + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, 3200, 1600, 0) + good[12:40] + b"\xff" * 4 + good[44:]
    (tmp_path / "long.wav").write_bytes(long)
    rows = sound.sound_frames(spark, f"file://{tmp_path}", 0.01, 0.01, 500)
    got = {r.path.rsplit("/", 1)[1]: (r.n, r.rows) for r in rows.groupBy("path").agg(F.count("frame").alias("n"), F.count("*").alias("rows")).collect()}
    assert got == {"good.wav": (20, 20), "cut.wav": (5, 5), "empty.wav": (0, 1), "float.wav": (0, 1), "extra.wav": (20, 20), "long.wav": (20, 20)}
    assert rows.where("path LIKE '%none'").count() == 0
    with pytest.raises(Exception, match="above 0"):
        sound.sound_frames(spark, str(tmp_path), 0.0).count()


def test_only_asked_bytes_are_read(spark, tmp_path):
    seconds = 3 * 1024**3 // 96_000
    wav(tmp_path / "day.wav", b"", 48_000)
    with open(tmp_path / "day.wav", "r+b") as file:  # 3 GB that take no room on disk
        file.seek(40)
        file.write(struct.pack("<I", seconds * 96_000))
        file.truncate(44 + seconds * 96_000)
        file.seek(44 + 30_000 * 96_000)
        file.write(struct.pack("<h", 16_384) * 48_000)
    reader = sound.SoundReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([GreaterThanOrEqual(("t",), 30_000.0), LessThan(("t",), 30_001.0)]))
    parts = reader.partitions()
    assert len(parts) == -(-(44 + seconds * 96_000) // (64 << 20)) == 48
    frames = [x for p in parts for b in reader.read(p) for x in b.column("t").to_pylist()]
    assert [x for x in frames if 30_000 <= x < 30_001] == pytest.approx([30_000 + i / 100 for i in range(100)])
    assert reader.bytes_read < 1.1 * 96_000
    rows = sound.sound_frames(spark, str(tmp_path)).where("t >= 30000 AND t < 30001")
    begin = time.monotonic()
    got = rows.selectExpr("count(*) AS n", "sum(aggregate(x, 0D, (a, v) -> a + v * v)) AS power", "max(size(x)) AS wide").first()
    assert time.monotonic() - begin < 60  # all frames would be 48 GB of doubles
    assert (got.n, got.wide) == (100, 1920)
    assert got.power == pytest.approx(0.25 * (97 * 1920 + 1440 + 960 + 480))
