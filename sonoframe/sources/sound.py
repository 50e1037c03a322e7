"""Recordings as frames, by a source that splits long files between tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, rate int, frame bigint, t double, x array<double>"

#: Format codes of plain and of extended PCM, and the size that says that the real one stands elsewhere.
PCM, EXTENDED, ELSEWHERE = 1, 0xFFFE, 0xFFFFFFFF


@dataclass(frozen=True)
class Layout:
    """Where a file's samples are: first byte, whole sample times, bytes of one sample, channels and rate."""

    begin: int
    n: int
    width: int
    channels: int
    rate: int


def layout(file, size: int) -> Layout | None:
    """Layout of a PCM file of ``size`` bytes from the heads of its chunks, or None; sizes beyond the end of the file are cut."""
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    at, form, long = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        at += 8
        if name == b"ds64":
            long = struct.unpack("<Q", file.read(16)[8:])[0]
        elif name == b"fmt ":
            form = file.read(min(length, 26))
            if len(form) < 16:
                return None
        elif name == b"data":
            if not form:
                return None
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            if kind == EXTENDED and len(form) >= 26:
                kind = struct.unpack("<H", form[24:26])[0]
            width = (bits + 7) // 8
            if kind != PCM or not channels or not rate or width not in (1, 2, 3, 4):
                return None
            length = long if length == ELSEWHERE and long is not None else length
            return Layout(at, max(0, min(length, size - at)) // (width * channels), width, channels, rate)
        at += length + length % 2
    return None


def samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mean of the channels, from -1 to 1, of little-endian PCM."""
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif width == 3:  # the sample becomes the three highest bytes of four
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.reshape(-1).view("<i4") / 256.0
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64)
    return x.reshape(-1, channels).mean(axis=1) / 2.0 ** (8 * width - 1)


@dataclass
class Parts(InputPartition):
    """Ranges of bytes of files: (path, size of the file, first byte, byte after the last)."""

    ranges: tuple[tuple[str, int, int, int], ...]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class SoundReader(DataSourceReader):
    """Frames of all files; conditions on ``t`` and ``path`` decide what is read, Spark applies them once more."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.hop = float(options.get("size", 0.04)), float(options.get("hop", 0.01))
        self.chunk = int(options.get("chunk", 64 << 20))
        self.tail = options.get("tail", "false").lower() == "true"
        if self.size <= 0 or self.hop <= 0 or self.chunk <= 0:
            raise ValueError("size, hop and chunk must be above 0")
        self.low, self.high, self.paths = -np.inf, np.inf, None
        self.bytes_read = 0  # by this object, for tests

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("t",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
            elif name == ("t",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
            elif name == ("t",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif name == ("path",) and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = some if self.paths is None else self.paths & some
            yield f

    def partitions(self) -> list[Parts]:
        """Long files in ranges of ``chunk`` bytes, short ones together up to as many; files aren't opened here."""
        system, path = opened(self.path)
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        found = system.get_file_info(fs.FileSelector(path)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        out, some, held = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            name = prefix + info.path
            if info.type != fs.FileType.File or not info.path.lower().endswith(".wav") or (self.paths is not None and name not in self.paths):
                continue
            size = info.size or 0
            for begin in range(0, max(size, 1), self.chunk):
                stop = min(begin + self.chunk, size)
                if some and held + stop - begin > self.chunk:
                    out.append(Parts(tuple(some)))
                    some, held = [], 0
                some.append((name, size, begin, stop))
                held += stop - begin
        return out + ([Parts(tuple(some))] if some else [])

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        for path, size, begin, stop in partition.ranges:
            system, name = opened(path)
            with system.open_input_file(name) as file:
                at = layout(file, size)
                if at:
                    yield from self.frames(file, path, at, begin, stop)
                elif not begin:
                    yield self.batch(path, None, np.zeros(1, np.int64), 1, np.zeros(0), np.zeros(2, np.int64))

    def frames(self, file, path: str, at: Layout, begin: int, stop: int) -> Iterator[pa.RecordBatch]:
        """Frames whose first sample lies in a range of bytes; the last of them reach beyond it."""
        wide = at.width * at.channels
        size, hop = max(1, round(self.size * at.rate)), max(1, round(self.hop * at.rate))
        count = -(-at.n // hop) if self.tail else max(0, 1 + (at.n - size) // hop)
        place = lambda byte: max(0, -(-(byte - at.begin) // (wide * hop)))  # the first frame at or after a byte
        first, last = place(begin), min(place(stop), count)
        if np.isfinite(self.low):
            first = max(first, int(np.floor(self.low * at.rate / hop)))
        if np.isfinite(self.high):
            last = min(last, int(np.ceil(self.high * at.rate / hop)) + 1)
        step = max(1, 500_000 // max(size, hop))  # frames at once
        for a in range(first, last, step):
            b = min(a + step, last)
            file.seek(at.begin + a * hop * wide)
            raw = file.read((min((b - 1) * hop + size, at.n) - a * hop) * wide)
            self.bytes_read += len(raw)
            x = samples(raw[: len(raw) // wide * wide], at.width, at.channels)
            starts = np.arange(b - a) * hop
            ends = np.minimum(starts + size, len(x))
            offsets = np.concatenate([[0], np.cumsum(ends - starts)])
            where = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
            yield self.batch(path, at.rate, np.arange(a, b), hop, x[where], offsets)

    @staticmethod
    def batch(path: str, rate: int | None, frames: np.ndarray, hop: int, flat: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n, null = len(frames), rate is None
        x = pa.nulls(n, pa.list_(pa.float64())) if null else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()))
        columns = [
            pa.array([path] * n, pa.string()),
            pa.array([rate] * n, pa.int32()),
            pa.nulls(n, pa.int64()) if null else pa.array(frames, pa.int64()),
            pa.nulls(n, pa.float64()) if null else pa.array(frames * hop / rate, pa.float64()),
            x,
        ]
        return pa.RecordBatch.from_arrays(columns, ["path", "rate", "frame", "t", "x"])


class SoundSource(DataSource):
    """Format ``sound``: see :func:`sound_frames`."""

    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SoundReader(dict(self.options))


def sound_frames(spark: SparkSession, path: str, size: float = 0.04, hop: float = 0.01, chunk: int = 64 << 20, tail: bool = False) -> DataFrame:
    """Frames of the WAV files of a folder, or of one file: path, rate, frame (from 0), t (seconds at its start), x (``size`` seconds of samples from -1 to 1).

    A frame begins every ``hop`` seconds; those that the end cuts are left out,
    or kept shorter with ``tail``. Long files are split into ranges of ``chunk``
    bytes: a task gives the frames that begin in its range and reads as far
    beyond it as the last of them reaches. Conditions on ``t`` and ``path``
    reach the source: other bytes aren't read. PCM of 8 to 32 bits and any
    number of channels (their mean) is understood, above 4 GB too; a file that
    isn't PCM gives one row with nulls, one without samples none. The path is
    one that every executor can open, an address of a remote store included.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SoundSource)
    return spark.read.format("sound").options(path=path, size=size, hop=hop, chunk=chunk, tail=str(tail).lower()).load()
