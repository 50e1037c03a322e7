"""Recordings and alignments as tables, and tables as files."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.signals import decode_wav, encode_wav, gated, prepared, resampled


def read_wav(spark: SparkSession, folder: str, start: float = 0.0, end: float | None = None, normalise: bool = True, rate: int | None = None) -> DataFrame:
    """WAV files of a folder (not below it): path, rate, x (samples from -1 to 1) between two times in seconds.

    Only the samples asked for are decoded. Quiet ones are raised if
    ``normalise``; ``rate`` resamples. A file that isn't PCM has null in rate and x.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "false").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode_wav(data, start, end, normalise) for data in batch["content"]]
            if rate:
                found = [f and (resampled(f[0], f[1], rate), rate) for f in found]
            yield pd.DataFrame({"path": batch["path"], "rate": pd.array([f[1] if f else None for f in found], "Int32"), "x": [f[0] if f else None for f in found]})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, x array<double>")


def part_of(recordings: DataFrame, start: float, end: float) -> DataFrame:
    """Samples of each recording between two times in seconds."""
    first = F.floor(start * F.col("rate")).cast("int")
    return recordings.withColumn("x", F.slice("x", first + 1, F.greatest(F.lit(0), F.floor(end * F.col("rate")).cast("int") - first)))


#: Strings (quotes are doubled in them) and numbers of a TextGrid, in its long or short form; places in brackets don't count.
_VALUE = re.compile(r'"((?:[^"]|"")*)"|\[\d*\]|(?<![\w.])(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)')


#: Tiers and intervals where a file names its values but neither classes nor counts.
_ITEM = re.compile(r'name\s*=\s*"([^"]*)"(.*?)(?=name\s*=\s*"|\Z)', re.S)
_SPAN = re.compile(r'xmin\s*=\s*([\d.]+)\s*xmax\s*=\s*([\d.]+)\s*text\s*=\s*"((?:[^"]|"")*)"')


def intervals(text: str) -> Iterator[tuple[str, str, float, float]]:
    """(tier, label, start, end) of the interval tiers of a TextGrid; tiers of points are passed over."""
    if '"IntervalTier"' not in text:
        for name, body in _ITEM.findall(text):
            yield from ((name, label.replace('""', '"'), float(a), float(b)) for a, b, label in _SPAN.findall(body))
        return
    values = [m[1].replace('""', '"') if m[1] is not None else float(m[2]) for m in _VALUE.finditer(text) if m[1] is not None or m[2] is not None]
    at = 0
    while at < len(values):
        kind, at = values[at], at + 1
        if kind not in ("IntervalTier", "TextTier") or at + 4 > len(values):
            continue
        name, n = values[at], int(values[at + 3]) if isinstance(values[at + 3], float) else 0
        at += 4
        wide = 3 if kind == "IntervalTier" else 2
        for _ in range(n):
            if at + wide > len(values):
                return
            if wide == 3:
                yield name, values[at + 2], values[at], values[at + 1]
            at += wide


def read_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of TextGrid files: path, tier (words or phones), label, start, end; silences are left out."""
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.TextGrid").select(F.input_file_name().alias("path"), "value")
    silent = {"words": ("", "sil", "<eps>"), "phones": ("", "sil")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(path, *span) for path, value in zip(batch["path"], batch["value"], strict=True) for span in intervals(value) if span[1] not in silent.get(span[0], (span[1],))]
            yield pd.DataFrame(out, columns=["path", "tier", "label", "start", "end"])

    return texts.mapInPandas(run, "path string, tier string, label string, start double, end double")


def once_written(df: DataFrame, path: str) -> DataFrame:
    """The Parquet table at ``path``, written from ``df`` only if it isn't there: alignments that cost much are kept."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def as_wav(recordings: DataFrame, clip: bool = False) -> DataFrame:
    """Recordings (rate, x and other columns) as ``content``, the bytes of a WAV file; without those that are too short.

    Leading silence goes, the beginning fades in and the peak is set; with
    ``clip`` the quiet at both ends goes instead.
    """
    kept = [f for f in recordings.schema.fields if f.name not in ("x", "content")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for x, rate in zip(batch["x"], batch["rate"], strict=True):
                x = None if x is None else gated(np.asarray(x), int(rate)) if clip else np.asarray(x)
                x = None if x is None else prepared(x, int(rate), 0.3 if clip else 0.5, -1.0 if clip else 1e-4, 0.0 if clip else 0.005)
                made.append(None if x is None else encode_wav(x, int(rate)))
            out = batch[[f.name for f in kept]].assign(content=made)
            yield out[out["content"].notna()]

    return recordings.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "content binary"]))


def write_wav(recordings: DataFrame, folder: str, name: str, clip: bool = False) -> None:
    """One WAV file for each recording in a folder that all executors share, named by the column ``name``; written whole or not at all."""

    def run(rows) -> None:
        for row in rows:
            path = os.path.join(folder, f"{row[name]}.wav")
            with tempfile.NamedTemporaryFile(dir=folder, suffix=".part", delete=False) as file:
                file.write(row["content"])
            os.replace(file.name, path)

    os.makedirs(folder, exist_ok=True)
    as_wav(recordings, clip).select(name, "content").foreachPartition(run)


def read_results(spark: SparkSession, path: str, schema=None, lines: bool = False) -> DataFrame:
    """Result documents: one for each file, or one for each line if ``lines``."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", str(not lines).lower()).json(path)


def write_segments(segments: DataFrame, keys: list[str], path: str) -> None:
    """A JSON document for each recording with the array of its segments in order of ``segment_id``."""
    own = [c for c in segments.columns if c not in keys]
    first = F.struct("segment_id", *(c for c in own if c != "segment_id"))
    segments.groupBy(*keys).agg(F.sort_array(F.collect_list(first)).alias("segments"), F.count("*").alias("n_segments")).write.mode("overwrite").json(path)


#: Parts of a result whose numbers are compared.
PARTS = ("pitch", "formants", "voice_quality", "articulation", "prosody", "valley_depth", "lpc_envelope")


def numeric_leaves(documents: DataFrame, keys: list[str], parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Numbers of nested documents by dotted path: keys, path, value. Only the named parts are entered; flags and arrays don't count."""
    found: list[str] = []

    def walk(fields, prefix: str) -> None:
        for f in fields:
            if isinstance(f.dataType, T.NumericType):
                found.append(prefix + f.name)
            elif isinstance(f.dataType, T.StructType) and f.name in parts:
                walk(f.dataType.fields, f"{prefix}{f.name}.")

    walk([f for f in documents.schema.fields if f.name not in keys], "")
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.col(p).cast("double").alias("value")) for p in found))
    return documents.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.path", "e.value").where("value IS NOT NULL")


def write_results(df: DataFrame, path: str, contours: tuple[str, ...] = ()) -> None:
    """JSON lines of a result; the named arrays are replaced by their lengths."""
    df.withColumns({c + "_frames": F.size(c) for c in contours}).drop(*contours).write.mode("overwrite").json(path)
