"""Sound without some of its spans: cut out or silenced on the grid of samples, and what is measured on the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions import signals
from sonoframe.operators.running import running_total

#: Samples of one piece of a recording, frames of one block of what is left, blocks and waveforms that one numpy step holds.
PIECE, BLOCK, BLOCKS, ROWS = 16_384, 256, 32, 1024
#: Seconds of a cepstral frame and between two of them; bins of a vowel's spectrum, and the range of its tilt in Hz.
CEPSTRAL, CEPSTRAL_STEP, BINS, TILT = 0.04, 0.01, 2048, (100.0, 5000.0)


@dataclass(frozen=True)
class Sound:
    """Sound that rows don't carry: it is made from ``columns`` of them, ``length`` samples each, where it is measured."""

    columns: tuple[str, ...]
    length: int
    of: Callable[[pd.DataFrame], np.ndarray]


def frame_spans(times: DataFrame, rate: int, step: float) -> DataFrame:
    """Rows with a time ``t`` as the samples of the frame around it: ``start``, ``end`` (exclusive)."""
    middle, half = F.floor(F.col("t") * rate), int(step * rate / 2)
    return times.withColumns({"start": F.greatest(F.lit(0), middle - half), "end": middle + half})


def pieces(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Recordings (keys, ``x``) in pieces of ``PIECE`` samples: keys, piece, begin (its first sample), x. Missing and empty ones have none."""
    count = F.ceil(F.size("x") / PIECE).cast("int")
    cut = recordings.where(F.size("x") > 0).select(*keys, "x", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return cut.select(*keys, "piece", (F.col("piece").cast("bigint") * PIECE).alias("begin"), F.slice("x", F.col("piece") * PIECE + 1, PIECE).alias("x"))


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of samples by piece, without overlaps: keys, piece, spans (sorted starts and ends within the piece).

    A span is cut at the ends of pieces first, so overlaps are settled piece by
    piece and a piece has at most half as many spans as samples. Spans without
    length, or with a null, don't count.
    """
    spans = spans.where("start IS NOT NULL AND end > greatest(start, 0)").select(*keys, F.greatest(F.col("start"), F.lit(0)).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    touched = F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("end") - 1) / PIECE))).alias("piece")
    first = F.col("piece") * PIECE
    inside = spans.select(*keys, touched, "start", "end").select(*keys, F.col("piece").cast("int").alias("piece"), F.greatest(F.col("start") - first, F.lit(0)).alias("start"), F.least(F.col("end") - first, F.lit(PIECE)).alias("end")).distinct()
    order = Window.partitionBy(*keys, "piece").orderBy("start", "end")
    inside = inside.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    inside = inside.withColumn("island", F.count_if("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = inside.groupBy(*keys, "piece", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy(*keys, "piece").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _spanned(recordings: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    cut, gone = pieces(recordings, keys), merged(spans, keys)
    same = [cut[k].eqNullSafe(gone[k]) for k in [*keys, "piece"]]
    return cut.join(gone, same, "left").select(*(cut[c] for c in cut.columns), gone["spans"])


def cut_out(recordings: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """What recordings (keys, ``x``) keep without the spans (keys, ``start``, ``end`` in samples, exclusive): keys, begin, x, in pieces."""
    size = F.size("x").cast("bigint")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce(F.col("spans.end"), F.array().cast("array<bigint>")))
    ends = F.concat(F.coalesce(F.col("spans.start"), F.array().cast("array<bigint>")), F.array(size))
    gaps = F.filter(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: F.struct(g["a"].alias("a"), F.least(g["b"], size).alias("b"))), lambda g: g["b"] > g["a"])
    left = _spanned(recordings, spans, keys).select(*keys, "begin", "x", F.explode(gaps).alias("g"))
    return left.select(*keys, (F.col("begin") + F.col("g.a")).alias("begin"), F.slice("x", F.col("g.a").cast("int") + 1, (F.col("g.b") - F.col("g.a")).cast("int")).alias("x"))


def silenced(recordings: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`cut_out`, but the samples of the spans stay, as zeros."""
    rows = _spanned(recordings, spans, keys)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for x, gone in zip(batch["x"], batch["spans"], strict=True):
                x = np.array(x, float)
                for span in gone if gone is not None else ():
                    x[span["start"] : span["end"]] = 0.0
                made.append(x)
            yield batch[[*keys, "begin"]].assign(x=made)

    return rows.mapInPandas(run, f"{own}, begin bigint, x array<double>")


def prominence(kept: DataFrame, keys: list[str], rate: int, order: tuple[str, ...] = ("begin",), part: Column | None = None, sound: Sound | None = None) -> DataFrame:
    """Mean cepstral prominence of pieces of sound joined in order: keys, cpp_db, cepstral_frames.

    ``kept`` has keys, ``order`` (unique by key) and ``x``; ``part`` cuts a key's
    rows into parts for :func:`running_total`, by ``begin`` if it isn't given. The place
    of a piece in what is left is a running total of lengths; pieces go to the
    blocks of ``BLOCK`` frames that they touch, so no key is gathered whole.
    Frames of 40 ms every 10 ms count unless they are silent or not finite; a key
    without such a frame has a null and 0. With ``sound``, rows carry no ``x``.
    """
    carried = list(sound.columns) if sound else ["x"]
    window, hop = int(CEPSTRAL * rate), max(1, int(CEPSTRAL_STEP * rate))
    span = BLOCK * hop
    held = kept.withColumn("n", F.lit(sound.length).cast("bigint")) if sound else kept.where(F.size("x") > 0).withColumn("n", F.size("x").cast("bigint"))
    held = held.select(*keys, *(c for c in (order if part is not None else {*order, "begin"}) if c in kept.columns), *carried, "n", *([] if part is None else [part.alias("in_part")]))
    part = F.floor(F.col("begin") / (64 * PIECE)) if part is None else F.col("in_part")
    held = running_total(held, keys, list(order), part, F.col("n"), "place", own=False)
    first = F.greatest(F.lit(0), F.floor((F.col("place") - window + hop) / span))
    last = F.floor((F.col("place") + F.col("n") - 1) / span)
    dealt = held.select(*keys, F.explode(F.sequence(first, last)).alias("block"), "place", *carried)
    blocks = dealt.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("place", *carried))).alias("r"))
    blocks = blocks.select(*keys, "block", F.col("r")[0]["place"].alias("place"), *(F.col("r")[c].alias(c) if sound else F.flatten("r.x").alias("x") for c in carried))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + BLOCKS] for whole in batches for i in range(0, len(whole), BLOCKS)):
            if sound:
                ends = np.cumsum(batch[carried[0]].map(len).to_numpy())
                made = sound.of(pd.DataFrame({c: np.concatenate(batch[c].to_numpy()) for c in carried}))
                batch = batch.assign(x=[x.ravel() for x in np.split(made, ends[:-1])])
            sums, counts = [], []
            for block, place, x in zip(batch["block"], batch["place"], batch["x"], strict=True):
                x = np.asarray(x, float)
                skip = block * span - place  # samples of the first piece before this block
                x = x[skip:] if skip >= 0 else x
                frames = signals.frame(x[: span - hop + window], window, hop)
                frames = frames[np.isfinite(frames).all(axis=1)]
                frames = frames[(frames != 0).any(axis=1)]
                found = signals.cepstral_prominences(frames, rate)
                sums.append(float(found.sum()))
                counts.append(len(found))
            yield batch[keys].assign(s=sums, n=counts)

    made = blocks.mapInPandas(run, f"{own}, s double, n bigint")
    return made.groupBy(*keys).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("cpp_db"), F.sum("n").alias("cepstral_frames"))


def mean_spectrum_tilt(rows: DataFrame, keys: list[str], rate: int, sound: Sound | None = None) -> DataFrame:
    """Slope in dB an octave of the averaged power spectrum of waveforms ``x`` by keys: keys, tilt_db_oct (null below five bins of power).

    Rows meet by key first; a key that holds many is still many tasks. A task
    sums a key's autocorrelations, as long as its waveforms, and the sums meet:
    the spectrum of their total is the total of the spectra, and has many more
    bins. Longer waveforms count with their first ``BINS`` samples; missing, empty
    and non-finite ones don't. With ``sound``, rows carry no ``x``.
    """
    f = np.fft.rfftfreq(BINS, 1 / rate)
    low, high = int(np.searchsorted(f, TILT[0])), int(np.searchsorted(f, TILT[1], "right"))
    shade = np.hanning(BINS)
    own = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + ROWS] for whole in batches for i in range(0, len(whole), ROWS)):
            waves = list(sound.of(batch)) if sound else [None if x is None else np.asarray(x, float)[:] for x in batch["x"]]
            good = [x is not None and len(x) > 0 and bool(np.isfinite(x).all()) for x in waves]
            batch, waves = batch[good], [x[:BINS] for x, fine in zip(waves, good, strict=True) if fine]
            if not len(batch):
                continue
            longest = max(map(len, waves))
            x = np.zeros((len(batch), longest))
            for row, values in zip(x, waves, strict=True):
                row[: len(values)] = values
            size = 1 << (2 * longest - 1).bit_length()
            power = np.abs(np.fft.rfft(x * shade[:longest], size)) ** 2
            which = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(which, kind="stable")
            edges = np.flatnonzero(np.diff(which[order], prepend=-1))
            sums = np.fft.irfft(np.add.reduceat(power[order], edges, axis=0), size)[:, :longest]
            yield batch[keys].iloc[order[edges]].assign(n=np.diff(np.append(edges, len(order))), r=list(sums))

    def slope(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        octave = np.log2(f[low:high])
        for batch in batches:
            found = []
            for n, parts in zip(batch["n"], batch["r"], strict=True):
                r = np.zeros(BINS)
                for part in parts:
                    r[: len(part)] += part
                r[1:] *= 2
                power = np.fft.rfft(r).real[low:high] / n  # of the even signal whose right half is r
                some = power > 0
                if some.sum() < 5:
                    found.append(None if some.any() else np.nan)
                    continue
                at, level = octave[some] - octave[some].mean(), 10 * np.log10(power[some] + 1e-20)
                found.append(float((at * level).sum() / (at * at).sum()))
            there = [v is None or v == v for v in found]
            yield batch[keys][there].assign(tilt_db_oct=pd.Series([v for v, t in zip(found, there, strict=True) if t], index=batch.index[there], dtype=object))

    some = rows.select(*keys, *(sound.columns if sound else ["x"])).hint("rebalance", *keys).sortWithinPartitions(*keys)
    sums = some.mapInPandas(run, f"{own}, n bigint, r array<double>").groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("r").alias("r"))
    return sums.mapInPandas(slope, f"{own}, tilt_db_oct double")
