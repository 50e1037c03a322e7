"""State that runs along a session, one session's events in order at a time.

Each is an Arrow-batched grouped map: rows are shuffled by session and sorted by
Spark; the state of a session is a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.operators.running import met


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable, start: Callable, schema: str) -> DataFrame:
    """Run ``step(state, row) -> state, out or None`` over the rows of each key in order.

    Rows are dealt out by key, sorted within partitions and streamed, so memory
    holds one batch and one state however long a key's history is. Rows whose key
    repeats in order positions are taken in any order; give a unique order.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                mine = tuple(getattr(row, k) for k in keys)
                if mine != key:
                    key, state = mine, start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_parts(rows: DataFrame, keys: list[str], order: list[str], work: Callable, start: Callable, schema: str) -> DataFrame:
    """As :func:`fold`, but a step takes all rows of a key that one batch holds.

    ``work(state, part) -> state, places, more``: ``part`` has an array for each
    column, ``places`` are those of the rows that stay, ``more`` has their values
    of further columns.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            columns = {n: batch[n].to_numpy() for n in batch.columns}
            change = np.ones(len(batch), bool)
            change[1:] = False
            for k in keys:
                change[1:] |= columns[k][1:] != columns[k][:-1]
            cuts = [*np.flatnonzero(change).tolist(), len(batch)]
            stay, added = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                mine = tuple(columns[k][a] for k in keys)
                if mine != key:
                    key, state = mine, start()
                state, places, more = work(state, {n: x[a:b] for n, x in columns.items()})
                stay.append(np.asarray(places, np.int64) + a)
                added.append(more)
            if stay:
                out = batch.iloc[np.concatenate(stay)]
                yield out.assign(**{n: np.concatenate([m[n] for m in added]) for n in added[0]})[names]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def let_through(t: np.ndarray, last: float | None, interval: float, once: np.ndarray | None = None) -> tuple[list[int], float | None]:
    """Places of the sorted times that come at least ``interval`` after the last one let through, greedy; and the last one.

    Those marked ``once`` pass only if none passed before. Each step searches
    for the next time that may pass, so it takes as many as are let through.
    """
    kept: list[int] = []
    at = 0
    plain = np.arange(len(t)) if once is None else np.flatnonzero(~once)
    while at < len(t):
        if last is not None:
            low, at = at, max(at, int(np.searchsorted(t, last + interval)))
            while at > low and t[at - 1] - last >= interval:  # the sum and the difference may round apart
                at -= 1
            while at < len(t) and t[at] - last < interval:
                at += 1
            after = int(np.searchsorted(plain, at))
            if after == len(plain):
                break
            at = int(plain[after])
        kept.append(at)
        last = float(t[at])
        at += 1
    return kept, last


def cooled_down(rows: DataFrame, keys: list[str], interval: float, schema: str, once: str | None = None) -> DataFrame:
    """Rows that come at least ``interval`` after the last one let through, by keys; greedy from the first.

    Rows for which the boolean column ``once`` holds pass only as the first of their key.
    """
    names = T.StructType.fromDDL(schema).names

    def work(last, part):
        kept, last = let_through(part["t"], last, interval, None if once is None else part[once].astype(bool))
        return last, kept, {}

    return fold_parts(rows.select(*names, *([once] if once else [])), keys, ["t", "seq"], work, lambda: None, schema)


def passage(t: np.ndarray, interval: float) -> tuple[np.ndarray, np.ndarray]:
    """What a part of sorted times does to the last time let through before it: entries and exits.

    If the first time that may pass is at or before an entry and after the entry
    before it, the last time let through in this part is that entry's exit.
    Only times within ``interval`` of the first, and one more, can be first.
    """
    n = len(t)
    after = np.searchsorted(t, t + interval)
    while (low := (after > np.arange(n) + 1) & (t[after - 1] - t >= interval)).any():  # the sum and the difference may round apart
        after[low] -= 1
    while (high := (after < n) & (t[np.minimum(after, n - 1)] - t < interval)).any():
        after[high] += 1
    last = np.where(after < n, after, np.arange(n))
    while (last[last] != last).any():  # steps double
        last = last[last]
    first = min(n, int(np.searchsorted(t, t[0] + interval, "right")) + 1)
    exits = t[last[:first]]
    ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    return t[:first][ends], exits[ends]


def entered(entries: np.ndarray, exits: np.ndarray, last: float | None, interval: float) -> float | None:
    """The last time let through after a part, see :func:`passage`."""
    if last is None:
        return float(exits[0])
    may = np.flatnonzero(entries - last >= interval)
    return float(exits[may[0]]) if len(may) else last


def cooled_in_parts(rows: DataFrame, keys: list[str], interval: float, width: float, schema: str, once: str | None = None) -> DataFrame:
    """The rows of :func:`cooled_down`, with each key's time cut into parts of ``width`` seconds that are tasks of their own.

    A part works out what it does to any time that may have been let through
    before it; these short tables meet by key, one after the other, and each
    part then starts with the time that is right for it. A key that holds a
    third of all rows is as many tasks as it has parts. ``width`` should be many
    times ``interval``: a key's tables hold the times within ``interval`` of its
    parts' beginnings at most. Rows without a time are left out.
    """
    names = T.StructType.fromDDL(schema).names
    own = [*keys, "_part"]
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _part bigint"
    rows = rows.select(*names, *([once] if once else [])).where("t IS NOT NULL").withColumn("_part", F.floor(F.col("t") / width).cast("bigint"))
    if once:  # the first row of a key passes whatever it is, and so does no later one that is marked
        begin = rows.groupBy(*own).agg(F.min(F.struct("t", "seq")).alias("_first"))
        begin = begin.withColumn("_first", F.min("_first").over(Window.partitionBy(*keys)))
        rows = met(rows, begin, own, ["_first"]).where(~F.coalesce(F.col(once), F.lit(False)) | (F.struct("t", "seq") == F.col("_first"))).select(*names, "_part")

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last part may go on in the next batch
        for batch in batches:
            table = batch if held is None else pd.concat([held, batch], ignore_index=True)
            change = np.zeros(len(table), bool)
            for k in own:
                values = table[k].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
            if cut:
                yield tables(table.iloc[:cut], change[:cut])
            held = table.iloc[cut:]
        if held is not None and len(held):
            yield tables(held, np.zeros(len(held), bool))

    def tables(table: pd.DataFrame, change: np.ndarray) -> pd.DataFrame:
        begins = np.flatnonzero(np.append(True, change[1:]))
        found = [passage(t, interval) for t in np.split(table["t"].to_numpy(), begins[1:])]
        return table[own].iloc[begins].assign(entries=[e for e, _ in found], exits=[e for _, e in found])

    def chain(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("_part")
        last, before = None, []
        for entries, exits in zip(table["entries"], table["exits"], strict=True):
            before.append(last)
            last = entered(np.asarray(entries), np.asarray(exits), last, interval)
        return table[own].assign(_last=pd.array(before, "Float64"))

    found = rows.select(*own, "t").repartition(*own).sortWithinPartitions(*own, "t").mapInPandas(through, f"{fields}, entries array<double>, exits array<double>")
    starts = found.groupBy(*keys).applyInPandas(chain, f"{fields}, _last double")
    both = met(rows, starts, own, ["_last"])

    def work(state, part):
        if state is None:
            state = (None if np.isnan(part["_last"][0]) else float(part["_last"][0]),)
        kept, last = let_through(part["t"], state[0], interval)
        return (last,), kept, {}

    return fold_parts(both, own, ["t", "seq"], work, lambda: None, schema)


def declines(rows: DataFrame, window: float, most: int, at_least: int, drop: float, rise: float) -> DataFrame:
    """Frames at which the later half of the trailing samples is worse than the earlier one: session_id, seq, t, cause.

    Samples are those of ``hnr`` and, apart, of ``jitter`` that are there and not
    0, in the trailing ``window`` seconds, the last ``most`` of the session at
    most; ``at_least`` are needed, and a session as old as the window. A fall of
    the first by ``drop`` counts before a rise of the second by ``rise``. Halves
    come from running sums, so a frame costs the same however long its window is.
    """

    def trend(t, at, values):
        """Earlier less later mean at each time; nan where there are too few samples. ``at`` and ``values`` are the samples."""
        total = np.concatenate([[0.0], np.cumsum(values)])
        end = np.searchsorted(at, t, "right")
        begin = np.maximum(np.searchsorted(at, t - window), end - most)
        n = end - begin
        half = n // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            change = (total[begin + half] - total[begin]) / half - (total[end] - total[begin + half]) / (n - half)
        return np.where(n >= at_least, np.round(change, 9), np.nan)

    def work(state, part):
        t = part["t"]
        first, held = (t[0], {}) if state is None else state
        found = {}
        for name in ("hnr", "jitter"):
            x = part[name].astype(float)
            some = ~np.isnan(x) & (x != 0)
            at, values = held.get(name, (np.zeros(0), np.zeros(0)))
            at, values = np.concatenate([at, t[some]]), np.concatenate([values, x[some]])
            found[name] = trend(t, at, values)
            held[name] = at[-most:], values[-most:]
        old = t - first >= window
        cause = np.where(found["hnr"] >= drop, "hnr", np.where(-found["jitter"] >= rise, "jitter", ""))
        keep = np.flatnonzero(old & (cause != ""))
        return (first, held), keep, {"cause": cause[keep]}

    return fold_parts(rows.select("session_id", "seq", "t", "hnr", "jitter"), ["session_id"], ["t", "seq"], work, lambda: None, "session_id bigint, seq bigint, t double, cause string")


def voice_by_timer(rows: DataFrame, threshold: float, onset: float, silence: float) -> DataFrame:
    """Events ``voice`` and ``silence`` of an armed detector: voice after ``onset`` above the threshold, then silence, which disarms it."""

    def step(state, row):
        armed, speaking, up, down = state
        if not armed:
            return state, None
        if row.rms >= threshold:
            down = None
            if not speaking:
                up = row.t if up is None else up
                if row.t - up >= onset:
                    return (True, True, None, None), (row.session_id, row.seq, row.t, "voice")
            return (True, speaking, up, down), None
        up = None
        if speaking:
            down = row.t if down is None else down
            if row.t - down >= silence:
                return (False, False, None, None), (row.session_id, row.seq, row.t, "silence")
        return (True, speaking, up, down), None

    start = lambda: (True, False, None, None)
    return fold(rows.select("session_id", "seq", "t", "rms"), ["session_id"], ["t", "seq"], step, start, "session_id bigint, seq bigint, t double, event string")


def voice_by_floor(rows: DataFrame, floor: float, speech: float, silence: float, alpha: float = 0.05, margin: float = 10.0, low: float = -60.0, high: float = -20.0) -> DataFrame:
    """Where each session stops by itself: a noise floor follows softer frames, speech is a margin above it."""

    def step(state, row):
        level, count, began, quiet, done = state
        if done:
            return state, None
        if row.rms > level + margin:
            count += 1
            if count >= 3 and began is None:
                began = row.t
            return (level, count, began, None, False), None
        level = alpha * min(max(row.rms, low), high) + (1 - alpha) * level
        if began is not None:
            count = 0
            quiet = row.t if quiet is None else quiet
            if row.t - began >= speech and row.t - quiet >= silence:
                return (level, count, began, quiet, True), (row.session_id, row.seq, row.t, level)
        return (level, count, began, quiet, False), None

    start = lambda: (floor, 0, None, None, False)
    return fold(rows.select("session_id", "seq", "t", "rms"), ["session_id"], ["t", "seq"], step, start, "session_id bigint, seq bigint, t double, floor double")
