"""The same rules on streams: alerts with a cooldown, trailing counts, and frames paired with video."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from sonoframe.operators.assembly import FIELDS, placed
from sonoframe.operators.folds import let_through


def cooled_down(stream: DataFrame, interval: float, delay: str = "1 hour") -> DataFrame:
    """Alerts (session_id, type, ts, seq) let through at most once in ``interval`` seconds by session and type.

    The state of a key is the time of its last alert; it is dropped once the
    watermark has passed that by the interval, when it can't hold anything back.
    Rows later than ``delay`` behind the watermark are dropped by Spark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], ignore_index=True)
        kept, last = let_through(rows["ts"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9, last, interval)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + interval) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.loc[kept, ["session_id", "type", "ts", "seq"]]

    return (
        stream.withWatermark("ts", delay)
        .groupBy("session_id", "type")
        .applyInPandasWithState(step, "session_id bigint, type string, ts timestamp, seq bigint", "last double", "append", GroupStateTimeout.EventTimeTimeout)
    )


def paired(audio: DataFrame, video: DataFrame, tolerance: str, delay: str = "1 hour") -> DataFrame:
    """For each audio row the nearest video row of its session within a tolerance, with the signed gap in seconds.

    Of two equally near the earlier counts, then the smaller ``seq``. An audio
    row comes once the watermark has passed it, so no later video row is nearer;
    rows without a video row in reach don't come.
    """
    a = audio.withWatermark("ts", delay).alias("a")
    v = video.withWatermark("ts", delay).select("session_id", F.col("ts").alias("video_ts"), F.col("seq").alias("video_seq")).alias("v")
    near = F.expr(f"a.session_id = v.session_id AND v.video_ts BETWEEN a.ts - INTERVAL {tolerance} AND a.ts + INTERVAL {tolerance}")
    gap = F.col("video_ts").cast("double") - F.col("a.ts").cast("double")
    met = a.join(v, near).select("a.session_id", "a.seq", "a.ts", "video_seq", gap.alias("gap"))
    best = F.min(F.struct(F.abs("gap").alias("away"), "gap", "video_seq")).alias("best")
    return met.groupBy("session_id", "seq", "ts").agg(best).select("session_id", "seq", "ts", "best.video_seq", "best.gap")


def trailing_counts(stream: DataFrame, width: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Frames and mean level by session and sliding window of event time."""
    return stream.withWatermark("ts", delay).groupBy("session_id", F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.avg("rms").alias("rms"))


def results_matched(turns: DataFrame, results: DataFrame, wait: str, delay: str = "1 hour") -> DataFrame:
    """Turns (turn_id, ts) with the results (turn_id, ts, score) that come for them: turn_id, ts, score, result_ts, status.

    A stream-stream left outer join with a watermark on either side. Results may
    come before or after their turn in the stream, and up to ``wait`` after it in
    time; a turn whose result hasn't come when the watermark passes that is
    ``pending`` for good. Several results of a turn give a row each; results of
    unknown turns, and later ones, give none.
    """
    t = turns.select("turn_id", "ts").withWatermark("ts", delay).alias("t")
    r = results.select(F.col("turn_id").alias("of_turn"), F.col("ts").alias("result_ts"), "score").withWatermark("result_ts", delay).alias("r")
    there = F.expr(f"turn_id = of_turn AND result_ts >= ts AND result_ts <= ts + INTERVAL {wait}")
    status = F.when(F.col("result_ts").isNull(), "pending").otherwise("done")
    return t.join(r, there, "leftOuter").select("turn_id", "ts", "score", "result_ts", status.alias("status"))


def write_sampled(stream: DataFrame, path: str, checkpoint: str, interval: float, delay: str = "1 hour", drop: tuple[str, ...] = ("raw",)):
    """Start writing a stream of frames (session_id, ts, seq) as JSON lines, at most one in ``interval`` seconds of a session.

    Sampling is greedy, as :func:`cooled_down` lets rows through; its state holds
    the last time of each session. Columns in ``drop`` aren't written. Each
    micro-batch is a folder named by its id, which a retry replaces, so a crash
    between writing and committing leaves nothing twice.
    """
    picked = cooled_down(stream.drop(*drop).withColumn("type", F.lit("frame")), interval, delay).drop("type")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return picked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _fields(**types: str) -> T.StructType:
    """A schema by names of types; workers can't read it from text."""
    made = T.StructType()
    for name, kind in types.items():
        made.add(name, kind)
    return made


class _Assembler(StatefulProcessor):
    """What a session waits for and has seen: see :func:`assembled`. Times are microseconds, those of timers milliseconds."""

    def __init__(self, size: int, idle: int):
        self.size, self.idle = size, idle
        self.names = [f.split()[0] for f in FIELDS.split(", ")]

    def init(self, handle) -> None:
        picture = _fields(us="long", seq="long", payload="string")
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _fields(at="long", rank="integer", seq="long", n="long"), _fields(us="long", source="string", payload="string"))
        self.ring = handle.getListState("ring", picture)
        self.latest = handle.getValueState("latest", picture)
        self.untold = handle.getListState("untold", _fields(source="string", payload="string"))
        self.due = handle.getValueState("due", _fields(ms="long"))
        self.seen = handle.getValueState("seen", _fields(n="long", at="long"))

    def wake(self, ms: int) -> None:
        """Keep one timer, the earliest that was asked for."""
        due = self.due.get()
        if due is None or ms < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        n, last = self.seen.get() or (0, 0)
        first = None
        for batch in rows:
            for at, rank, seq, us, source, payload in zip(*(batch[c].tolist() for c in ("at", "rank", "seq", "us", "source", "payload")), strict=True):
                self.waiting.updateValue((at, rank, seq, n), (us, source, payload))
                n, last = n + 1, max(last, at)
                first = at if first is None else min(first, at)
        self.seen.update((n, last))
        if first is not None:
            self.wake(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        waiting = [(tuple(k), tuple(v)) for k, v in self.waiting.iterator()]
        now = sorted((w for w in waiting if w[0][0] <= mark), key=lambda w: (*w[0][:3], w[1][2] or "", w[0][3]))
        later = [k[0] for k, _ in waiting if k[0] > mark]
        if now:
            out = self.passed(key, [(k[2], *v) for k, v in now])
            for k, _ in now:
                self.waiting.removeKey(k)
            if out:
                yield pd.DataFrame(out, columns=self.names)
        idle_from = self.seen.get()[1] + self.idle
        if later:
            self.wake(-(-min(later) // 1000))
        elif idle_from > mark:
            self.wake(-(-idle_from // 1000))
        else:
            for state in (self.waiting, self.ring, self.latest, self.untold, self.seen):
                state.clear()

    def passed(self, key: tuple, parts: list[tuple]) -> list[tuple]:
        """Rows for the sounds of the parts (seq, us, source, payload), which come in order."""
        ring, untold, latest = [tuple(r) for r in self.ring.get()], [tuple(r) for r in self.untold.get()], self.latest.get()
        out = []
        for seq, us, source, payload in parts:
            if source == "reset":
                ring = []
            elif source == "video":
                latest = (us, seq, payload)
                ring = [*ring, latest][-self.size :]
            elif source != "audio":
                untold.append((source, payload or ""))
            else:
                best = min(ring, key=lambda r: (abs(r[0] - us), r[0], r[1], r[2] or ""), default=None)
                _, video_seq, video = best or latest or (None, None, None)
                coaching = [p for s, p in untold if s == "coaching"]
                out.append((key[0], us, seq, payload, video_seq, video, (best[0] - us) / 1e6 if best else None, [p for s, p in untold if s == "warning"], coaching[-1] if coaching else None))
                untold = []
        for state, values in ((self.ring, ring), (self.untold, untold)):
            state.clear()
            if values:
                state.put(values)
        if latest is not None:
            self.latest.update(tuple(latest))
        return out


def assembled(stream: DataFrame, lag: float, size: int, delay: str = "1 hour", idle: float = 86_400.0) -> DataFrame:
    """The rows of :func:`sonoframe.operators.assembly.assembled` from one stream of parts, the union of all sources.

    Parts may come in any order within ``delay``; a sound comes once the watermark
    has passed it by ``lag``. Later parts are dropped by Spark. The state of a
    session is what waits for the watermark, a ring of ``size`` pictures and the
    messages not delivered; it goes ``idle`` seconds after the last part, so that
    pictures and messages from before such a gap are forgotten. The watermark is
    that of the union: a silent source holds nothing up.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = placed(stream.withWatermark("ts", delay), lag)
    return rows.groupBy("session_id").transformWithStateInPandas(_Assembler(size, round(idle * 1e6)), FIELDS, "append", "eventTime")
