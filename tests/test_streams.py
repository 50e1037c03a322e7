"""Late results and the sampled sink, over micro-batches in any order and after a crash."""

import datetime as dt
import random

from sonoframe.operators import assembly
from sonoframe.streaming import live

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_results(spark, tmp_path):
    turn, result = "turn_id bigint, ts timestamp", "turn_id bigint, ts timestamp, score double"
    turns, results = str(tmp_path / "turns"), str(tmp_path / "results")
    steps = [
        ([(1, at(0)), (2, at(1)), (3, at(2))], [(1, at(3), 0.5), (4, at(9), 0.8)]),  # 4's result comes before its turn
        ([(4, at(8))], [(2, at(20), 0.7), (2, at(21), 0.9), (77, at(20), 0.1)]),  # 2's come later, 77 is unknown
        ([(5, at(40))], [(3, at(41), 0.3)]),  # too late for 3
        ([(9, at(300))], [(9, at(300), 1.0)]),
        ([(10, at(600))], [(10, at(600), 1.0)]),
    ]
    put(spark, [], turn, turns)
    put(spark, [], result, results)
    for new_turns, new_results in steps:  # each step is a run of its own, going on from the checkpoint
        put(spark, new_turns, turn, turns)
        put(spark, new_results, result, results)
        matched = live.results_matched(spark.readStream.schema(turn).parquet(turns), spark.readStream.schema(result).parquet(results), "30 minutes", "10 minutes")
        query = matched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    rows = {(r["turn_id"], r["score"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(1, 0.5, "done"), (2, 0.7, "done"), (2, 0.9, "done"), (3, None, "pending"), (4, 0.8, "done"), (5, None, "pending"), (9, 1.0, "done"), (10, 1.0, "done")}


def test_sampled_sink_writes_once(spark, tmp_path):
    schema, source, out, checkpoint = "session_id bigint, ts timestamp, seq bigint, raw string", *(str(tmp_path / x) for x in ("in", "out", "cp"))
    put(spark, [], schema, source)
    start = lambda: live.write_sampled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), out, checkpoint, 120.0, "60 days").trigger(availableNow=True).start()
    written = lambda: sorted((r["session_id"], r["seq"]) for r in spark.read.schema("session_id bigint, seq bigint").json(out).collect())
    want = []
    for step in range(3):
        put(spark, [(s, at(step * 10 + i), step * 10 + i, "x" * 9) for s in (1, 2) for i in range(10)], schema, source)
        assert start().awaitTermination(120)
        want += [(s, step * 10 + i) for s in (1, 2) for i in range(0, 10, 2)]
        assert written() == sorted(want) and "raw" not in spark.read.json(out).columns
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if it crashed after writing and before committing
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert start().awaitTermination(120)
    assert written() == sorted(want)


PART = "session_id bigint, ts timestamp, seq bigint, source string, payload string"


def plain_assembly(rows, lag, size):
    """The same in one walk over sorted rows."""
    out = []
    for session in {r[0] for r in rows}:
        mine = [(r[1] + dt.timedelta(seconds=lag if r[3] == "audio" else 0), assembly.ORDER[r[3]], r[2], r[4] or "", r) for r in rows if r[0] == session and r[3] in assembly.ORDER]
        ring, latest, told = [], None, []
        for *_, (_, ts, seq, source, payload) in sorted(mine, key=lambda m: m[:4]):
            if source == "reset":
                ring = []
            elif source == "video":
                latest, ring = (ts, seq, payload), [*ring, (ts, seq, payload)][-size:]
            elif source == "audio":
                near = min(ring, key=lambda r: (abs(r[0] - ts), r[0], r[1])) if ring else None
                video = near or latest or (None, None, None)
                coaching = [p for s, p in told if s == "coaching"]
                out.append((session, seq, payload, video[1], video[2], (near[0] - ts).total_seconds() if near else None, tuple(p for s, p in told if s == "warning"), coaching[-1] if coaching else None))
                told = []
            else:
                told.append((source, payload or ""))
    return sorted(out, key=repr)


def flat(df):
    return sorted(((r.session_id, r.seq, r.audio, r.video_seq, r.video, r.gap, tuple(r.warnings), r.coaching) for r in df.collect()), key=repr)


def made(n, seed=3):
    """Parts of three sessions over n minutes; none of the third has a picture."""
    rng = random.Random(seed)
    kinds = ["audio"] * 6 + ["video"] * 4 + ["warning", "warning", "coaching", "reset"]
    rows = []
    for i in range(n * 3):
        session, source = rng.randrange(1, 4), rng.choice(kinds)
        if session == 3 and source == "video":
            source = "audio"
        rows.append((session, at(rng.randrange(n * 4) / 4), i, source, f"{source}-{i}"))  # quarters of minutes, so times repeat
    return rows


def test_assembly_in_batch(spark):
    rows = made(120)
    rows += [rows[5]] + [(1, at(3), 900, "other", "x"), (1, at(4), 901, "audio", None), (1, at(4), 902, "video", None), (2, at(4), 903, "warning", None)]
    gone = [(None, at(1), 1, "audio", "x"), (1, None, 2, "audio", "x"), (1, at(1), None, "audio", "x"), (1, at(1), 3, None, "x")]
    df = spark.createDataFrame(rows + gone, PART)
    for lag, size in ((0.0, 30), (60.0, 2)):
        want = plain_assembly(rows, lag, size)
        assert flat(assembly.assembled(df, lag, size)) == want
        assert any(w[6] for w in want) and any(w[3] is not None and w[5] is None for w in want) and all(w[3] is None for w in want if w[0] == 3)
    assert assembly.assembled(df.limit(0), 1.0, 3).count() == 0
    sound = spark.createDataFrame([(1, at(0), 7, 0.5, "a")], "session_id int, ts timestamp, seq int, level double, payload string")
    assert assembly.parts(sound, "audio").first().payload == '{"level":0.5,"payload":"a"}'


def test_assembly_on_a_stream(spark, tmp_path):
    rows, end = made(100), [(s, at(100_000), 10_000 + s, "reset", "end") for s in (1, 2, 3)]
    by_time = sorted(rows, key=lambda r: r[1])
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rng = random.Random(1)

    def go():
        stream = spark.readStream.schema(PART).option("maxFilesPerTrigger", 1).parquet(source)
        query = live.assembled(stream, 60.0, 3, "30 minutes", 1e6).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(300)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for step in range(4):  # each a run of its own from the checkpoint; parts are out of order within it and between its files
            some = by_time[step * 75 : (step + 1) * 75]
            rng.shuffle(some)
            for i in range(0, 75, 40):
                put(spark, some[i : i + 40], PART, source)
            go()
        put(spark, end, PART, source)
        go()
        want = plain_assembly(rows, 60.0, 3)
        assert flat(spark.read.parquet(out)) == want == flat(assembly.assembled(spark.createDataFrame(rows, PART), 60.0, 3))
        last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()  # as if it crashed after writing and before committing
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        go()
        assert flat(spark.read.parquet(out)) == want  # nothing is delivered twice
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    rows = [(1, at(0), 1, "video", "a"), (1, at(1), 2, "audio", "b"), (1, at(1), 3, "warning", "w"), (2, at(500), 4, "audio", "c"), (1, at(900), 5, "audio", "d"), (2, at(5000), 6, "reset", "e")]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for row in rows:
            put(spark, [row], PART, source)
            query = live.assembled(spark.readStream.schema(PART).parquet(source), 0.0, 3, "10 minutes", 600.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            assert query.awaitTermination(300)
        got = {r.seq: r for r in spark.read.parquet(out).collect()}
        assert set(got) == {2, 4, 5} and got[2].video_seq == 1 and list(got[2].warnings) == ["w"] and got[5].video_seq is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
