"""Rules and running values of a session that many tasks share, against one walk over it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.operators import folds

SCHEMA = "k string, seq bigint, t double"


def walk(rows, interval):
    kept, last = {}, {}
    for k, seq, t, once in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        if (k not in last) if once else (k not in last or t - last[k] >= interval):
            last[k] = t
            kept.setdefault(k, []).append(seq)
    return sorted(((k, s) for k, some in kept.items() for s in some), key=repr)


@pytest.mark.parametrize("interval", [0.1, 1.0, 7.3])
def test_passage(interval):
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400):
        for t in (np.sort(rng.integers(0, 60, n) / 10), np.sort(rng.random(n) * 30)):  # tenths meet the interval's rounding
            entries, exits = folds.passage(t, interval)
            for last in (None, t[0] - 100, t[0], *(t[0] - rng.random(20) * interval)):
                kept, want = folds.let_through(t, last, interval)
                assert folds.entered(entries, exits, last, interval) == want, (n, last)


def test_one_session_of_many_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", i, float(t), False) for i, t in enumerate(np.round(rng.random(6000) * 3000, 1))]
    rows += [(f"k{rng.integers(0, 300)}" if i % 50 else None, 10_000 + i, float(np.round(rng.random() * 3000, 1)), bool(rng.random() < 0.3)) for i in range(12_000)]
    rows += [rows[0], ("one", 99_999, 5.0, True)]
    df = spark.createDataFrame([*rows, ("hot", 1, None, False)], SCHEMA + ", once boolean").repartition(4)
    for interval, width in ((0.7, 60.0), (40.0, 25.0), (5.0, 500.0)):  # parts longer and shorter than the interval
        want = walk(rows, interval)
        assert sorted(((r.k, r.seq) for r in folds.cooled_in_parts(df, ["k"], interval, width, SCHEMA, "once").collect()), key=repr) == want
        plain = walk([(*r[:3], False) for r in rows], interval)
        assert sorted(((r.k, r.seq) for r in folds.cooled_in_parts(df, ["k"], interval, width, SCHEMA).collect()), key=repr) == plain
    assert folds.cooled_in_parts(df.limit(0), ["k"], 1.0, 10.0, SCHEMA, "once").count() == 0
    dealt = df.where("t IS NOT NULL").repartition(8, "k", F.floor(F.col("t") / 30)).groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]  # though one key holds a third of all rows
