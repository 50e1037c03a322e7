"""Joins in time against plain loops."""

import random

from sonoframe.operators import joins


def test_nearest_in_time(spark):
    rng = random.Random(3)
    times = lambda n: [rng.choice([rng.randrange(60) / 4, rng.uniform(0, 15), 7.0]) for _ in range(n)]
    left = [(rng.choice("ab"), t, i) for i, t in enumerate(times(300))] + [(None, 1.0, 300), ("a", None, 301), ("c", 2.0, 302), ("a", 500.0, 303)]
    right = [(rng.choice("ab"), t, i, f"v{i}") for i, t in enumerate(times(80))] + [(None, 1.0, 80, "no"), ("a", None, 81, "no"), ("b", -3.0, 82, "early")]
    rows = joins.nearest_in_time(spark.createDataFrame(left, "k string, t double, seq int"), spark.createDataFrame(right, "k string, t double, seq int, v string"), ["k"], 0.3, ["v"])
    got = {r.seq: (r.t_right, r.seq_right, r.v_right) for r in rows.collect()}
    assert len(got) == len(left) == rows.count()
    for k, t, i in left:
        near = [(abs(t - x), x, j, v) for q, x, j, v in right if k is not None and q == k and None not in (t, x) and abs(t - x) <= 0.3]
        assert got[i] == (min(near)[1:] if near else (None, None, None))


def test_dense_session(spark):
    """A window of 200,000 rows on both sides: 40,000,000,000 pairs, none of them made."""
    rows = spark.range(200_000).selectExpr("1 AS k", "id / 1e6 AS t", "id AS seq")
    got = joins.nearest_in_time(rows, rows.selectExpr("k", "t + 4e-7 AS t", "seq"), ["k"], 1.0, []).selectExpr("sum(cast(seq = seq_right AS int)) AS n", "max(abs(gap)) AS gap").first()
    assert got.n == 200_000 and got.gap < 5e-7
