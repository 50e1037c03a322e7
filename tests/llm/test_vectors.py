"""Embedding links and exact top-k against brute force."""

import numpy as np
import pytest

from sonoframe.llm import graph, vectors


def brute_links(rows, cosine=0.9):
    ok = [(i, np.array(x, float)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    links = {k: [] for k in range(len(ok))}
    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= cosine:
                links[a].append(b)
    out = []
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((ok[a][0], len(links[a]), min(ok[b][0] for b in seen)))
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 16))
    rows = [(i, (centers[i % 40] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(20)]  # exact copies
    odd = [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, []), (505, [1.0] * 8), (506, [2.0] * 8), (None, rows[5][1]), (507, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS x")
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    want = {i: (n, c) for i, n, c in brute_links(rows + odd)}
    for r in got:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)), r
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    """Pairs just above, at and below the cosine, nearer than the rounding of what travels."""
    rows, rng = [], np.random.default_rng(3)
    for k, shift in enumerate([0.0, 1e-7, -1e-7, 1e-9, -1e-9, 1e-5, -1e-5, 1e-3, -1e-3]):
        for n in range(6):
            base, side = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
            c = 0.9 + (shift or 1e-11)
            rows += [(1000 * k + 10 * n, (3.7 * base).tolist()), (1000 * k + 10 * n + 1, (c * base + np.sqrt(1 - c * c) * side).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df, miss=1e-9).collect())
    assert got == sorted(brute_links(rows))
    x = np.array([v for _, v in rows])
    q, step = vectors.rounded(x)
    every = np.arange(len(x))
    i, j, sure = vectors.close(q, step, every, every, 0.9)
    cosines = np.einsum("ij,ij->i", vectors.unit(x)[i], vectors.unit(x)[j])
    assert (cosines[sure] >= 0.9).all() and 0 < sure.sum() < len(sure)
    assert (np.triu(vectors.unit(x) @ vectors.unit(x).T >= 0.9, 1).sum()) == (cosines >= 0.9).sum()


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_top_k(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "SENT_BYTES", sent)
    monkeypatch.setattr(vectors, "SCAN_BLOCK", 64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 12)).round(1)
    x[100:140] = x[0]  # ties
    x[7] *= 500
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(600, None), (700, [float("nan")] * 12), (800, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS score", "'a' AS rank")
    got = sorted(tuple(r) for r in vectors.top_k(df, every=20).collect())
    cells = np.floor(1024 * x).astype(np.int64)
    want = []
    for q in range(0, 500, 20):
        order = sorted((-(cells[q] @ cells[v]), v) for v in range(500) if v != q)[:10]
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(order)]
    assert got == sorted(want)
    assert vectors.top_k(df.limit(0)).count() == 0
    assert len(vectors.top_k(spark.createDataFrame(rows[:4], "vec_id bigint, embedding array<double>")).collect()) == 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_top_k_of_many_lengths(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "SENT_BYTES", sent)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 64)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(1 + i // 10 % 17).tolist()) for i in range(340)]
    got = sorted(tuple(r) for r in vectors.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3, every=5).collect())
    cells = {i: np.floor(1024 * np.array(x)).astype(np.int64) for i, x in rows}
    want = []
    for q in range(0, 340, 5):
        order = sorted((-(cells[q] @ cells[v]), v) for v in cells if v != q and len(cells[v]) == len(cells[q]))[:3]
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(order)]
    assert got == sorted(want)


def test_top_k_of_many_queries(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((17_000, 2)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in vectors.top_k(df, k=1, every=1).collect():
        got[r.query_id] = (r.vec_id, r.score)
    cells = np.floor(1024 * x).astype(np.int64)
    assert len(got) == len(x)
    for q in range(0, len(x), 97):
        score = cells @ cells[q]
        score[q] = np.iinfo(np.int64).min
        assert got[q] == (int(score.argmax()), int(score.max()))


@pytest.mark.parametrize("kind", ["int", "smallint", "bigint"])
def test_key_types_and_magnitudes(spark, kind):
    """Keys of any whole type; vectors whose products pass 64 bits have no score, however large they are."""
    x = [[1.0, 0.5, 0.25], [1.0, 0.5, 0.26], [-1.0, 2.0, 0.0], [1e5, -2e5, 3e5], [1e300, -1e300, 1.0], [1e18, 1e18, 1.0], [3e8, 0.0, 0.0], [1e-300, 1e-300, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), f"vec_id {kind}, embedding array<double>")
    near = vectors.near_duplicates(df)
    assert dict(near.dtypes)["vec_id"] == dict(near.dtypes)["component_id"] == kind
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near.collect() if r.n_links) == [(i, 3, 0) for i in (0, 1, 5, 7)]
    cells = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in enumerate(x) if max(map(abs, v)) * 1024 < (2.0**60 / 3) ** 0.5}
    assert set(cells) == {0, 1, 2, 3, 7}
    want = []
    for q in cells:
        order = sorted((-int(cells[q] @ cells[v]), v) for v in cells if v != q)
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(order)]
    assert sorted(tuple(r) for r in vectors.top_k(df, every=1).collect()) == sorted(want)
