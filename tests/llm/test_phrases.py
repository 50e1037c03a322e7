"""Collocations and the graph behind them held against plain counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, a string, f string, part string, n string"


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW))]


def counts(rows):
    f = defaultdict(Counter)
    for lang, text in rows:
        for ws in pieces(text):
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def plain(rows, top=2000):
    out = set()
    for lang, f in counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < 10:
                continue
            if len(p) == 2 and any(100 * f[q] >= 50 * a for q in f if len(q) == 3 and f[q] >= 10 and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -s))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    words = ["the", "of", "a", "é", "ÉÉ", "x\x01y", " ", "New", "york", "日本"] + [f"w{i}" for i in range(30)]
    made = []
    passage = "One long passage of words, which many texts repeat from its first word to the last one and then some"
    for i in range(160):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(draw.randrange(80)))
        made.append(((None, "en", "de", "und")[i % 4], text + (passage if i % 5 == 0 else "") + ("New york city " if i % 3 else "")))
    made += [("en", None), ("en", ""), (None, "..."), ("en", "a a a a a a a a a a a a a a"), ("en", "b " * 20000), made[0], made[0]]
    return made


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", None) for i, (lang, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("top", [2000, 7])
def test_equals_plain_counts(spark, rows, top):
    got = phrases.collocations(frame(spark, rows).repartition(5), top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain(rows, top)


def test_frequent_pairs_are_spread(spark, rows, monkeypatch):
    """The same graph whether pairs of frequent words are dealt by edge or by node."""
    few, many = ({tuple(r) for r in phrases.collocations(frame(spark, rows)).collect()} for share in (1, 10**6) if not monkeypatch.setattr(phrases, "SHARE", share))
    assert few == many == plain(rows)


def test_paths_are_the_unary_ones(spark, rows):
    graph = phrases.Graph(frame(spark, rows), 10)
    spelt = {(r["lang"], r["h"]): r["word"] for r in graph.spelt.collect()}
    f = counts(rows)
    edges = {(r["lang"], *(spelt[r["lang"], r[c]] for c in "abc")): r["f"] for r in graph.edges.collect()}
    assert edges == {(lang, *p): c for lang in f for p, c in f[lang].items() if len(p) == 3 and c >= 10}
    assert {(r["lang"], spelt[r["lang"], r["a"]]): r["f"] for r in graph.words.collect()} == {(lang, p[0]): c for lang in f for p, c in f[lang].items() if len(p) == 1 and c >= 10}
    unary = {e for e, c in edges.items() if c == f[e[0]][e[1:3]] == f[e[0]][e[2:]]}
    seen = set()
    paths = phrases.compacted(graph.edges, graph.nodes).collect()
    for r in paths:
        words = [spelt[r["lang"], x] for x in r["path"]]
        own = {(r["lang"], *words[i : i + 3]) for i in range(len(words) - 2)}
        assert own <= unary and not own & seen and all(edges[e] == r["f"] for e in own)
        seen |= own
    assert seen == unary and max(len(r["path"]) for r in paths) > 10
    ends = [(r["lang"], tuple(r["path"][-2:])) for r in paths]
    starts = {(r["lang"], tuple(r["path"][:2])) for r in paths}
    assert len(set(ends)) == len(ends) and not starts & set(ends)  # none could be longer


def test_scores_of_very_many(spark):
    a, left, right = 10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 9
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 1000000 * a * a // (left * right)


def test_sums_when_keys_collide(monkeypatch):
    monkeypatch.setattr(phrases, "mix", lambda x: x & np.uint64(1))
    x, y = np.array([1, 2, 1, 3, 2, 1]), np.array([5, 6, 5, 5, 6, 7])
    (a, b), f = phrases.summed([x, y], np.ones(6, np.int64))
    assert sorted(zip(a.tolist(), b.tolist(), f.tolist(), strict=True)) == [(1, 5, 2), (1, 7, 1), (2, 6, 2), (3, 5, 1)]


def test_empty(spark):
    for rows in ([], [("en", None), (None, "")]):
        assert phrases.collocations(frame(spark, rows)).collect() == []
