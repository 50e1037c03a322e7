"""Spelling variants held against edit distances and plain counts."""

import random
import re
import zlib
from collections import Counter

import pytest

from sonoframe.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(n):
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 10 * n[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("cell,leaf", [(4096, 64), (40, 4)])
def test_variants(spark, monkeypatch, cell, leaf):
    """Also with many small cells, where most near words meet in the cell of another word."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    draw = random.Random(5)
    n = {}
    for _ in range(120):
        word = "".join(draw.choice("abcdeéÉß") for _ in range(draw.randrange(1, 10)))
        for _ in range(draw.randrange(6)):
            at = draw.randrange(len(word) + 1)
            n[word] = draw.choice([2, 3, 20, 30, 300, 3000, 10**12])
            word = draw.choice([word[:at] + "x" + word[at:], word[:at] + word[at + 1 :], word[:at] + "q" + word[at + 1 :], word[::-1], "".join(sorted(word))]) or "a"
    n |= {"日本語": 2, "日木語": 20, "z" * 3000: 5, "z" * 2999: 500, "𝒳ab": 3, "ab": 30}
    got = spelling.variants(spark.createDataFrame([(w, c, "x") for w, c in n.items()] + [(None, 3, "y"), ("none", None, "y")], "word string, n bigint, best string"))
    assert rows_of(got) == plain(n)


def test_many_words_of_the_same_letters(spark, monkeypatch):
    """Where words share their letter counts, edited forms are looked up."""
    monkeypatch.setattr(spelling, "LEAF", 2)
    n = {format(i, "010b").replace("0", "a").replace("1", "b"): 2 + i % 7 for i in range(1024)}
    n |= {w[1:]: 40 for w in list(n)[::5]}
    assert rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint"))) == plain(n)


def test_word_counts(spark):
    low, rows = "Mispellingss", []
    for i in range(300):
        rows.append((i, f"{low} ÀÉÎÕÜßÿ×÷ x{low}9abcdefg-HIJKLMN abcdef\n{low.lower()}ā"))
    rows += [rows[3], (None, "nokeyword nokeyword"), (7000, None), (7001, ""), (7002, "abcdefgh" * 40000), (7003, "abcdefgh" * 40000)]
    for damage in (31, None):
        want = Counter()
        for key, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                word = run.translate(LOW)
                h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
                if damage and h % damage == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                if len(word) >= 7:
                    want[word] += 1
        docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id bigint, text string, word string, key string")
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs.repartition(3), damage=damage).collect()}
        assert got == {w: c for w, c in want.items() if c >= 2}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.word_counts(docs)).collect() == []
