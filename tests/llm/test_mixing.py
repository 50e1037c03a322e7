"""Mixing held against plain water filling, whole blocks and permutations."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sonoframe.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, sid string, begin string, src string"


def plain_targets(sizes, cap=3):
    """Targets by sharing the excess again and again; sources in order, null last."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (total - sum(cap * sizes[s] for s in full)) / free if free else 0
        above = {s for s in names if s not in full and cap * sizes[s] < weight[s] * level}
        if not above:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= above


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(400):
        source = ["b", None, "a", "é", "tiny", "hot"][0 if i % 7 == 1 else 1 if i % 7 == 2 else 2 if i % 11 == 3 else 3 if i % 13 == 4 else 5]
        rows.append((i, " ".join(f"w{j}" for j in range(i % 90 * 7)), source, "x", "y", "z"))
    rows += [(900, "one two  three\n\tfour ", "tiny", "x", "y", "z"), (901, "five", "", "x", "y", "z")]
    rows += [rows[50], rows[50], (902, None, "hot", None, None, None), (None, "no key here", "hot", None, None, None), (903, " \t\n", "hot", "", "", "")]
    rows.append((904, "long " * 30000, "hot", "", "", ""))
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_sizes_and_cap(docs):
    mixed, rows = mixing.mixture(docs)
    rows, pieces = rows.collect(), mixed.collect()
    given = docs.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], count(r["text"])) for r in given)
    sizes = Counter()
    for r in given:
        sizes[r["source"]] += count(r["text"])
    targets = plain_targets(sizes)
    assert targets["tiny"] == 3 * sizes["tiny"]
    taken, used = Counter(), Counter()
    for p in pieces:
        taken[p["sid"]] += p["length"]
        used[p["sid"], p["begin"]] += p["length"]
    for r in rows:
        source = None if r["src"] == "1" else r["src"][1:]
        assert r["source_size"] == sizes[source] and abs(r["target"] - targets[source]) < 1e-6 * max(1, targets[source])
        assert abs(taken[r["sid"]] - targets[source]) <= 64
        assert used[r["sid"], r["begin"]] <= 3 * r["size"]


def test_slots_hold_whole_blocks_and_passes_are_permutations(docs):
    mixed, rows = mixing.mixture(docs, block=16, shard=100)
    begins = defaultdict(list)
    for r in rows.collect():
        if r["size"]:
            begins[r["sid"]].append((r["begin"], r["begin"] + r["size"]))
    for ranges in begins.values():  # documents tile their source
        ranges.sort()
        assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    by_slot = defaultdict(list)
    for p in mixed.collect():
        assert p["shard"] == p["slot"] // 100
        by_slot[p["slot"]].append((p["sid"], p["begin"] + p["start"], p["length"]))
    assert sorted(by_slot) == list(range(len(by_slot)))
    uses = defaultdict(Counter)
    for slot in by_slot.values():
        slot.sort()
        assert len({x[0] for x in slot}) == 1 and slot[0][1] % 16 == 0
        assert all(a[1] + a[2] == b[1] for a, b in zip(slot, slot[1:]))
        whole = sum(x[2] for x in slot)
        assert whole == 16 or slot[-1][1] + slot[-1][2] == begins[slot[0][0]][-1][1]
        uses[slot[0][0]][slot[0][1] // 16] += 1
    for sid, counts in uses.items():
        blocks = -(-begins[sid][-1][1] // 16)
        each = sum(counts.values()) / blocks
        assert all(int(each) <= counts[b] <= -(-sum(counts.values()) // blocks) for b in range(blocks))


def test_shards_vary_and_reruns_agree(docs):
    first, again = ({tuple(r) for r in mixing.mixture(docs.repartition(n), shard=50)[0].drop("start").collect()} for n in (3, 7))
    assert first == again
    per_shard = defaultdict(Counter)
    for r in {(r[0], r[1], r[4]) for r in first}:
        per_shard[r[0]][r[2]] += 1
    assert len({tuple(sorted(x.items())) for x in per_shard.values()}) > 3


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    maps = []
    for salt in range(2):
        rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), [F.lit(salt)], 5).alias("to")).collect()
        assert sorted(r["to"] for r in rows) == list(range(n))
        maps.append([r["to"] for r in rows])
    if n >= 97:
        assert maps[0] != maps[1] and sum(i == x for i, x in enumerate(maps[0])) < 12


def test_empty(spark):
    for rows in ([], [(1, None, None, None, None, None), (2, " ", "a", None, None, None)]):
        mixed, out = mixing.mixture(spark.createDataFrame(rows, SCHEMA))
        assert mixed.count() == 0 and [(r["size"], r["target"]) for r in out.collect()] == [(0, 0.0)] * len(rows)
