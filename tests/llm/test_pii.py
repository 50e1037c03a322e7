"""Personal data against plain regular expressions, and terms that reveal it."""

import collections
import hashlib
import math
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoframe.llm import pii

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="a1.@+-( )0%_4\n", max_size=60) | st.from_regex("(" + ")|(".join(PLAIN) + ")", alphabet=st.characters(max_codepoint=127)))
@settings(max_examples=1500, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_base_examples():
    text = "ä x@a.b@c.d 1.2.3.4.5.6.7.8 and 4111 1111-1111 1111 or +1 (017) 555-7713 or 300.1.1.1 001.2.3.4"
    assert pii.base_spans(text) == brute(text) and {k for k, *_ in brute(text)} == {0, 1, 2, 3}
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 100_000 + "@") == []


ROWS = [
    *((i, f"Please write to Zorbat {w} at jo.doe@mail.example.com about {w}") for i, w in enumerate(["tea", "milk", "wine", "beer"])),
    (10, "Please ask Zorbat himself"), (11, None), (12, ""), (12, ""), (13, "Please write to someone about tea and milk, wine, beer at home"), (None, "at +1 (017) 555-7713"),
    *((20 + i, f"Please write about {w} at other{i}@mail.example.com") for i, w in enumerate(["tea", "milk", "wine", "beer"])),
    *((40 + i, f"clean text {i}") for i in range(200)),
]


@pytest.mark.parametrize("few", [True, False])
def test_terms(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "'x' AS term", "1 AS kind")
    got = {(r.doc_id, r.text): r for r in pii.sanitise(docs).collect()}
    assert got[(10, ROWS[4][1])].pii_text == "Please ask [TERM] himself"
    assert got[(13, ROWS[8][1])].pii_text == ROWS[8][1] and got[(11, None)].pii_text is None
    assert got[(0, ROWS[0][1])].pii_text == "Please write to [TERM] tea at [EMAIL] about tea"
    assert [s.kind for s in got[(None, "at +1 (017) 555-7713")].pii_spans] == ["phone"]
    assert all(got[(40 + i, f"clean text {i}")].pii_spans == [] for i in range(200))
    rows = pii.digests(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = next(t or "" for i, t in ROWS if i == r.doc_id)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(text))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert pii.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("footer", ["", "\nContact Zorbat at jo@x.com"])
def test_all_contexts_count(spark, footer):
    rows = [(f"Ask Zorbat {w} jo@x.com{footer}",) for w in ["tea", "milk", "wine", "beer", "rum"]] + [(f"clean text {i}",) for i in range(200)]
    found = pii.revealing_terms(spark.createDataFrame(rows, "text string")).collect()
    assert [(r.term, r.entity, r.p_entity) for r in found if r.term == "zorbat"] == [("zorbat", "email:jo@x.com", 1.0)]


def test_contexts_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(pii, "HELD", 1)
    one = "\n".join(f"Ask Zorbat {w} jo@x.com" for w in ["tea", "milk", "wine"])
    rows = [(one,)] + [(f"clean text {i}",) for i in range(200)]
    found = {r.term: r for r in pii.revealing_terms(spark.createDataFrame(rows, "text string")).collect()}
    assert set(found) == {"ask", "zorbat"} and found["zorbat"].p_entity == 1.0
    assert not pii.revealing_terms(spark.createDataFrame([("Ask Zorbat jo@x.com",)] * 9 + rows[1:], "text string")).count()


@given(st.lists(st.sampled_from([" ", "\n", "w" * 150, "ab", "a@b.co", "\x0b", ";"]), max_size=60), st.integers(1, 8))
@settings(max_examples=500, deadline=None)
def test_words(parts, window):
    text = "".join(parts)
    for at in range(0, len(text) + 1, 7):
        assert pii.words_before(text, at, window) == text[:at].rpartition("\n")[2].split()[-window:]
        assert pii.words_after(text, at, window) == text[at:].partition("\n")[0].split()[:window]


def test_long_words():
    far = ["x" * 200 + str(i) for i in range(8)]
    (_, words, _), = pii.contexts(f"no {' '.join(far)} jo@x.com {' '.join(far).upper()} no", 8)
    assert words == set(far)
    glued = list(pii.contexts(";".join(f"me{i}@x.com" for i in range(20_000)), 8))
    assert len(glued) == 20_000 and glued[9][1] == {"com", *(f"me{i}" for i in range(1, 17) if i != 9)}
    text, spans = pii.parted("a@b.co;c@d.com,1.2.3.4 e@f.org")
    assert text == "a@b.co; c@d.com, 1.2.3.4 e@f.org" and [text[a:b] for _, a, b in spans] == ["a@b.co", "c@d.com", "1.2.3.4", "e@f.org"]


def plain_terms(texts, window=8, least=3, posterior=0.8, bits=4.0):
    """(term, entity): (share, bits) counted one by one."""
    met, pair, rows, holds = collections.defaultdict(set), collections.Counter(), collections.Counter(), collections.Counter()
    for text in texts:
        text = text or ""
        holds.update({w.lower() for w in re.findall(r"\w{3,}", text)})
        spans, shift, last, spaced = [], 0, None, text
        for kind, a, b in sorted(brute(text), key=lambda x: x[1:]):
            if last is not None and last <= a and not re.search(r"\s", text[last:a]):
                spaced = spaced[: a + shift] + " " + spaced[a + shift :]
                shift += 1
            spans.append((kind, a + shift, b + shift))
            last = max(last or 0, b)
        near = set()
        for kind, a, b in spans:
            value = spaced[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", spaced[a:b])
            name = ["email", "ip", "card", "phone"][kind] + ":" + value
            around = (tuple(spaced[:a].split("\n")[-1].split()[-window:]), tuple(spaced[b:].split("\n")[0].split()[:window]))
            for t in {w.lower() for x in around for w in re.findall(r"\w{3,}", " ".join(x))}:
                met[t, name].add(around)
                near.add((t, name))
            near.add((None, name))
        pair.update(x for x in near if x[0])
        rows.update(name for t, name in near if t is None)
    out = {}
    for (t, name), contexts in met.items():
        share = pair[t, name] / holds[t]
        told = math.log2(share * len(texts) / rows[name])
        if len(contexts) >= least and share >= posterior and told >= bits:
            out[t, name] = (share, told)
    return out


def test_terms_equal_plain_counts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [t for _, t in ROWS] + [f"Call Quentin {w} +44 (20) 7946 0958;quentin@x.org {w}" for w in ("now", "then", "soon", "later")]
    found = pii.revealing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = plain_terms(texts)
    assert {(r.term, r.entity) for r in found} == set(want) and ("quentin", "phone:442079460958") in want
    for r in found:
        assert (r.p_entity, r.bits) == pytest.approx(want[r.term, r.entity])


def test_terms_outside_base_spans():
    """Also with very many of both in one text: both lists are walked once."""
    text = "quentin@x.org quentin +44 (20) 7946 0958quentin quentin" * 3
    base = brute(text)
    want = [m.span() for m in re.finditer(r"\w{3,}", text) if m[0] == "quentin" and not any(m.start() < d and c < m.end() for _, c, d in base)]
    assert [(a, b) for k, a, b in pii.all_spans(text, {"quentin"}) if k == 4] == want and want
    many = "jo@x.com quentin " * 100_000
    began = time.time()
    assert len(pii.all_spans(many, {"quentin"})) == 200_000 and time.time() - began < 20


@pytest.mark.parametrize("room", [1 << 20, 3])
def test_terms_too_long_to_send(spark, monkeypatch, room):
    docs = spark.createDataFrame([(i, f"Call Quentin {w} +44 (20) 7946 0958") for i, w in enumerate(("now", "then", "soon", "later"))] + [(9 + i, "x") for i in range(100)], "doc_id bigint, text string")
    told = spark.createDataFrame([("quentin", "phone:442079460958", 1.0, 5.0)], "term string, entity string, p_entity double, bits double")
    monkeypatch.setattr(pii, "BROADCAST_BYTES", room)
    got = {r.doc_id: r.pii_text for r in pii.sanitise(docs, revealing=told).collect()}
    assert got[0] == "Call  now [PHONE]" and got[10] == "x" and len(got) == 104
