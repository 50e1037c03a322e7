"""Token counts, byte BPE and packing against the library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonoframe.llm import byte_bpe, packing, token_counts, tokens

TEXTS = [
    None, "", " ", "\xa0 \xa0foo bar\xa0 baz", "a  b\n\n c\t d <|endoftext|> x<|endoftext|>y", "It's we'll DON'T I'M", "é ê ñ 　x   y", "aaaa aaaaaaaa ababab!!!???",
    "x" * 5000, "日本語 テスト 한국어", "<|startoftext|> hi<|STARTOFTEXT|>", "é É H̱", "Σας ΣΑΣ İ", "\x1c\x1d a\x85b \x01", "😀 👩‍👩‍👧 12345 6.7", "end \n", " a  b ", "tab\t tab", "word, word. word!?; don't,", "same text", "same text", "long " * 3000,
]
WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))


def library(path):
    found = Tokenizer.from_file(path)
    return [found.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, x, 7, "kept") for i, x in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, digest string")


def test_encoder_equals_library():
    flat, at = tokens.Encoder(WORD).ids(pa.array(TEXTS, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library(WORD)


def test_counts_fill_and_use_the_cache(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    want = sorted(map(len, library(WORD)))
    for _ in range(2):
        got = token_counts.token_counts(docs, WORD, cache)
        assert sorted(r.n_tokens for r in got.collect()) == want
        assert "digest" in got.columns
        assert spark.read.parquet(cache).count() == len({" ".join((x or "").replace("\xa0", "N").split()) for x in TEXTS if "\x1c" not in (x or "")}) + 1
    spark.createDataFrame([], docs.schema)
    assert token_counts.token_counts(docs.limit(0), WORD, cache).count() == 0
    whole = token_counts.token_counts(docs, BYTE, cache, normalise=lambda x: x)
    assert sorted(r.n_tokens for r in whole.collect()) == sorted(map(len, library(BYTE)))


def test_counts_come_from_the_cache(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.token_counts(docs, WORD, cache)
    stored = spark.read.parquet(cache).toPandas()
    stored["n_tokens"] += 1000
    other = str(tmp_path / "other")
    spark.createDataFrame(stored, token_counts.CACHE_SCHEMA).write.parquet(other)
    got = token_counts.token_counts(docs, WORD, other)
    assert min(r.n_tokens for r in got.collect()) >= 1000


def test_byte_bpe_round_trip(spark, docs):
    want = library(BYTE)
    encoded = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, BYTE), BYTE)
    got = {(r.doc_id, r.text): (list(r.ids), r.decoded) for r in encoded.collect()}
    assert got == {(i if i != 3 else None, x): (ids, x or "") for i, (x, ids) in enumerate(zip(TEXTS, want, strict=True))}
    rows = {r.doc_id: r for r in byte_bpe.digests(docs, BYTE).collect()}
    for i, ids in enumerate(want):
        r = rows[i if i != 3 else None]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[i] or "").encode()).hexdigest()
    assert byte_bpe.digests(docs.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("windows", [1, 4])
def test_packing_is_whole(docs, windows):
    pieces = packing.pack(docs.repartition(3), WORD, size=256, windows=windows).toPandas()
    want = {i if i != 3 else -1: np.array([*ids, 1], "<u4") for i, ids in enumerate(library(WORD))}
    pieces["doc_id"] = pieces["doc_id"].fillna(-1).astype(int)
    for doc, rows in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for r in rows.itertuples():
            assert (r.start, r.doc_tokens) == (at, len(want[doc]))
            assert r.ids_crc32 == zlib.crc32(want[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[doc])
    assert set(pieces.doc_id) == set(want)
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        total = rows.length.sum()
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        assert total <= 256 and total & (total - 1) == 0  # full or a power of two: no padding
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_long_words():
    rng = np.random.default_rng(3)
    letters = "".join(rng.choice(list("abcdefghijklmnoprstuvwxyzéñ"), 300_000))
    texts = [letters, "ab" * 400 + "a" * 301, " " + "x" * 70_000, "the" * 500 + " and " + letters[:1000], "=-" * 5000, "日本" * 2000]
    found = byte_bpe.byte_bpe(BYTE).encode(texts)
    whole = Tokenizer.from_file(BYTE)
    assert [x.tolist() for x in found] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_only_asked_counts_are_read(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.token_counts(docs, WORD, cache)
    other = spark.createDataFrame([(1, "some new text", 0, ""), (2, None, 0, ""), (3, "some  new text", 0, "")], docs.schema)
    before = spark.read.parquet(cache).count()
    got = token_counts.token_counts(other, WORD, cache)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == [(1, 3), (2, 0), (3, 3)]
    assert spark.read.parquet(cache).count() == before + 1


def test_counts_keep_columns_named_as_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "two words", "mine", "too")], "doc_id bigint, text string, digest_of_content string, digest_of_content_ string")
    row = token_counts.token_counts(docs, WORD, str(tmp_path / "cache")).first()
    assert (row.digest_of_content, row.digest_of_content_, row.n_tokens) == ("mine", "too", 2)


def test_memory_of_long_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_CHARS", 50)
    encoder = tokens.Encoder(WORD)
    for x in [*TEXTS, *TEXTS]:
        flat, _ = encoder.ids(pa.array([x], pa.string()))
        assert flat.tolist() == library(WORD)[TEXTS.index(x)]
    assert encoder.memory.chars <= 50 + max(len(x or "") for x in TEXTS)


def test_open_windows_hold_their_own_ids_only():
    held = []
    packer = packing.Packer(8, 3, held.append, lambda piece, begin, end: piece[begin:end].tobytes())
    for n in (5, 7, 3, 30, 2, 6):
        packer.add(np.arange(n, dtype="<u4"), 0, n)
    parts = [x for window in [*held, *packer.leftovers()] for x in window]
    assert all(isinstance(x, bytes) for x in parts) and sum(map(len, parts)) == 4 * 53
