"""Byte-level BPE: encoding in numpy merge rounds over many words, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sonoframe.llm.common import ragged_index, sums, text_buffer, text_slices, with_fields
from sonoframe.llm.tokens import PieceMemory, split_pieces, words_after_space

#: Bytes of a word above which its merges follow a list of ranks, since rounds over the whole word would be too many.
LONG = 256
#: The byte-level pattern that splits a text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class ByteBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        letters = byte_letters()
        to_byte = {x: b for b, x in enumerate(letters)}
        vocab = read["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in read["added_tokens"] if x["special"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.hint = re.compile("|".join({re.escape(x[:2]) for x in self.special}) or "(?!)").search
        self.first = np.array([vocab[x] for x in letters], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in read["model"]["merges"]]
        self.n = 1 + max([*vocab.values(), *self.special.values()])
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        spelled = [b""] * self.n
        for token, i in vocab.items():
            spelled[i] = bytes(to_byte[x] for x in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.fromiter(map(len, spelled), np.int64, self.n)
        self.start = np.cumsum(self.length) - self.length
        self.memory = PieceMemory(self.encode_pieces)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted pair keys; no merge: the number of merges."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of many words, held in one flat array; every word has one at least.

        In each round every word merges its lowest-ranked pair, from left to
        right wherever it occurs; words without a pair are set aside. Words of
        more than ``LONG`` symbols go to :meth:`merge_long`.
        """
        none = len(self.keys)
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_word = [], []
        far = np.repeat(lengths > LONG, lengths)
        if far.any():
            found, place = self.merge_long(symbols[far], word[far])
            done_symbols.append(found)
            done_word.append(place)
            symbols, word = symbols[~far], word[~far]
        while len(symbols):
            rank = np.full(len(symbols), none)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            count = np.diff(np.append(begins, len(symbols)))
            lowest = np.minimum.reduceat(rank, begins)
            live = np.repeat(lowest < none, count)
            done_symbols.append(symbols[~live])
            done_word.append(word[~live])
            symbols, word, rank = symbols[live], word[live], rank[live]
            if not len(symbols):
                break
            hit = rank == np.repeat(lowest, count)[live]
            # in a run of hits ("aaa" for a pair "aa") every other one merges
            at = np.arange(len(hit))
            place = at - np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
            hit &= place % 2 == 0
            symbols = symbols.copy()
            symbols[hit] = self.merged[rank[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate([symbols, *done_symbols]), np.concatenate([word, *done_word])
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(lengths))

    def merge_long(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of long words, lowest rank first over all of them; symbols that remain, and their words.

        A round merges all pairs of one rank. Merged symbols stand in a linked
        list, and only pairs beside a merge are looked up anew, so that the work
        grows with the number of merges.
        """
        n, none = len(symbols), len(self.keys)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
        after[last] = n
        before[last[:-1] + 1] = -1
        alive, rank = np.ones(n, bool), np.full(n, none)
        waiting: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def look_up(at: np.ndarray) -> None:
            rank[at] = none
            at = at[after[at] < n]
            rank[at] = self.ranks(symbols[at], symbols[after[at]])
            at = at[rank[at] < none]
            at = at[np.argsort(rank[at], kind="stable")]
            some, begin = np.unique(rank[at], return_index=True)
            for r, part in zip(some.tolist(), np.split(at, begin[1:]), strict=False):
                if r not in places:
                    heapq.heappush(waiting, r)
                places.setdefault(r, []).append(part)

        look_up(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # in a run of hits every other one merges
            begins = np.append(True, after[at[:-1]] != at[1:])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
            right = after[at]
            symbols[at] = self.merged[r]
            alive[right] = False
            after[at] = after[right]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            look_up(np.unique(np.concatenate([at, left[left >= 0]])))
        return symbols[alive], word[alive]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each piece of text.

        Special strings are ids of their own; the rest is split into words.
        """
        words: list[str] = []
        held = []  # words of each piece
        special: list[tuple[int, int]] = []  # place among the words, id
        for piece in pieces:
            before = len(words)
            if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
                words.append(piece)
            else:
                for part in self.cut.split(piece) if self.cut and self.hint(piece) else [piece]:
                    if part in self.special:
                        special.append((len(words), self.special[part]))
                        words.append(" ")
                    else:
                        words += WORD.findall(part)
            held.append(len(words) - before)
        column = pa.array(words, pa.large_string()).dictionary_encode()
        flat, offsets = text_buffer(column.dictionary)
        symbols, counts = self.merge(self.first[flat], np.diff(offsets))
        code = column.indices.to_numpy()
        if special:  # a word of its own for each special id
            places, ids = map(np.array, zip(*special, strict=True))
            code = code.astype(np.int64)
            code[places] = len(counts) + np.arange(len(ids))
            symbols, counts = np.concatenate([symbols, ids]), np.concatenate([counts, np.ones(len(ids), np.int64)])
        length = counts[code]
        ids = symbols[ragged_index((np.cumsum(counts) - counts)[code], length)].astype(np.uint32)
        return ids, sums(length, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(held, np.int64))]))

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffer(column)
        return split_pieces(self.memory, data, offsets, words_after_space)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        slots, at = self.pieces(pa.array(texts, pa.string()))
        memory = self.memory
        return [memory.ids[ragged_index(memory.start[x], memory.length[x])] for x in np.split(slots, at[1:-1])] if texts else []

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, special tokens included."""
        ids = ids.astype(np.int64)
        return self.bytes[ragged_index(self.start[ids], self.length[ids])].tobytes()


_loaded: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``out``, the array of ids of the whole text.

    A null or empty text has no ids. A column named as ``out`` is replaced. Rows
    are independent: repeated rows, nulls and extra columns pass through.
    """
    docs = docs.drop(out)
    fields = with_fields(docs, f"`{out}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for i, j in text_slices(batch.column(text)):
                part = batch.slice(i, j - i)
                slots, at = bpe.pieces(part.column(text))
                length = bpe.memory.length[slots]
                flat = bpe.memory.ids[ragged_index(bpe.memory.start[slots], length)].astype(np.int32)
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])[at]
                made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return docs.mapInArrow(run, fields)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and ``out``, the text of the array ``ids`` (null: null).

    Bytes that aren't UTF-8 become replacement characters.
    """
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(run, with_fields(docs, f"`{out}` string"))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, SHA-256 of the ids and of the text decoded from them.

    Distinct pieces are encoded once, and decoded once from their ids, in each worker.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for i, j in text_slices(batch.column(text)):
                part = batch.slice(i, j - i)
                slots, at = bpe.pieces(part.column(text))
                used, where = np.unique(slots, return_inverse=True)
                memory = bpe.memory
                flat = memory.ids[ragged_index(memory.start[used], memory.length[used])]
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(memory.length[used])])
                spelled = list(map(str, flat.tolist()))
                size = bpe.length[flat]
                back = bpe.decode(flat)
                cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[ends].tolist()
                ends = ends.tolist()
                listed = np.array([",".join(spelled[a:b]).encode() for a, b in zip(ends, ends[1:], strict=False)], object)
                decoded = np.array([back[a:b] for a, b in zip(cut, cut[1:], strict=False)], object)
                listed, decoded = listed[where], decoded[where]
                lengths = memory.length[slots]
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[at]
                rows = list(zip(at.tolist(), at[1:].tolist(), strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array(np.diff(total)),
                        pa.array([hashlib.sha256(b",".join(listed[a:b])).hexdigest() for a, b in rows], pa.string()),
                        pa.array([hashlib.sha256(_valid(b"".join(decoded[a:b]))).hexdigest() for a, b in rows], pa.string()),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _valid(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").encode()


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
