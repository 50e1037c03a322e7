"""Token ids of many texts at once, one encoding for each distinct piece of text."""

from __future__ import annotations

import hashlib
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sonoframe.llm.common import ragged_index, sums, text_buffer

#: Distinct pieces that a Python worker remembers, and their characters; beyond either it starts afresh.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[_SPACE] = 32
_LOWERED = _BLANKED.copy()
_LOWERED[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOPS = b".,;:!?"
_STOP = np.zeros(256, bool)
_STOP[list(_STOPS)] = True


def version(path: str) -> str:
    """Digest that names the vocabulary and the library that reads it."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.encode()).hexdigest()


def drops_space(path: str) -> bool:
    """Whether the tokenizer is known to bound its rules by white space, in lower case.

    That is: white space is squeezed, case is folded after composing (NFC), only
    letters, numbers and other characters in runs of their own kind become words,
    and no special string holds a character of ``_STOPS``.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    split = [x for x in (read["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
    steps = (read["normalizer"] or {}).get("normalizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": "\\s+"}
        and steps[1]["content"] == " "
        and bool(split)
        and split[0]["behavior"] == "Removed"
        and split[0]["invert"]
        and split[0]["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and all(x["content"].startswith("<|") and not set(x["content"]) & set(_STOPS.decode() + " ") for x in read["added_tokens"])
    )


def folded(data: np.ndarray) -> np.ndarray:
    """White space as spaces, and ASCII in lower case where that can't change an id.

    Lower case waits for the library if a special string may occur or a
    combining mark may compose with a letter of one case only.
    """
    plain = b"<|" not in memoryview(data).tobytes() and not np.isin(data, (0xCC, 0xCD)).any()
    return (_LOWERED if plain else _BLANKED)[data]


def words_and_stops(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces: words, the white space between them, and stops after ASCII letters."""
    space = _SPACE[data]
    start = np.ones(len(data), bool)
    start[1:] = space[1:] != space[:-1]
    start[1:] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


def words_after_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces: a single space and what follows it up to the next such space.

    A space counts where white space neither ends before it nor goes on after it;
    there the byte-level pattern always begins a new word, which holds the space.
    Bytes that may begin a white space character of several bytes (C2, E1, E2,
    E3) after it count as white space.
    """
    start = data == 32
    space = _SPACE[data]
    start[1:] &= ~space[:-1]
    start[:1] = False
    after = space | np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))
    start[:-1] &= ~after[1:]
    start[-1:] = False
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


#: A control character that stands between pieces; pieces that hold it are encoded alone.
MARK = "\x01"


class PieceMemory:
    """Ids of distinct pieces in one flat array.

    ``encode`` takes a list of pieces and returns all ids and the length of each piece's.
    """

    def __init__(self, encode):
        self.encode = encode
        self.forget()

    def forget(self):
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.ids = np.zeros(0, np.uint32)
        self.length = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)

    def slots(self, pieces: list[str]) -> np.ndarray:
        if len(self.slot) + len(pieces) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        known = self.slot
        new = [x for x in pieces if x not in known]
        if new:
            self.chars += sum(map(len, new))
            flat, lengths = self.encode(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


class Encoder:
    """Ids of whole texts as the library gives them, without added special tokens.

    Where white space bounds all its rules, the library sees each distinct word
    once; else it sees whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_padding()
            library.no_truncation()
            self.whole = lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        self.memory = None
        if drops_space(path):
            self.memory = PieceMemory(self.joined)
            self.mark = np.array(self.whole([MARK])[0], np.uint32)

    def joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that the library sees many at a time, parted by a mark that is a word of its own."""
        if len(self.mark) != 1 or any(MARK in x for x in pieces):
            each = self.whole(pieces)
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(lengths.sum())), lengths
        parts = self.whole([f" {MARK} ".join(["", *pieces[i : i + 100]]) for i in range(0, len(pieces), 100)])
        flat = np.concatenate([np.asarray(x, np.uint32) for x in parts])
        mark = flat == self.mark[0]
        at = np.flatnonzero(mark)
        return flat[~mark], np.diff(np.append(at, len(flat))) - 1

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slot in the memory of every piece, and each text's offset among the pieces."""
        data, offsets = text_buffer(column)
        return split_pieces(self.memory, folded(data), offsets, words_and_stops)

    def counts(self, column: pa.Array) -> np.ndarray:
        if self.memory is None:
            return np.fromiter(map(len, self.whole(pc.fill_null(column, "").to_pylist())), np.int64, len(column))
        slots, at = self.pieces(column)
        return sums(self.memory.length[slots], at)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offset of each text."""
        if self.memory is None:
            each = self.whole(pc.fill_null(column, "").to_pylist())
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, np.uint32) for x in each)])
        else:
            slots, at = self.pieces(column)
            length = self.memory.length[slots]
            flat = self.memory.ids[ragged_index(self.memory.start[slots], length)]
            lengths = sums(length, at)
        return flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def split_pieces(memory: PieceMemory, data: np.ndarray, offsets: np.ndarray, starts_of) -> tuple[np.ndarray, np.ndarray]:
    """Cut the texts into pieces and look up the distinct ones."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts = starts_of(data, offsets)
    bounds = np.append(starts, len(data))
    at = np.searchsorted(starts, offsets)
    cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    coded = cut.dictionary_encode()
    slots = memory.slots(coded.dictionary.to_pylist())
    return slots[coded.indices.to_numpy()], at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
