"""Spelling variants: words one edit apart, found in k-d trees over letter counts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import ragged_index, stash, text_buffer, text_slices, trimmed

#: Dimensions of a letter-count vector: a to z, then U+00C0 to U+00FF; other characters share them.
LETTERS = 90
#: Words of one cell of the trees that deal words to tasks, about.
CELL = 4096
#: Words, those of the smallest hashes, that these trees are built from. They settle only who meets where; all words are dealt.
SAMPLE = 65536
#: Points of a leaf.
LEAF = 64
#: Pairs whose letters are compared at once.
PAIRS = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # C3 leads U+00C0 to U+00FF and nothing else
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.array(words, f"<U{max(length, 1)}").view("<u4").reshape(len(words), -1)[:, :length]


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row of code points."""
    bins = np.where((points >= 97) & (points < 123), points - 97, np.where((points >= 0xC0) & (points <= 0xFF), points - (0xC0 - 26), points % LETTERS))
    rows, counts = np.arange(len(points)), np.zeros((len(points), LETTERS), np.int32)
    for i in range(points.shape[1]):
        counts[rows, bins[:, i]] += 1
    return counts


class Tree:
    """A k-d tree over rows of counts; ``leaves`` holds the points of each leaf."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[tuple] = []  # (leaf,) or (letter, cut, least, most, left, right)
        self.leaves: list[np.ndarray] = []
        far = np.iinfo(np.int32).max
        self._grow(points, np.arange(len(points)), leaf, np.zeros(points.shape[1], np.int64), np.full(points.shape[1], far, np.int64))

    def _grow(self, points, own, leaf, lo, hi) -> int:
        number = len(self.nodes)
        self.nodes.append((len(self.leaves),))
        inside = points[own]
        best = (0, 0, 0)
        if len(own) > leaf:
            middle = np.median(inside, axis=0).astype(np.int64)
            for cut in (middle, middle - 1):
                below = (inside <= cut).sum(0)
                even = np.minimum(below, len(own) - below)
                letter = int(even.argmax())
                best = max(best, (int(even[letter]), letter, int(cut[letter])))
        if not best[0]:  # few points, or all of them equal
            self.leaves.append(own)
            return number
        _, letter, cut = best
        down, up = hi.copy(), lo.copy()
        down[letter], up[letter] = cut, cut + 1
        low = inside[:, letter] <= cut
        left, right = self._grow(points, own[low], leaf, lo, down), self._grow(points, own[~low], leaf, up, hi)
        self.nodes[number] = (letter, cut, int(lo[letter]), int(hi[letter]), left, right)
        return number

    def visit(self, queries: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves whose box can be reached with at most ``more`` letters added and ``fewer`` taken away, and the queries that reach them."""
        zero = np.zeros(len(queries), np.int64)
        stack = [(0, np.arange(len(queries)), zero, zero)]
        while stack:
            node, some, added, taken = stack.pop()
            if not len(some):
                continue
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], some
                continue
            letter, cut, lo, hi, left, right = self.nodes[node]
            x = queries[some, letter].astype(np.int64)
            less = taken - np.maximum(x - hi, 0) + np.maximum(x - cut, 0)
            plus = added - np.maximum(lo - x, 0) + np.maximum(cut + 1 - x, 0)
            go = less <= fewer
            stack.append((left, some[go], added[go], less[go]))
            go = plus <= more
            stack.append((right, some[go], plus[go], taken[go]))


class Cells:
    """Trees by word length that deal words to cells; a length without a tree is one cell."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, leaf: int):
        self.trees: dict[int, Tree] = {}
        self.first: dict[int, int] = {}
        self.n = 0
        for length in np.unique(lengths).tolist():
            self.trees[length] = Tree(counts[lengths == length], leaf)
            self.first[length] = self.n
            self.n += len(self.trees[length].leaves)

    def reach(self, length: int, counts: np.ndarray, more: int, fewer: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of cell and row."""
        if length not in self.trees:
            return np.full(len(counts), -1 - length), np.arange(len(counts))
        found = [(np.full(len(some), self.first[length] + leaf), some) for leaf, some in self.trees[length].visit(counts, more, fewer)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Cell:
    """Words of one length in a tree over their distinct letter counts."""

    def __init__(self, words: list[str], length: int):
        self.words, self.length = words, length
        self.points = codes(words, length)
        counts = letter_counts(self.points)
        self.kinds, self.kind = np.unique(counts, axis=0, return_inverse=True)
        self.kind = self.kind.reshape(-1)
        self.member = np.argsort(self.kind, kind="stable")
        self.size = np.bincount(self.kind, minlength=len(self.kinds))
        self.start = np.cumsum(self.size) - self.size
        self.tree = Tree(self.kinds, LEAF)
        # counts in unary, so that the sum of the lesser counts of two words is a product of matrices
        letter, times = np.nonzero(np.arange(self.kinds.max())[None, :] < self.kinds.max(0)[:, None])
        self.letter, self.times = letter, times
        unary = self.unary(self.kinds)
        self.parts = [unary[leaf].T.copy() for leaf in self.tree.leaves]
        self.lookups: dict[int, dict[str, int]] = {}

    def unary(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.letter] > self.times).astype(np.float32)

    def near(self, words: list[str], points: np.ndarray, counts: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word of the cell) that are one edit apart; queries have the cell's length or one letter more.

        ``own`` gives the queries' places where they are words of the cell; then a pair counts once.
        """
        longer = points.shape[1] - self.length
        unary, shared = self.unary(counts), self.length - 1 + longer
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for leaf, some in self.tree.visit(counts, 1 - longer, 1):
            at, kind = np.nonzero(unary[some] @ self.parts[leaf] >= shared)
            query, kind = some[at], self.tree.leaves[leaf][kind]
            many = self.size[kind] > 4 * LEAF
            for i in np.flatnonzero(many).tolist():
                hits = self._edited(words[query[i]], int(kind[i]), longer)
                lefts.append(np.full(len(hits), query[i]))
                rights.append(np.array(hits, np.int64))
            query, kind = query[~many], kind[~many]
            if not len(kind):
                continue
            ends = np.cumsum(self.size[kind])
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], PAIRS)))
            for i, j in zip(cuts, [*cuts[1:], len(kind)], strict=True):
                size = self.size[kind[i:j]]
                left = np.repeat(query[i:j], size)
                right = self.member[ragged_index(self.start[kind[i:j]], size)]
                if own is not None:
                    left, right = left[own[left] < right], right[own[left] < right]
                good = (deleted if longer else replaced)(points[left], self.points[right])
                lefts.append(left[good])
                rights.append(right[good])
        left, right = np.concatenate(lefts), np.concatenate(rights)
        if own is not None:
            return left[own[left] < right], right[own[left] < right]
        return left, right

    def _edited(self, word: str, kind: int, longer: int) -> list[int]:
        """Words of one large kind that are an edit from ``word``, by looking up its edited forms."""
        if kind not in self.lookups:
            members = self.member[self.start[kind] : self.start[kind] + self.size[kind]]
            self.lookups[kind] = {self.words[i]: i for i in members.tolist()}
            self.lookups[kind, "letters"] = sorted({c for w in self.lookups[kind] for c in w})
        known, letters = self.lookups[kind], self.lookups[kind, "letters"]
        new = [""] if longer else letters
        forms = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in new}
        return [known[x] for x in forms - {word} if x in known]


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of one length differ in exactly one place."""
    return (a != b).sum(1) == 1


def deleted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b`` are those of ``a`` without one letter."""
    same = np.logical_and.accumulate(a[:, :-1] == b, axis=1).sum(1)
    back = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(1)
    return same + back >= b.shape[1]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 7, least: int = 2, damage: int | None = 31) -> DataFrame:
    """Words (word, n) of at least ``letters`` code points that occur at least ``least`` times in all texts.

    A word is a whole run of A-Z, a-z and U+00C0 to U+00FF, with A-Z as a-z.
    Where the CRC-32 of key, colon and word is a multiple of ``damage``, the
    occurrence loses one letter, which that number chooses; so every corpus has
    misspelt words. A null key is an empty one, a null text has no words, and
    repeated rows count each. Extra columns are ignored; an empty table gives an
    empty table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column("text")):
                yield _counted(batch.slice(i, j - i), letters, damage)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(trimmed(count), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(batch: pa.RecordBatch, letters: int, damage: int | None) -> pa.RecordBatch:
    data, offsets = text_buffer(batch.column("text"))
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    start = np.ones(len(data), bool)
    start[1:] = inside[1:] != inside[:-1]
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(_LOWER[data]))
    run = np.flatnonzero(inside[starts] & (np.diff(starts, append=len(data)) >= letters))
    coded = runs.take(pa.array(run)).dictionary_encode()
    words = coded.dictionary
    long = pc.utf8_length(words).to_numpy(zero_copy_only=False) >= letters
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.searchsorted(offsets, starts[run], side="right") - 1
    kept = long[code]
    pair, times = np.unique(doc[kept] * max(1, len(words)) + code[kept], return_counts=True)
    doc, code = np.divmod(pair, max(1, len(words)))
    if damage:
        before = [zlib.crc32(f"{k}:".encode()) for k in batch.column("key").to_pylist()]
        raw = words.cast(pa.large_binary()).to_pylist()
        check = np.fromiter((zlib.crc32(raw[c], before[d]) for d, c in zip(doc.tolist(), code.tolist(), strict=True)), np.int64, len(pair))
        hurt = check % damage == 0
    else:
        check, hurt = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
    total = np.bincount(code[~hurt], times[~hurt], len(words)).astype(np.int64)
    found = Counter()
    for c, at, n in zip(code[hurt].tolist(), check[hurt].tolist(), times[hurt].tolist(), strict=True):
        word = words[c].as_py()
        at %= len(word)
        if len(word) > letters:
            found[word[:at] + word[at + 1 :]] += n
    whole = np.flatnonzero(total)
    out = pa.concat_arrays([words.take(pa.array(whole)).cast(pa.string()), pa.array(list(found), pa.string())])
    return pa.RecordBatch.from_arrays([out, pa.array(np.concatenate([total[whole], np.fromiter(found.values(), np.int64, len(found))]))], ["word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """For words (word, n), all distinct: word, n_near, and ``best``, the near word of largest n (ties: the first in code-point order).

    Two words are near if one code point inserted, deleted or replaced turns one
    into the other. Only words that have a near one are returned.

    Trees over the letter counts of a bounded sample, one for each length, cut
    the words into cells. A word is dealt to its own cell, to the later cells of
    its length whose box is within one letter more and one less, and to cells of
    the length below whose box is within one letter less. In a cell a tree over
    the distinct letter counts prunes by its boxes again; what is left is
    compared letter by letter, or looked up where very many words share the same
    letters. Each near pair is found in one cell, once, and only sums by word
    and task go on.
    """
    n = words.count()
    sample = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word").mapInArrow(_vectors, "length bigint, counts binary").collect()
    lengths = np.array([r["length"] for r in sample], np.int64)
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in sample), np.int32).reshape(-1, LETTERS)
    cells = Cells(lengths, counts, max(16, math.ceil(CELL * min(1.0, SAMPLE / max(n, 1)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in _by_length(batch):
                vectors = letter_counts(codes(part.column("word").to_pylist(), length))
                home = np.empty(len(part), np.int64)
                cell, row = cells.reach(length, vectors, 0, 0)
                home[row] = cell
                later, other = cells.reach(length, vectors, 1, 1)
                ahead = later > home[other]
                below, shorter = cells.reach(length - 1, vectors, 0, 1)
                row = np.concatenate([np.arange(len(part)), other[ahead], shorter])
                cell = np.concatenate([home, later[ahead], below])
                role = np.repeat(np.arange(3, dtype=np.int8), [len(part), int(ahead.sum()), len(shorter)])
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(role), taken.column("word"), taken.column("n")], ["cell", "role", "word", "n"])

    dealt = words.mapInArrow(deal, "cell bigint, role tinyint, word string, n bigint")
    dealt = dealt.repartition(max(1, cells.n), "cell").sortWithinPartitions("cell", "role")
    found = dealt.mapInArrow(trimmed(_search), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        yield length, batch.filter(pa.array(lengths == length))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length, part in _by_length(batch):
            counts = letter_counts(codes(part.column("word").to_pylist(), length))
            yield pa.RecordBatch.from_arrays([pa.array([length] * len(part), pa.int64()), pa.array([x.tobytes() for x in counts], pa.binary())], ["length", "counts"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the cells of sorted rows: a cell's own words come first, then stream those that others send."""
    held: list[pa.RecordBatch] = []
    cell = own_n = None
    at = None
    for batch in batches:
        cells, roles = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "role"))
        cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(roles) != 0)) + 1).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part, role = batch.slice(i, j - i), roles[i]
            if cells[i] != at:
                if held:
                    cell, own_n = _open(held)
                    yield from _pairs(cell, own_n, None, None)
                held, at, cell = [], cells[i], None
            if role == 0:
                held.append(part)
                continue
            if held:
                cell, own_n = _open(held)
                yield from _pairs(cell, own_n, None, None)
                held = []
            if cell is not None:
                yield from _pairs(cell, own_n, part.column("word").to_pylist(), part.column("n").to_numpy())
    if held:
        yield from _pairs(*_open(held), None, None)


def _open(held: list[pa.RecordBatch]) -> tuple[Cell, np.ndarray]:
    table = pa.Table.from_batches(held)
    words = table.column("word").to_pylist()
    return Cell(words, len(words[0])), table.column("n").to_numpy()


def _pairs(cell: Cell, own_n: np.ndarray, words: list[str] | None, n: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if words is None:  # the cell's own words with one another, each kind of letter counts at once
        left, right = cell.near(cell.words, cell.points, cell.kinds[cell.kind], np.arange(len(cell.words)))
        every, n = cell.words, own_n
    else:
        points = codes(words, len(words[0]))
        left, right = cell.near(words, points, letter_counts(points))
        right = right + len(words)
        every, n = [*words, *cell.words], np.concatenate([n, own_n])
    if not len(left):
        return
    word, other = np.concatenate([left, right]), np.concatenate([right, left])
    some, other_at = np.unique(other, return_inverse=True)
    rank = np.argsort(np.argsort(np.array([every[i] for i in some.tolist()])))  # numpy orders text by code points
    order = np.lexsort((rank[other_at], -n[other], word))
    word, other = word[order], other[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    count = np.diff(first, append=len(word))
    yield pa.RecordBatch.from_arrays(
        [pa.array([every[i] for i in word[first].tolist()], pa.string()), pa.array(count), pa.array(n[other[first]]), pa.array([every[i] for i in other[first].tolist()], pa.string())],
        ["word", "n_near", "best_n", "best"],
    )


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Words (word, n) with ``n_near``, ``form`` and its ``form_n``, and ``root``.

    A word's form is its best near word (:func:`near_words`) if that is at least
    ``ratio`` times as frequent, else null. The root follows the forms to the
    last; as each is ``ratio`` times as frequent as the one before, doubling the
    steps finds it after a few joins.

    Words are distinct; rows with a null are left out. An empty table gives an
    empty table; extra columns are dropped.
    """
    words = stash(words.where("word is not null and n is not null").select("word", "n"), "words")
    near = words.join(near_words(words), "word", "left")
    far = F.col("best_n") >= F.col("n") * ratio
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n"))
    near = stash(near, "near")
    steps = stash(near.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "steps")
    while not steps.where("moved").isEmpty():
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        steps = stash(steps, "steps")
    return near.join(steps.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, hex(concat(doc_id, ':', run)) AS h FROM pairs),
checked AS (
  SELECT run, times, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS crc
  FROM bytes, steps),
written AS (
  SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times FROM checked),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cut),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL),
roots AS (SELECT k.word, k.at AS root FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
