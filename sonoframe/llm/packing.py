"""Packing of token sequences into windows by bounded-space online best fit."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm import tokens
from sonoframe.llm.common import stash, text_slices, trimmed

#: Text bytes whose ids are looked up at once, or one text.
SLICE = 1 << 20
#: Partitions whose leftover windows are merged together.
MERGED = 32
#: Above all sequence ids that partitions of the first pass give.
LATE = 1 << 62

FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """A fixed number of open windows of ``size`` tokens.

    A piece goes into the window with the least room that holds it. If none
    does, a new window opens while there are fewer than ``windows``; else the
    fullest window takes as much of the piece as it has room for and is emitted,
    and the rest of the piece goes on. So every emitted window is full.
    ``emit(window)`` gets lists of what ``cut(piece, begin, end)`` made of each part.
    """

    def __init__(self, size: int, windows: int, emit, cut=lambda *part: part):
        self.size, self.windows, self.emit, self.cut = size, windows, emit, cut
        self.open: list[tuple[int, int]] = []  # (room, number), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, piece, begin: int, end: int) -> None:
        while end - begin >= self.size:
            self.emit([self.cut(piece, begin, begin + self.size)])
            begin += self.size
        while begin < end:
            at = bisect.bisect_left(self.open, (end - begin, -1))
            if at == len(self.open) and len(self.open) < self.windows:
                self.held[self.next] = []
                self.open.append((self.size, self.next))
                self.next += 1
            at = min(at, len(self.open) - 1) if self.open[-1][0] >= end - begin else 0
            room, number = self.open.pop(at)
            taken = min(room, end - begin)
            self.held[number].append(self.cut(piece, begin, begin + taken))
            begin += taken
            if room > taken:
                bisect.insort(self.open, (room - taken, number))
            else:
                self.emit(self.held.pop(number))

    def leftovers(self) -> list[list]:
        """The open windows, fullest first."""
        return [self.held[number] for _, number in self.open]


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    windows: int = 64,
    end_id: int | None = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    A document is the ids of its whole text and then ``end_id``. Returns a row
    for each piece: key, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset`` in it.

    Each partition packs its rows as they come with a fixed number of open
    windows (:class:`Packer`). The windows that stay open at its end, no more
    than ``windows``, are merged with those of up to ``MERGED`` partitions in
    one task; what remains there is cut into sequences whose lengths are powers
    of two, which need no padding. The first pass is written to the shared
    folder, so that a lost executor can't change sequences that others have.

    Null or empty texts have the end id alone (no row without one). Rows are
    packed one by one, repeated or not; keys may be null. Extra columns are
    dropped; an empty table gives an empty table.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, {FIELDS}, grp bigint, ids binary"
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "grp", "ids"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        partition = TaskContext.get().partitionId()
        rows: list[tuple] = []
        sequence = partition << 36

        def emit(window, grp=None):
            nonlocal sequence
            offset = 0
            for doc, begin, ids, whole in window:
                rows.append((doc, begin, len(ids) // 4, zlib.crc32(ids), whole, sequence, offset, grp, None if grp is None else ids))
                offset += len(ids) // 4
            sequence += 1

        # an open window holds its own ids only, not the documents or slices that they come from
        packer = Packer(size, windows, emit, lambda piece, begin, end: (piece[0], begin, piece[1][begin:end].tobytes(), len(piece[1])))
        for batch in batches:
            for i, j in text_slices(batch.column(text), SLICE):
                part = batch.slice(i, j - i)
                flat, at = encoder.ids(part.column(text))
                flat = flat.astype("<u4")
                for doc, a, b in zip(part.column(key).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                    ids = flat[a:b] if end_id is None else np.append(flat[a:b], np.uint32(end_id))
                    packer.add((doc, ids), 0, len(ids))
                if rows:
                    yield _batch(rows, names, schema_arrow)
                    rows.clear()
        for window in packer.leftovers():
            emit(window, partition // MERGED)
        if rows:
            yield _batch(rows, names, schema_arrow)

    schema_arrow = _arrow(docs.sparkSession, schema)
    packed = stash(docs.select(key, text).mapInArrow(trimmed(first), schema), "packed")

    final_arrow = pa.schema([f for f in schema_arrow if f.name not in ("grp", "ids")])

    def merge(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        sequence = LATE + (table.column("grp")[0].as_py() << 24)

        def emit(window):
            nonlocal sequence
            offset = 0
            for (row, ids), begin, end in window:
                rows.append((row[key], row["start"] + begin, end - begin, zlib.crc32(ids[begin:end].tobytes()), row["doc_tokens"], sequence, offset))
                offset += end - begin
            sequence += 1

        packer = Packer(size, 1, emit)
        order = [("sequence_id", "ascending"), ("offset", "ascending")]
        for row in table.sort_by(order).to_pylist():
            ids = np.frombuffer(row["ids"], "<u4")
            packer.add((row, ids), 0, len(ids))
        for window in packer.leftovers():
            for part in _powers_of_two(window):
                emit(part)
        return _table(rows, names[:-2], final_arrow)

    late = packed.where("grp is not null").groupBy("grp").applyInArrow(merge, f"`{key}` {kind}, {FIELDS}")
    return packed.where("grp is null").drop("grp", "ids").unionByName(late)


def _powers_of_two(window: list) -> Iterator[list]:
    total = sum(end - begin for _, begin, end in window)
    rest = list(window)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            need, part = 1 << bit, []
            while need:
                piece, begin, end = rest.pop(0)
                if end - begin > need:
                    rest.insert(0, (piece, begin + need, end))
                    end = begin + need
                part.append((piece, begin, end))
                need -= end - begin
            yield part


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _table(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, schema.field(i).type) for i, x in enumerate(zip(*rows, strict=True))], schema=schema)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return _table(rows, names, schema).combine_chunks().to_batches()[0]


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
