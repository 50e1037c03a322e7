"""Quality by perplexity under a character model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import sized, stash, text_slices, trimmed
from sonoframe.llm.shingles import powers

#: Trigrams of one shard of the model, and bytes of text that one numpy step takes (which needs some 48 times as much; a longer text is a step of its own).
SHARD, SLICE = 500_000, 1 << 20
#: Symbols before those of characters; AGAIN stands for the first letter of a word that repeats the word before it.
BEGIN, END, AGAIN, FIRST = 0, 1, 2, 3


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and each text's offset (null: empty)."""
    column = pc.fill_null(column, "")
    lengths = pc.utf8_length(column).to_numpy().astype(np.int64)
    flat = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def repeats(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a word begins that is the same as the word before it in its text."""
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    start = ~space
    start[1:] &= space[:-1]
    first = at[:-1][at[:-1] < len(flat)]
    start[first] = ~space[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts
    place = np.arange(len(flat)) - starts[np.maximum(np.cumsum(start) - 1, 0)]
    place[space] = 0
    value = (flat.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
    value[space] = 0
    word = np.add.reduceat(value, starts)
    text = np.searchsorted(at, starts, "right")
    same = np.zeros(len(starts), bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    return starts[same]


def trigrams(column: pa.Array, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One number for each trigram of every text, which begins with two marks and ends with one; and offsets.

    A word that repeats the one before it begins with a symbol of its own.

    ``table`` gives the number of each code point, ``n`` is above all of them.
    """
    flat, at = code_points(column)
    rows = np.arange(len(at) - 1)
    symbols = table[flat]
    symbols[repeats(flat, at)] = AGAIN
    ids = np.full(len(flat) + 3 * len(rows), BEGIN, np.int32)
    ids[np.arange(len(flat)) + 3 * np.repeat(rows, np.diff(at)) + 2] = symbols
    ids[at[1:] + 3 * rows + 2] = END
    key = ids[:-2].astype(np.int64)
    key *= n
    key += ids[1:-1]
    key *= n
    key += ids[2:]
    keep = np.ones(len(key), bool)
    last = at[1:-1] + 3 * rows[1:]  # trigrams that would reach into the next text
    keep[last - 2], keep[last - 1] = False, False
    return key[keep], at + np.arange(len(at))


def _alphabet(docs: DataFrame, text: str) -> np.ndarray:
    """Number of each code point: a table over Unicode, which bounds its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for batch in batches:
            for i, j in text_slices(batch.column(text), SLICE):
                seen[code_points(batch.column(text).slice(i, j - i))[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["c"])

    found = sorted(r.c for r in docs.select(text).mapInArrow(trimmed(run), "c int").distinct().collect())
    table = np.zeros(0x110000, np.int32)
    table[found] = FIRST + np.arange(len(found))
    return table


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that occur once to four times."""
    row = counts.agg(*(F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5))).first()
    n = [row[i] or 0 for i in range(4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 * (i + 1) for i in range(3)]
    return tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _contexts(counts: DataFrame, context: str, d: tuple[float, float, float], name: str) -> DataFrame:
    """Total and left-over weight of each context."""
    total = F.sum("c").alias("t_" + name)
    return counts.groupBy(context).agg(total, (F.sum(_discount(F.col("c"), d)) / F.sum("c")).alias("g_" + name))


def kneser_ney(counts: DataFrame, n: int) -> DataFrame:
    """(key, logp) for every row of ``counts`` (key, c), c = 0 for trigrams that the trusted text lacks.

    Interpolated modified Kneser-Ney: the trigram's count, then continuation
    counts for bigrams and characters, then a uniform share; each by a join of
    count tables on the n-gram or its context.
    """
    wide = counts.select("key", "c", F.floor(F.col("key") / n).alias("xy"), (F.col("key") % (n * n)).alias("yz"))
    wide = wide.withColumns({"y": F.floor(F.col("yz") / n), "z": F.col("yz") % n})
    c3 = stash(wide.where("c > 0"), "trigrams")
    c2 = stash(c3.groupBy("yz", "y", "z").agg(F.count("*").alias("c")), "bigrams")
    c1 = stash(c2.groupBy("z").agg(F.count("*").alias("c")), "characters")
    d3, d2, d1 = (_discounts(x) for x in (c3, c2, c1))
    whole = c1.agg(F.sum("c"), F.sum(_discount(F.col("c"), d1))).first()
    total, left = whole[0] or 1, (whole[1] or 1) / (whole[0] or 1)
    of = lambda table, key, name: table.select(key, F.col("c").alias(name))
    out = (
        wide.join(_contexts(c3, "xy", d3, "3"), "xy", "left")
        .join(of(c2, "yz", "c2"), "yz", "left")
        .join(_contexts(c2, "y", d2, "2"), "y", "left")
        .join(of(c1, "z", "c1"), "z", "left")
    )
    share = lambda c, d, t: F.coalesce((F.col(c) - _discount(F.col(c), d)) / t, F.lit(0.0))
    p1 = share("c1", d1, F.lit(total)) + left / n
    p2 = F.when(F.col("t_2").isNull(), p1).otherwise(share("c2", d2, F.col("t_2")) + F.col("g_2") * p1)
    seen = F.when(F.col("c") > 0, (F.col("c") - _discount(F.col("c"), d3)) / F.col("t_3")).otherwise(0.0)
    p3 = F.when(F.col("t_3").isNull(), p2).otherwise(seen + F.col("g_3") * p2)
    return out.select("key", F.log(p3).alias("logp"))


def tally(cell: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (cell, key) in order, and how often each occurs; keys are below ``most``."""
    if (int(cell.max(initial=0)) + 1) * most < 2**63:
        both, times = np.unique(cell * most + key, return_counts=True)
        return both // most, both % most, times
    order = np.lexsort((key, cell))
    cell, key = cell[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])]))
    return cell[new], key[new], np.diff(np.append(new, len(cell)))


def packed(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers of each range as bytes of seven bits, the last without the high bit."""
    size = np.ones(len(x), np.int64)
    for bits in range(7, 63, 7):
        size += x >= 1 << bits
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for place in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > place)
        out[at[some] + place] = ((x[some] >> (7 * place)) & 127) | np.where(size[some] > place + 1, 128, 0)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at[bounds]), pa.py_buffer(out)]).cast(pa.binary())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    start = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128]))
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), start)


def perplexities(docs: DataFrame, trusted: DataFrame, text: str = "text", digest: str = "digest", folds: int = 2) -> DataFrame:
    """(doc_id, digest, n, logp): characters with the end mark, and the log probability of each document.

    ``trusted`` has the ``doc_id`` of the rows that train the models. Rows are
    dealt over ``folds`` by their text (``digest``), and those of a fold are
    scored by the model that the other folds' trusted rows train, so no text is
    scored by a model that has seen it. The counts of all documents' trigrams
    are looked up in the models by shards: every document sends its distinct
    trigrams with their counts to the shards that hold them, and the shards'
    sums are added up. Rows of one id and text give one row, scored as one text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", digest, text, F.pmod(F.col(digest), F.lit(folds)).cast("int").alias("fold"))
    alphabet = _alphabet(docs, text)
    n = int(alphabet.max(initial=FIRST)) + 1
    sent = spark.sparkContext.broadcast(alphabet)
    names = [f"c{i}" for i in range(folds)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(text), SLICE):
                part = batch.slice(i, j - i)
                key, at = trigrams(part.column(text), sent.value, n)
                fold = np.where(part.column("trusted").to_numpy(zero_copy_only=False), part.column("fold").to_numpy(), folds).astype(np.int8)
                fold = np.repeat(fold, np.diff(at))
                order = np.argsort(key)
                key, fold = key[order], fold[order]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(key[begin]), *(pa.array(np.add.reduceat(fold == f, begin, dtype=np.int64)) for f in range(folds))], ["key", *names])

    known = sized(trusted.select("doc_id", F.lit(True).alias("trusted")))
    marked = docs.join(known, "doc_id", "left").select("fold", F.coalesce("trusted", F.lit(False)).alias("trusted"), text)
    counts = marked.mapInArrow(trimmed(count), "key bigint, " + ", ".join(f"{c} bigint" for c in names)).groupBy("key").agg(*(F.sum(c).alias(c) for c in names))
    counts = stash(counts, "counts")
    shards = max(1, -(-counts.count() // SHARD))
    salts = max(2, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // (shards * folds)))  # over which a shard's documents are dealt
    kind = dict(docs.dtypes)["doc_id"]

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(text), SLICE):
                part = batch.slice(i, j - i)
                key, at = trigrams(part.column(text), sent.value, n)
                row = np.repeat(np.arange(len(part)), np.diff(at))
                cell, key, times = tally(row * shards + key % shards, key, n**3)
                begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
                step = key.copy()
                step[1:] -= key[:-1]
                step[begin] = key[begin]
                own, shard = np.divmod(cell[begin], shards)
                bounds = np.append(begin, len(cell))
                columns = [part.column(c).take(pa.array(own)) for c in ("fold", "doc_id", digest)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), *columns, packed(step, bounds), packed(times, bounds)], ["shard", "fold", "doc_id", "digest", "keys", "times"]
                )

    salt = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(salts)).cast("int").alias("salt")
    asked = docs.mapInArrow(trimmed(request), f"shard int, fold int, doc_id {kind}, digest bigint, keys binary, times binary").select("*", salt)

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, logp = batch.column("key").to_numpy(), batch.column("logp").to_numpy()
            for shard in range(shards):
                at = key % shards == shard
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([key[at].tobytes()], pa.binary()), pa.array([logp[at].tobytes()], pa.binary())], ["shard", "keys", "times"])

    models = None
    for fold, own in enumerate(names):
        others = counts.select("key", sum((F.col(c) for c in names if c != own), F.lit(0).cast("bigint")).alias("c"))
        one = kneser_ney(others, n).mapInArrow(trimmed(model), "shard int, keys binary, times binary").withColumn("fold", F.lit(fold))
        models = one if models is None else models.unionByName(one)
    models = models.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = models.select("shard", "salt", "fold", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("bigint").alias("digest"), "keys", "times", F.lit(0).alias("asks"))
    both = both.unionByName(asked.withColumn("asks", F.lit(1)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, model, keys, logp = None, [], None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held != (row["shard"], row["salt"], row["fold"]):
                    held, model, keys = (row["shard"], row["salt"], row["fold"]), [], None
                if not row["asks"]:
                    model.append((row["keys"], row["times"]))
                    continue
                if keys is None:
                    keys, logp = (np.concatenate([np.frombuffer(x[i], t) for x in model]) for i, t in ((0, np.int64), (1, np.float64)))
                    order = np.argsort(keys)
                    keys, logp = keys[order], logp[order]
                times = unpacked(row["times"])
                wanted = np.cumsum(unpacked(row["keys"]))
                found = logp[np.searchsorted(keys, wanted)]
                out.append((row["doc_id"], row["digest"], int(times.sum()), float((found * times).sum()), int(wanted[0] < n)))
            if out:
                a, b, c, d, e = zip(*out, strict=True)
                columns = [pa.array(a, batch.column("doc_id").type), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64()), pa.array(e, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "logp", "rows"])

    where = ["shard", "salt", "fold"]
    sums = both.repartition(shards * salts * folds, *where).sortWithinPartitions(*where, "asks").mapInArrow(trimmed(look_up), f"doc_id {kind}, digest bigint, n bigint, logp double, rows bigint")
    # each text has one trigram below n, that of both marks before it, which tells how often rows are repeated
    each = lambda c: (F.sum(c) / F.sum("rows")).alias(c)
    return sums.groupBy("doc_id", "digest").agg(each("n").cast("bigint").alias("n"), each("logp"))


def assess(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.08, prior: int = 100, folds: int = 2, least: int = 20, text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, digest, lang, ``perplexity``, ``threshold``, ``kept``.

    Trusted text is that of all rows labelled with quality 1. It trains the
    models and calibrates: every row is scored by a model of other ``folds`` (see
    :func:`perplexities`). The perplexity of a document is per character, drawn
    towards the calibrating rows' mean of its language as by ``prior`` more
    characters, so that a few words decide nothing. A row is kept if its log
    perplexity is at most ``slack`` times the ``quantile`` of the calibrating
    rows' of its language (of all of them, where a language has fewer than
    ``least``; all rows are kept if none calibrate at all).

    Null and empty texts consist of the end mark alone, and are kept; a null
    language is one of its own; rows are known by id and text, so repeated or
    null ids do no harm. Labels without a document are ignored, of repeated ones
    the lowest counts. Extra columns don't matter; an empty table gives an empty
    table.
    """
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text, digest.alias("digest"))
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = stash(good, "trusted")
    scores = perplexities(docs, good, text, folds=folds)
    rows = docs.drop(text).join(sized(good.withColumn("calibrates", F.lit(True))), "doc_id", "left")
    scored = stash(
        rows.withColumn("id", F.struct("doc_id", "digest")).join(scores.withColumn("id", F.struct("doc_id", "digest")).select("id", "n", "logp"), "id").drop("id"),
        "scores",
    )
    calibrating = scored.where("calibrates")
    means = calibrating.groupBy("lang").agg((-F.sum("logp") / F.sum("n")).alias("mean"), F.count("*").alias("rows")).where(F.col("rows") >= least).drop("rows")
    overall = calibrating.agg(-F.sum("logp") / F.sum("n")).first()[0] or 0.0
    drawn = (-F.col("logp") + prior * F.coalesce("mean", F.lit(overall))) / (F.col("n") + prior)
    scored = scored.join(sized(stash(means, "means")), "lang", "left").withColumn("entropy", drawn).drop("mean")
    scored = stash(scored, "entropies")
    at = F.percentile_approx("entropy", F.lit(quantile), F.lit(100_000))
    limits = scored.where("calibrates").groupBy("lang").agg(at.alias("limit"), F.count("*").alias("rows")).where(F.col("rows") >= least).drop("rows")
    every = scored.where("calibrates").agg(at).first()[0]
    limit = slack * F.coalesce("limit", F.lit(every if every is not None else float("inf")))
    return scored.join(sized(stash(limits, "limits")), "lang", "left").select(
        "doc_id", "digest", "lang", F.exp("entropy").alias("perplexity"), F.exp(limit).alias("threshold"), (F.col("entropy") <= limit).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`assess` keeps."""
    bad = stash(assess(docs, labels, text=text, **options).where("not kept").select("doc_id", "digest").distinct(), "rejected")
    return docs.join(
        sized(bad.select(F.col("doc_id").alias("id of a rejected"), F.col("digest").alias("digest of a rejected"))),
        F.col("id of a rejected").eqNullSafe(docs["doc_id"]) & (F.col("digest of a rejected") == F.xxhash64(F.coalesce(docs[text], F.lit("")))),
        "left_anti",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return assess(docs, labels).drop("digest")
