"""Embeddings: near-duplicate links by sign hashing, and exact top-k by vector approximations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import sized, stash
from sonoframe.llm.graph import components

#: Rows of one block in a bucket; a larger bucket is compared block by block, in as many tasks as there are pairs of blocks.
BLOCK = 2048
#: Vectors in a bucket on average.
BUCKET = 1024


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Arrays of one length as rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class SignHashes:
    """Keys of vectors in each table: the signs of their products with random hyperplanes.

    ``tables`` is such that a pair at the cosine is missed with a probability of
    ``miss`` at most.
    """

    def __init__(self, bits: int, cosine: float, miss: float, seed: int):
        same = (1 - math.acos(cosine) / math.pi) ** bits
        self.bits, self.seed = bits, seed
        self.tables = math.ceil(math.log(miss) / math.log(1 - same))
        self.planes: dict[int, np.ndarray] = {}

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """Keys, a row for each vector and a column for each table."""
        d = vectors.shape[1]
        if d not in self.planes:  # whole numbers, as the vectors' are, so that signs don't hang on the order of sums
            self.planes[d] = np.rint(4096 * np.random.default_rng([self.seed, d]).standard_normal((d, self.tables * self.bits)))
        signs = (vectors @ self.planes[d] >= 0).reshape(len(vectors), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, miss: float = 0.001, seed: int = 17) -> DataFrame:
    """Per row: key, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are one class, linked with each other without comparison.
    Classes are hashed by the signs of random hyperplanes in several tables; the
    number of signs follows the number of classes, and that of tables follows
    from ``miss``, the chance of missing a pair exactly at the threshold (for
    closer pairs it is far smaller). What travels to the buckets are vectors in
    whole numbers of 16 bits. They decide a pair unless its cosine is so near
    the threshold that their rounding matters; the vectors of such pairs meet
    again as they are, and double precision decides. A pair counts in the first
    table where it meets. Buckets of more than ``BLOCK`` classes are split into
    blocks whose pairs are separate tasks, so a hot bucket is whole yet never in
    one place; of each task's links only a spanning forest and sums by vector,
    and of its undecided pairs only the vectors, go on. Components are found by
    contraction.

    Vectors that are null, zero, or hold a null or non-finite component link
    with nothing; so do vectors of different dimensions with one another. Rows
    whose key is null link with nothing and have a null component. Repeated keys
    are separate vectors. Extra columns are dropped. An empty table gives an
    empty table.
    """
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kind = dict(rows.dtypes)[key]
    rows = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("x"))
    good = rows.where(F.col("vec_id").isNotNull() & finite(F.col("x")) & F.exists("x", lambda x: x != 0))
    classes = stash(good.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    n = classes.count()
    hashes = SignHashes(max(4, round(math.log2(max(n, 1) / BUCKET))), cosine, miss, seed)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            lengths = pa.compute.list_value_length(x).to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                q, step = rounded(matrix(part.column("x")))
                columns = [part.column("rep"), part.column("size"), lists(q.astype(np.int16)), pa.array(step), lists(hashes(q) * 4096 + d % 4096)]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "size", "q", "step", "keys"])

    keyed = classes.mapInArrow(hashed, "rep bigint, size bigint, q array<smallint>, step double, keys array<bigint>")
    counts = keyed.select(F.posexplode("keys").alias("t", "bucket")).groupBy("t", "bucket").count()
    counts = stash(counts.where("count > 1").select("t", "bucket", F.ceil(F.col("count") / BLOCK).alias("blocks")), "buckets")
    spread = keyed.select("rep", "size", "q", "step", F.posexplode("keys").alias("t", "bucket")).join(sized(counts), ["t", "bucket"])
    spread = spread.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    where, what = ["t", "bucket", "lo", "hi"], ["own", "rep", "size", "step"]
    spread = spread.select("t", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *what, "q")

    def compare(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, where):
            lo, hi, t = (table.column(c)[0].as_py() for c in ("lo", "hi", "t"))
            lengths = pa.compute.list_value_length(table.column("q")).to_numpy()
            for d in np.unique(lengths):
                part = table.filter(pa.array(lengths == d))
                own, rep, size, step = (part.column(c).to_numpy() for c in what)
                q = matrix(part.column("q").combine_chunks())
                a, b = (np.flatnonzero(own == side) for side in (lo, hi))
                i, j, sure = close(q, step, a, b, cosine)
                some, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                codes = hashes(q[some])[:, :t]
                left, right = np.split(back, 2)
                first = np.ones(len(i), bool)
                for before in range(t):
                    first &= codes[left, before] != codes[right, before]
                i, j, sure = i[first], j[first], sure[first]
                if exact:
                    i, j = i[~sure], j[~sure]
                    x = unit(matrix(part.column("x").combine_chunks()))
                    linked = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                    i, j = i[linked], j[linked]
                else:
                    open_ = np.unique(np.concatenate([i[~sure], j[~sure]]))
                    if len(open_):
                        again = part.take(pa.array(open_)).combine_chunks()
                        nothing = pa.nulls(len(again), pa.int64())
                        yield from pa.table([nothing, nothing, nothing, *again.columns], ["a", "b", "links", *again.column_names]).to_batches()
                    i, j = i[sure], j[sure]
                if not len(i):
                    continue
                some, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                i, j = np.split(back, 2)
                rep, size = rep[some], size[some]
                links = np.bincount(i, size[j], len(some)) + np.bincount(j, size[i], len(some))
                label = forest(len(some), i, j)
                at = np.flatnonzero(links)
                given = [pa.array(rep[at]), pa.array(rep[label[at]]), pa.array(links[at].astype(np.int64))]
                rest = [] if exact else [pa.nulls(len(at), f.type) for f in part.schema]
                yield pa.RecordBatch.from_arrays([*given, *rest], ["a", "b", "links", *([] if exact else part.column_names)])

    def meet(rows: DataFrame, fields: str, exact: bool) -> DataFrame:
        rows = rows.repartition(*where).sortWithinPartitions(*where)
        return rows.mapInArrow(lambda batches: compare(batches, exact), fields)

    told = "a bigint, b bigint, links bigint"
    found = stash(meet(spread, f"{told}, t int, bucket bigint, lo bigint, hi bigint, own bigint, rep bigint, size bigint, step double, q array<smallint>", False), "met")
    undecided = found.where("rep is not null").drop("a", "b", "links").join(classes.select("rep", "x"), "rep")
    found = stash(found.where("a is not null").select("a", "b", "links").unionByName(meet(undecided, told, True)), "links")
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    facts = stash(classes.join(linked, "rep", "left").join(parts, "rep", "left"), "facts")
    # joined by a hash, so that the shuffle compares numbers, and by the vectors themselves, which decide
    facts, rows = facts.withColumn("h", F.xxhash64("x")), rows.withColumn("h", F.xxhash64("x"))
    whole = rows.join(facts, (rows["h"] == facts["h"]) & (rows["x"] == facts["x"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return whole.select(
        F.col("vec_id").cast(kind).alias(key),
        F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        component.cast(kind).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in whole numbers of 16 bits, and the step of each that leads back to the row at length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x * 32767), 1 / (32767 * np.sqrt((x * x).sum(axis=1)))


def close(q: np.ndarray, step: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows in ``a`` and ``b`` that may reach the cosine, and which of them surely do, whatever was rounded.

    A rounded row is at most half a step times the root of its length away. The
    products are sums of whole numbers, exact in any order, so a pair gets the
    same answer wherever it is asked. If ``a`` and ``b`` are the same rows, each
    pair comes once.
    """
    half = np.sqrt(q.shape[1]) / 2
    far = half * step.max()
    dots = q[a] @ q[b].T
    may = dots >= (cosine - far * (2 + far) - 1e-9) / step[a][:, None] / step[b]
    i, j = np.nonzero(np.triu(may, 1) if np.array_equal(a, b) else may)
    dots = dots[i, j]
    i, j = a[i], b[j]
    both = step[i] * step[j]
    about, margin = dots * both, half * (step[i] + step[j]) + half * half * both + 1e-12
    may = about + margin >= cosine
    return i[may], j[may], (about - margin >= cosine)[may]


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows as arrays."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest vertex that each of n vertices reaches over the edges i-j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Queries whose vectors travel together, and vectors that are scanned together, at most; and the bytes of one block of either.
QUERY_BLOCK, SCAN_BLOCK, BLOCK_BYTES = 1024, 4096, 4 << 20
#: Bytes of all queries up to which their blocks are sent to every worker once; more are joined by sorting and merging.
SENT_BYTES = 64 << 20
#: Tasks that share the scan for one block of queries where blocks are joined.
SHARES = 32


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest integer inner products for each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows whose key is
    divisible by ``every``; candidates are all other rows. The vector
    approximation keeps each component as a cell of 8 bits, with a cell width of
    the vector's own (a power of two). A scan of the cells bounds every score
    from both sides; a candidate stays if its upper bound reaches the query's kth
    lower bound. Exact vectors are read in the order of the bounds: the first 2k
    of each query, then those whose upper bound reaches the kth score so found,
    which makes the result certain. Queries go in blocks against blocks of cells.

    Vectors that are null, or hold a null or non-finite component, take no part.
    Nor do those with a component whose |scale * x| is the root of 2 ** 60 / d or
    more (d components), since products of such vectors pass 64 bits. Keys are
    whole numbers of any type; ids are given back as bigint. Vectors of different lengths have no score with each other. Rows without a
    key take no part; of rows that share one, the smallest vector counts. Ties go
    to the smaller key. Extra columns are dropped; empty tables give empty ones.
    """
    whole = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("x")).where(F.col("vec_id").isNotNull() & finite(F.col("x")))
    most = F.sqrt(F.lit(2.0**60) / F.greatest(F.size("x"), F.lit(1)))
    whole = whole.where(F.forall("x", lambda x: F.abs(x.cast("double")) * scale < most))
    whole = whole.groupBy("vec_id").agg(F.min("x").alias("x"))
    whole = whole.select("vec_id", F.transform("x", lambda x: F.floor(scale * x.cast("double"))).alias("x"))
    whole = stash(whole, "vectors")
    queries = whole.where(F.col("vec_id") % every == 0)
    dims = F.size("x").alias("d")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            for n in np.unique(d):
                at = np.flatnonzero(d == n)
                rows = block_rows(SCAN_BLOCK, int(n))
                for i in range(0, len(at), rows):
                    part = batch.take(pa.array(at[i : i + rows]))
                    x = matrix(part.column("x"), np.int64)
                    shift = widths(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n], pa.int32()),
                            pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()),
                            pa.array([(x >> shift[:, None]).astype(np.int8).tobytes()], pa.binary()),
                            pa.array([shift.astype(np.int8).tobytes()], pa.binary()),
                        ],
                        ["d", "ids", "cells", "shifts"],
                    )

    scan = stash(whole.select("vec_id", "x", dims).mapInArrow(cells, "d int, ids binary, cells binary, shifts binary"), "cells")
    lengths = queries.groupBy(dims).count().select("d", F.ceil(F.col("count") / F.greatest(F.lit(1), F.least(F.lit(QUERY_BLOCK), F.floor(BLOCK_BYTES / (8 * F.col("d") + 1))))).alias("blocks"))
    lengths = stash(lengths, "lengths")

    def blocked(table: pa.Table) -> pa.Table:
        x = matrix(table.column("x").combine_chunks(), np.int64)
        return pa.table({
            "d": table.column("d")[:1], "block": table.column("block")[:1],
            "query_ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "queries": pa.array([x.tobytes()], pa.binary()),
        })

    asked = queries.select("vec_id", "x", dims).join(sized(lengths), "d").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = stash(asked.groupBy("d", "block").applyInArrow(blocked, "d int, block int, query_ids binary, queries binary"), "queries")
    few = (asked.agg(F.sum(F.octet_length("queries") + F.octet_length("query_ids"))).first()[0] or 0) <= SENT_BYTES
    if few:  # every worker gets all blocks once; a block of cells meets those of its length
        blocks: dict[int, list] = {}
        for r in asked.collect():
            blocks.setdefault(r.d, []).append((r.block, bytes(r.query_ids), bytes(r.queries)))
        sent = rows.sparkSession.sparkContext.broadcast(blocks)
        pairs = scan
    else:
        sent = None
        share = F.pmod(F.xxhash64("ids"), F.lit(SHARES)).alias("share")
        all_blocks = lengths.select("d", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
        spread = scan.select("*", share).join(sized(all_blocks), "d")
        copies = asked.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))).alias("share"))
        pairs = spread.join(copies.hint("merge"), ["d", "block", "share"]).select("d", "block", "query_ids", "queries", "ids", "cells", "shifts")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], Bounds] = {}
        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                for block, query_ids, queries in sent.value.get(d, ()) if sent else ((row["block"], row["query_ids"], row["queries"]),):
                    if (d, block) not in kept:
                        if not sent:  # rows come sorted by their block, so the one before is done
                            for some in kept.values():
                                yield some.rows()
                            kept.clear()
                        kept[d, block] = Bounds(query_ids, queries, d, k)
                    kept[d, block].add(row["ids"], row["cells"], row["shifts"])
        for some in kept.values():
            yield some.rows()

    found = stash(pairs.mapInArrow(bound, "query_id bigint, vec_id bigint, lower bigint, upper bigint"), "bounds")
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    by_upper = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    ranked = found.withColumns({"by_lower": F.row_number().over(by_lower), "place": F.row_number().over(by_upper)})
    kth = ranked.where(F.col("by_lower") == k).select("query_id", F.col("lower").alias("kth"))
    ranked = stash(ranked.join(kth, "query_id", "left").where("kth is null or upper >= kth").select("query_id", "vec_id", "upper", "place"), "candidates")

    def read(pairs: DataFrame) -> DataFrame:
        asked = queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
        product = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
        exact = pairs.join(whole, "vec_id").join(asked, "query_id")
        return exact.select("query_id", "vec_id", product.alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = stash(read(ranked.where(F.col("place") <= 2 * k)), "scores")
    certain = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = ranked.where(F.col("place") > 2 * k).join(certain, "query_id").where("upper >= kth").select("query_id", "vec_id")
    scored = first.unionByName(read(rest))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_rows(most: int, d: int) -> int:
    """Vectors of d components in one block: no more than ``most``, and than ``BLOCK_BYTES`` hold."""
    return max(1, min(most, BLOCK_BYTES // (8 * d + 1)))


def widths(x: np.ndarray) -> np.ndarray:
    """For each vector the least s for which all components shifted by s fit 8 bits."""
    most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    shift = np.zeros(len(x), np.int64)
    while ((most >> shift) > 127).any():
        shift += (most >> shift) > 127
    return shift


class Bounds:
    """Candidates of one block of queries that the cells seen so far can't rule out."""

    def __init__(self, query_ids: bytes, queries: bytes, d: int, k: int):
        self.ids = np.frombuffer(query_ids, np.int64)
        self.x = np.frombuffer(queries, np.int64).reshape(len(self.ids), d)
        self.real = self.x.astype(np.float64)
        self.up = np.maximum(self.x, 0).sum(axis=1)
        self.down = np.minimum(self.x, 0).sum(axis=1)
        self.k = k
        self.query = self.vec = self.lower = self.upper = np.zeros(0, np.int64)
        self.kth = np.full(len(self.ids), np.iinfo(np.int64).min)

    def add(self, ids: bytes, cells: bytes, shifts: bytes) -> None:
        ids, shift = np.frombuffer(ids, np.int64), np.frombuffer(shifts, np.int8).astype(np.int64)
        cells = np.frombuffer(cells, np.int8).reshape(len(ids), -1)
        small = np.abs(self.real).sum(axis=1).max(initial=0) * 128 < 2**53
        base = (self.real @ cells.T.astype(np.float64)).astype(np.int64) if small else self.x @ cells.T.astype(np.int64)
        base = base << shift
        width = (1 << shift) - 1
        lower, upper = base + np.outer(self.down, width), base + np.outer(self.up, width)
        own = self.ids[:, None] == ids
        lower[own] = np.iinfo(np.int64).min
        if len(ids) > self.k:
            kth = np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            self.kth = np.maximum(self.kth, kth)
        q, v = np.nonzero((upper >= self.kth[:, None]) & ~own)
        self.query, self.vec = np.concatenate([self.query, q]), np.concatenate([self.vec, ids[v]])
        self.lower, self.upper = np.concatenate([self.lower, lower[q, v]]), np.concatenate([self.upper, upper[q, v]])
        order = np.lexsort((-self.lower, self.query))
        count = np.bincount(self.query, minlength=len(self.ids))
        full = np.flatnonzero(count >= self.k)
        at = order[(np.cumsum(count) - count)[full] + self.k - 1]
        self.kth[full] = np.maximum(self.kth[full], self.lower[at])
        stay = self.upper >= self.kth[self.query]
        self.query, self.vec, self.lower, self.upper = (x[stay] for x in (self.query, self.vec, self.lower, self.upper))

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[self.query], self.vec, self.lower, self.upper)], ["query_id", "vec_id", "lower", "upper"])


def top_query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM n p JOIN n q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.9),
reach AS (
  SELECT DISTINCT a, a AS b FROM l
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
