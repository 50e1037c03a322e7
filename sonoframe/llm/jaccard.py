"""Documents whose sets of word shingles overlap: a similarity join by signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import ragged_index, sized, stash, text_slices, trimmed
from sonoframe.llm.graph import components
from sonoframe.llm.shingles import mix, set_ids, shingle_sets
from sonoframe.llm.vectors import groups

#: A pair links if at least PART / WHOLE of the union is shared.
PART, WHOLE = 3, 4
#: Frequent shingles that are ordered last, and in how many documents of a batch one counts as such at least; the order alone depends on them, no result.
FREQUENT, OFTEN = 65_536, 8
#: Prefix shingles that one bucket holds on average; a frequent one that more documents than HOT have is dealt over all buckets.
BUCKET, HOT = 400_000, 200_000
#: Sets in one tree, and bytes of them; a larger group or cluster has several trees.
TREE, TREE_BYTES = 4096, 16 << 20
#: Bytes of sorted rows that a task holds before it works on them, and of texts that are shingled at once.
HELD, SLICE = 32 << 20, 1 << 20
#: Children of a node, and node pairs that one step looks at.
FANOUT, STEP = 8, 8192
NARROW, WIDE, SPARSE, SMALL = 64, 1 << 18, 4, 512
#: How much wider than in a tree bitmaps are that leaf pairs are looked at with before their shingles are, and pairs whose shingles are compared at once.
FINER, EXACT = 8, 1024
#: Closer pairs come first: similarities of which each step takes those that the bounds let pass.
CLOSER = ((9, 10), (17, 20), (33, 40), (4, 5), (31, 40))


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n shingles: one to two times as wide as the set is large, ``SPARSE`` times that for small sets."""
    return min(max(NARROW, 1 << ((SPARSE if n <= SMALL else 1) * n - 1).bit_length()), WIDE)


def bitmap(shingles: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def signatures(shingles: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap of each set with a bit for each shingle."""
    return [bitmap(shingles[a:b], width_of(b - a)) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def prefixes(shingles: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first |A| - ceil(3/4 |A|) + 1 shingles of each set in one order for all: rare before frequent, then by value.

    Two sets that link share a shingle among these.
    """
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    often = np.isin(shingles.view(np.int64), frequent) if len(frequent) else np.zeros(len(shingles), bool)
    order = np.lexsort((often, doc))  # stable: values stay in order
    taken = np.where(n > 0, n - -(-n * PART // WHOLE) + 1, 0)
    return shingles[order[ragged_index(at[:-1], taken)]], taken


class Trees:
    """Signature trees of many groups side by side, all of one height, over sets of one signature width.

    A node holds the OR of the bitmaps below it, the range of their sizes and the
    least number of bits of one; ``levels[0]`` are the sets themselves, the last
    level has one root for each group.
    """

    def __init__(self, rows: np.ndarray, group: np.ndarray, bits: np.ndarray, size: np.ndarray, near: np.ndarray, height: int):
        order = np.lexsort((bits[:, 0], size, near, group))
        self.rows, bits, size, group = rows[order], bits[order], size[order], group[order]
        self.levels = [(bits, size, size, np.bitwise_count(bits).sum(axis=1).astype(np.int64))]
        self.below: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(height):
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            nodes = -(-np.diff(np.append(begin, len(group))) // FANOUT)
            cut = np.repeat(begin, nodes) + FANOUT * ragged_index(np.zeros(len(nodes), np.int64), nodes)
            bits, lo, hi, least = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.minimum.reduceat(least, cut)))
            self.below.append((cut, np.diff(np.append(cut, len(group)))))
            group = group[cut]
        self.groups = group

    def relabel(self, label: np.ndarray) -> None:
        """Note for each node the least and the greatest label below it."""
        self.labels = [(label[self.rows], label[self.rows])]
        for cut, _ in self.below:
            lo, hi = self.labels[-1]
            self.labels.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def folded(self, words: int) -> Trees:
        """The same trees with the bitmaps folded to a smaller width."""
        other = object.__new__(Trees)
        other.rows, other.below, other.groups, other.labels, other.levels = self.rows, self.below, self.groups, self.labels, []
        for bits, lo, hi, _ in self.levels:
            bits = np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)
            if other.levels:
                least = np.minimum.reduceat(other.levels[-1][3], self.below[len(other.levels) - 1][0])
            else:
                least = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
            other.levels.append((bits, lo, hi, least))
        return other


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, part: int = PART, whole: int = WHOLE) -> np.ndarray:
    """Node pairs below which a similarity of ``part / whole`` (3/4) is possible.

    Sizes must be within 3:4. Of such A and B at most (4|A| - 3|B|) / 7 shingles
    of A aren't in B, so as many bits of A's bitmap at most are missing in B's;
    the bits that two nodes share bound from above those that A and B can share.
    """
    (ba, la, ha, na), (bb, lb, hb, nb) = a, b
    ok = (whole * ha[i] >= part * lb[j]) & (whole * hb[j] >= part * la[i])
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    shared = np.bitwise_count(ba[i] & bb[j]).sum(axis=1).astype(np.int64)
    both = part + whole
    fine = (both * (na[i] - shared) <= whole * ha[i] - part * lb[j]) & (both * (nb[j] - shared) <= whole * hb[j] - part * la[i])
    ok[at] = fine
    return ok


def traverse(a: Trees, i: np.ndarray, b: Trees, j: np.ndarray, part: int, whole: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that may link, below the given pairs of roots; depth first, in steps of many node pairs.

    Node pairs below which all have one label are pruned too.
    """
    step = max(64, STEP * 16 // a.levels[0][0].shape[1])
    stack = [(len(a.levels) - 1, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            stack.append((level, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        (lo, hi), (other_lo, other_hi) = a.labels[level], b.labels[level]
        mixed = (lo[i] != hi[i]) | (lo[i] != other_lo[j]) | (other_lo[j] != other_hi[j])
        i, j = i[mixed], j[mixed]
        ok = possible(a.levels[level], i, b.levels[level], j, part, whole)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if not level:
            yield a.rows[i], b.rows[j]
            continue
        (start_a, count_a), (start_b, count_b) = a.below[level - 1], b.below[level - 1]
        count = count_a[i] * count_b[j]
        place = ragged_index(np.zeros(len(i), np.int64), count)
        i, j, wide = np.repeat(i, count), np.repeat(j, count), np.repeat(count_b[j], count)
        i, j = start_a[i] + place // wide, start_b[j] + place % wide
        if a is b:
            keep = i < j if level == 1 else i <= j
            i, j = i[keep], j[keep]
        stack.append((level - 1, i, j))


class Exact:
    """Sets by their shingles: ``links`` says which pairs of rows link."""

    def __init__(self, shingles: np.ndarray, at: np.ndarray):
        self.at, self.n = at[:-1], np.diff(at)
        self.code, self.key, self.base = None, None, 0
        self.shingles = shingles

    def finer(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of ``width`` bits, as numbers of 64 bits."""
        made = [bitmap(self.shingles[a : a + n], width) for a, n in zip(self.at[rows].tolist(), self.n[rows].tolist(), strict=True)]
        return np.frombuffer(b"".join(made), np.uint64).reshape(len(rows), -1)

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether wider bitmaps still let pairs pass."""
        rows, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        width = min(WIDE, FINER * width_of(int(self.n[rows].max())))
        bits = self.finer(rows, width)
        least = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        level = (bits, self.n[rows], self.n[rows], least)
        x, y = np.split(where, 2)
        ok = np.zeros(len(i), bool)
        step = max(64, (8 << 20) // (bits.shape[1] * 8))
        for a in range(0, len(i), step):
            ok[a : a + step] = possible(level, x[a : a + step], level, y[a : a + step])
        return ok

    def links(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether 100 times the intersection is at least 75 times the union, for pairs of rows."""
        if self.code is None:
            values, self.code = np.unique(self.shingles, return_inverse=True)
            self.base = len(values)
            self.key = np.repeat(np.arange(len(self.n)), self.n) * self.base + self.code
        i, j = np.where(self.n[i] <= self.n[j], i, j), np.where(self.n[i] <= self.n[j], j, i)
        size = self.n[i]
        key = self.code[ragged_index(self.at[i], size)] + np.repeat(j, size) * self.base
        there = self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] == key
        shared = np.bincount(np.repeat(np.arange(len(i)), size)[there], minlength=len(i))
        return 100 * shared >= 75 * (size + self.n[j] - shared)


def spanning_pairs(group: np.ndarray, right: np.ndarray, size: np.ndarray, bitmaps: list[bytes], label: np.ndarray, exact: Exact | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, of different labels, that connect all that may link, or with ``exact`` all that link.

    Two rows marked ``right`` don't meet. Closer pairs come first; a pair whose
    rows earlier pairs connect is left out.
    """
    label = np.unique(label, return_inverse=True)[1]
    group = np.unique(group, return_inverse=True)[1]
    side = 2 * group + right
    width = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps)) // 8
    times = np.bincount(label)
    near = np.where(times[label] > 1, label + 1, 0)  # those of one component side by side, so that whole nodes are
    height, most = 1, np.bincount(side).max(initial=0)
    while FANOUT**height < most:
        height += 1
    trees = {}
    for words in np.unique(width).tolist():
        rows = np.flatnonzero(width == words)
        bits = np.frombuffer(b"".join(bitmaps[r] for r in rows), np.uint64).reshape(len(rows), words)
        trees[words] = Trees(rows, side[rows], bits, size[rows], near[rows], height)
    found_i, found_j = [], []

    def take(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if exact is not None and len(x):
            ok = exact.links(x, y)
            x, y = x[ok], y[ok]
        x, y, label = joined(x, y, label)
        found_i.append(x)
        found_j.append(y)

    def meet(a: Trees, b: Trees, part: int, whole: int) -> None:
        i, j = [], []
        for mine, other in ((0, 0), (0, 1), (1, 0)):
            if (mine, other) == (1, 0) and a is b:
                continue
            ga, gb = a.groups[a.groups % 2 == mine] // 2, b.groups[b.groups % 2 == other] // 2
            both = np.intersect1d(ga, gb)
            i.append(np.searchsorted(a.groups, 2 * both + mine))
            j.append(np.searchsorted(b.groups, 2 * both + other))
        for x, y in traverse(a, np.concatenate(i), b, np.concatenate(j), part, whole):
            if exact is None:
                take(x, y)
                continue
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if len(x) > 16:
                ok = exact.close(x, y)
                x, y = x[ok], y[ok]
            for at in range(0, len(x), EXACT):
                take(x[at : at + EXACT], y[at : at + EXACT])

    for part, whole in (*CLOSER, (PART, WHOLE)):
        for tree in trees.values():
            tree.relabel(label)
        for words, own in trees.items():
            meet(own, own, part, whole)
            if 2 * words in trees:
                meet(own, trees[2 * words].folded(words), part, whole)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = HELD) -> Iterator[pa.Table]:
    """Sorted batches cut anew, so that rows with equal keys are in one table; it has ``limit`` bytes or one group's."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(x.nbytes for x in held) < limit:
            continue
        table = pa.concat_tables(held).combine_chunks()
        last = np.zeros(len(table), bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last |= column != column[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut).combine_chunks()]
    if sum(map(len, held)):
        yield pa.concat_tables(held).combine_chunks()


def joined(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs, a set that connects what all of them connect; and the labels after that."""
    parent = int(label.max(initial=-1)) + 1
    root = list(range(parent))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(label[i].tolist(), label[j].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    kept = np.array(kept, np.int64)
    return i[kept], j[kept], np.fromiter(map(find, range(parent)), np.int64, parent)[label]


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_shingles``, ``component_id``.

    Two documents link if the sets of their word shingles share at least 3/4 of
    their union, exactly; see :mod:`sonoframe.llm.shingles` for the sets (64-bit
    hashes stand for shingles and for whole sets). ``component_id`` is the
    smallest key that a document reaches by links, itself included.

    Equal sets are one class. A class is listed under the shingles of its prefix,
    and classes that share one form a group; two that link meet in at least one.
    In each group, signature trees (OR-combined bitmaps, size ranges) are
    traversed pairwise, node pairs whose greatest possible overlap is too small
    are pruned with all below them, and pairs that span what remains go on: every
    link lies within a cluster that they connect. Then the shingles of each
    cluster's classes come together, once for each class; trees are traversed
    again, leaf pairs are verified by their shingles, and a forest of true links
    is the result. A group or cluster of more sets than a tree holds has several:
    each is a task, and sets that aren't of the group's largest component so far
    visit the other trees, so pairs of any two components are met.

    Null, empty or blank texts have no shingles and link with nothing; rows with
    a null key take the component of their class (null if alone). Repeated rows
    stay, extra columns go, an empty table gives an empty table.
    """
    sets, facts = _classified(docs, key, text)
    least = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = stash(facts.join(least, "component").select("cls", "component_id"), "least")
    return sets.join(facts, "cls", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def first_of_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of each component only one does.

    That is the row of the smallest key (null counts as the greatest; of equal
    keys, that of the smallest set id; of repeated rows, any). Rows without
    shingles stay.
    """
    sets, facts = _classified(docs, key, text)
    own, name, its = "hash of the row", "key of a dropped row", "hash of it"
    rows = sets.where("n > 0").groupBy("key", "cls", "h").agg(F.count("*").alias("times")).join(facts.select("cls", "component"), "cls")
    rows = stash(rows, "keyed")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "cls", "h")).alias("first"))
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("cls") == F.col("first.cls")) & (F.col("h") == F.col("first.h"))
    rows = stash(rows.join(first, "component").select(F.col("key").alias(name), F.col("h").alias(its), "times", stays.alias("stays")), "decided")
    gone = rows.where("not stays").select(name, its)
    marked = docs.withColumn(own, _text_hash(text))
    kept = marked.join(sized(stash(gone, "dropped")), marked[key].eqNullSafe(F.col(name)) & (F.col(own) == F.col(its)), "left_anti")
    often = stash(rows.where("stays and times > 1").select(name, its), "repeated")
    if often.limit(1).count():
        repeated = kept[key].eqNullSafe(F.col(name)) & (F.col(own) == F.col(its))
        kept = kept.join(sized(often), repeated, "left_anti").unionByName(kept.join(sized(often), repeated, "left_semi").dropDuplicates([key, own]))
    return kept.drop(own)


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _classified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, n, cls, h) of all documents, and (cls, least, component) of the classes with shingles."""
    kind = dict(docs.dtypes)[key]
    fields = f"key {kind}, n bigint, cls bigint, h bigint, sig binary, token bigint, df bigint"
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _text_hash(text).alias("h"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # shingles that recur in the batch, and how often
            for i, j in text_slices(batch.column("text"), SLICE):
                part = batch.slice(i, j - i)
                shingles, at = shingle_sets(part.column("text"))
                token, df = np.unique(shingles.view(np.int64), return_counts=True)
                token, df = token[df > 1], df[df > 1]  # most occur once
                seen, count = np.concatenate([seen, token]), np.concatenate([count, df])
                nothing = pa.nulls(len(part), pa.int64())
                sig = pa.array(signatures(shingles, at), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(at)), pa.array(set_ids(shingles, at)), part.column("h"), sig, nothing, nothing], names)
            token, where = np.unique(seen, return_inverse=True)
            df = np.bincount(where, count, len(token)).astype(np.int64)
            often = df >= max(OFTEN, len(batch) // 1024)
            none = pa.nulls(int(often.sum()), pa.int64())
            columns = [none.cast(batch.column("key").type), none, none, none, pa.nulls(len(none), pa.binary()), pa.array(token[often]), pa.array(df[often])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "n", "cls", "h", "sig", "token", "df"]
    listed = stash(docs.mapInArrow(trimmed(first), fields), "sets")
    sets = listed.where("n is not null")
    classes = sets.where("n > 0").groupBy("cls").agg(F.min("key").alias("least"), F.max("n").alias("n"), F.min("h").alias("h"), F.first("sig").alias("sig"))
    classes = stash(classes, "classes")
    top = listed.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(FREQUENT).collect()
    shared = _shared(docs, np.array(sorted(r.token for r in top), np.int64), np.array(sorted(r.token for r in top if r.df > HOT), np.int64), classes)

    # clusters: what pairs that the bitmaps can't rule out connect; first in each class's largest group, then in all
    pairs = _met(_primary(shared), None, classes, visits=False)
    clusters = components(pairs)
    pairs = stash(pairs.unionByName(_met(shared.select("grp", "cls", "n"), clusters, classes, visits=True)), "pairs")
    clusters = components(pairs)
    members = stash(classes.select("cls", "n", "h").join(clusters.select(F.col("node").alias("cls"), F.col("component").alias("grp")), "cls"), "members")
    held = _shingled(docs, members)
    linked = _met(members.select("grp", "cls", "n"), None, held, visits=False, exact=True)
    labels = components(linked)
    again = _met(members.select("grp", "cls", "n"), labels, held, visits=True, exact=True)
    if again is not None:
        labels = components(linked.unionByName(again))
    facts = classes.select("cls", "least").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    facts = facts.withColumn("component", F.coalesce("component", "cls"))
    return sets, stash(facts, "components")


def _shingled(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, sig) with the shingles of one text of each class; copies of it may come again, from other batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = np.sort(np.unique(batch.column("h").to_numpy(), return_index=True)[1])
            batch = batch.take(pa.array(once))
            for i, j in text_slices(batch.column("text"), SLICE):
                part = batch.slice(i, j - i)
                shingles, at = shingle_sets(part.column("text"))
                cls = set_ids(shingles, at)
                own = np.flatnonzero(cls == part.column("cls").to_numpy())
                packed = [shingles[at[r] : at[r + 1]].tobytes() for r in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array(packed, pa.binary())], ["cls", "sig"])

    found = docs.select("text", "h").join(sized(members.select("h", "cls")), "h").mapInArrow(trimmed(run), "cls bigint, sig binary")
    return stash(found.dropDuplicates(["cls"]), "shingles")


def _shared(docs: DataFrame, often: np.ndarray, hot: np.ndarray, classes: DataFrame) -> DataFrame:
    """Groups of classes that share a prefix shingle, two of fitting sizes at least: (grp, cls, n, many).

    Entries meet in a bucket for each shingle; those of shingles in ``hot`` are
    dealt over all buckets by class, and Spark counts them.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(often)
    total = classes.agg(F.sum(F.col("n") / WHOLE + 2)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / BUCKET) + 1)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column("text"), SLICE):
                shingles, at = shingle_sets(batch.column("text").slice(i, j - i))
                cls, n = set_ids(shingles, at), np.diff(at)
                token, taken = prefixes(shingles, at, frequent.value)
                owner = np.repeat(np.arange(len(n)), taken)
                once = np.zeros(len(n), bool)
                once[np.unique(cls, return_index=True)[1]] = True
                token, owner = token[once[owner]], owner[once[owner]]
                place = token >> np.uint64(8)
                if len(hot):
                    place = np.where(np.isin(token.view(np.int64), hot), mix(cls[owner].view(np.uint64)), place)
                bucket = (place % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                token, owner, bucket = token[order].view(np.int64), owner[order], bucket[order]
                used = np.unique(bucket)
                cuts = np.searchsorted(bucket, np.append(used, buckets)).tolist()
                pieces = list(zip(cuts, cuts[1:], strict=False))
                packed = lambda x: pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(used), packed(token), packed(cls[owner]), packed(n[owner].astype(np.int32))], ["bucket", "token", "cls", "n"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["bucket"]):
            token, cls, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("token", np.int64), ("cls", np.int64), ("n", np.int32)))
            order = np.lexsort((cls, n, token))
            token, cls, n = token[order], cls[order], n[order].astype(np.int64)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            token, cls, n = token[new], cls[new], n[new]
            if len(hot):
                some = np.isin(token, hot)
                if some.any():
                    columns = (token[some], cls[some], n[some], np.full(some.sum(), -1))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["grp", "cls", "n", "many"])
                token, cls, n = token[~some], cls[~some], n[~some]
            fits = (token[1:] == token[:-1]) & (PART * n[1:] <= WHOLE * n[:-1])
            keep = np.zeros(len(token), bool)
            keep[1:] |= fits
            keep[:-1] |= fits
            token, cls, n = token[keep], cls[keep], n[keep]
            if not len(token):
                continue
            # shingles that the same classes share make one group, named by its classes
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.diff(np.append(begin, len(token)))
            name = mix(np.add.reduceat(mix(cls.view(np.uint64)), begin)).view(np.int64)
            once = np.zeros(len(begin), bool)
            once[np.unique(name, return_index=True)[1]] = True
            stay = np.repeat(once, many)
            columns = (np.repeat(name, many), cls, n, np.repeat(many, many))
            yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in columns], ["grp", "cls", "n", "many"])

    packed = docs.select("text").mapInArrow(trimmed(listed), "bucket int, token binary, cls binary, n binary")
    met = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(meeting), "grp bigint, cls bigint, n bigint, many bigint")
    shared = stash(met.groupBy("grp", "cls").agg(F.max("n").alias("n"), F.max("many").alias("many")), "shared")
    if not len(hot):
        return shared
    # of hot shingles that the same classes share, the first stays
    large = shared.where("many < 0").groupBy("grp").agg(F.bit_xor(F.xxhash64("cls")).alias("name"), F.count("*").alias("count"))
    large = stash(large.groupBy("name", "count").agg(F.min("grp").alias("grp")).select("grp", "count"), "large")
    known = shared.where("many < 0").join(F.broadcast(large), "grp").select("grp", "cls", "n", F.col("count").alias("many"))
    return stash(shared.where("many >= 0").unionByName(known), "shared")


def _primary(shared: DataFrame) -> DataFrame:
    """Of each class its largest group; near copies have it in common as a rule."""
    return shared.groupBy("cls").agg(F.max(F.struct("many", "grp"))["grp"].alias("grp"), F.max("n").alias("n"))


def _met(rows: DataFrame, labels: DataFrame | None, sigs: DataFrame, visits: bool, exact: bool = False) -> DataFrame | None:
    """Pairs (a, b) of classes of different components that span what the trees of each group let pass.

    ``sigs`` has the bitmaps or, if ``exact``, the shingles of the classes, and
    links are verified. Without ``visits`` sets meet in their own tree only; with
    it those that aren't of their group's largest component also visit its other
    trees. If ``exact`` and ``visits``, groups of one tree are left out, and the
    result is None if there are no others.
    """
    if labels is None:
        rows = rows.withColumn("label", F.col("cls"))
    else:
        rows = rows.join(labels.select(F.col("node").alias("cls"), F.col("component").alias("label")), "cls", "left")
        rows = stash(rows.withColumn("label", F.coalesce("label", "cls")), "labelled")
    size = F.col("n") * 8 if exact else F.least(F.greatest(F.col("n"), F.lit(NARROW // 8)), F.lit(WIDE // 8))
    mixed = rows.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n_sets"), F.sum(size).alias("bytes"))
    trees = F.ceil(F.greatest(F.col("n_sets") / TREE, F.col("bytes") / TREE_BYTES)).alias("trees")
    mixed = mixed.where("low != high").select("grp", trees)
    mixed = stash(mixed.where("trees > 1") if exact and visits else mixed, "groups")
    if exact and visits and not mixed.limit(1).count():
        return None
    rows = rows.join(sized(mixed), "grp")
    home = F.pmod(F.xxhash64("cls"), F.col("trees"))
    if visits:
        large = rows.where("trees > 1").groupBy("grp", "label").count().groupBy("grp").agg(F.max(F.struct("count", "label"))["label"].alias("largest"))
        rows = rows.join(sized(stash(large, "largest")), "grp", "left")
        stays = (F.col("trees") == 1) | (F.col("label") == F.col("largest"))
        rows = rows.withColumn("tree", F.explode(F.when(stays, F.array(home)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("trees") - 1))))
    else:
        rows = rows.withColumn("tree", home)
    rows = rows.withColumn("visits", F.col("tree") != home).join(sigs.select("cls", "sig"), "cls")
    where = ["grp", "tree"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, where):
            grp, tree, cls, n, label = (table.column(c).to_numpy() for c in [*where, "cls", "n", "label"])
            right = table.column("visits").to_numpy(zero_copy_only=False)
            new = np.ones(len(grp), bool)
            new[1:] = (grp[1:] != grp[:-1]) | (tree[1:] != tree[:-1])
            sig, sets = table.column("sig").to_pylist(), None
            if exact:
                sets = Exact(np.frombuffer(b"".join(sig), np.uint64), np.concatenate([[0], np.cumsum(n)]))
                sig = signatures(sets.shingles, np.append(sets.at, len(sets.shingles)))
            i, j = spanning_pairs(np.cumsum(new), right, n, sig, label, sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], ["a", "b"])

    rows = rows.select("grp", "tree", "visits", "cls", "n", "label", "sig")
    return stash(rows.repartition(*where).sortWithinPartitions(*where).mapInArrow(trimmed(pairs), "a bigint, b bigint"), "linked" if exact else "near")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS s FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a, a AS b FROM sides
  UNION
  SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN least ON a = doc_id
"""
