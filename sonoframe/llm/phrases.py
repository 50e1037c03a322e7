"""Collocations from a weighted de Bruijn graph: words are letters, pairs of words are nodes, triples are edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import hand_back, ragged_index, sized, stash, text_buffer, text_slices, trimmed
from sonoframe.llm.shingles import mix, powers

#: Text bytes whose edges are summed before they travel, or one text.
SLICE = 3 << 19
#: Parts of the graph for each input partition.
PARTS = 8
#: Rows, and characters of each, in which frequent words are looked for, and the share that makes one. Pairs of them are dealt
#: by edge, other pairs by node: this settles only where things meet; all texts are counted whole.
SAMPLE, SAMPLE_CHARS, SHARE = 256, 4096, 512
#: Stands for "the piece has ended".
END = 0

_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)

PARTIAL = "lang string, part int, a array<bigint>, b array<bigint>, c array<bigint>, f array<bigint>, w array<string>"
REDUCED = "kind string, lang string, a array<bigint>, b array<bigint>, c array<bigint>, f array<bigint>, w array<string>"


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and their pieces; pieces of different texts differ."""
    apart = _BLANK[data] | _BREAK[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start, end = ~apart, ~apart
    start[1:] &= apart[:-1]
    start[first] = ~apart[first]
    end[:-1] &= apart[1:]
    before = first[first > 0] - 1
    end[before] = ~apart[before]
    starts = np.flatnonzero(start)
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts] + np.searchsorted(offsets, starts, side="right")
    return starts, np.flatnonzero(end) + 1, piece


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, with A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.int64)
    length = ends - starts
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    value = powers(int(length.max()))[place]
    value *= _LOWER[data[np.repeat(starts - at, length) + np.arange(len(place))]] + np.uint64(1)
    hashes = mix(np.add.reduceat(value, at) + length.astype(np.uint64) * _ODD).view(np.int64)
    hashes[hashes == END] = 1
    return hashes


def edges_of(hashes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word the edge that begins with it; what lies beyond the end of its piece is ``END``."""
    b, c = np.full(len(hashes), END), np.full(len(hashes), END)
    b[:-1] = np.where(piece[1:] == piece[:-1], hashes[1:], END)
    c[:-2] = np.where(piece[2:] == piece[:-2], hashes[2:], END)
    return hashes, b, c


def summed(columns: list[np.ndarray], f: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, and the sum of ``f`` over each."""
    if not len(f):
        return columns, f
    key = np.zeros(len(f), np.uint64)
    for x in columns:
        key = mix(key * _ODD + x.view(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) != 0)
    changes = np.append(True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in columns]))
    if (changes & ~new).any():  # two rows share a key
        order = np.lexsort(columns[::-1])
        changes = np.append(True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in columns]))
    first = np.flatnonzero(changes)
    return [x[order[first]] for x in columns], np.add.reduceat(f[order], first)


def _dealt(n: int, *columns: np.ndarray) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        key = mix(key + x.view(np.uint64) * _ODD)
    return (key >> np.uint64(8)).astype(np.int64) % n


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


class Graph:
    """The graph of all texts by language: what of it can be a phrase of ``least`` occurrences.

    ``edges`` (lang, a, b, c, f): triples of words, as hashes; ``nodes`` (lang, a,
    b, f): pairs; ``words`` (lang, a, f); each with f >= ``least``; ``totals``
    (lang, n): all occurrences of words; ``spelt`` (lang, h, word).

    Every word occurrence is one edge, to the two words after it or to the end
    of its piece. Each slice of text sums its edges, and those of one part of
    the graph travel together. Parts hold whole nodes but for pairs of frequent
    words, whose edges are spread. What flows out of a node, ends included, is
    its count; what flows out of all nodes that begin with a word, pieces that
    end with it included, is the word's.
    """

    def __init__(self, docs: DataFrame, least: int = 10, lang: str = "lang", text: str = "text"):
        rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
        parts = PARTS * max(1, rows.rdd.getNumPartitions())
        sample = pa.array([r[0] for r in rows.select(F.substring("text", 1, SAMPLE_CHARS)).limit(SAMPLE).collect()], pa.string())
        data, offsets = text_buffer(sample)
        seen, times = np.unique(hashed(data, *split_words(data, offsets)[:2]), return_counts=True)
        frequent = seen[times * SHARE >= times.sum()]

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j in text_slices(batch.column("text"), SLICE):
                    yield from _partial(batch.slice(i, j - i), parts, frequent)

        def reduce(table: pa.Table) -> pa.Table:
            out = _reduced(table, frequent, least)
            hand_back()
            return out

        split_rows = rows.mapInArrow(trimmed(split), PARTIAL)
        found = stash(split_rows.groupBy("lang", "part").applyInArrow(reduce, REDUCED), "graph")

        def unrolled(kind: str, *names: str) -> DataFrame:
            zipped = F.explode(F.arrays_zip(*names)).alias("x")
            return found.where(F.col("kind") == kind).select("lang", zipped).select("lang", *(F.col(f"x.{c}").alias(c) for c in names))

        self.edges = unrolled("edges", "a", "b", "c", "f")
        split_nodes = unrolled("spread", "a", "b", "f").groupBy("lang", "a", "b").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        self.nodes = unrolled("nodes", "a", "b", "f").unionByName(split_nodes)
        self.spelt = unrolled("spelt", "a", "w").select("lang", F.col("a").alias("h"), F.col("w").alias("word"))

        # words that are too rare to matter are summed up as one, for the totals
        flows = unrolled("flows", "a", "f").groupBy("lang", "a").agg(F.sum("f").alias("f"))
        flows = flows.withColumn("a", F.when(F.col("f") >= least, F.col("a")))
        words = stash(flows.groupBy("lang", "a").agg(F.sum("f").alias("f")), "words")
        self.words = words.where("a is not null")
        self.totals = words.groupBy("lang").agg(F.sum("f").alias("n"))


def _partial(batch: pa.RecordBatch, parts: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Summed edges and distinct words of one slice, a row for each language and part."""
    data, offsets = text_buffer(batch.column("text"))
    starts, ends, piece = split_words(data, offsets)
    if not len(starts):
        return
    hashes = hashed(data, starts, ends)
    langs = batch.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(offsets, starts, side="right") - 1]
    a, b, c = edges_of(hashes, piece)
    (lang_of, a, b, c), f = summed([lang, a, b, c], np.ones(len(a), np.int64))
    spread = _both(a, b, frequent)
    to = lang_of * parts + np.where(spread, _dealt(parts, a, b, c), _dealt(parts, a, b))
    order = np.lexsort((a, to))
    a, b, c, f, to = a[order], b[order], c[order], f[order], to[order]
    # one place of every distinct word
    key, at = np.unique(mix(hashes.view(np.uint64) + mix(lang.view(np.uint64))), return_index=True)
    word_to = lang[at] * parts + _dealt(parts, hashes[at])
    at, word_to = at[order := np.argsort(word_to, kind="stable")], word_to[order]
    length = ends[at] - starts[at]
    low = _LOWER[data[ragged_index(starts[at], length)]].astype(np.uint8)
    spelt = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32)), pa.py_buffer(low))
    groups = np.union1d(to, word_to)
    cuts = np.append(np.searchsorted(to, groups), len(to))
    word_cuts = np.append(np.searchsorted(word_to, groups), len(word_to))
    names = langs.dictionary.take(pa.array(groups // parts))
    yield pa.RecordBatch.from_arrays(
        [names, pa.array((groups % parts).astype(np.int32)), *(_lists(x, cuts) for x in (a, b, c, f)), pa.ListArray.from_arrays(pa.array(word_cuts, pa.int32()), spelt)],
        ["lang", "part", "a", "b", "c", "f", "w"],
    )


def _both(a: np.ndarray, b: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return np.isin(a, frequent) & np.isin(b, frequent)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pc.list_flatten(table.column(name)).to_numpy().astype(np.int64)


def _reduced(table: pa.Table, frequent: np.ndarray, least: int) -> pa.Table:
    """One part of the graph: its frequent edges and nodes, the flow out of its words, and how words are spelt."""
    lang = table.column("lang")[0].as_py()
    (a, b, c), f = summed([_flat(table, x) for x in "abc"], _flat(table, "f"))
    rows: dict[str, list] = {x: [] for x in ("kind", "lang", "a", "b", "c", "f", "w")}

    def put(kind: str, **columns) -> None:
        for name in rows:
            rows[name].append({"kind": kind, "lang": lang}.get(name, columns.get(name)))

    often = (f >= least) & (c != END)
    put("edges", a=a[often], b=b[often], c=c[often], f=f[often])
    (u, v), flow = summed([a, b], f)
    inner = v != END
    spread = _both(u, v, frequent) & inner
    often = inner & ~spread & (flow >= least)
    put("nodes", a=u[often], b=v[often], f=flow[often])
    put("spread", a=u[spread], b=v[spread], f=flow[spread])
    (u,), flow = summed([u], flow)
    put("flows", a=u, f=flow)
    spelt = pc.unique(pc.list_flatten(table.column("w")))
    data, offsets = text_buffer(spelt)
    put("spelt", a=hashed(data, offsets[:-1], offsets[1:]), w=spelt.to_pylist())
    kinds = {"kind": pa.string(), "lang": pa.string(), "w": pa.list_(pa.string())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.list_(pa.int64()))) for k, v in rows.items()})


def compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unary paths of the graph: lang, path (hashes of its words in order), f.

    An edge is unary if its count is that of the node it leaves and of the node
    it enters: the one goes nowhere else and the other is come by no other way.
    Such edges form paths (never rings, as every piece ends), on which all nodes
    and edges have one count. Steps are doubled until every node knows the end
    of its path and how far it is, some 13 joins for passages of 5,000 words;
    a path is no longer than the piece of text that it occurs in.
    """
    unary = with_flows(edges, nodes).where("f = f_ab and f = f_bc")
    steps = stash(unary.select("lang", "a", "b", F.struct(F.col("b").alias("a"), F.col("c").alias("b")).alias("to"), F.lit(1).alias("far"), "f", F.lit(True).alias("moved")), "steps")
    while not steps.where("moved").isEmpty():
        ahead = steps.select("lang", F.struct("a", "b").alias("to"), F.col("to").alias("further"), F.col("far").alias("more"))
        steps = steps.join(ahead, ["lang", "to"], "left").select(
            "lang", "a", "b", F.coalesce("further", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), "f", F.col("further").isNotNull().alias("moved")
        )
        steps = stash(steps, "steps")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("at"), "a")))
    paths = steps.groupBy("lang", "to").agg(ordered.alias("own"), F.first("f").alias("f"))
    return paths.select("lang", F.concat(F.col("own.a"), F.array("to.a", "to.b")).alias("path"), "f")


def with_flows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the counts of the nodes that they leave (f_ab) and enter (f_bc)."""
    left = nodes.select("lang", "a", "b", F.col("f").alias("f_ab"))
    right = nodes.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc"))
    return edges.join(left, ["lang", "a", "b"]).join(right, ["lang", "b", "c"])


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    big = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big(a) * big(a), big(left) * big(right))


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The ``top`` phrases of 2 or 3 words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts in lower case (A-Z) fall into pieces at ``.,;:!?`` and line ends, and
    those into words at spaces and tabs. Phrases with a = f(phrase) >= ``least``
    are candidates, scored by the cut that scores lowest. A pair in a candidate
    of three words with at least ``covered`` per cent of its count is dropped.

    Counts come from a :class:`Graph`: those of pairs and words are flows. Its
    unary paths (:func:`compacted`) give their triples, with the counts of both
    pairs in them, and drop all their pairs without a join; the rest of the
    edges meet their nodes.

    A null language is ``und``; null and empty texts have no words; repeated
    rows count each. Languages without a candidate have no row. Extra columns
    are ignored; an empty table gives an empty table. Words are told apart by 64
    bits of a hash.
    """
    graph = Graph(docs, least, lang, text)
    edges, nodes = stash(graph.edges, "edges"), stash(graph.nodes, "nodes")
    paths = stash(compacted(edges, nodes).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("path") - 2))), "paths")
    word = lambda i: F.element_at("path", F.col("at") + i).alias("abc"[i])
    unary = paths.select("lang", word(0), word(1), word(2), "f")
    rest = edges.join(unary.select("lang", "a", "b", "c"), ["lang", "a", "b", "c"], "left_anti")
    triples = with_flows(rest, nodes).select("lang", "a", "b", "c", "f", "f_ab", "f_bc").unionByName(unary.select("*", F.col("f").alias("f_ab"), F.col("f").alias("f_bc")))
    triples = stash(triples, "triples")
    inside = triples.where(F.col("f") * 100 >= F.col("f_ab") * covered).select("lang", "a", "b").unionByName(
        triples.where(F.col("f") * 100 >= F.col("f_bc") * covered).select("lang", F.col("b").alias("a"), F.col("c").alias("b"))
    )
    pairs = nodes.join(inside.distinct(), ["lang", "a", "b"], "left_anti")
    first = graph.words.select("lang", F.col("a"), F.col("f").alias("f_first"))
    last = lambda c: graph.words.select("lang", F.col("a").alias(c), F.col("f").alias("f_last"))
    pairs = pairs.join(first, ["lang", "a"]).join(last("b"), ["lang", "b"])
    pairs = pairs.select("lang", F.array("a", "b").alias("words"), F.col("f").alias("a"), F.col("f_first").alias("l"), F.col("f_last").alias("r"), _score(F.col("f"), F.col("f_first"), F.col("f_last")).alias("score"))
    triples = triples.join(first, ["lang", "a"]).join(last("c"), ["lang", "c"])
    one = F.struct(_score(F.col("f"), F.col("f_first"), F.col("f_bc")).alias("score"), F.lit(1).alias("k"), F.col("f_first").alias("l"), F.col("f_bc").alias("r"))
    two = F.struct(_score(F.col("f"), F.col("f_ab"), F.col("f_last")).alias("score"), F.lit(2).alias("k"), F.col("f_ab").alias("l"), F.col("f_last").alias("r"))
    triples = triples.select("lang", F.array("a", "b", "c").alias("words"), F.col("f").alias("a"), F.least(one, two).alias("cut"))
    triples = triples.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ranked = stash(pairs.unionByName(triples).withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank"), "ranked")
    asked = sized(stash(ranked.select("lang", F.explode("words").alias("h")).distinct(), "asked"))
    spelt = graph.spelt.join(asked, ["lang", "h"], "left_semi")
    put = ranked.select("*", F.posexplode("words").alias("at", "h")).join(spelt, ["lang", "h"])
    put = put.groupBy("lang", "words", "a", "l", "r", "score").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    rank = F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    put = put.withColumn("rank", rank).where(F.col("rank") <= top).join(sized(graph.totals), "lang")
    return put.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
grams AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (VALUES (1), (2), (3)) AS sizes(k)
  WHERE i + k - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
halves AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM halves c JOIN grams l ON l.lang = c.lang AND l.phrase = c.head JOIN grams r ON r.lang = c.lang AND r.phrase = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s
  JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) t
    ON t.lang = s.lang AND t.phrase = s.phrase
  WHERE 100 * t.a >= 50 * s.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM lowest ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
