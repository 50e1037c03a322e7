"""Personal data: fixed patterns, and terms that co-occurrence shows to reveal them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, stash, text_slices, trimmed, with_fields

KINDS = ("email", "ip", "card", "phone", "term")

#: An address is found from its "@"; what stands before it is added by hand, which keeps long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that begins inside a run of digits would have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: A chain of digits matches from its first digit to its last, so shorter ones can be left out.
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]")
#: Stands for all entities.
ANY = "*"
_TERM = re.compile(r"\w{3,}")
_SPACE = re.compile(r"\s")
#: Rows that a task holds before it hands them on.
HELD = 100_000


def luhn(digits: str) -> bool:
    odd = sum(int(x) for x in digits[-1::-2])
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of addresses, IPs, cards and phone numbers, by kind and start."""
    if not _ANY.search(text):
        return []
    found = []
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _NO_DIGIT.sub('', value)}"


def parted(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with a space between spans that no white space parts, so that each is a word, and its base spans there."""
    parts, spans, at, last = [], [], 0, -1
    for kind, start, end in sorted(base_spans(text), key=lambda x: x[1:]):
        if 0 <= last <= start and not _SPACE.search(text, last, start):
            parts.append(text[at:start])
            at = start
        spans.append((kind, start + len(parts), end + len(parts)))
        last = max(last, end)
    return " ".join([*parts, text[at:]]), spans


def words_before(text: str, start: int, window: int) -> list[str]:
    """The last ``window`` words of the line before a place, however long they are."""
    reach = 40 * window
    while True:
        line = text[max(0, start - reach) : start].rpartition("\n")[2]
        words = line.split()
        if len(words) > window or len(line) < reach:
            return words[-window:]
        reach *= 2


def words_after(text: str, end: int, window: int) -> list[str]:
    """The first ``window`` words of the line after a place."""
    reach = 40 * window
    while True:
        line = text[end : end + reach].partition("\n")[0]
        words = line.split()
        if len(words) > window or len(line) < reach:
            return words[:window]
        reach *= 2


def contexts(text: str, window: int) -> Iterator[tuple[str, set[str], str]]:
    """(entity, terms near it on its line, digest of those words) of each base span."""
    text, spans = parted(text)
    for kind, start, end in spans:
        before, after = words_before(text, start, window), words_after(text, end, window)
        words = {x.lower() for x in _TERM.findall(" ".join([*before, *after]))}
        yield entity(kind, text[start:end]), words, hashlib.md5(" ".join([*before, "\0", *after]).encode()).hexdigest()


def revealing_terms(
    docs: DataFrame, text: str = "text", window: int = 8, contexts_at_least: int = 3, posterior: float = 0.8, bits: float = 4.0
) -> DataFrame:
    """Terms that reveal a protected entity: ``term``, ``entity``, ``p_entity``, ``bits``.

    From all rows: a term counts as evidence for an entity if both stand within
    ``window`` words in at least ``contexts_at_least`` different contexts
    (copies of one passage are one context). With n(t) rows that hold the term
    and n(t, e) that hold it near the entity, it exceeds the disclosure
    threshold if n(t, e) / n(t) >= ``posterior`` and log2 of the ratio of that
    to the entity's share of all rows is at least ``bits``.
    """
    spark = docs.sparkSession

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        names, types = ["entity", "term", "context", "n"], [pa.string()] * 3 + [pa.int64()]
        for batch in batches:
            for i, j in text_slices(batch.column(text)):
                rows = []
                for value in batch.column(text).slice(i, j - i).to_pylist():
                    each: dict[str, set[str]] = {}
                    met = set()
                    for name, words, digest in contexts(value or "", window):
                        if (name, digest) in met:
                            continue
                        met.add((name, digest))
                        mine = each.setdefault(name, set())
                        words = words | {""}
                        rows += [(name, t, digest, int(t not in mine)) for t in words]
                        mine |= words
                        if len(rows) >= HELD:
                            yield packed(rows)
                            rows = []
                    rows += [(ANY, t, "", 1) for t in set().union(*each.values()) if t]
                if rows:
                    yield packed(rows)

    # a row for each document, entity, term and context, n = 1 on the first of the document's contexts and else 0;
    # term "" stands for the entity itself, entity ANY for all of them
    pairs = docs.select(text).mapInArrow(trimmed(near), "entity string, term string, context string, n bigint")
    counted = (
        pairs.groupBy("entity", "term", "context")
        .agg(F.sum("n").alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_pair"), F.count("*").alias("n_contexts"))
        .where((F.col("n_contexts") >= contexts_at_least) | (F.col("entity") == ANY))
    )
    counted = stash(counted, "evidence")
    entities = counted.where("term = ''").select("entity", F.col("n_pair").alias("n_entity"))
    # no term is in fewer rows than it is near any entity in, which bounds the posterior from above
    near_any = counted.where(F.col("entity") == ANY).select("term", F.col("n_pair").alias("n_near"))
    told = counted.where((F.col("entity") != ANY) & (F.col("term") != "")).join(near_any, "term")
    told = stash(told.where(F.col("n_pair") >= posterior * F.col("n_near")), "likely")
    terms = stash(told.select("term").distinct(), "evidence-terms")
    n_rows = docs.count()
    seen = _document_counts(docs, terms, text)
    return stash(
        told.join(entities, "entity")
        .join(seen, "term")
        .withColumn("p_entity", F.col("n_pair") / F.col("n_term"))
        .withColumn("bits", F.log2(F.col("p_entity") * F.lit(n_rows) / F.col("n_entity")))
        .where((F.col("p_entity") >= posterior) & (F.col("bits") >= bits))
        .select("term", "entity", "p_entity", "bits"),
        "revealing",
    )


def _document_counts(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(term, n_term): in how many rows each of the terms stands."""
    few = _few(terms)
    if few is None:
        return holding(docs, terms, text).groupBy("term").agg(F.count("*").alias("n_term"))
    if not few.value:
        return terms.select("term", F.lit(0).cast("bigint").alias("n_term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(text):
                counts.update(few.value.intersection({x.lower() for x in _TERM.findall(value.as_py() or "")}))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n_term"])

    return docs.select(text).mapInArrow(trimmed(run), "term string, n_term bigint").groupBy("term").agg(F.sum("n_term").alias("n_term"))


def holding(docs: DataFrame, terms: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row (keys, term) for each document and each of the terms that it holds.

    Up to ``BROADCAST_ROWS`` terms travel to the scan; beyond, the documents'
    distinct words are joined with them.
    """
    few = _few(terms)
    if few is not None and not few.value:
        return docs.select(*keys).limit(0).withColumn("term", F.lit(""))
    fields = with_fields(docs.select(*keys), "term string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(text)):
                part = batch.slice(i, j - i)
                at, found = [], []
                for row, value in enumerate(part.column(text).to_pylist()):
                    words = {x.lower() for x in _TERM.findall(value or "")}
                    words = words if few is None else words & few.value
                    at += [row] * len(words)
                    found += words
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at, pa.int64())) for k in keys), pa.array(found, pa.string())], [*keys, "term"])

    words = docs.select(*keys, text).mapInArrow(trimmed(run), fields)
    return words if few is not None else words.join(terms, "term", "left_semi")


def _few(terms: DataFrame):
    """The terms as a broadcast set if they are few and short."""
    return terms.sparkSession.sparkContext.broadcast({x["term"] for x in terms.collect()}) if _small(terms) else None


def _small(terms: DataFrame) -> bool:
    """Whether the terms are few and short enough to be sent to all workers."""
    row = terms.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    return row["n"] <= BROADCAST_ROWS and row["bytes"] <= BROADCAST_BYTES


def all_spans(text: str, terms: set[str] | frozenset[str]) -> list[tuple[int, int, int]]:
    """Base spans, then the spans of the given terms outside them."""
    base = base_spans(text)
    if not terms:
        return base
    covered = sorted((a, b) for _, a, b in base)
    found, at, reach = [], 0, 0  # both in order: ``reach`` is where the base spans that begin before the term's end stop
    for m in _TERM.finditer(text):
        if m[0].lower() in terms:
            while at < len(covered) and covered[at][0] < m.end():
                reach = max(reach, covered[at][1])
                at += 1
            if reach <= m.start():
                found.append((4, *m.span()))
    return base + found


def redacted(text: str, spans: list[tuple[int, int, int]], remove: set[str] | frozenset[str]) -> str:
    """Base spans become their kind in brackets; terms become [TERM] or [NUMBER], or go if in ``remove``."""
    parts, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if end <= at:
            continue
        word = text[start:end].lower()
        parts.append(text[at : max(at, start)])
        if start >= at:
            parts.append(f"[{KINDS[kind].upper()}]" if kind < 4 else "" if word in remove else "[NUMBER]" if word.isdigit() else "[TERM]")
        at = end
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", remove_at: float = 0.95, revealing: DataFrame | None = None, prefix: str = "pii_", **limits) -> DataFrame:
    """All columns of ``docs`` with the sanitised text in ``<prefix>text`` and what was found.

    Added: ``<prefix>spans`` (array of kind, start, end in code points of the
    text given, by kind and start), ``<prefix>text``. Base spans (addresses, IPs,
    cards, phone numbers) are always replaced by their kind; terms that
    :func:`revealing_terms` finds in all rows are generalised, or removed where
    the posterior is at least ``remove_at``.

    A null text has no spans and stays null; an empty one has none. Repeated
    rows, nulls in other columns and extra columns pass through (columns with
    the added names are replaced); an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop(prefix + "spans", prefix + "text")
    told = revealing_terms(docs, text, **limits) if revealing is None else revealing
    worst = told.groupBy("term").agg(F.max("p_entity").alias("p")).select("term", (F.col("p") >= remove_at).alias("gone"))
    worst = stash(worst, "flagged")
    flagged = worst.collect() if _small(worst) else None
    fields = with_fields(docs, f"`{prefix}spans` array<struct<kind:string,start:bigint,end:bigint>>, `{prefix}text` string")
    own = "terms of this row"
    if flagged is not None:
        sent = spark.sparkContext.broadcast(({x[0] for x in flagged}, {x[0] for x in flagged if x[1]}))
    else:  # too many to send: each row gets its own
        sent = None
        docs = docs.withColumn("id of this row", F.monotonically_increasing_id())
        docs = stash(docs, "rows")
        of_row = holding(docs, worst.select("term"), text, ("id of this row",)).join(worst, "term")
        of_row = of_row.groupBy("id of this row").agg(F.collect_list(F.struct("term", "gone")).alias(own))
        docs = docs.join(of_row, "id of this row", "left").drop("id of this row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(text)):
                part = batch.slice(i, j - i)
                mine = None if sent else part.column(own).to_pylist()
                spans, texts = [], []
                for row, value in enumerate(part.column(text).to_pylist()):
                    terms, gone = sent.value if sent else ({x["term"] for x in mine[row] or ()}, {x["term"] for x in mine[row] or () if x["gone"]})
                    found = all_spans(value or "", terms)
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found])
                    texts.append(redacted(value, found, gone) if found else value)
                kept = [x for n, x in zip(part.schema.names, part.columns, strict=True) if n != own]
                kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, kinds), pa.array(texts, pa.string())], fields.names)

    return docs.mapInArrow(trimmed(run), fields)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Per row of :func:`sanitise`: key, counts by kind, digest of the base spans, and all spans as text."""
    found = sanitise(docs.select(key, text), text, **options)
    joined = lambda some: F.array_join(
        F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    spans = F.col("pii_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        key,
        *(count(kind).alias("n_" + kind) for kind in KINDS[:4]),
        F.sha2(joined(F.filter(spans, lambda x: x["kind"] != "term")), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
