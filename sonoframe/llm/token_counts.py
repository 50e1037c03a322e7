"""Token counts by a cache of content digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm import tokens
from sonoframe.llm.common import scratch, sized, stash, text_slices

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def squeezed(text: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends; for tokenizers that drop it."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def token_counts(
    docs: DataFrame,
    path: str,
    cache: str,
    normalise: Callable[[Column], Column] | None = None,
    text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` with ``n_bytes`` and ``n_tokens`` of the whole text.

    ``cache`` is a Parquet folder of (tokenizer version digest, content digest,
    count). Digests of the normalised content are joined with it, and only
    counts of these digests are taken from it; of the texts that it lacks, each
    distinct one is encoded once and appended. ``normalise`` must not change the
    count; without it the text itself is the content. It defaults to
    :func:`squeezed` for tokenizers that drop white space.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay; an empty
    table gives an empty table and leaves the cache as it is. Columns called
    ``n_bytes`` or ``n_tokens`` are replaced; other extra columns are kept,
    names included.
    """
    spark = docs.sparkSession
    named = tokens.version(path)
    normalise = normalise or (squeezed if tokens.drops_space(path) else lambda x: x)
    content = normalise(F.coalesce(F.col(text), F.lit("")))
    digest = F.unhex(F.sha2(content, 256))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    # a file holds one tokenizer's rows as a rule, so the statistics of Parquet skip the others
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == named)
    misses = docs.select(digest.alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    known = None
    if not cached.isEmpty():
        asked = stash(docs.select(digest.alias("digest")).distinct(), "asked")
        # writers that ran at the same time may have left a digest twice
        known = cached.join(sized(asked), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        known = stash(known, "known")
        misses = misses.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            for i, j in text_slices(batch.column("content")):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([named] * len(part)), part.column("digest"), pa.array(encoder.counts(part.column("content")))],
                    ["tokenizer", "digest", "n_tokens"],
                )

    new = stash(misses.mapInArrow(encode, CACHE_SCHEMA), "counted")
    new.write.mode("append").parquet(cache)
    new = new.select("digest", "n_tokens")
    counts = new if known is None else new.unionByName(known)
    own = "digest_of_content"
    while own in docs.columns:
        own += "_"
    return (
        docs.drop("n_bytes", "n_tokens")
        .withColumns({own: digest, "n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")})
        .join(counts.withColumnRenamed("digest", own), own)
        .drop(own)
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Counts for ``documents``; the run keeps a cache of its own."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
