"""Mixing sources to target weights: fixed blocks, multinomial counts by shard, pseudorandom index permutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import sized, stash

#: Ranges of hashes into which a source's rows are dealt, so that running sums of a large source are no single task.
BUCKETS = 1024
#: Swap-or-not rounds of an index permutation.
ROUNDS = 24
#: Slots that one partition draws.
SLOTS = 1 << 20

_WHITE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0. No word is made an object of its own."""
    return F.length(F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(_WHITE)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("bigint")


def running(rows: DataFrame, order: str, value: Column) -> DataFrame:
    """The rows with ``before``: the sum of ``value`` over the rows that precede in ``order``, whose values are distinct.

    Ranges of ``order`` are partitions; what meets in one task is a sum for each range.
    """
    dealt = stash(rows.withColumn("value", value).repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("range").agg(F.sum("value").alias("all")).select("range", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    within = dealt.withColumn("within", F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return within.join(F.broadcast(ranges), "range").withColumn("before", F.col("ahead") + F.col("within")).drop("range", "value", "ahead", "within")


def shares(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Sources (``src`` in order, ``source_size``) with ``sid`` (their rank), ``weight`` and ``target``.

    The weights repeat along the ranks and share the sum of all sizes; a target
    stops at ``cap`` times its source's size, and the excess is shared again
    until none is above. Only sums reach the driver.
    """
    given = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("before"), F.lit(len(weights))) + 1).cast("int"))
    ranked = stash(running(sizes, "src", F.lit(1)).withColumn("weight", given).withColumnRenamed("before", "sid"), "sources")
    most = F.col("source_size") * cap
    level, full = 0.0, -1
    while True:
        above = most < F.col("weight") * F.lit(level)
        row = ranked.select(
            F.sum("source_size").alias("total"), F.count_if(above).alias("full"),
            F.sum(F.when(above, most)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("free"),
        ).first()
        if row["full"] == full or not row["free"]:
            break
        full, level = row["full"], (row["total"] - (row["capped"] or 0)) / row["free"]
    return ranked.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(level)))


def permuted(index: Column, n: Column, salt: Sequence[Column], seed: int) -> Column:
    """``index`` mapped through a pseudorandom permutation of 0 .. n - 1, another one for each ``salt``.

    Swap-or-not: each round pairs every index with its mirror image at a random
    place, and a hash of the pair says whether the two change places.
    """

    def swap(x: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(seed), i, *salt), n) - x, n)
        coin = F.xxhash64(F.lit(seed + 1), i, *salt, F.greatest(x, mirror))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows with their ``size`` in words and ``begin``, the words before them in their source: key, src, size, begin.

    ``src`` sorts as the sources do by code point, null last. Rows of a source
    follow one another by a hash of key and text.
    """
    src = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    rows = docs.select(F.col(key).alias("key"), src.alias("src"), words(F.col(text)).alias("size"), F.xxhash64(key, text).alias("h"))
    rows = stash(rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))), "sizes")
    inside = Window.partitionBy("src", "bucket").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("all")).select("src", "bucket", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    within = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return stash(within.join(buckets, ["src", "bucket"]).select("key", "src", "size", (F.col("ahead") + F.col("within")).alias("begin")), "placed")


def drawn(sources: DataFrame, block: int, shard: int, cap: int, seed: int) -> DataFrame:
    """The slots of all output shards and the block that each takes: shard, slot, sid, nth, block.

    ``nth`` counts the slots of a source. Every shard draws the sources of its
    slots independently in the ratio of their targets, which makes its counts
    multinomial. What a source has been drawn beyond its target in all shards
    together, some square root of it, goes to the sources that fell short, slot
    by slot, so that totals meet the targets.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.when(F.col("source_size") > 0, F.least(blocks * cap, F.round(F.col("target") / F.col("source_size") * blocks).cast("bigint"))).otherwise(F.lit(0))
    sources = sources.select("sid", blocks.alias("blocks"), quota.cast("bigint").alias("quota"))
    sources = stash(running(sources, "sid", F.col("quota")).withColumnRenamed("before", "lo"), "quotas")
    row = sources.select(F.sum("quota").alias("n"), F.count("*").alias("sources")).first()
    n = row["n"] or 0
    # a guide: the numbers below n in as many cells as there are sources, and the sources that own a part of each cell
    width = max(1, -(-n // max(1, row["sources"])))
    cells = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("quota") - 1) / width))
    guide = stash(sources.where("quota > 0").select("sid", "lo", (F.col("lo") + F.col("quota")).alias("hi"), F.explode(cells).alias("cell")), "guide")
    slots = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, n // SLOTS)).withColumnRenamed("id", "slot")
    slots = slots.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(n, 1)))).withColumn("cell", F.floor(F.col("u") / width))
    slots = slots.join(sized(guide), "cell").where("u >= lo and u < hi").select(F.floor(F.col("slot") / shard).alias("shard"), "slot", "sid")
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = stash(slots.groupBy("shard", "sid").agg(F.count("*").alias("count")), "counts")
    got = counts.groupBy("sid").agg(F.sum("count").alias("got"))
    sources = sources.drop("lo").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    sources = running(sources, "sid", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumnRenamed("before", "over_before")
    sources = stash(running(sources, "sid", F.greatest(F.col("quota") - F.col("got"), F.lit(0))).withColumnRenamed("before", "short_before"), "drawn")
    counts = counts.select("shard", "sid", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    numbered = slots.withColumn("own", own).join(counts, ["shard", "sid"]).join(sized(sources), "sid")
    numbered = stash(numbered.select("shard", "slot", "sid", (F.col("before") + F.col("own")).alias("nth"), "blocks", "quota", "over_before"), "slots")
    kept = numbered.where("nth < quota").select("shard", "slot", "sid", "nth", "blocks")
    short = sources.where("quota > got").select("sid", "blocks", "got", "short_before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - F.col("got") - 1)).alias("i"))
    short = short.select((F.col("short_before") + F.col("i")).alias("turn"), "sid", (F.col("got") + F.col("i")).alias("nth"), "blocks")
    moved = numbered.where("nth >= quota").select("shard", "slot", (F.col("over_before") + F.col("nth") - F.col("quota")).alias("turn")).join(short, "turn")
    slots = kept.unionByName(moved.drop("turn")).withColumn("pass", F.floor(F.col("nth") / F.col("blocks")))
    block = permuted(F.pmod("nth", "blocks"), F.col("blocks"), [F.col("sid"), F.col("pass")], seed + 2)
    return stash(slots.select("shard", "slot", "sid", "nth", block.alias("block")), "mixed")  # written, as a join would work the index out twice


def mixture(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, block: int = 64, shard: int = 16384, seed: int = 29, key: str = "doc_id", text: str = "text", source: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The mix of all sources, and the documents it comes from.

    The words of a source, document after document, are cut into blocks of
    ``block`` words (the last may be shorter). Output shards have ``shard``
    slots each. Every shard draws how many slots each source gets
    (:func:`drawn`); the slots of a source, over all shards, go through its
    blocks in the order of a pseudorandom permutation, a new one for each pass,
    and slots and blocks are joined by index. So no block, and no document, is
    used more often than ``cap`` times, and a rerun gives the same mix.

    The mix has a row for each piece of a document in a slot: shard, slot, key,
    ``start`` (words of the document before it) and ``length``, with ``sid`` and
    ``begin``, which name the document's row in the second table: key, src, sid,
    size, source_size, target, begin (null if it has no words).

    Null texts have no words; a null source is a source of its own, the last.
    Repeated rows are separate documents; keys may be null. Extra columns are
    dropped; an empty table gives empty tables. Only sums over sources reach the
    driver.
    """
    rows = placed(docs, key, text, source)
    sources = stash(shares(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    rows = rows.join(sized(sources.drop("weight")), "src")
    slots = drawn(sources, block, shard, cap, seed)
    end = F.col("begin") + F.col("size")
    pieces = rows.where("size > 0").select("key", "sid", "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((end - 1) / block))).alias("block"))
    start, stop = F.greatest(F.col("begin"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    pieces = pieces.select("key", "sid", "begin", "block", (start - F.col("begin")).alias("start"), (stop - start).alias("length"))
    mixed = slots.join(pieces, ["sid", "block"]).select("shard", "slot", F.col("key").alias(key), "start", "length", "sid", "begin")
    rows = rows.select(F.col("key").alias(key), "src", "sid", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("begin")).alias("begin"))
    return mixed, rows


def query(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    mixed, rows = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mixed.groupBy("sid", "begin").agg(F.sum("length").alias("taken"))
    return rows.join(taken, ["sid", "begin"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
