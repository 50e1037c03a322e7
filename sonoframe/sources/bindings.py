"""The tables at hand as frames, spectra, words and turns; in Spark, and as SQL for comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measurements that events stand for, as expressions that Spark and other engines share.
MEASURES = {
    "f0": "CASE WHEN event_id % 11 = 0 THEN 0D ELSE 90D + (event_id * 29) % 220 END",
    "conf": "((event_id * 17) % 100) / 100D",
    "f1": "CASE WHEN event_id % 23 = 0 THEN 0D ELSE 250D + 1.3D * value END",
    "f2": "800D + 17D * k",
    "f3": "2200D + (event_id * 53) % 900",
    "f4": "CASE WHEN event_id % 19 = 0 THEN 0D ELSE 3000D + 10D * (event_id % 50) END",
    "bw1": "40D + event_id % 200",
    "bw2": "60D + (event_id * 3) % 200",
    "bw3": "80D + (event_id * 7) % 600",
    "rms": "-70D + (event_id * 13) % 70",
    "hnr": "4D + (event_id * 7) % 21",
    "jitter": "((event_id * 11) % 40) / 10D",
    "shimmer": "((event_id * 5) % 110) / 10D",
    "h1_h2": "-10D + (event_id * 19) % 25",
    "tilt": "-12D + ((event_id * 23) % 80) / 10D",
    "a1": "-10D - event_id % 7",
    "a4": "-20D - event_id % 13",
    "prominence": "10D + event_id % 37",
}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: session_id, seq, t (seconds), kind, value, k and the measurements."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) / 1000000D").alias("t"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return base.select("session_id", F.col("event_id").alias("seq"), "t", "kind", "value", "k", *(F.expr(e).alias(n) for n, e in MEASURES.items()))


def _plain(e: str) -> str:
    """Doubles written as another engine reads them."""
    import re

    return re.sub(r"(\d+(?:\.\d+)?)D\b", r"CAST(\1 AS DOUBLE)", e)


FRAMES = (
    "base AS (SELECT user_id AS session_id, event_id, epoch(ts) AS t, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), "
    "frames AS (SELECT session_id, event_id AS seq, t, kind, value, k, " + ", ".join(f"{_plain(e)} AS {n}" for n, e in MEASURES.items()) + " FROM base)"
)


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as short series: id and x, an array of doubles."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


SPECTRA = "spectra AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


#: Samples a second of the waveforms that frames stand for, samples of one, and frames of one recording at most.
RATE, SAMPLES, PART = 8000.0, 400, 64


#: What a frame's sound is made of, and the frames and recordings whose sound one step makes.
VOICE, ROWS, SOUNDS = ("f0", "f1", "f2", "f3", "rms"), 1024, 32


def waves(f0: np.ndarray, f1: np.ndarray, f2: np.ndarray, f3: np.ndarray, rms: np.ndarray, first: int = 0, last: int = SAMPLES) -> np.ndarray:
    """Harmonics of a pitch and tones at the formants, as loud as the level says: samples ``first`` to ``last`` of each frame.

    ``ROWS`` frames at a time; a frequency that several of them have is worked out once.
    """
    turn = 2 * np.pi / RATE * np.arange(first, last)
    out = np.empty((len(f0), last - first))

    def of(hz: np.ndarray, harmonics: int) -> np.ndarray:
        each, at = np.unique(hz, return_inverse=True)
        return sum(np.sin(h * each[:, None] * turn) / h for h in range(1, harmonics + 1))[at]

    for i in range(0, len(f0), ROWS):
        a, b, c, d, level = (v[i : i + ROWS] for v in (f0, f1, f2, f3, rms))
        x = of(a, 5) + 0.5 * of(b, 1) + 0.3 * of(c, 1) + 0.2 * of(d, 1)
        out[i : i + ROWS] = x * 10 ** (level[:, None] / 20) / 3
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def tones(f0: pd.Series, f1: pd.Series, f2: pd.Series, f3: pd.Series, rms: pd.Series) -> pd.Series:
    return pd.Series(list(waves(*(v.to_numpy(float) for v in (f0, f1, f2, f3, rms)))))


def sound_of(frames: pd.DataFrame, first: int = 0, last: int = SAMPLES) -> np.ndarray:
    """Sound of frames, a row each, from their own columns."""
    return waves(*(frames[v].to_numpy(float) for v in VOICE), first, last)


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames dealt out, since the sound of a frame costs much more than its row."""
    return frames(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with ``x``, 50 ms of sound."""
    rows = dealt(spark, sf_dir)
    return rows.withColumn("x", tones("f0", "f1", "f2", "f3", "rms"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ``PART`` frames in a row of a session: session_id, part, and arrays of what their sound is made of."""
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    rows = frames(spark, sf_dir).select("session_id", "t", "seq", *VOICE).withColumn("part", F.floor((F.row_number().over(order) - 1) / PART))
    held = rows.groupBy("session_id", "part").agg(F.sort_array(F.collect_list(F.struct("t", "seq", *VOICE))).alias("r"))
    return held.select("session_id", "part", *(F.col("r")[v].alias(v) for v in VOICE))


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`parts` dealt out, since their sound costs much more than its row."""
    return parts(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id", "part")


def sounds_of(rows: pd.DataFrame) -> list[np.ndarray]:
    """Sound of recordings, from the arrays of what it is made of."""
    ends = np.cumsum(rows["f0"].map(len).to_numpy())
    x = waves(*(np.concatenate(rows[v].to_numpy()).astype(float) for v in VOICE))
    return [p.ravel() for p in np.split(x, ends[:-1])]


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound of up to ``PART`` frames in a row of a session: session_id, part, x.

    Frames meet, and recordings are dealt out, by what their sound is made of, a
    hundredth of it; the sound is made where it is used and never shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), SOUNDS):
                some = batch.iloc[i : i + SOUNDS]
                yield some[["session_id", "part"]].assign(x=sounds_of(some))

    return dealt_parts(spark, sf_dir).mapInPandas(run, "session_id bigint, part bigint, x array<double>")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of Spanish documents: word, n."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'es'")
    each = docs.select(F.explode(F.split("text", r"[^a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]+")).alias("word")).where("word != ''")
    return each.groupBy("word").agg(F.count("*").alias("n"))


WORDS = (
    "words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]+')) AS word "
    "FROM documents WHERE lang = 'es') WHERE word <> '' GROUP BY word)"
)
