"""Importance resampling towards a target distribution over hashed word n-grams.

A streaming CRC ring turns a text into buckets in one scan: it keeps the running zlib states of the runs that began at the last
``order`` words and extends each by a space and the next word, so no n-gram is ever built as a string. The corpus and the
target are counted by bucket, each bucket's log ratio is its gain, a document's weight is the sum of its features' gains, and the
draw takes the largest weights with Gumbel noise, which samples without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, cut, table

#: A-Z become a-z; digits, a-z and all bytes of other characters are kept; everything else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def ring(words: list[bytes], order: int) -> list[int]:
    """CRC-32 of every run of 1 to ``order`` words joined by one space, by the place where runs end."""
    out: list[int] = []
    states: list[int] = []  # of the runs that began at the last words, the latest first
    for word in words:
        spaced = b" " + word
        states = [crc32(word), *[crc32(spaced, s) for s in states[: order - 1]]]
        out += states
    return out


def features(text: bytes | None, order: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each feature)."""
    words = words_of(text)
    return len(words), (np.array(ring(words, order), np.uint32) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, order: int = 3, buckets: int = 10_000) -> DataFrame:
    """Rows (bucket, n) over all features of ``text``; each task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(text.as_py(), order, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down. As many numbers as there are buckets come to the driver."""
    s, t = ({r["bucket"]: r["n"] for r in df.collect()} for df in (corpus, target))
    rest_s, rest_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1.0) * rest_s / ((s.get(b, 0) + 1.0) * rest_t))) for b in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from the hash of ``seed:doc_id``."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, order: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score)."""
    buckets = len(gain)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = features(text.as_py(), order, buckets)
                weight = int(gain[found].sum())
                rows.append((i, n, len(found), weight, weight + noise(i, seed)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "n_words", "n_features", "weight", "score"])

        return f

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return by_batch(narrow, make, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank``, their place from 1 on in ``order``; equal rows in any order. Rows are dealt to tasks by ranges of ``order``
    and sorted there; only each task's number of rows comes to the driver."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(spread)
    sizes = dict(placed.groupBy(F.spark_partition_id().alias("p")).count().collect())
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append((p, before))
        before += sizes.get(p, 0)
    # a row for each partition
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__p int, __before long"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.select("*", F.spark_partition_id().alias("__p"), place.alias("__place"))
    return numbered.join(starts, "__p").select(*rows.columns, (F.col("__before") + F.col("__place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, order: int = 3, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """Every document's (doc_id, n_words, n_features, weight, score, rank); rank is 1, 2, ... for the drawn ones and null for others.

    Of the N documents with ``min_words`` words at least, percent * N // 100 are drawn: the highest scores, ties to the smaller doc_id.

    Null or empty text: no words, weight 0, score is the noise alone, never drawn unless ``min_words`` is 0. A null doc_id
    has the noise of an empty id and comes after all others among equal scores. Rows with an equal doc_id and text have equal scores and ranks of their own, in any
    order. A feature that the target lacks, or all if the target is empty, has the gain that the counts plus one give.
    Texts are read whole, in bounded batches of rows. Extra columns are left out. An empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets), buckets)
    # a row number keeps equal rows apart, so that no range of the sort is one key
    scored = cut(weigh(docs, gain, order, seed)).withColumn("__row", F.monotonically_increasing_id())
    able = scored.filter(F.col("n_words") >= min_words)
    draw = percent * able.count() // 100
    places = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row"))
    drawn = places.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("__row")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
