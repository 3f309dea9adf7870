"""Target-distribution importance resampling: a draw of documents that looks like a target set.

Runs of one to three words are hashed into buckets (crc32 modulo their number). The first Arrow pass over the documents
gives one np.bincount vector a partition, and treeReduce merges them; the target texts are counted in the same way. A
bucket's gain is how much likelier it is among the targets. The second pass gathers the gains, which are broadcast (one
double a bucket), and sums them by document with np.bincount weights. A seeded Gumbel term makes the highest scores a
draw without replacement.

Scale: both passes only read; what leaves a task is one vector or one narrow row a document. Ranks come from one range
shuffle of these rows, salted by their place so that equal scores spread, and from the sizes of its partitions; nothing
is ever sorted in one task. Long texts are hashed in blocks of BLOCK bytes, cut between words.

Defined cases: null text has no words; a document without words weighs 0; a null doc_id draws as the empty text does and
comes after others of its score; equal rows are drawn each on its own; columns besides id and text are ignored; an empty
table gives no rows, and an empty target set leaves each bucket the gain that smoothing gives it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, saved, table, texts_of

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
BLOCK = 4_000_000
#: Features that a task holds before it adds them up.
FEATURES = 2_000_000
#: Lower-cases A-Z; bytes outside words become spaces. Bytes from 128 on belong to letters of words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def hashed(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) of each block of a text."""
    data, at, before = text.translate(FOLD), 0, []
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        words = before + data[at:end].split()
        spaced, old = [b" " + w for w in words], len(before)
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        yield len(words) - old, np.array(one[old:] + two[max(0, old - 1) :] + three, np.int64) % buckets
        before, at = words[-2:], end


def counted(texts: DataFrame, buckets: int, least_words: int) -> tuple[np.ndarray, int]:
    """How often each bucket occurs in texts(text), and how many texts have least_words words or more."""

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, enough, some, size = np.zeros(buckets, np.int64), 0, [], 0
        for b in batches:
            for text in texts_of(b):
                n = 0
                for words, x in hashed(text, buckets):
                    n += words
                    size += len(x)
                    some.append(x)
                    if size >= FEATURES:
                        total += np.bincount(np.concatenate(some), minlength=buckets)
                        some, size = [], 0
                enough += n >= least_words
        if some:
            total += np.bincount(np.concatenate(some), minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([enough], pa.int64())], names=["vector", "enough"])

    parts = texts.mapInArrow(vector, "vector binary, enough long").rdd.map(lambda r: (np.frombuffer(r.vector, np.int64), r.enough))
    if not parts.getNumPartitions():
        return np.zeros(buckets, np.int64), 0
    return parts.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=2 if parts.getNumPartitions() < 10_000 else 3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of each bucket's smoothed share among the targets over that among the documents)."""
    all_s, all_t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.float64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, least_words: int) -> DataFrame:
    """(doc_id, n_features, weight, score, enough) of each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a double a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            n_words, n_features, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            some, size = [], 0

            def add() -> None:
                if some:
                    at = np.repeat([k for k, _ in some], [len(x) for _, x in some])
                    weight[:] += np.bincount(at, weights=gain[np.concatenate([x for _, x in some])], minlength=len(weight))

            for k, text in enumerate(texts_of(b)):
                for words, x in hashed(text, len(gain)):
                    n_words[k] += words
                    n_features[k] += len(x)
                    size += len(x)
                    some.append((k, x))
                    if size >= FEATURES:
                        add()
                        some, size = [], 0
            add()
            noise = [gumbel(i, seed) for i in b.column("doc_id").to_pylist()]
            weight = weight.astype(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(n_features), pa.array(weight), pa.array(weight + np.array(noise, np.int64)), pa.array(n_words >= least_words)], names=["doc_id", "n_features", "weight", "score", "enough"])

    return docs.mapInArrow(run, "doc_id long, n_features long, weight long, score long, enough boolean")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """rows with rank: 1, 2, 3... for the drawn highest scores among those that have enough words, null for others."""
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("place")]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    # an id made in sorted order holds the partition in its upper bits and the place there in its lower 33
    placed = saved(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place").withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect())  # one row a partition
    before = [0, *accumulate(r["count"] for r in sizes)]
    starts = placed.sparkSession.createDataFrame([(r["part"], n) for r, n in zip(sizes, before)] or [(0, 0)], "part long, before long")
    out = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part", "left")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return out.withColumn("rank", F.when(rank <= drawn, rank))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text", percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; rank is null where it is not drawn."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    source, enough = counted(rows.select("text"), buckets, least_words)
    wanted, _ = counted(target.select(F.col(target_column).cast("string").alias("text")), buckets, least_words)
    found = saved(scored(rows, gains(source, wanted), seed, least_words))
    return ranked(found, percent * enough // 100).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
