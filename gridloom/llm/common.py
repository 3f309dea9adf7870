"""What the operators of this subpackage share: checkpoints, held-out rows, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import ship

#: A word of the text operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1
#: Rows of an Arrow batch at most: a Python worker holds a few batches of whole texts.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Make checkpoints possible (in the shared folder named by the session, or a local one where none is set), and keep Arrow batches small."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that a lost executor costs no recomputation of what lies before."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared checkpoint folder: compressed, read by column, with no partitioning
    kept, so that a join shuffles both sides and AQE can split hot keys."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What make() returned for the key in this worker; only the last key's is kept, so that a stage leaves nothing to the next but one thing."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | F.Column, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives empty bytes."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component under the links a-b (all in memory, by min-label hooking)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(up := label[label], label):
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges(src long, dst long).

    Alternates large-star and small-star steps until nothing changes (a number of rounds in the order of the
    logarithm of the longest path). Every round is an aggregation with partial sums and a join by node whose
    two sides are plain shuffles, so AQE splits the rows of a hub; no component is ever gathered in one place.
    Loops and repeated edges are fine; nodes without edges are not in the result. Empty edges give an empty result.
    """
    pairs = saved(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("m")).distinct()
    )
    seen, now = (0, 0), _sum(pairs)
    while now != seen:
        seen = now
        both = pairs.union(pairs.select("m", "v")).toDF("u", "w")
        low = saved(both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("low")))
        large = saved(both.join(low, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct())
        low = saved(large.groupBy("v").agg(F.min("m").alias("low")))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e")).select("e.*").where("v <> m")
        pairs = saved(small.distinct())
        now = _sum(pairs)
    own = pairs.select(F.col("m").alias("node"), F.col("m").alias("label")).distinct()
    return pairs.select(F.col("v").alias("node"), F.col("m").alias("label")).union(own)


def _sum(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "m") % F.lit(1 << 31))).first()
    return row[0], row[1] or 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of so many bytes (uint8 in, uint64 out, one for each start), in linear time."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down, up = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * up[: len(data) - width + 1])


_R = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_POWERS_KEPT = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, at least n of each; the worker keeps those of usual texts."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, _POWERS_KEPT)
    with np.errstate(over="ignore"):
        make = lambda r: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, r & MASK64, np.uint64)]).astype(np.uint64), dtype=np.uint64)
        made = make(_R), make(pow(_R, -1, 1 << 64))
    if size == _POWERS_KEPT:
        _POWERS[:] = made
    return made
