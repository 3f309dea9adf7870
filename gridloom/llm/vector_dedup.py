"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors link at cosine >= THRESHOLD, that is within EPSILON = sqrt(2 - 2 * THRESHOLD) of each other. A
few leading principal directions (orthonormal, from a bounded sample) contract distances, so vectors whose
projections are farther apart than EPSILON are provably no link, however good the directions are. Vectors are
ordered by their grid cells of width EPSILON on these directions, leading one first. Cut points of the sample's
order divide the sequence into intervals; an interval longer than BLOCK is dealt into blocks. Block pairs meet
by an equi-join on neighbouring cells of the leading direction, and pairs whose boxes are farther apart than
EPSILON are skipped. Inside a pair, both sequences are halved recursively, again skipping distant boxes, and
small intervals are compared by a product in double precision.

Scale: equal vectors are collapsed first; a block is at most BLOCK vectors in expectation, so a task's memory
is bounded however hot a cell is; a pair's task emits each vector's number of links and a spanning forest,
never the pairs. In high dimensions with weak leading directions nearly all block pairs remain, and the work
is quadratic (vectors^2 / 2 products) though still without pairs in any shuffle.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; copies link with each other; a null vec_id is kept, and links
like any other; component_id is the least vec_id of a component, or null if all of its are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forest, prepare, table

THRESHOLD = 0.95
EPSILON = math.sqrt(2 - 2 * THRESHOLD) + 1e-9
DIRECTIONS = 8
SAMPLE = 20_000
BLOCK = 8192
LEAF = 512
MOST_CUTS = 4096


def keyed(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, key, v): key is null for vectors that link with nothing; v holds the components in double precision as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, data = [], []
            for x in b.column("v").to_pylist():
                v = np.array([np.nan if y is None else y for y in x or []], np.float64) + 0.0
                ok = len(v) and np.isfinite(v).all() and (top := np.abs(v).max()) > 0
                raw = np.ascontiguousarray(v).tobytes() if ok else None
                if ok and not 1e-100 < top < 1e100:
                    raw = np.ascontiguousarray(v / top).tobytes()
                elif ok and np.array_equal(v.astype(np.float32), v):
                    raw = v.astype(np.float32).tobytes()  # half the bytes for single-precision input
                keys.append(hashlib.md5(f"{len(v)}:".encode() + v.tobytes()).digest() if ok else None)
                data.append(raw if raw is None else len(v).to_bytes(4, "little") + raw)
            yield pa.record_batch([b.column("vec_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "key", "v"])

    return vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("v")).mapInArrow(run, "vec_id long, key binary, v binary")


def unit(data: list[bytes], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded to one width, and their lengths."""
    size = np.array([int.from_bytes(x[:4], "little") for x in data], np.int64)
    out = np.zeros((len(data), width or int(size.max(initial=1))))
    for i, x in enumerate(data):
        v = np.frombuffer(x, np.float64 if len(x) - 4 == 8 * size[i] else np.float32, offset=4).astype(np.float64)[: out.shape[1]]
        out[i, : len(v)] = v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0), size


def grid_key(p: np.ndarray) -> np.ndarray:
    """The place of projections in the epsilon grid order, as integers; a finer part orders vectors of one cell."""
    cells = np.clip(np.floor(p / EPSILON) + 4, 0, 7).astype(np.int64)
    key = np.zeros(len(p), np.int64)
    for d in range(p.shape[1]):
        key = key << 3 | cells[:, d]
    return key << 20 | np.clip((p[:, 0] + 1) * (1 << 19), 0, (1 << 20) - 1).astype(np.int64)


class Pair:
    """The join of two blocks (or of one with itself)."""

    def __init__(self, v: np.ndarray, size: np.ndarray, p: np.ndarray, copies: np.ndarray):
        self.v, self.size, self.p, self.copies = v, size, p, copies
        self.links = np.zeros(len(v), np.int64)
        self.root = np.arange(len(v))

    def far(self, a: np.ndarray, b: np.ndarray) -> bool:
        p, q = self.p[a], self.p[b]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        return float(gap @ gap) > EPSILON * EPSILON

    def join(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Joins two intervals of the sequence; same if they are one."""
        if not len(a) or not len(b) or not same and self.far(a, b):
            return
        if max(len(a), len(b)) <= LEAF:
            self.compare(a, b, same)
        elif same:
            x, y = np.array_split(a, 2)
            self.join(x, x, True)
            self.join(y, y, True)
            self.join(x, y, False)
        else:
            for x in np.array_split(a, 2) if len(a) > LEAF else [a]:
                for y in np.array_split(b, 2) if len(b) > LEAF else [b]:
                    self.join(x, y, False)

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        near = (self.v[a] @ self.v[b].T >= THRESHOLD) & (self.size[a][:, None] == self.size[b][None, :])
        if same:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links[a] += near @ self.copies[b]
        if not same:
            self.links[b] += near.T @ self.copies[a]
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        open_ = self.root[i] != self.root[j]
        if open_.any():
            n = np.arange(len(self.v))
            self.root = forest(len(n), np.concatenate([n, i[open_]]), np.concatenate([self.root, j[open_]]))


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    spark = prepare(vectors.sparkSession)
    rows = cut(keyed(vectors, id_column, column))
    reps = cut(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("rep", F.monotonically_increasing_id()))
    n = reps.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = [r.v for r in reps.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(2 * SAMPLE).collect()]
    width = int(max([int.from_bytes(x[:4], "little") for x in sample], default=1))
    units = unit(sample, width)[0] if sample else np.zeros((0, width))
    basis = np.linalg.svd(units - units.mean(0), full_matrices=False)[2][:DIRECTIONS].T if len(units) > DIRECTIONS else np.eye(width, min(width, DIRECTIONS))
    order = np.sort(grid_key(units @ basis)) if len(units) else np.zeros(0, np.int64)
    pieces = min(MOST_CUTS, math.ceil(n / block), max(1, len(order) // 4))
    cuts = order[[len(order) * k // pieces for k in range(1, pieces)]] if pieces > 1 else np.zeros(0, np.int64)
    deal = max(1, math.ceil(n / (block * max(1, pieces))))  # blocks of an interval, where cuts are at their bound

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data = b.column("v").to_pylist()
            p = unit(data, width)[0] @ basis
            size = np.array([int.from_bytes(x[:4], "little") for x in data])
            if (size > width).any():  # a vector longer than any in the sample: its projection has a norm of its own
                p = np.stack([unit([x])[0][0][:width] @ basis[: int.from_bytes(x[:4], "little")] for x in data])
            key = grid_key(p)
            salt = np.frombuffer(b"".join(k[:8] for k in b.column("key").to_pylist()), np.uint64).astype(np.int64) & 0x7FFFFFFF
            low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            at = (low + salt % (high - low + 1)) * deal + (salt >> 8) % deal
            yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(key), pa.array(list(p), pa.list_(pa.float64())), *(b.column(c) for c in ("rep", "copies", "v"))], names=["block", "place", "p", "rep", "copies", "v"])

    placed = cut(reps.mapInArrow(place, "block long, place long, p array<double>, rep long, copies long, v binary"))
    dims = basis.shape[1]
    box = placed.groupBy("block").agg(*[f(F.col("p")[d]).alias(f"{name}{d}") for d in range(dims) for name, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.floor(F.col(c) / F.lit(EPSILON)).cast("int")
    left = box.withColumn("cell", F.explode(F.sequence(cell("lo0") - 1, cell("hi0") + 1)))
    right = box.select(*[F.col(c).alias(f"{c}_") for c in box.columns], F.explode(F.sequence(cell("lo0"), cell("hi0"))).alias("cell"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{d}") - F.col(f"hi{d}_"), F.col(f"lo{d}_") - F.col(f"hi{d}")), F.lit(2.0)) for d in range(dims)), F.lit(0.0))
    pairs = left.join(right, "cell").where((F.col("block") <= F.col("block_")) & (gap <= EPSILON * EPSILON)).select(F.col("block").alias("a"), F.col("block_").alias("b")).distinct()
    member = pairs.select(F.col("a").alias("block"), "a", "b").union(pairs.where("a <> b").select(F.col("b").alias("block"), "a", "b"))

    def compare(x: pa.Table) -> pa.Table:
        x = x.sort_by("place")
        v, size = unit(x.column("v").to_pylist())
        side = x.column("block").to_numpy() == x.column("a").to_numpy()
        p = np.stack(x.column("p").to_pylist())
        pair = Pair(v, size, p, x.column("copies").to_numpy())
        if side.all():
            pair.join(np.arange(len(v)), np.arange(len(v)), True)
        else:
            pair.join(np.flatnonzero(side), np.flatnonzero(~side), False)
        some = np.flatnonzero(pair.links)
        rep = x.column("rep").to_numpy()
        return pa.table({"rep": rep[some], "links": pair.links[some], "root": rep[pair.root[some]]})

    found = cut(placed.join(member, "block").groupBy("a", "b").applyInArrow(compare, "rep long, links long, root long"))
    groups = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = reps.select("key", "rep", "least", "copies").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    facts = cut(facts.withColumn("label", F.coalesce("label", "rep")))
    facts = facts.join(facts.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    facts = facts.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(facts, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
