"""Hard-negative mining by distributed radix selection.

Vectors are quantised to integers and packed into blocks; anchors (rows whose id is divisible by a number) into blocks of
their own. Each pair of an anchor block and a row block is scored by an exact product. A selection runs for windows
(anchor, lowest and highest score, how many): every pair of blocks gives a histogram of the scores in each window, from
the top until it holds as many rows as are wanted; the sums locate the bucket with the kth score, the window shrinks to
that bucket, and so on digit by digit until a bucket is one score. Then each pair gives the rows of its windows from the
kth score on, its first k at most, and the first k of all are kept. The first selection finds each anchor's positives
(same label), the second the negatives between a share of a positive's score and all of it.

Scale: work is anchors x rows, as a stated query set against all rows needs; scores never leave a task. Row blocks are
copied for each anchor block, so a shuffle carries the vectors once for ANCHORS anchors; what comes back is at most k
counts or rows for each window and block. A block and its windows have a fixed size, whatever label or score is hot.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no part; vectors score only
those of their own length; components are held within a size at which scores fit a long; a null id is no anchor, keeps
its label and comes after other ids; equal rows and equal ids are rows of their own; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, saved, table

DIGIT = 1024
POSITIVES = 5
NEGATIVES = 5
ANCHORS = 2048
ROWS = 8192
SCORED = 256  # anchors scored at once
NULL_ID = np.iinfo(np.int64).max
BLOCK = "block long, dim int, n int, ids binary, labels binary, rids binary, q binary"


def quantised(vectors: DataFrame, id_column: str, column: str, label_column: str, moved: int, labels: int) -> DataFrame:
    """(vec_id, label, rid, dim, q, norm): the rows that take part, components as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("v").to_pylist():
                v = np.array([np.nan if y is None else y for y in x], np.float64)
                most = 2.0 ** math.floor(27 - math.log2(max(1, len(v))) / 2)
                out.append(np.clip(np.floor(256 * v), -most, most).astype("<i4") if np.isfinite(v).all() else None)
            keep = [k for k, q in enumerate(out) if q is not None]
            some = b.select(["vec_id", "label"]).take(pa.array(keep, pa.int64()))
            q = [out[k] for k in keep]
            norm = [math.isqrt(int((x.astype(object) ** 2).sum()) if len(x) else 0) + 1 for x in q]
            yield pa.record_batch([*some.columns, pa.array([len(x) for x in q], pa.int32()), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(norm, pa.int64())], names=["vec_id", "label", "dim", "q", "norm"])

    vec_id, label = F.col(id_column).cast("long"), F.col(label_column).cast("long")
    rows = vectors.where(F.col(column).isNotNull() & F.col(label_column).isNotNull())
    rows = rows.select(vec_id.alias("vec_id"), F.when(vec_id % moved == 0, (label + 1) % labels).otherwise(label).alias("label"), F.col(column).alias("v"))
    return rows.mapInArrow(run, "vec_id long, label long, dim int, q binary, norm long").withColumn("rid", F.monotonically_increasing_id())


def packed(rows: DataFrame, size: int) -> DataFrame:
    """BLOCK records of at most size rows of one length each, dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def record(dim: int) -> pa.RecordBatch:
            got = waiting.pop(dim)
            ids, labels, rids = (np.array([r[k] for r in got], np.int64).tobytes() for k in range(3))
            return pa.record_batch([pa.array([c], t) for c, t in zip((got[0][2], dim, len(got), ids, labels, rids, b"".join([r[3] for r in got])), (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["block", "dim", "n", "ids", "labels", "rids", "q"])

        for b in batches:
            for vec_id, label, rid, dim, q in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "rid", "dim", "q")), strict=True):
                waiting.setdefault(dim, []).append((NULL_ID if vec_id is None else vec_id, label, rid, q))
                if len(waiting[dim]) == size:
                    yield record(dim)
        for dim in list(waiting):
            yield record(dim)

    n = rows.count()
    return saved(rows.repartition(max(1, math.ceil(n / size))).mapInArrow(run, BLOCK))


class Side:
    """The vectors of a block."""

    def __init__(self, n: int, dim: int, ids: bytes, labels: bytes, rids: bytes, q: bytes):
        self.ids, self.labels, self.rids = (np.frombuffer(x, np.int64) for x in (ids, labels, rids))
        self.q = np.frombuffer(q, "<i4").reshape(n, dim)
        self.norm = float(np.sqrt((self.q.astype(np.float64) ** 2).sum(1).max(initial=0)))

    def scores(self, some: slice, other: Side) -> np.ndarray:
        """Exact inner products: in floating point where all partial sums are small enough to be exact."""
        bound = self.norm * other.norm
        kind = np.float32 if bound < 2**24 - 2 else np.float64 if bound < 2**53 - 2 else np.int64
        return (self.q[some].astype(kind) @ other.q.T.astype(kind)).astype(np.int64)


def scan(pairs: DataFrame, same: bool, found: Callable, fields: str) -> DataFrame:
    """found(scores of a window's rows, their places, window) for each window of each pair of blocks, as rows of (anchor, win, *fields).

    pairs: a row block's columns, those of an anchor block with an a before, and windows as arrays: anchor place, win, low, high, need, width.
    """
    names = ["anchor", "win", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, anchors = (Side(*[r[f"{side}{c}"] for c in ("n", "dim", "ids", "labels", "rids", "q")]) for side in ("", "a"))
                windows: dict[int, list] = {}
                for w in r["windows"]:
                    windows.setdefault(w["place"], []).append(w)
                out = []
                for at in range(0, len(anchors.ids), SCORED):
                    scores = anchors.scores(slice(at, at + SCORED), rows)
                    for k in range(at, at + len(scores)):
                        if k in windows:
                            own, s = windows[k], scores[k - at]
                            fits = (s >= min(w["low"] for w in own)) & (s <= max(w["high"] for w in own))
                            fits &= (rows.labels == anchors.labels[k]) & (rows.rids != anchors.rids[k]) if same else rows.labels != anchors.labels[k]
                            place = np.flatnonzero(fits)
                            s = s[place]
                            for w in own:
                                inside = (s >= w["low"]) & (s <= w["high"])
                                if inside.any():
                                    out += [(int(anchors.rids[k]), w["win"], *x) for x in found(rows, s[inside], place[inside], w)]
                if out:
                    yield pa.record_batch([pa.array(c) if n != "vec_id" else pa.array(c, pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return pairs.mapInArrow(run, f"anchor long, win long, {fields}")


def histogram(rows: Side, s: np.ndarray, place: np.ndarray, w: dict) -> list[tuple[int, int]]:
    """(digit, count) from the top until there are as many rows as are wanted."""
    count = np.bincount((s - w["low"]) // w["width"], minlength=1)
    digits = np.flatnonzero(count)[::-1]
    enough = int(np.searchsorted(np.cumsum(count[digits]), w["need"])) + 1
    return [(int(d), int(count[d])) for d in digits[:enough]]


def first(rows: Side, s: np.ndarray, place: np.ndarray, w: dict) -> list[tuple]:
    """(score, id, rid) of a block's first rows of a window."""
    ids = rows.ids[place]
    order = np.lexsort((rows.rids[place], ids, -s))[: w["need"]]
    return [(int(s[i]), None if ids[i] == NULL_ID else int(ids[i]), int(rows.rids[place[i]])) for i in order]


class Search:
    """The blocks of a table and of its anchors."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, size: int, anchor_size: int):
        self.rows = packed(rows, size)
        self.anchors = packed(anchors, anchor_size)
        n = self.anchors.count()
        # blocks of one length meet by it; every anchor block is numbered within its length
        number = F.row_number().over(Window.partitionBy("dim").orderBy("block"))
        self.anchors = saved(self.anchors.withColumn("number", number)) if n else self.anchors.withColumn("number", F.lit(0))
        most = self.anchors.groupBy("dim").agg(F.max("number").alias("most"))
        self.copies = self.rows.join(most, "dim").withColumn("number", F.explode(F.sequence(F.lit(1), "most"))).drop("most")
        place = F.col("n")
        self.places = self.anchors.select("dim", "number", F.explode(F.sequence(F.lit(0), place - 1)).alias("place"), "rids")
        self.places = saved(self.places.mapInArrow(_rid_of_place, "dim int, number int, place int, anchor long"))

    def pairs(self, windows: DataFrame) -> DataFrame:
        """Each row block with each anchor block of its length that has windows(anchor, win, low, high, need, width)."""
        own = windows.join(self.places, "anchor").groupBy("dim", "number").agg(F.collect_list(F.struct("place", "win", "low", "high", "need", "width")).alias("windows"))
        held = self.anchors.join(own, ["dim", "number"])
        held = held.select("dim", "number", F.col("dim").alias("adim"), F.col("n").alias("an"), F.col("ids").alias("aids"), F.col("labels").alias("alabels"), F.col("rids").alias("arids"), F.col("q").alias("aq"), "windows")
        return self.copies.join(held, ["dim", "number"]).drop("number", "block")

    def select(self, windows: DataFrame, same: bool, k: int, digit: int = DIGIT) -> DataFrame:
        """(anchor, win, rank, score, vec_id, rid): the first k rows by score, then id, of each of windows(anchor, win, low, high)."""
        width = F.expr(f"(high - low + {digit}) div {digit}")
        by = Window.partitionBy("anchor", "win")
        now = saved(windows.withColumns({"top": F.col("high"), "need": F.lit(k), "done": F.lit(False)}))
        while not (active := now.where("not done").withColumn("width", width)).isEmpty():
            counts = scan(self.pairs(active), same, histogram, "digit long, n long").groupBy("anchor", "win", "digit").agg(F.sum("n").alias("n"))
            upto = counts.withColumn("upto", F.sum("n").over(by.orderBy(F.desc("digit")))).join(active.select("anchor", "win", "need"), ["anchor", "win"])
            kth = upto.where("upto >= need").groupBy("anchor", "win").agg(F.max_by(F.struct("digit", (F.col("upto") - F.col("n")).alias("above")), "digit").alias("kth"))
            step = active.join(kth, ["anchor", "win"], "left").withColumn("from", F.col("low") + F.col("kth.digit") * F.col("width"))
            # a window with fewer rows than are wanted has no kth: all of it qualifies
            step = step.select("anchor", "win", F.coalesce("from", "low").alias("low"), F.coalesce(F.least("high", F.col("from") + F.col("width") - 1), "high").alias("high"), "top", (F.col("need") - F.coalesce("kth.above", F.lit(0))).cast("int").alias("need"), (F.col("kth").isNull() | (F.col("width") == 1)).alias("done"))
            now = saved(now.where("done").unionByName(step))
        last = now.select("anchor", "win", "low", F.col("top").alias("high"), F.lit(k).alias("need"), F.lit(1).cast("long").alias("width"))
        got = scan(self.pairs(last), same, first, "score long, vec_id long, rid long")
        rank = F.row_number().over(by.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
        return got.withColumn("rank", rank).where(F.col("rank") <= k)


def _rid_of_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid = [int.from_bytes(r[8 * p : 8 * p + 8], "little", signed=True) for p, r in zip(b.column("place").to_pylist(), b.column("rids").to_pylist(), strict=True)]
        yield pa.record_batch([b.column("dim"), b.column("number"), b.column("place"), pa.array(rid, pa.int64())], names=["dim", "number", "place", "anchor"])


def mine(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label", every: int = 100, moved: int = 7, labels: int = 10, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = 80, size: int = ROWS, anchor_size: int = ANCHORS, digit: int = DIGIT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's positives."""
    prepare(vectors.sparkSession)
    rows = saved(quantised(vectors, id_column, column, label_column, moved, labels))
    anchors = rows.where(F.col("vec_id") % every == 0)
    bound = rows.agg(F.max("norm")).first()[0] or 1
    search = Search(rows, anchors, size, anchor_size)
    most = bound * bound
    windows = anchors.select(F.col("rid").alias("anchor"), F.lit(0).cast("long").alias("win"), F.lit(-most).alias("low"), F.lit(most).alias("high"))
    near = saved(search.select(windows, True, positives, digit))
    # a negative's 100 times score lies between percent times the positive's and 100 times it
    windows = near.where("score >= 0").select("anchor", F.col("rank").cast("long").alias("win"), F.expr(f"(score * {percent} + 99) div 100").alias("low"), F.col("score").alias("high"))
    hard = search.select(windows, False, negatives, digit)
    near = near.join(anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    near = near.select("anchor", "anchor_id", F.col("rank").cast("long").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(hard, ["anchor", "win"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
