"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is a share of all words by its weight, at most CAP times its own words; the excess goes
to the other sources by weight (water filling, in closed form with two windows over the table of sources).
A document is taken floor(r) times for sure, r = target / size of its source, and once more with inclusion
probability r - floor(r). Which documents get the extra copy is a balanced sample: the flight phase moves
probabilities inside the null space of two constraints, the words and the number of documents, so both
totals stay exactly as expected until at most two documents of a group are undecided.

Scale: equal rows collapse to one with their number n, whose owed extra copies are n times the fraction: the whole
part is taken, the rest is the probability of one more. A source is dealt into groups of about GROUP such rows by a
hash of id and text, so a source or a (null) id with a third of all rows is many tasks. Groups leave at most two undecided documents each; those fly again in groups of groups,
until one group of a source is left, whose last documents land with the least error in words; one exchange of a
taken for a left document of that group then closes what the landing left open. The texts are
read once and only (id, size, source) is shuffled.

Defined cases: null text has size 0; documents of size 0 are never taken; the null source comes last; a
source without words has target 0; equal rows are separate documents, taken in any order; random numbers are hashes
of id, text and seed, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, prepare, table

WEIGHTS = (5, 2, 1)
CAP = 3
GROUP = 512
STRETCH = 4096
_HASHES = "doc_id long, size long, rank int, bucket long, h long, p double, y int"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size, n) -> with rank, target and ratio = target / source_size; one row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights))
    ranked = ranked.withColumns({"w": weight, "top": F.col("source_size") * F.lit(float(cap)), "total": F.sum("source_size").over(everything).cast("double")})
    # sources in the order in which rising water fills them; those before the first that stays below its top are full
    fill = Window.orderBy(F.col("top") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"full": F.coalesce(F.sum("top").over(before), F.lit(0.0)), "rest_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    ranked = ranked.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest_w"))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct("at", "level"))).over(everything)
    ranked = ranked.withColumn("at", F.row_number().over(fill)).withColumn("level", F.coalesce(first["level"], F.lit(float("inf"))))
    ranked = ranked.withColumn("target", F.least(F.col("top"), F.col("level") * F.col("w")))
    return ranked.select("source", "source_size", "n", "rank", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"))


def fly(p: np.ndarray, size: np.ndarray, u: np.ndarray, land: bool) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping sum(p) and sum(p * size); at most two stay between unless land."""
    start, p = p, p.copy()
    window: list[int] = []
    eps = 1e-9
    for k in range(len(p)):
        if eps < p[k] < 1 - eps:
            window.append(k)
        if len(window) < 3:
            continue
        a, b, c = (float(size[i]) for i in window)
        move = (b - c, c - a, a - b)  # sums to 0, and so does its product with the sizes
        if a == b == c:
            move = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, v in zip(window, move, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if u[window[0]] * (up + down) < down else -down
        for i, v in zip(window, move, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q < eps else 1.0 if q > 1 - eps else q
        window = [i for i in window if 0 < p[i] < 1]
    if land and window:
        owed = sum(p[i] * size[i] for i in window)
        best = min(range(1 << len(window)), key=lambda m: (abs(sum(int(size[i]) for b, i in enumerate(window) if m >> b & 1) - owed), m))
        for b, i in enumerate(window):
            p[i] = float(best >> b & 1)
        _settle(p, size, float(np.dot(p - start, size)))
    return p


def _settle(p: np.ndarray, size: np.ndarray, error: float) -> None:
    """Exchanges the one taken and the one left document of a group that bring its words nearest to what was expected."""
    taken, left = np.flatnonzero(p >= 1), np.flatnonzero(p <= 0)
    if not len(taken) or not len(left):
        return
    left = left[np.argsort(size[left], kind="stable")]
    at = np.searchsorted(size[left], size[taken] - error)
    best = (abs(error), -1, -1)
    for near in (np.clip(at, 0, len(left) - 1), np.clip(at - 1, 0, len(left) - 1)):
        off = np.abs(error - size[taken] + size[left[near]])
        k = int(np.argmin(off))
        best = min(best, (float(off[k]), int(taken[k]), int(left[near[k]])))
    if best[1] >= 0:
        p[best[1]], p[best[2]] = 0.0, 1.0


def _flight(df: DataFrame, land: bool) -> DataFrame:
    def run(x: pa.Table) -> pa.Table:
        x = x.take(pc.sort_indices(x, [("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending")]))
        p, size, h = (x.column(c).to_numpy() for c in ("p", "size", "h"))
        p = fly(p, size, (h.view(np.uint64) >> np.uint64(11)) / float(1 << 53), land)
        y = np.where(p >= 1, 1, np.where(p <= 0, 0, -1)).astype(np.int32)
        return x.drop(["p", "y"]).append_column("p", pa.array(p)).append_column("y", pa.array(y)).select(["doc_id", "size", "rank", "bucket", "h", "p", "y"])

    return df.groupBy("rank", "bucket").applyInArrow(run, _HASHES)


def copies(groups: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """groups(doc_id, size, source, t, n), n equal rows each, with source_size, target, base (times that each row is taken) and more (how many are taken once more)."""
    sums = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    plan = cut(targets(sums, weights, cap))
    key = lambda s: [F.coalesce(s["source"], F.lit("")), s["source"].isNull()]
    facts = plan.withColumnsRenamed({"source": "source_", "n": "groups"})
    left, right = key(groups), (F.coalesce(facts["source_"], F.lit("")), facts["source_"].isNull())
    joined = groups.join(facts, (left[0] == right[0]) & (left[1] == right[1])).drop("source_")
    joined = joined.withColumn("base", F.floor(F.col("ratio") + F.lit(1e-12)).cast("long"))
    joined = joined.withColumn("owed", F.when(F.col("size") > 0, F.col("n") * F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0))).otherwise(0.0))
    joined = joined.withColumn("sure", F.least(F.col("n"), F.floor(F.col("owed") + F.lit(1e-9))).cast("long"))
    joined = joined.withColumns({"p": F.greatest(F.col("owed") - F.col("sure"), F.lit(0.0)), "bucket": F.pmod(F.col("h"), F.greatest(F.lit(1), F.ceil(F.col("groups") / F.lit(GROUP))))})
    joined = cut(joined)
    largest = plan.agg(F.max("n")).first()[0] or 0
    flown = cut(_flight(joined.where("size > 0").select("doc_id", "size", "rank", "bucket", "h", "p", F.lit(-1).alias("y")), largest <= GROUP))
    done, buckets = [flown.where("y >= 0")], math.ceil(largest / GROUP)
    while buckets > 1:
        buckets = math.ceil(buckets / (GROUP // 2))
        again = flown.where("y < 0").withColumn("bucket", F.floor(F.col("bucket") / F.lit(GROUP // 2)))
        flown = cut(_flight(again, buckets <= 1))
        done.append(flown.where("y >= 0"))
    chosen = done[0]
    for x in done[1:]:
        chosen = chosen.union(x)
    chosen = chosen.where("y > 0").groupBy("rank", "h", "size").agg(F.sum("y").alias("y"))
    joined = joined.join(chosen, ["rank", "h", "size"], "left").withColumn("more", F.least(F.col("n"), F.col("sure") + F.coalesce("y", F.lit(0))))
    return joined.select("doc_id", "size", "source", "t", "n", "source_size", "target", "base", "more")


def hashable(df: DataFrame) -> list[Column]:
    """The columns of df in a form that can be hashed: those with a map in them as JSON."""
    return [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes]


def spread(df: DataFrame, times: Column) -> DataFrame:
    """Each row so many times, numbered 1.. in __i; what comes of one row is dealt to tasks STRETCH rows at a time."""
    df = df.withColumn("__times", times.cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = df.where(F.col("__times").between(1, STRETCH)).withColumn("__k", F.lit(0).cast("long"))
    many = df.where(F.col("__times") > STRETCH).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / F.lit(STRETCH)))))
    out = few.unionByName(many.repartition(parts, "__k", F.xxhash64(*hashable(df))))
    first = F.col("__k") * STRETCH + 1
    return out.withColumn("__i", F.explode(F.sequence(first, F.least(F.col("__times"), first + STRETCH - 1)))).drop("__times", "__k")


def grouped(docs: DataFrame, id_column: str, text_column: str, source_column: str, row: list[Column], seed: int = 7) -> DataFrame:
    """(doc_id, size, source, t, n, h) of the distinct rows by id, text, source and what else is in row."""
    size = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), size.alias("size"), F.col(source_column).alias("source"), F.xxhash64(F.col(id_column), F.col(text_column), *row).alias("t"))
    rows = rows.groupBy("doc_id", "size", "source", "t").agg(F.count("*").alias("n"))
    return cut(rows.withColumn("h", F.xxhash64("t", F.lit(seed))))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs."""
    prepare(docs.sparkSession)
    of = copies(grouped(docs, id_column, text_column, source_column, [], seed), weights, cap)
    taken = F.col("size") * (F.col("base") + (F.col("__i") <= F.col("more")).cast("long"))
    return spread(of, F.col("n")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix takes them; rows without words are not taken."""
    prepare(docs.sparkSession)
    own = hashable(docs)
    of = copies(grouped(docs, id_column, text_column, source_column, own, seed), weights, cap)
    times = of.where("size > 0").select("t", (F.col("n") * F.col("base") + F.col("more")).alias("taken")).where("taken > 0")
    # a row travels as one column, whatever its columns are called
    rows = docs.select(F.xxhash64(F.col(id_column), F.col(text_column), *own).alias("t"), F.struct(*docs.columns).alias("row")).dropDuplicates(["t"])
    return spread(rows.join(times, "t"), F.col("taken")).select("row.*")


def op1_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
