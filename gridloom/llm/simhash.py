"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits agree in at
least five of the eight (LEAST_BYTES). Posting lists are keyed by some positions and their bytes, chosen so that
every linked pair meets in a list; inside a list the shared positional bytes of each pair are tallied position by
position, pairs with fewer than five are dropped, and the rest are verified bit by bit.

Keys grow with the corpus: a list is keyed by two neighbouring positions (of any five positions two are
neighbours, so four lists a fingerprint). The members of a list longer than LIST move on to lists keyed by two
more positions (three of the other six agree, so two of one half do: six lists each), and from there to one more
(one of the other four agrees: four lists each), whose members agree in the guaranteed five. Copies of a
fingerprint in the index are thus bounded, and an average list stays short up to LIST * 2^32 fingerprints. What
is longer even then is cut into pieces by a hash of the fingerprint, and every pair of pieces is a group of
its own: no task holds more than two pieces, and no pair is lost. Equal fingerprints are collapsed before the
index, so copies never meet each other. A group emits a spanning forest of its links, not the pairs, so its rows
grow with its members. Components come from star contraction.

Defined cases: null or empty text has fingerprint zero and links like any other; fewer than three words are
one shingle; repeated shingles count each time; null ids are kept with a null component where alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forest, prepare, table, texts_of

SEED = 42
SHINGLE = 3
MAX_BITS = 3
LEAST_BYTES = 5
LIST = 512
FIRST = ((0, 1), (2, 3), (4, 5), (6, 7))


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: -SHINGLE]])
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, len(values), 65536):
        counts += np.unpackbits(values[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, text_hash long, fp long): the fingerprint, as a signed long, of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in texts_of(b)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def byte_mask(positions: tuple[int, ...]) -> int:
    """The bits of some byte positions, as a signed long."""
    x = sum(0xFF << 8 * p for p in positions)
    return x - (1 << 64) if x >> 63 else x


def narrower() -> list[dict[tuple[int, ...], list[tuple[int, ...]]]]:
    """For each of the two steps, the position sets that take the members of a long list, by the list's own."""
    rest = lambda own: [p for p in range(8) if p not in own]
    two = {own: [tuple(sorted({*own, *pair})) for half in (rest(own)[:3], rest(own)[3:]) for pair in combinations(half, 2)] for own in FIRST}
    return [two, {own: [tuple(sorted({*own, p})) for p in rest(own)] for own in {x for some in two.values() for x in some}}]


def postings(distinct: DataFrame, longest: int = LIST) -> DataFrame:
    """(m, v, i, j, side, fp): index entries by positions, their bytes and pair of pieces; all but the longest lists have the one group (0, 0)."""
    key = ["m", "v"]

    def entries(rows: DataFrame, masks: F.Column) -> DataFrame:
        return rows.select("fp", F.explode(masks).alias("m")).withColumn("v", F.col("fp").bitwiseAND(F.col("m")))

    index = entries(distinct, F.array(*[F.lit(byte_mask(x)).cast("long") for x in FIRST]))
    short: list[DataFrame] = []
    for step in narrower():
        long_ = index.groupBy(*key).count().where(F.col("count") > longest).select(*key, F.lit(True).alias("long"))
        index = cut(index.join(long_, key, "left"))
        short.append(index.where("long is null").select("m", "v", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp"))
        masks = F.create_map(*[y for own, some in step.items() for y in (F.lit(byte_mask(own)).cast("long"), F.array(*[F.lit(byte_mask(x)).cast("long") for x in some]))])
        index = entries(index.where("long").select("fp", "m").withColumn("m", masks[F.col("m")]), F.col("m"))
    size = index.groupBy(*key).count().select(*key, F.ceil(F.col("count") / F.lit(longest)).cast("int").alias("pieces"))
    index = index.join(size, key).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    index = index.select(*key, "fp", "c", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("o"))
    out = index.select(*key, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"), "fp")
    for x in short:
        out = out.unionByName(x)
    return out


def tally(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) fingerprints: a spanning forest of the links in each run of equal group values."""
    n = len(fp)
    ends = np.searchsorted(group, group, side="right") if n else np.zeros(0, np.int64)
    octets = fp.view(np.uint8).reshape(-1, 8)
    a, label, held_a, held_b = np.arange(n), np.arange(n), [], []
    for step in range(1, n):
        a = a[a + step < ends[a]]
        if not len(a):
            break
        for part in np.array_split(a, max(1, len(a) // 500_000)):
            x, y = part, part + step
            apart = (side[x] == 0) | (side[x] != side[y])
            x, y = x[apart], y[apart]
            shared = np.zeros(len(x), np.uint8)
            for p in range(8):
                shared += octets[x, p] == octets[y, p]
            x, y = x[shared >= LEAST_BYTES], y[shared >= LEAST_BYTES]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= MAX_BITS
            held_a.append(x[near])
            held_b.append(y[near])
        if sum(map(len, held_a)) > 2_000_000:
            label = forest(n, *map(np.concatenate, ([np.arange(n), *held_a], [label, *held_b])))
            held_a, held_b = [], []
    label = forest(n, *map(np.concatenate, ([np.arange(n), *held_a], [label, *held_b])))
    out = label != np.arange(n)
    return fp[out], fp[label[out]]


def links(distinct: DataFrame, longest: int = LIST) -> DataFrame:
    """(src, dst): links that connect every two of the distinct fingerprints within MAX_BITS, by way of others within MAX_BITS or directly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for b in batches:
            m, v, i, j, side, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("m", "v", "i", "j", "side", "fp"))
            now = np.stack([m, v, i.astype(np.int64) << 32 | j, side.astype(np.int64), fp])
            now = np.concatenate([*rest, now], axis=1)
            new = np.any(now[:3, 1:] != now[:3, :-1], axis=0)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            rest = [now[:, last:]]
            if last:
                yield emit(now[:, :last])
        if rest and rest[0].shape[1]:
            yield emit(rest[0])

    def emit(x: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum(np.any(x[:3, 1:] != x[:3, :-1], axis=0))])
        src, dst = tally(group, x[3], np.ascontiguousarray(x[4]).view(np.uint64))
        return pa.record_batch([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    grouped = postings(distinct, longest)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(parts, "m", "v", "i", "j").sortWithinPartitions("m", "v", "i", "j").mapInArrow(run, "src long, dst long")


def labels(same: DataFrame) -> DataFrame:
    """Adds label, one for each component of links, to rows of distinct fp."""
    found = components(links(same.select("fp")))
    return cut(same.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprint and smallest id reachable by links, for every row of docs."""
    fps = cut(fingerprints(docs, id_column, text_column).drop("text_hash"))
    least = labels(cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))))
    lowest = least.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = least.join(lowest, "label").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def firsts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(no_id, doc_id, text_hash): the first of each component of near copies; rows without an id (doc_id 0) come last."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash")
    least = labels(cut(fingerprints(docs, id_column, text_column).groupBy("fp").agg(F.min(key).alias("key"))))
    return least.groupBy("label").agg(F.min("key").alias("key")).select("key.*")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
