"""Suffix-array dedup: finds every byte covered by a string of LENGTH bytes that starts anywhere else too.

One suffix array of all texts would be one machine's work, so suffixes are dealt into groups in which every
two equal windows of LENGTH bytes meet. A window's anchor is the least hash of its grams; it is a function of
the window's bytes alone. A run of windows with one anchor is a row (anchor, hash of the run's bytes, place).
Anchors met once cannot hold a repeat and go; runs whose bytes are equal are repeats as a whole; what remains,
the different runs of one anchor, is sorted: shards of whole anchors get a suffix array by induced sorting and
permuted common prefixes, and windows with a common prefix of LENGTH with a neighbour in the array are repeats.

Skew: equal texts collapse to one row with a count before anything else, counts per anchor and per run are
pre-aggregated, and copies of one run collapse to a representative before any sorting. Runs are at most RUN
windows long. A shard holds SHARD bytes. An anchor whose different runs pass SHARD bytes is not sorted but
divided until nothing is left to divide: its windows are dealt by their distance to the anchor, FINE distances
to a piece, whose key is the hash of all bytes that windows of these distances share; pieces of one key that
are equal are repeats as a whole, and of those that differ the windows are counted one by one by their own hash.
No task holds a whole anchor, and only hashes are shuffled for it. Joins by anchor, run and text have plain
shuffles on both sides, so AQE splits hot keys.

remove_repeats (the pipeline's stage) takes away passages of over WORDS words, whose shortest are well under 400
bytes: it looks for windows of PASSAGE bytes, and of the maximal runs of repeated ones it removes those with more
than WORDS words. digests looks for windows of LENGTH bytes only inside such maximal runs (a repeated window of
LENGTH bytes consists of repeated windows of PASSAGE bytes), so that its second pass reads the repeated part alone.

Defined cases: null text is empty; texts shorter than the window keep everything; repeats within a text and
overlapping ones count; every copy goes, the first too; equal rows (null ids too) are copies of each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, saved, table, texts_of, windows_hash
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 400, 128
PASSAGE, PASSAGE_GRAM, WORDS = 200, 48, 50
RUN = 4096
CHUNK = 1 << 20
SHARD = 1_500_000
FINE = 16

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False  # white space of common.WORD


def pack(data: bytes) -> bytes:
    """A text as it is shuffled and checkpointed."""
    import zstandard

    return zstandard.compress(data, 1)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, whether it may repeat in itself) of the runs of windows with one anchor, CHUNK windows at a time."""
    n = len(data) - length + 1
    parts = [_runs(np.frombuffer(data, np.uint8, min(CHUNK, n - at) + length - 1, at), at, length, gram) for at in range(0, n, CHUNK)]
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(data: np.ndarray, offset: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = windows_hash(data, gram)
    w = length - gram + 1
    n = len(h) - w + 1
    blocks = np.concatenate([h, np.full(-len(h) % w, (1 << 64) - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    new = np.concatenate([[True], least[1:] != least[:-1]])
    inner = np.flatnonzero((h[: n - 1] == least[:-1]) & ~new[1:])  # the run goes on past a place of its anchor
    first = np.flatnonzero(new)
    twice = np.zeros(len(first), bool)
    twice[np.cumsum(new)[inner] - 1] = True
    last = np.concatenate([first[1:], [n]]) - 1
    if (last - first >= RUN).any():  # long periods: cut into pieces, which may repeat in each other
        pieces = (last - first) // RUN + 1
        at = np.repeat(np.arange(len(first)), pieces)
        k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[at] + k * RUN
        return least[first[at]], start + offset, np.minimum(start + RUN - 1, last[at]) + offset, twice[at]
    return least[first], first + offset, last + offset, twice


def anchors(texts: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """(h, c, twice), and where whole also (k, t, n, a, b), of every run in texts(t, n, c, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, z in enumerate(batch.column("z").to_pylist()):
                data = unpack(z)
                h, a, b, twice = runs(data, length, gram)
                k = np.array([digest(data[x : y + length]) for x, y in zip(a.tolist(), b.tolist(), strict=True)] if whole else [0] * len(h), np.uint64)
                for column, value in zip(out, (h.view(np.int64), twice, np.full(len(h), row), k.view(np.int64), a, b), strict=True):
                    column.append(value)
            h, twice, row, k, a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            row = pa.array(row.astype(np.int64))
            columns = {"h": pa.array(h), "c": batch.column("c").take(row), "twice": pa.array(twice.astype(bool))}
            if whole:
                columns |= {"k": pa.array(k), "t": batch.column("t").take(row), "n": batch.column("n").take(row), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return texts.mapInArrow(run, "h long, c long, twice boolean" + ", k long, t long, n int, a int, b int" * whole)


def repeats(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each piece, the runs (first, last) of its windows that occur in any piece at another place."""
    size = np.array([len(x) for x in pieces])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    t = np.zeros(int(size.sum()) + len(pieces), np.uint16)
    whole = np.ones(len(t), bool)
    whole[start + size] = False
    t[whole] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    sa = suffix_array(t)
    phi, prefix = permuted_common_prefixes(t, sa)
    left = np.repeat(start + size, size + 1) - np.arange(len(t))  # symbols up to the end of the piece
    hit = np.flatnonzero((prefix >= length) & (left >= length))
    again = np.zeros(len(t) + 1, bool)
    again[hit] = True
    again[phi[hit]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again]).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for s, e, k in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(start, edge[::2], "right") - 1).tolist(), strict=True):
        out[k].append((s - int(start[k]), e - 1 - int(start[k])))
    return out


_MARKS = "h long, k long, s int, e int"


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "k", "s", "e"])


def sort_shards(contexts: DataFrame, length: int, shard: int = SHARD) -> DataFrame:
    """(h, k, s, e): repeated windows, by offset in their run, from contexts(h, k, alone, bytes) grouped by h."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return _marks([(h, k, s, e) for (h, k, alone, _), got in zip(rows, repeats([r[3] for r in rows], length), strict=True) if alone for s, e in got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "k", "alone", "bytes")), strict=True):
                if size >= shard and rows[-1][0] != row[0]:
                    yield emit(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3]) + 1
        if rows:
            yield emit(rows)

    return contexts.mapInArrow(run, _MARKS)


def contexts_of(wanted: DataFrame, length: int) -> DataFrame:
    """(h, k, alone, bytes) of the runs in wanted(z, want)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for z, want in zip(batch.column("z").to_pylist(), batch.column("want").to_pylist(), strict=True):
                data = unpack(z)
                rows += [(w["h"], w["k"], w["alone"], data[w["a"] : w["b"] + length]) for w in want]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["h", "k", "alone", "bytes"])

    return wanted.mapInArrow(run, "h long, k long, alone boolean, bytes binary")


def cells(data: bytes, anchor: int, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(key, first, last) of the pieces of a run's bytes: windows whose distance to the anchor falls into one class of FINE, with the hash of what such windows share."""
    import xxhash

    h = windows_hash(np.frombuffer(data, np.uint8), gram)
    m = len(data) - length + 1
    there = np.where(h == np.uint64(anchor & (1 << 64) - 1), np.arange(len(h)), len(h))
    place = np.minimum.accumulate(there[::-1])[::-1][:m]
    kind = (place - np.arange(m)) // FINE
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])]))
    last = np.concatenate([first[1:], [m]]) - 1
    out = []
    for x, y, p, q in zip(first.tolist(), last.tolist(), place[first].tolist(), kind[first].tolist(), strict=True):
        key = xxhash.xxh3_64_intdigest(data[p - q * FINE : p - q * FINE - FINE + 1 + length], q)
        out.append((key - (1 << 64) if key >> 63 else key, x, y))
    return out


def divide(texts: DataFrame, hot: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, k, s, e): repeated windows of the runs hot(h, k, t, n, a, b, alone), by hashes alone."""
    key = ["t", "n"]

    def of_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
        want = rows.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("want"))
        return texts.join(saved(want), key).select("z", "want", *key)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for z, want, t, n in zip(*(batch.column(c).to_pylist() for c in ("z", "want", "t", "n")), strict=True):
                data = unpack(z)
                for w in want:
                    part = data[w["a"] : w["b"] + length]
                    rows += [(w["h"], w["k"], t, n, w["a"], w["alone"], sub, xxhash.xxh3_64_intdigest(part[x : y + length]) >> 1, x, y) for sub, x, y in cells(part, w["h"], length, gram)]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["h", "k", "t", "n", "a", "alone", "sub", "same", "x", "y"])

    dealt = saved(of_texts(hot, ["h", "k", "a", "b", "alone"]).mapInArrow(pieces, "h long, k long, t long, n int, a int, alone boolean, sub long, same long, x int, y int"))
    groups = dealt.groupBy("h", "sub").agg(F.count("*").alias("rows"), (F.min("same") != F.max("same")).alias("mixed"))
    dealt = dealt.join(saved(groups.where("rows > 1").select("h", "sub", "mixed")), ["h", "sub"])
    whole = dealt.where("alone and not mixed").select("h", "k", F.col("x").alias("s"), F.col("y").alias("e"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for z, want in zip(batch.column("z").to_pylist(), batch.column("want").to_pylist(), strict=True):
                data = unpack(z)
                for w in want:
                    rows += [(w["h"], w["k"], w["alone"], x, xxhash.xxh3_64_intdigest(data[w["a"] + x : w["a"] + x + length]) >> 1) for x in range(w["x"], w["y"] + 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["h", "k", "alone", "x", "own"])

    single = saved(of_texts(dealt.where("mixed"), ["h", "k", "a", "alone", "x", "y"]).mapInArrow(windows, "h long, k long, alone boolean, x int, own long"))
    again = saved(single.groupBy("h", "own").agg(F.count("*").alias("rows")).where("rows > 1").select("h", "own"))
    single = single.where("alone").join(again, ["h", "own"]).select("h", "k", "x").distinct()
    single = single.withColumn("island", F.col("x") - F.row_number().over(Window.partitionBy("h", "k").orderBy("x")))  # a run has RUN windows at most
    return whole.union(single.groupBy("h", "k", "island").agg(F.min("x").alias("s"), F.max("x").alias("e")).drop("island"))


def repeated_windows(texts: DataFrame, length: int, gram: int, shard: int = SHARD) -> DataFrame:
    """(t, n, spans): for every text of the distinct texts(t, n, c, z) with repeats, the runs (s, e) of repeated windows.

    t and n (hash and number of bytes) stand for a text, c is the number of its copies and z its packed bytes;
    a frame that is partitioned by t and n is not shuffled again.
    """
    session = texts.sparkSession
    long_enough = texts.where(F.col("n") >= length)
    met = anchors(long_enough, length, gram, False).groupBy("h").agg(F.sum("c").alias("rows"), F.max("twice").alias("self"))
    met = saved(met.where("rows > 1 or self").select("h"))
    rows = saved(anchors(long_enough, length, gram, True).join(met, "h"))
    kinds = rows.groupBy("h", "k").agg(F.sum("c").alias("rows"), F.max("twice").alias("self"), F.min(F.struct("t", "n", "a", "b")).alias("at"))
    kinds = saved(kinds.select("h", "k", "rows", "self", "at.*"))
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("self").alias("self"), F.sum(F.col("b") - F.col("a") + length).alias("bytes"))
    groups = saved(groups.where("kinds > 1 or self").select("h", "bytes"))
    mixed = kinds.join(groups, "h").withColumn("alone", F.col("rows") == 1)
    fit = F.col("bytes") <= shard
    facts = groups.agg(F.sum(F.when(fit, F.col("bytes"))).alias("sorted"), F.count(F.when(~fit, 1)).alias("hot")).first()
    want = saved(mixed.where(fit).groupBy("t", "n").agg(F.collect_list(F.struct("h", "k", "a", "b", "alone")).alias("want")))
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), math.ceil((facts["sorted"] or 0) / shard))
    contexts = contexts_of(texts.join(want, ["t", "n"]).select("z", "want"), length)
    marks = sort_shards(contexts.repartition(parts, "h").sortWithinPartitions("h", "k"), length, shard)
    marks = marks.union(kinds.where("rows > 1").select("h", "k", F.lit(0), F.col("b") - F.col("a")))
    if facts["hot"]:
        marks = marks.union(divide(texts, mixed.where(~fit).select("h", "k", "t", "n", "a", "b", "alone"), length, gram))
    marks = saved(marks.groupBy("h", "k").agg(F.collect_list(F.struct("s", "e")).alias("marks")))  # one row a run, so that the join makes no more rows than there are runs
    spans = rows.join(marks, ["h", "k"]).select("t", "n", F.transform("marks", lambda x: F.struct((F.col("a") + x["s"]).alias("s"), (F.col("a") + x["e"]).alias("e"))).alias("spans"))
    return spans.groupBy("t", "n").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keyed(docs: DataFrame, text_column: str) -> DataFrame:
    """docs with __t and __n, which stand for a row's text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.withColumns({"__t": F.xxhash64(text), "__n": F.octet_length(text)})


def distinct_texts(docs: DataFrame, text_column: str, least: int) -> DataFrame:
    """texts(t, n, c, z) of at least so many bytes, partitioned by t and n; the copies in a batch collapse before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(zip(b.column("t").to_pylist(), b.column("n").to_pylist(), strict=True))
            first: dict[tuple[int, int], int] = {}
            count: dict[tuple[int, int], int] = {}
            for i, key in enumerate(own):
                first.setdefault(key, i)
                count[key] = count.get(key, 0) + 1
            some = b.take(pa.array(list(first.values()), pa.int64()))
            packed = pa.array([pack(x) for x in texts_of(some)], pa.binary())
            yield pa.record_batch([some.column("t"), some.column("n"), pa.array([count[k] for k in first], pa.int64()), packed], names=["t", "n", "c", "z"])

    rows = keyed(docs.select(text_column), text_column).where(F.col("__n") >= least)
    rows = rows.select(F.col("__t").alias("t"), F.col("__n").alias("n"), F.col(text_column).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.mapInArrow(run, "t long, n int, c long, z binary").repartition(parts, "t", "n")
    return rows.groupBy("t", "n").agg(F.sum("c").alias("c"), F.first("z").alias("z"))


def stretches(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs of repeated windows that start one after the other, as bytes (from, to); two runs may overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"] + length) for x in spans or []):
        if out and s + length <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes in ranges (from, to) given in order."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def words_in(data: bytes) -> int:
    """The number of words that lie in a piece of text, cut ones included."""
    inside = _WORD_BYTE[np.frombuffer(data, np.uint8)]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """What is left of a text."""
    edges = [0, *(x for c in cuts for x in c), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = PASSAGE, gram: int = PASSAGE_GRAM, words: int = WORDS, shard: int = SHARD) -> DataFrame:
    """docs with the repeated passages of over so many words cut out of the text; a character that loses some of its bytes goes as a whole."""
    prepare(docs.sparkSession)
    found = saved(repeated_windows(cut(distinct_texts(docs, text_column, length)), length, gram, shard))
    found = found.select(F.col("t").alias("__t_"), F.col("n").alias("__n_"), F.col("spans").alias("__spans"))
    rows = keyed(docs, text_column)
    out = rows.join(found, (F.col("__t") == F.col("__t_")) & (F.col("__n") == F.col("__n_")), "left").drop("__t", "__n", "__t_", "__n_")
    schema = docs.schema

    def left(data: bytes | None, spans: list[dict] | None) -> str | None:
        if data is None or not spans:
            return None if data is None else data.decode()
        return without(data, covered([(a, b) for a, b in stretches(spans, length) if words_in(data[a:b]) > words])).decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [left(x, s) for x, s in zip(b.column(text_column).cast(pa.large_binary()).to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(texts, pa.string()) if n == text_column else b.column(n) for n in schema.names], names=schema.names)

    return out.mapInArrow(run, schema)


_FACTS = "t long, n int, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM, words: int = WORDS, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes) of each row of docs(doc_id, text).

    n_removed, n_spans and kept_sha256 are about windows of length bytes; n_passages and passage_bytes are about
    repeated passages of over so many words (runs of repeated windows of passage bytes, overlapping ones taken together).
    """
    prepare(docs.sparkSession)
    key = ["t", "n"]
    texts = cut(distinct_texts(docs, "text", passage))
    found = saved(repeated_windows(texts, passage, passage_gram, shard).withColumnRenamed("spans", "passages"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, n, c, z, spans in zip(*(batch.column(x).to_pylist() for x in ("t", "n", "c", "z", "passages")), strict=True):
                data = unpack(z)
                rows += [(t, n, c, a, b - a, pack(data[a:b])) for a, b in stretches(spans, passage) if b - a >= length]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["t", "n", "c", "start", "size", "z"])

    pieces = saved(texts.join(found, key).mapInArrow(cut_out, "t long, n int, c long, start int, size int, z binary"))
    pieces = pieces.withColumn("own", F.xxhash64("t", "n", "start"))
    again = repeated_windows(pieces.select(F.col("own").alias("t"), F.col("size").alias("n"), "c", "z"), length, gram, shard)
    again = saved(again.select(F.col("t").alias("own"), F.col("n").alias("size"), "spans"))
    again = pieces.select("t", "n", "start", "own", "size").join(again, ["own", "size"])
    again = again.select(*key, F.explode(F.transform("spans", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["e"] + F.col("start")).alias("e")))).alias("span"))
    again = saved(again.groupBy(*key).agg(F.collect_list("span").alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, n, z, passages, spans in zip(*(batch.column(x).to_pylist() for x in ("t", "n", "z", "passages", "spans")), strict=True):
                data = unpack(z)
                cuts = covered(stretches(spans, length))
                wordy = covered([(a, b) for a, b in stretches(passages, passage) if words_in(data[a:b]) > words])
                rows.append((t, n, sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(without(data, cuts)).hexdigest(), len(wordy), sum(b - a for a, b in wordy)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _FACTS.split(", ")])

    facts = saved(texts.join(found, key).join(again, key, "left").select(*key, "z", "passages", "spans").mapInArrow(run, _FACTS))
    facts = facts.withColumnsRenamed({"t": "__t", "n": "__n"})
    own = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").select("doc_id", "__t", "__n", own.alias("own"))
    zero: list[Column] = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans")]
    more = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_passages", "passage_bytes")]
    return rows.join(facts, ["__t", "__n"], "left").select("doc_id", F.col("__n").cast("long").alias("n_bytes"), *zero, F.coalesce("kept_sha256", "own").alias("kept_sha256"), *more)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
