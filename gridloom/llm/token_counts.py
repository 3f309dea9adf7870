"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a text; dynamic programming over positions
carries the best score so far and the number of pieces on that path, nothing else. Ties follow the unigram
tokenizer: at equal scores the piece that starts earlier wins; a character without a piece of its own may be
unknown at the least score minus PENALTY, and counts as many pieces as it has bytes (byte fallback).

No piece holds the space mark after another character, so a text falls into independent segments at its
spaces; each distinct segment is counted once and kept (at most KEPT). Scores are summed exactly, in double
precision; the library adds single-precision numbers, which is the same until a sum leaves 2^24 (long texts, or
texts with unknown characters, whose scores lie near -1e9 in this vocabulary).

The vocabulary is a file of the tokenizers' folder (a parameter), read by the driver and sent with the task.
Defined cases: null and empty text count 0; one space mark is put in front; white space other than the space
is an ordinary character.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

FILE = "piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
KEPT = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, value) of the length-delimited, fixed and varint fields of a serialised message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return x

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, bytes([varint() & 255])
            continue
        n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, data[i : i + n]
        i += n


#: Kinds of pieces in a model file.
NORMAL, USER_DEFINED = 1, 4


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of the normal and user-defined pieces of a model file."""
    with open(path, "rb") as f:
        pieces = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
    rows = [(p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, b"\x01")[0]) for p in pieces]
    return [r for r in rows if r[2] in (NORMAL, USER_DEFINED)]


class Counter:
    """Counts the pieces of texts under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores = [s for _, s, kind in vocabulary if kind == NORMAL]
        for piece, score, kind in vocabulary:  # a user-defined piece always beats what else could stand there
            self.automaton.add_word(piece, (len(piece), len(piece.encode()) * max(scores) - 0.1 if kind == USER_DEFINED else score))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in vocabulary if len(p) == 1}
        self.unknown = min(scores) - PENALTY
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in vocabulary):
            raise ValueError("a piece holds the space mark after another character")
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.kept: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path through one segment."""
        n = len(text)
        none = float("-inf")
        score, count = [0.0] + [none] * n, [0] * (n + 1)
        at, unknown, single = 0, self.unknown, self.single

        def close(end: int) -> None:
            """Positions up to end have all their matches; unknown characters may follow each."""
            nonlocal at
            while at < end:
                at += 1
                c = text[at - 1]
                if c not in single and score[at - 1] + unknown > score[at]:
                    score[at] = score[at - 1] + unknown
                    count[at] = count[at - 1] + len(c.encode())

        for last, (size, worth) in self.automaton.iter(text):
            end = last + 1
            if at < end - 1:
                close(end - 1)
            new = score[end - size] + worth
            if new > score[end]:
                score[end] = new
                count[end] = count[end - size] + 1
        close(n)
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a whole text."""
        if not text:
            return 0, 0.0
        pieces, total, kept = 0, 0.0, self.kept
        if len(kept) > KEPT:
            kept.clear()
        for s in self.segments(SPACE + text.replace(" ", SPACE)):
            got = kept.get(s)
            if got is None:
                got = self.segment(s)
                if len(s) < 64:
                    kept[s] = got
            pieces += got[0]
            total += got[1]
        return pieces, total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score) of every whole text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_vocabulary(model_path))  # a vocabulary, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = Counter(shared.value)
        count = _COUNTERS[model_path].count
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            got = [count(x) for x in texts]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "n_chars", "n_tokens", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))
