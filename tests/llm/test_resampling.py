"""Importance resampling against a plain version, with nulls, empties, repeats, long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import resampling
from gridloom.llm.resampling import hashed, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def features(text):
    w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5):
    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s, t = sum(source.values()), sum(wanted.values())
    out = []
    for doc_id, text in rows:
        n, f = features(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000.0) / ((source[b] + 1) * (t + 10000.0)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = drawn[: percent * len(drawn) // 100]
    rank = {id(r): k for k, r in enumerate(drawn, 1)}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "café", "ÉTÉ", "x-y", "a1"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    return out + [(400, None), (401, ""), (402, ". \x00!"), (None, out[1][1] * 9), (None, out[1][1] * 9), (7, out[7][1]), (403, "long " * 40000 + "tail"), (404, "z" * 300_000)]


def test_equals_plain(spark, rows):
    target = [rows[3][1], None, "", "café w1 w2 w3"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"enough": F.lit(1), "rank": F.lit("x"), "place": F.lit(2.0)})
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for n, percent in ((1, 5), (6, 5), (30, 50)):
        got = resample(docs.repartition(n), aims, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, target, percent)


def test_blocks_lose_no_run(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["aa", "b", "ccc", "straße"]) for _ in range(3000)).encode()
    whole = np.sort(np.concatenate([x for _, x in hashed(text)]))
    for size in (1, 7, 1000):
        monkeypatch.setattr(resampling, "BLOCK", size)
        assert np.array_equal(np.sort(np.concatenate([x for _, x in hashed(text)])), whole)
        assert sum(n for n, _ in hashed(text)) == 3000


def test_hot_copies(spark):
    rows = [(5, "same words " * 15)] * 2000 + [(i, f"other w{i} " * 12) for i in range(300)]
    target = ["same words same"]
    docs = spark.createDataFrame(rows, DOCS).repartition(8)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample(none, none).count() == 0
    some = [(1, "a b c " * 10), (2, None)]
    assert sorted(map(tuple, resample(spark.createDataFrame(some, DOCS), none, percent=100).collect()), key=str) == plain(some, [], 100)
