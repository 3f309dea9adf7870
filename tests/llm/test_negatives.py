"""Hard-negative mining against a plain version, with nulls, ties, hot copies, other lengths, huge components and clashing columns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm.negatives import Side, mine

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    v = []
    for k, (vec_id, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        v.append((k, vec_id, label, [math.floor(256 * c) for c in x]))
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for k, vec_id, label, q in v:
        if vec_id is None or vec_id % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, o)), i, n, la == label) for n, i, la, o in v if n != k and len(o) == len(q)]
        for p in sorted((s for s in scored if s[3]), key=order)[:5]:
            hard = sorted((s for s in scored if not s[3] and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=order)[:5]
            out += [(vec_id, p[1], r, n[1], p[0], n[0]) for r, n in enumerate(hard, 1)]
    return sorted(out, key=str)


def make(seed, n, dims=6, grain=4):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-grain, grain) / grain for _ in range(dims)], rng.randint(0, 3)) for i in range(n)]
    odd = [(100, None, 1), (200, [1.0] * dims, None), (300, [float("nan")] * dims, 1), (301, [float("inf")] * dims, 1), (302, [None] * dims, 1), (400, [0.0] * dims, 2), (500, [], 1), (501, [], 1), (502, [], 2), (600, [1.0, 2.0], 1), (601, [1.0, 1.5], 1), (602, [1.0, 1.4], 2), (None, [0.5] * dims, 1), (None, [0.5] * dims, 2), (700, [0.5] * dims, -3), (700, [0.5] * dims, -3), (14, [0.25] * dims, 9)]
    return rows + odd


@pytest.mark.parametrize("bounds", [{}, {"size": 7, "anchor_size": 2, "digit": 4}])
def test_equals_plain(spark, bounds):
    rows = make(1, 350)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"rid": F.lit(1), "block": F.lit("x"), "norm": F.lit(None).cast("string")}).repartition(5)
    got = mine(df, **bounds)
    want = plain(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 40 and sorted(map(tuple, got.collect()), key=str) == want


def test_hot_copies(spark):
    rows = [(i, [0.5, 0.5, 0.5], 1 if i % 2 else 2) for i in range(1500)] + [(i, [0.5, 0.5, 0.45], i % 5) for i in range(1500, 1700)]
    got = mine(spark.createDataFrame(rows, VECTORS).repartition(6), size=200)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_huge_components(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 2), (2, [9e29, 1.0], 3), (3, [1000.0, 3.0], 3)]
    assert mine(spark.createDataFrame(rows, VECTORS)).select("negative_id").distinct().collect() == [(2,)]


def test_exact_products_at_each_size():
    import numpy as np

    rng = np.random.default_rng(0)
    for top in (100, 1 << 20, 1 << 26):
        q = rng.integers(-top, top, (9, 3)).astype("<i4")
        ids = np.arange(9).tobytes()
        side = Side(9, 3, ids, ids, ids, q.tobytes())
        assert side.scores(slice(0, 9), side).tolist() == [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in q] for x in q]


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert mine(none).count() == 0
    assert mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], VECTORS)).count() == 0
    assert mine(spark.createDataFrame([(100, [1.0], 1)], VECTORS)).count() == 0
