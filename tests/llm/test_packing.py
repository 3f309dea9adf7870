"""Best-fit packing against the tokenizer itself, with nulls, empties, repeats, long texts and clashing columns."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm.packing import FILE, Encoder, best_fit, pack, sequences

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(FILE))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    some = ["river", " Straße", " été", "\n\n", " 12", "ing", "  ", " the", "日本", "'s"]
    out = [(i, "".join(rng.choice(some) for _ in range(rng.randint(1, 900)))) for i in range(150)]
    return out + [(150, None), (151, ""), (152, "   "), (153, "a <|endoftext|> b"), (None, "no id"), (None, "no id"), (154, "x\x01y z"), (155, " word" * 9000), (156, "q" * 100_000), (157, " w" * 4095), (158, " w" * 2047), (159, " w" * 2048)]


def check(got, rows, tokenizer, room):
    by_id, fill = defaultdict(list), defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)] if len(ids) > room else [0, len(ids)]
        want[doc_id] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in by_id.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(fill), sum(r.length for r in got)


def test_pieces_and_sequences(spark, rows, tokenizer):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"length": F.lit("x"), "open": F.lit(1)})
    for n in (1, 7, 40):
        got = pack(docs.repartition(n), public_tokenizers.path(FILE)).collect()
        used, total = check(got, rows, tokenizer, 2048)
        assert used <= total / 2048 * 1.02 + 1


def test_bounds_lose_no_piece(spark, rows, tokenizer):
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    got = pack(docs, public_tokenizers.path(FILE), room=256, keep=2, items=10, fan=2).collect()
    check(got, rows, tokenizer, 256)


def test_sequences_hold_the_ids(spark, rows, tokenizer):
    docs = spark.createDataFrame(rows[:60], DOCS)
    packed = pack(docs, public_tokenizers.path(FILE), with_ids=True)
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    pieces = packed.collect()
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in pieces)
    for r in pieces:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    check(pieces, rows[:60], tokenizer, 2048)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS), public_tokenizers.path(FILE)).count() == 0


def test_repeated_rows(spark):
    got = pack(spark.createDataFrame([(1, "one two three")] * 3000, DOCS).repartition(5), public_tokenizers.path(FILE)).collect()
    assert len(got) == 3000 and len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x250)] + [chr(i) for i in range(0x370, 0x530)] + [chr(i) for i in range(0x2000, 0x2070)] + list("  ''  ab19\n\t") * 40 + ["日", "😀", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(5000)]
    with open(public_tokenizers.path(FILE)) as f:
        got = Encoder(f.read()).encode(pa.array(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_leaves_no_pair_that_fits():
    length = np.random.default_rng(0).integers(1, 2048, 5000)
    bins, offset, full = best_fit(length, 2048)
    assert max(full) <= 2048 and sum(full) == length.sum() and sorted(full)[0] + sorted(full)[1] > 2048
    assert np.array_equal(np.bincount(bins, length).astype(int), full)
    assert len(full) <= length.sum() / 2048 * 11 / 9 + 1
