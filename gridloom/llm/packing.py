"""Best-fit packing of documents into sequences of a fixed number of tokens, by hierarchical residual packing.

One pass encodes the texts of each partition, cuts documents longer than a sequence into whole sequences (the first
piece may be shorter) and packs the pieces by best fit decreasing. Sequences that are nearly full are emitted where they
are made. Those with more room go up a tree as the items that they hold: each round reads the items left in the shared
folder with FAN times fewer partitions, packs them again by best fit, and emits again. No row is shuffled; a round's
partitions read what FAN partitions before them left.

Scale: a task holds at most ITEMS pieces at a time and leaves at most KEEP of them (those of its emptiest sequences;
the fuller ones are emitted as they are), so the last round's only task holds a bounded number as well. Every round
writes to the shared folder, so a lost executor costs its own tasks only.

Encoding: distinct words (matches of the byte-level pattern) are cut, numbered and counted by Arrow, and each is
encoded once by the tokenizer's model. Texts with characters outside the scripts that are surely cut alike, or with
the mark that Arrow cuts by, are encoded whole by the tokenizer.

Defined cases: null text is empty; an empty text is one piece that holds the end id alone; equal rows are packed each on
its own; a null doc_id is kept; special tokens in a text are ordinary text; columns besides id and text are ignored, and
clash with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, prepare, table

FILE = "byte_bpe_50k.json"
ROOM = 2048
END = 0
#: A sequence with so many free places or fewer is nearly full.
SLACK = 8
ITEMS = 200_000
KEEP = 4096
FAN = 16
#: Words that a worker knows, and bytes of text taken at once.
KNOWN = 400_000
TEXT_BYTES = 8_000_000
MARK = "\x01"
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: In a run of white space before a word, the last character stands apart.
APART = rf"([{SPACES}]+)([{SPACES}][^{SPACES}])"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}\x01]+|[{SPACES}]+"
#: Characters besides Latin, Greek, Cyrillic and common punctuation, or the mark.
STRANGE = r"[^\x{00}\x{02}-\x{24F}\x{370}-\x{52F}\x{2000}-\x{206F}]"
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
IDS = pa.field("ids", pa.binary())


class Encoder:
    """The ids of texts by a byte-level tokenizer, as little-endian unsigned 32-bit numbers."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = count(256)
        self.letters = "".join(chr(b) if b in printable else chr(next(other)) for b in range(256))  # the format's letter of each byte
        self.number = [k.to_bytes(4, "little") for k in range(self.whole.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """The ids of one word; those of words not met again for a while go."""
        if (ids := self.old.get(w)) is None:
            got = self.model.tokenize(charmap_decode(w.encode(), "strict", self.letters)[0]) if w else []
            ids = b"".join([self.number[t.id] for t in got])
        self.known[w] = ids
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        strange = pc.match_substring_regex(texts, STRANGE)
        plain = pc.if_else(strange, "", texts)
        marked = pc.replace_substring_regex(plain, APART, rf"\1{MARK}\2")
        cut = pc.split_pattern(pc.replace_substring_regex(marked, WORDS, rf"\0{MARK}"), MARK)
        ends = cut.offsets.to_numpy()
        coded = cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        if len(self.known) > KNOWN:
            self.known, self.old = {}, self.known
        get, word = self.known.get, self.word
        parts = [word(w) if (ids := get(w)) is None else ids for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        at = coded.indices.to_numpy()
        each = size[at]
        after = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(first[at] - after[:-1], each) + np.arange(after[-1])]
        bounds = after[ends - ends[0]]
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(strange.to_numpy(zero_copy_only=False)):
            out[k] = np.array(self.whole.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def pieces(ids: bytes, room: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document of these ids; only a longer one is cut, its first piece takes what is over."""
    n = len(ids) // 4
    first = n if n <= room else n % room or room
    for k in range(1 + (n - first) // room):
        yield (k, first + (k - 1) * room, room) if k else (0, 0, first)


def best_fit(length: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit decreasing: the bin of each item, its offset there, and what each bin holds.

    Open bins stand in stacks by free places; a bit for each stack that is not empty gives the fullest bin that an item fits in.
    """
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    full: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        if above := some >> n:
            free = n + (above & -above).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                some ^= 1 << free
        else:
            free, b = room, len(full)
            full.append(0)
        bins[i], offset[i] = b, full[b]
        full[b] += n
        stacks[free - n].append(b)
        some |= 1 << (free - n)
    return bins, offset, full


class Packer:
    """Packs a stream of pieces; sequence ids start at base."""

    def __init__(self, schema: pa.Schema, base: int, room: int, slack: int, keep: int, items: int):
        self.schema, self.next, self.room, self.slack, self.keep, self.items = schema, base, room, slack, keep, items
        self.rows: list[pa.Table] = []
        self.n = 0

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Takes pieces; gives those of emitted sequences."""
        self.rows.append(rows)
        self.n += len(rows)
        if self.n >= self.items:
            yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Packs what is held; emits nearly full sequences, and the fullest others until at most keep pieces are left (last: all)."""
        if not self.n:
            return
        rows = pa.concat_tables(self.rows)
        bins, offset, full = best_fit(rows.column("length").to_numpy(), self.room)
        fill, items = np.array(full), np.bincount(bins, minlength=len(full))
        order = np.argsort(fill, kind="stable")  # emptiest first
        out = (fill >= self.room - self.slack) | last
        kept = order[~out[order]]
        out[kept[np.cumsum(items[kept]) > self.keep]] = True
        go = out[bins]
        number = self.next + np.cumsum(out) - 1
        self.next += int(out.sum())
        yield from self._set(rows.filter(pa.array(go)), number[bins[go]], offset[go])
        self.rows, self.n = [rows.filter(pa.array(~go))], int((~go).sum())

    def left(self) -> Iterator[pa.RecordBatch]:
        for rows in self.rows:
            yield from rows.to_batches()

    def _set(self, rows: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
        for name, values in (("sequence_id", pa.array(sequence)), ("offset", pa.array(offset)), ("open", pa.array(np.zeros(len(rows), bool)))):
            rows = rows.set_column(self.schema.get_field_index(name), self.schema.field(name), values)
        yield from rows.to_batches()


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, slack: int = SLACK, keep: int = KEEP, items: int = ITEMS, fan: int = FAN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of docs; with_ids adds its ids."""
    spark = prepare(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB
    schema = PIECE.append(IDS) if with_ids else PIECE

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("packing", len(spec.value), zlib.crc32(spec.value.encode())), lambda: Encoder(spec.value))
        packer = Packer(schema, TaskContext.get().partitionId() << 32, room, slack, keep, items)
        for b in batches:
            for part in shares(b):
                rows, sequence = [], []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                    ids += END.to_bytes(4, "little")
                    for k, start, length in pieces(ids, room):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, k, start, length, zlib.crc32(own), None, None, True, *[own] * with_ids))
                if rows:
                    yield from packer.add(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema))
        yield from packer.flush()
        yield from packer.left()

    def again(level: int, last: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(schema, level << 56 | TaskContext.get().partitionId() << 32, room, slack, keep, items)
            for b in batches:
                yield from packer.add(pa.Table.from_batches([b]).cast(schema))
            yield from packer.flush(last)
            yield from packer.left()

        return run

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean" + ", ids binary" * with_ids
    columns = [f.split()[0] for f in ddl.split(", ")]
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows.mapInArrow(first, ddl).write.partitionBy("open").parquet(f"{folder}/0")
    level, parts = 0, rows.rdd.getNumPartitions()
    while not level or parts > 1:
        left = spark.read.schema(ddl).parquet(f"{folder}/{level}").where("open").select(*columns)
        parts = max(1, math.ceil(min(parts, left.rdd.getNumPartitions()) / fan))
        level += 1
        left.coalesce(parts).mapInArrow(again(level, parts == 1), ddl).write.partitionBy("open").parquet(f"{folder}/{level}")
    out = spark.read.schema(ddl).parquet(f"{folder}/0").where("not open")
    for k in range(1, level + 1):
        out = out.unionByName(spark.read.schema(ddl).parquet(f"{folder}/{k}").where("not open"))
    return out.select([c for c in columns if c != "open"])


def shares(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about TEXT_BYTES, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield b.slice(at, upto - at)
        at = upto


def sequences(packed: DataFrame, room: int = ROOM) -> DataFrame:
    """(sequence_id, ids, doc_ids) of each sequence of pack(with_ids=True): its pieces' ids in order, little-endian bytes."""
    one = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return one.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))
