"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

A text is cut by the tokenizer's pattern; each distinct piece (word) is encoded once. The words of a batch
that the worker has not met become token-position rows of a DuckDB table. A recursive query joins every
word's neighbouring tokens with the merge table (rank of the concatenated bytes), contracts each word's
leftmost pair of minimum rank, and goes on until no word has a pair left. The ids of a text are those of its
words in order; decoding joins ids with the vocabulary and aggregates their bytes ordered by position.

The merge table is read by the driver from the tokenizer's rank file (a parameter) and sent with the task:
its size is the vocabulary's, never the data's. Words longer than LONGEST bytes take a form of the query that joins
all of a word's pairs of least rank in one round, so that rounds grow with the kinds of tokens met and not with bytes.
A worker's memory holds one Arrow batch, the merge table, at most KEPT words and the rows of one query.

Defined cases: null text is empty; empty text has no tokens and the digests of empty bytes; rows repeat
freely; ids do not depend on batch or partition, since words are independent.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

LONGEST = 64
KEPT = 500_000
PIECE_BYTES = 1_000_000  # of the words of one query; a longer word is a query of its own
STEP_ROWS = 8_000_000  # of the rounds of one query for long words
FILE = "byte_bpe_50k.tiktoken"

#: One round: neighbouring tokens of each word meet the merge table; the leftmost pair of least rank is joined.
#: Tokens are rows (word, position, id); merges has (left id, right id, id of the joined bytes, its rank).
CONTRACT = """
WITH RECURSIVE tokens(w, i, t, open) AS (
    SELECT w, i, t, true FROM pieces
  UNION ALL
    (WITH pairs AS (
        SELECT w, i, t, m.rank, next_i FROM
        (SELECT w, i, t, lead(t) OVER o AS r, lead(i) OVER o AS next_i FROM tokens WHERE open WINDOW o AS (PARTITION BY w ORDER BY i)) a
        LEFT JOIN merges m ON m.l = a.t AND m.r = a.r
     ), best AS (
        SELECT w, min((rank::BIGINT << 32) | (i << 16) | next_i) AS x FROM pairs WHERE rank IS NOT NULL GROUP BY w
     )
     SELECT p.w, p.i, CASE WHEN p.i = ((x >> 16) & 65535) THEN (x >> 32)::INT ELSE p.t END, x IS NOT NULL
     FROM pairs p LEFT JOIN best b ON b.w = p.w
     WHERE x IS NULL OR p.i <> (x & 65535))
)
SELECT w, list(t ORDER BY i) AS ids FROM tokens WHERE NOT open GROUP BY w
"""

#: The same for long words, whose single joins would take as many rounds as they have bytes: a round joins all of a
#: word's pairs of least rank, from the left, those that overlap a joined one left out. Where the joined token could
#: form a pair of lower rank (alone) only the leftmost is joined; where it cannot, single joins would take the others
#: next all the same. Words that are still open after the last step come back as they are, to go on from there.
CONTRACT_LONG = """
WITH RECURSIVE tokens(w, i, t, open, step) AS (
    SELECT w, i, t, true, 0 FROM pieces
  UNION ALL
    (WITH pairs AS (
        SELECT w, i, t, step, m.rank, m.alone, min(m.rank) OVER (PARTITION BY w) AS least FROM
        (SELECT w, i, t, step, lead(t) OVER (PARTITION BY w ORDER BY i) AS r FROM tokens WHERE open AND step < {steps}) a
        LEFT JOIN merges m ON m.l = a.t AND m.r = a.r
     ), runs AS (
        SELECT *, coalesce(rank = least, false) AS hit, row_number() OVER o AS k,
            max(CASE WHEN rank = least THEN NULL ELSE i END) OVER o AS miss, min(CASE WHEN rank = least THEN i END) OVER (PARTITION BY w) AS leftmost
        FROM pairs WINDOW o AS (PARTITION BY w ORDER BY i ROWS UNBOUNDED PRECEDING)
     ), chosen AS (
        SELECT w, i, t, step, least, hit AND CASE WHEN alone THEN i = leftmost ELSE (row_number() OVER (PARTITION BY w, miss ORDER BY i) + (miss IS NULL)::INT) % 2 = 0 END AS joined FROM runs
     ), kept AS (
        SELECT *, lag(joined) OVER (PARTITION BY w ORDER BY i) AS gone FROM chosen
     )
     SELECT w, i, CASE WHEN joined THEN least ELSE t END, least IS NOT NULL, step + 1 FROM kept WHERE gone IS NOT TRUE)
)
SELECT w, list(i ORDER BY i), list(t ORDER BY i), bool_or(open) FROM tokens WHERE NOT open OR step = {steps} GROUP BY w
"""

DECODE = """
SELECT w, string_agg(v.hex, '' ORDER BY p.i) AS hex
FROM (SELECT w, unnest(ids) AS t, unnest(range(len(ids))) AS i FROM coded) p JOIN vocabulary v ON v.id = p.t
GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """A worker's DuckDB session with the merge table, and the words that it has coded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, longest: int = LONGEST):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks, self.longest = ranks, longest
        self.byte = np.array([ranks[bytes([i])] for i in range(256)])
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}
        # nothing is spilled: PIECE_BYTES and STEP_ROWS bound what a query holds
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "600MB", "temp_directory": ""})
        merges = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        least: dict[int, int] = {}
        for left, right, r in merges:
            least[left], least[right] = min(r, least.get(left, r)), min(r, least.get(right, r))
        columns = list(zip(*merges, strict=True))
        m = pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("l", "r", "rank"), columns, strict=True)})
        m = m.append_column("alone", pa.array([least.get(r, r + 1) < r for *_, r in merges]))
        v = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        for name, data in (("merges", m), ("vocabulary", v)):
            self.db.register("x", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM x")
            self.db.unregister("x")

    def learn(self, words: list[str]) -> None:
        """Codes words, decodes their ids again, and keeps both."""
        raw = [w.encode() for w in words]
        ids: list[list[int]] = [[]] * len(raw)
        for some, sql in (([k for k, w in enumerate(raw) if len(w) <= self.longest], CONTRACT), ([k for k, w in enumerate(raw) if len(w) > self.longest], CONTRACT_LONG)):
            while some:
                ends = np.cumsum([len(raw[k]) for k in some])
                n = max(1, int(np.searchsorted(ends, PIECE_BYTES, "right")))
                part, some = some[:n], some[n:]
                size = np.array([len(raw[k]) for k in part])
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                token = self.byte[np.frombuffer(b"".join([raw[k] for k in part]), np.uint8)]
                rows = [pa.array(c.astype(np.int32)) for c in (np.repeat(part, size), place, token)]
                while rows:
                    steps = max(4, STEP_ROWS // len(rows[0]))
                    got, rows = self._query("pieces", rows, ["w", "i", "t"], sql.format(steps=steps)), []
                    open_ = [x for x in got if len(x) > 2 and x[3]]
                    for x in got:
                        ids[x[0]] = x[-1] if len(x) == 2 else x[2]
                    if open_:
                        rows = [pa.array(np.concatenate(c).astype(np.int32)) for c in ([np.full(len(x[1]), x[0]) for x in open_], [x[1] for x in open_], [x[2] for x in open_])]
        back = dict(self._query("coded", [pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["w", "ids"], DECODE))
        for k, w in enumerate(words):
            self.words[w] = (" ".join(map(str, ids[k])), len(ids[k]), bytes.fromhex(back[k]))

    def _query(self, name: str, arrays: list[pa.Array], columns: list[str], sql: str) -> list[tuple]:
        self.db.register(name, pa.table(arrays, names=columns))
        try:
            return self.db.execute(sql).fetchall()
        finally:
            self.db.unregister(name)

    def code(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """(ids as decimals joined by a space, their number, the bytes they decode to) of each text."""
        out, start = [], 0
        while start < len(texts):
            if len(self.words) > KEPT // 2:  # words not met again since the last time go
                self.words, self.old = {}, self.words
            cut, new, known, old = [], {}, self.words, self.old
            while start < len(texts) and len(new) < KEPT // 4:
                cut.append(self.find(texts[start]))
                for w in set(cut[-1]):
                    if w not in known:
                        if w in old:
                            known[w] = old[w]
                        else:
                            new[w] = None
                start += 1
            if new:
                self.learn(list(new))
            for words in cut:
                got = [known[w] for w in words]
                out.append((" ".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got])))
        return out


_CODECS: dict[tuple, Codec] = {}


def codec(path_key: str, ranks: bytes, pattern: str) -> Codec:
    """The worker's codec for a rank table, made once."""
    key = (path_key, hashlib.md5(ranks).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids and decoded where with_ids, for each row of docs."""
    prepare(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, shared.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = coder.code([x or "" for x in part.column("text").to_pylist()])
                columns = [part.column("doc_id").cast(pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0].encode()).hexdigest() for g in got]), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got])]
                if with_ids:
                    columns += [pa.array([list(map(int, g[0].split())) for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.binary())]
                yield pa.record_batch(columns, schema=schema)

    spark_schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, spark_schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE), public_tokenizers.PATTERN)
