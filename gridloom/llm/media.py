"""Media columns: signature sniffing of binary values.

An Aho-Corasick automaton over the magic bytes of common containers finds candidate places in one pass;
a validator for each format then confirms structure and lengths, so that a chance "BM" or "PK" in prose
is no detection. The validated structure at offset 0 corrects the declared type; validated structures
further in are carved out as embedded media.

Defined cases: null or empty values are `application/octet-stream` without spans; a truncated or
overlong structure fails its validator; nested hits inside an accepted span belong to that span.
Rows are independent (a map over Arrow batches), so nothing is shuffled and memory is one batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table, texts_of

UNKNOWN = "application/octet-stream"
UNIT = 192


def _png(d: bytes, at: int) -> int:
    i = at + 8
    while i + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, i)
        end = i + 12 + n
        if end > len(d) or struct.unpack_from(">I", d, end - 4)[0] != zlib.crc32(d[i + 4 : end - 4]):
            return 0
        if i == at + 8 and kind != b"IHDR":
            return 0
        if kind == b"IEND":
            return end - at
        i = end
    return 0


def _riff(d: bytes, at: int) -> int:
    """WAVE with a format chunk and a data chunk that fill the declared size."""
    if at + 12 > len(d) or d[at + 8 : at + 12] != b"WAVE":
        return 0
    end, i, seen = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12, set()
    if end > len(d):
        return 0
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", d, i)
        seen.add(kind)
        i += 8 + n + n % 2
    return end - at if i == end and {b"fmt ", b"data"} <= seen else 0


def _bmp(d: bytes, at: int) -> int:
    if at + 54 > len(d):
        return 0
    n, _, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    row = (abs(w) * bits + 31) // 32 * 4
    return n if head == 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and start >= 54 and n == start + row * abs(h) and at + n <= len(d) else 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    flags, i = d[at + 10], at + 13
    i += 3 << (flags & 7) + 1 if flags & 128 else 0
    while i < len(d):
        mark = d[i]
        if mark == 0x3B:
            return i + 1 - at
        if mark == 0x21:
            i += 2
        elif mark == 0x2C and i + 10 < len(d):
            i += 10 + (3 << (d[i + 9] & 7) + 1 if d[i + 9] & 128 else 0) + 1
        else:
            return 0
        while i < len(d) and d[i]:
            i += d[i] + 1
        i += 1
    return 0


def _jpeg(d: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(d) and d[i] == 0xFF:
        mark, n = d[i + 1], struct.unpack_from(">H", d, i + 2)[0]
        i += 2 + n
        if mark == 0xDA:
            end = d.find(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else 0
    return 0


def _pdf(d: bytes, at: int) -> int:
    if d[at + 5 : at + 7] not in (b"1.", b"2.") or not d[at + 7 : at + 8].isdigit():
        return 0
    end = d.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 else 0


def _zip(d: bytes, at: int) -> int:
    end = d.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d):
        return 0
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    return end + 22 + note - at if start + size == end - at and end + 22 + note <= len(d) else 0


def _gzip(d: bytes, at: int) -> int:
    z = zlib.decompressobj(31)
    try:
        rest = d[at:]
        while not z.eof and rest:
            z.decompress(rest, 1 << 20)
            rest = z.unconsumed_tail
    except zlib.error:
        return 0
    return len(d) - at - len(z.unused_data) if z.eof else 0


#: Magic bytes of containers, their media type and the validator that confirms them.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"RIFF", "audio/wav", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
)
_AUTOMATON: list = []


def automaton():
    """The automaton over latin-1 text, in which a byte is a character; made once in each worker."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(SIGNATURES):
            a.add_word(magic.decode("latin-1"), (k, len(magic)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def spans(data: bytes, embedded: bool = True) -> list[tuple[int, int, str]]:
    """(start, length, media type) of validated structures, outermost first, in order of their start."""
    found, free = [], 0
    for last, (k, n) in automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at < free or not embedded and at:
            continue
        _, kind, valid = SIGNATURES[k]
        if length := valid(data, at):
            found.append((at, length, kind))
            free = at + length
    return found


def sniff(data: bytes | None, declared: str | None) -> tuple[str, bool, list[tuple[int, int, str]]]:
    """The type that the bytes have, whether the declared one was wrong, and the carved spans."""
    found = spans(data or b"")
    kind = found[0][2] if found and found[0][0] == 0 else UNKNOWN
    return kind, kind != (declared or UNKNOWN), found


def sniff_media(df: DataFrame, column: str = "content", declared: str = "media_type") -> DataFrame:
    """Adds sniffed_type, type_corrected and media_spans (start, length, type) to each row of binary values.

    Column names that clash with these are replaced. The declared column may be missing.
    """
    prepare(df.sparkSession)
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())])))])

    @F.pandas_udf(out)
    def look(content, said):
        import pandas as pd

        rows = [sniff(x, y) for x, y in zip(content, said, strict=True)]
        return pd.DataFrame({"kind": [r[0] for r in rows], "corrected": [r[1] for r in rows], "spans": [[{"start": a, "length": n, "type": k} for a, n, k in r[2]] for r in rows]})

    said = F.col(declared) if declared in df.columns else F.lit(None).cast("string")
    return df.withColumn("__look", look(F.col(column), said)).withColumns({"sniffed_type": F.col("__look.kind"), "type_corrected": F.col("__look.corrected"), "media_spans": F.col("__look.spans")}).drop("__look")


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM at 8 kHz; a sample for each byte (payload lengths are even)."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload


def to_bmp(payload: bytes) -> bytes:
    """24-bit rows of 64 pixels, top first; UNIT bytes are a row."""
    n = len(payload)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + n, 0, 54, 40, 64, -(n // UNIT), 1, 24, 0, n, 0, 0, 0, 0) + payload


def to_png(payload: bytes) -> bytes:
    """8-bit RGB rows of 64 pixels, filter 0; UNIT bytes are a row."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(media: bytes, kind: str) -> bytes:
    """The samples that a validated WAV, BMP or PNG made here holds."""
    if kind == "audio/wav":
        i = 12
        while media[i : i + 4] != b"data":
            i += 8 + struct.unpack_from("<I", media, i + 4)[0]
        return media[i + 8 : i + 8 + struct.unpack_from("<I", media, i + 4)[0]]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    if kind == "image/png":
        i, body = 8, []
        while (k := media[i + 4 : i + 8]) != b"IEND":
            n = struct.unpack_from(">I", media, i)[0]
            body += [media[i + 8 : i + 8 + n]] * (k == b"IDAT")
            i += 12 + n
        return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, UNIT + 1)[:, 1:].tobytes()
    raise ValueError(f"no samples in {kind}")


STORES = (("audio/wav", to_wav), ("image/bmp", to_bmp), ("image/png", to_png))


def digest(text: bytes) -> tuple:
    """The columns of op8 for one text: it is stored under a type declared by rote, sniffed, carved and read back."""
    payload = pad(text)
    check = zlib.crc32(payload)
    stored = STORES[check % len(STORES)][1](payload)
    declared = STORES[check // len(STORES) % len(STORES)][0]
    kind, wrong, found = sniff(stored, declared)
    at, n, _ = found[0]
    back = samples(stored[at : at + n], kind)
    inner = spans(back)
    level = np.frombuffer(back, np.uint8)
    feature = f"{kind};declared={declared};corrected={int(wrong)};units={len(back) // UNIT};min={level.min()};max={level.max()};sum={int(level.sum(dtype=np.int64))};embedded={','.join(f'{k}@{a}+{m}' for a, m, k in inner)}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as a media value: stored, sniffed, carved, read back and digested. Null text counts as empty."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest(x) for x in texts_of(b)]
            columns = list(zip(*rows, strict=True)) or [()] * (len(_ARROW) - 1)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, SCHEMA)
