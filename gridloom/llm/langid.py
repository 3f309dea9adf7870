"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (a seeded stream for its code point). An n-gram is bound from
its letters' vectors, permuted by their place (a roll) and multiplied; a document bundles (adds) the vectors
of all its trigrams; a language's prototype bundles its training documents at unit length. A document takes
the language whose prototype has the largest cosine with it.

Training bundles all labelled rows; its sums are aggregated on executors, and what reaches the driver is
languages x DIMENSIONS numbers. Prediction is a map; a worker keeps at most KEPT trigram vectors.

The score of a text without a known trigram is noise of standard deviation 1 / sqrt(DIMENSIONS). To tell such
texts, learn(sketched=True) also sums each language's trigrams, hashed with a sign to WIDTH places, twice; cosines
with these are exact but for collisions, of deviation 1 / sqrt(WIDTH), and the lower one counts, as few trigrams
collide in both. They take languages x 2 x WIDTH numbers to the driver.

Defined cases: null text and text without a letter are `und` with score 0; other text is lower-cased, and
every run of other characters is one space; ties go to the first language by code point; with nothing to
learn from, every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, mix, prepare, table

DIMENSIONS = 512
WIDTH = 1 << 15
KEPT = 40_000
UNKNOWN = "und"
LANGUAGES_AT_MOST = 10_000


class Trigrams:
    """Vectors of trigrams, made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 11):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((1024, self.dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return self.letters[code]

    def indices(self, grams: np.ndarray) -> np.ndarray:
        """The row in the matrix of each trigram (three code points of 21 bits)."""
        rows = self.rows
        out = [rows.get(g, -1) for g in grams.tolist()]
        if -1 in out:
            for k, r in enumerate(out):
                if r < 0:
                    g = int(grams[k])
                    if len(rows) == len(self.matrix):
                        self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                    out[k] = rows[g] = len(rows)
                    self.matrix[out[k]] = np.roll(self.letter(g >> 42), 2) * np.roll(self.letter(g >> 21 & 0x1FFFFF), 1) * self.letter(g & 0x1FFFFF)
        return np.array(out)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of a text's trigram vectors, or null if it has no letter."""
        counted = count(text)
        return None if counted is None else self.bundle_of(*counted)

    def bundle_of(self, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(kinds) > KEPT:
            self.clear()
        out = np.zeros(self.dimensions, np.float64)
        for i in range(0, len(kinds), 8192):
            out += counts[i : i + 8192].astype(np.float32) @ self.matrix_of(kinds[i : i + 8192])
        return out

    def matrix_of(self, kinds: np.ndarray) -> np.ndarray:
        rows = self.indices(kinds)
        return self.matrix[rows]


_LETTER = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter; filled once in each worker."""
    if not _LETTER.any():
        _LETTER[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return _LETTER


def trigrams(text: str) -> np.ndarray | None:
    """All trigrams of letters and single spaces as integers, or null without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32)
    code = code[letter | np.concatenate([[True], letter[:-1]])]
    code = np.concatenate([[32], code, [32]]) if code[0] != 32 else np.concatenate([code, [32]])
    return code[:-2] << 42 | code[1:-1] << 21 | code[2:]


def count(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """A text's distinct trigrams and how often each occurs, or null if it has no letter."""
    grams = trigrams(text or "")
    return None if grams is None else np.unique(grams, return_counts=True)


def sketch(kinds: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of two hashes, the place of each trigram among its WIDTH and its signed count, all counts together at unit length."""
    h = mix(kinds.astype(np.uint64))
    sides = (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32))
    return [((x % np.uint64(WIDTH)).astype(np.int64) + WIDTH * k, np.where(x >> np.uint64(31), -counts, counts) / np.linalg.norm(counts)) for k, x in enumerate(sides)]


_MADE: list[Trigrams] = []


def maker() -> Trigrams:
    if not _MADE:
        _MADE.append(Trigrams())
    return _MADE[0]


def learn(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", sketched: bool = False) -> tuple[list[str], np.ndarray]:
    """The languages and their unit prototypes, each followed by its two unit sketches if sketched, from all rows with a text and a language."""
    prepare(labelled.sparkSession)
    data = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))

    size = DIMENSIONS + 2 * WIDTH * sketched

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        made = maker()
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                counted = count(text)
                if counted is not None and (n := np.linalg.norm(v := made.bundle_of(*counted))):
                    if lang not in sums:
                        sums[lang] = np.zeros(size)
                    sums[lang][:DIMENSIONS] += v / n
                    if sketched:
                        for at, x in sketch(*counted):
                            np.add.at(sums[lang], DIMENSIONS + at, x)
        for lang, v in sums.items():
            some = np.flatnonzero(v).astype(np.int32)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(v[some])], names=["lang", "i", "v"])

    sums = data.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.round(F.sum("v"), 6).alias("v"))
    per = sums.groupBy("lang").agg(F.collect_list(F.struct("i", "v")).alias("x")).select("lang", "x.i", "x.v").limit(LANGUAGES_AT_MOST + 1).collect()
    if len(per) > LANGUAGES_AT_MOST:
        raise ValueError(f"more than {LANGUAGES_AT_MOST} languages")
    per = sorted(per, key=lambda r: r["lang"])
    protos = np.zeros((len(per), size))
    for k, r in enumerate(per):
        protos[k, r["i"]] = r["v"]
    for part in np.split(protos, [DIMENSIONS, DIMENSIONS + WIDTH], axis=1):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return [r["lang"] for r in per], protos


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text_column: str = "text") -> DataFrame:
    """Adds lang_pred and score (the cosine, 0 to 1) to each row; columns with these names are replaced.

    With sketches after the prototypes, also __known (replaced likewise): the largest cosine with a language by its sketches.
    """
    prepare(docs.sparkSession)
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score", *["__known"] * (prototypes.shape[1] > DIMENSIONS))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    protos, sketches = prototypes[:, :DIMENSIONS].astype(np.float64), prototypes[:, DIMENSIONS:].astype(np.float32)
    sketched = sketches.shape[1] > 0
    if sketched:
        schema = schema.add("__known", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = maker()
        for b in batches:
            lang, score, known = [], [], []
            for text in b.column(text_column).to_pylist():
                counted = count(text) if languages else None
                if counted is None or not (n := np.linalg.norm(v := made.bundle_of(*counted))):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    known.append(0.0)
                    continue
                cosine = protos @ v / n
                k = int(np.argmax(cosine))
                lang.append(languages[k])
                score.append(float(min(1.0, max(0.0, cosine[k]))))
                if sketched:
                    known.append(float(np.minimum(*(sketches[:, at] @ x for at, x in sketch(*counted))).max()))
            more = {"__known": pa.array(known, pa.float64())} if sketched else {}
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), *more.values()], names=[*b.schema.names, "lang_pred", "score", *more])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, predicted for all."""
    held = fold(id_column, 4) == 2
    languages, protos = learn(docs.where(~held), text_column, lang_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), held.alias("held_out"), F.col(text_column).alias("text"))
    return predict(rows, languages, protos).select("doc_id", "held_out", "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
