"""Toxicity: a convolutional text classifier in numpy.

Words (runs of ASCII letters and digits or any other character, A-Z lower-cased) are hashed to 64 bits, and the
embedding of a word is the sum of two rows of a table of BUCKETS, named by two halves of the hash: no vocabulary is
kept, and words that share one row seldom share the other. Filters of several widths slide over the embeddings;
each filter's maximum over the text goes into a logistic layer. The first embedding component starts at the row's
smoothed log odds; rows not met in training are zero. Only the places of the maxima pass gradients back, so an epoch
costs little more than the forward pass.

Thresholds are calibrated by language, which is itself guessed from the text by word frequencies learned in
training: in each guessed language the raw logit that best separates calibration documents is moved to the
score FLAG, so one cut serves all languages.

Training takes a bounded sample of labelled rows (POSITIVES and NEGATIVES labels at most, in expectation, by a hash of
the id; then at most ROWS distinct texts of TRAIN_BYTES together, by a hash of id and text; texts over LONGEST bytes
are not learned from): the sample's labels are broadcast, so no text is shuffled but those of the sample; executors
turn its whole texts into table places, the driver trains. Scoring is a map over Arrow batches with a broadcast model
of fixed size.

Defined cases: null and empty texts score as the model's value of an empty text; without toxic or without clean
labels every score is 0; repeated labels and repeated rows count once; a document labelled both ways counts as one
of each; ties do not occur in scoring (it is a function of the text).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, fold, mix, prepare, table, texts_of

FLAG = 0.7
POSITIVES, NEGATIVES = 4000, 8000
ROWS, TRAIN_BYTES, LONGEST = 24_000, 80_000_000, 1_000_000
BUCKETS = 1 << 18
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.03
CHUNK = 1 << 19

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word in a text, in order."""
    out = []
    start = 0
    while start < len(data):
        end = min(len(data), start + CHUNK)
        while end < len(data) and _WORD[data[end]]:  # no word is cut
            end += 1
        b = _LOWER[np.frombuffer(data, np.uint8, end - start, start)]
        inside = np.concatenate([[False], _WORD[b], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        down, up = _powers(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[: len(b)], out=sums[1:])
            out.append(mix((sums[last] - sums[first]) * up[first]))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def places(data: bytes) -> np.ndarray:
    """The two table rows of each word in a text, in order."""
    h = word_hashes(data)
    return np.stack([h & np.uint64(BUCKETS - 1), (h >> np.uint64(32)) & np.uint64(BUCKETS - 1)]).astype(np.int32)


def padded(x: np.ndarray, width: int) -> np.ndarray:
    """Places with room for a filter before and after; BUCKETS is the place of no word, whose row is zero."""
    return np.pad(x, ((0, 0), (width - 1, max(1, width - 1))), constant_values=BUCKETS)


class Net:
    """Embeddings, filters of several widths, maxima, a logistic layer."""

    def __init__(self, odds: np.ndarray, seen: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.e[:-1, 0] = odds / 2
        self.e[:-1][~seen] = 0
        self.e[-1] = 0
        self.w = [rng.normal(0, 0.2, (width * DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
        for w in self.w:
            w[::DIM] = np.abs(w[::DIM]) + 0.3  # filters start by looking for words with high odds
        self.v = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.c = np.float32(-2.0)
        self.state: dict[str, np.ndarray] = {}

    def maxima(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's maximum over the places x, and the places under it."""
        values, under = [], []
        for width, w in zip(WIDTHS, self.w, strict=True):
            at = padded(x, width)
            e = self.e[at[0]] + self.e[at[1]]
            n = at.shape[1] - width + 1
            s = sum(e[j : j + n] @ w[j * DIM : (j + 1) * DIM] for j in range(width))
            k = s.argmax(0)
            values.append(np.maximum(s[k, np.arange(FILTERS)], 0))
            under.append(at[:, k[:, None] + np.arange(width)])
        return np.concatenate(values), under

    def logit(self, x: np.ndarray) -> float:
        return float(self.maxima(x)[0] @ self.v + self.c)

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, at=...) -> None:
        """Adagrad, on the rows `at` of a parameter."""
        s = self.state.setdefault(name, np.full_like(value, 1e-4))
        s[at] += grad * grad
        value[at] -= RATE * grad / np.sqrt(s[at])

    def train(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                gw, gv, gc = [np.zeros_like(w) for w in self.w], np.zeros_like(self.v), 0.0
                rows, grads = [], []
                for k in order[lo : lo + BATCH]:
                    h, under = self.maxima(texts[k])
                    d = float(weight[k] * (1 / (1 + math.exp(-max(-30.0, min(30.0, float(h @ self.v + self.c))))) - y[k])) / BATCH
                    gv += d * h
                    gc += d
                    back = d * self.v * (h > 0)
                    for i, (w, words) in enumerate(zip(self.w, under, strict=True)):
                        g = back[i * FILTERS : (i + 1) * FILTERS]
                        e = (self.e[words[0]] + self.e[words[1]]).reshape(FILTERS, -1)
                        gw[i] += e.T * g
                        rows += [words[0].ravel(), words[1].ravel()]
                        grads += [(w.T * g[:, None]).reshape(-1, DIM)] * 2
                for i, w in enumerate(self.w):
                    self.step(f"w{i}", w, gw[i] + 1e-5 * w)
                self.step("v", self.v, gv)
                self.c -= np.float32(RATE * gc)
                at, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(at), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(grads))
                total, at = total[at < BUCKETS], at[at < BUCKETS]
                self.step("e", self.e, total, at)


class Model:
    """What scoring needs; picklable, of fixed size."""

    def __init__(self, net: Net, speech: np.ndarray, cuts: np.ndarray):
        self.speech, self.cuts = speech, cuts
        self.c = float(net.c)
        self.v = net.v
        # products of every row with every part of every filter: a text's convolution is then sums of rows
        self.parts = [[np.ascontiguousarray(net.e @ w[j * DIM : (j + 1) * DIM]) for j in range(width)] for width, w in zip(WIDTHS, net.w, strict=True)]

    def score(self, text: bytes) -> float:
        x = places(text)
        values = []
        for width, parts in zip(WIDTHS, self.parts, strict=True):
            at = padded(x, width)
            n = at.shape[1] - width + 1
            top = np.full(FILTERS, -np.inf, np.float32)
            for lo in range(0, n, 65536):
                hi = min(n, lo + 65536)
                s = parts[0][at[0, lo:hi]] + parts[0][at[1, lo:hi]]
                for j in range(1, width):
                    s += parts[j][at[0, lo + j : hi + j]]
                    s += parts[j][at[1, lo + j : hi + j]]
                top = np.maximum(top, s.max(0))
            values.append(np.maximum(top, 0))
        z = float(np.concatenate(values) @ self.v + self.c)
        z += math.log(FLAG / (1 - FLAG)) - self.cuts[speaks(self.speech, x)]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def speaks(speech: np.ndarray, x: np.ndarray) -> int:
    """The likeliest language of places by their frequencies (the first for texts without words)."""
    return int(np.argmax(speech[x.ravel()].sum(0))) if x.size else 0


def sample(marks: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """About so many of the distinct rows of each class of marks(__id, toxic), by a hash of the id: small enough to broadcast."""
    marks = marks.where(F.col("toxic").isin(0, 1) & F.col("__id").isNotNull()).select("__id", "toxic").distinct()
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = lambda k, most: int(min(1, most / max(1, counts.get(k, 0))) * 1e6)
    return marks.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share(1, positives)).otherwise(share(0, negatives)))


def bounded(labelled: DataFrame, rows: int = ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """The distinct texts of labelled(__id, text, lang, toxic), or about as many of them as the bounds allow."""
    known = labelled.where(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST)).withColumn("k", F.xxhash64("__id", "text"))
    facts = known.select("k", "toxic", F.octet_length("text").alias("b")).distinct().agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    share = min(1.0, rows / max(1, facts["n"]), size / max(1, facts["b"] or 0))
    some = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1e6))
    return some.groupBy("k", "toxic").agg(F.first("text").alias("text"), F.first(F.coalesce("lang", F.lit(""))).alias("lang"))


def fit(labelled: DataFrame) -> Model | None:
    """A model from the rows labelled(__id, text, lang, toxic), within the bounds; null if one of the classes is missing."""
    prepare(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("toxic").cast(pa.int32()), b.column("lang"), pa.array([places(x).tobytes() for x in texts_of(b)], pa.binary())], names=["toxic", "lang", "h"])

    got = sorted((bytes(r.h), r.toxic, r.lang) for r in bounded(labelled).select("toxic", "lang", "text").mapInArrow(run, "toxic int, lang string, h binary").collect())
    if len({t for _, t, _ in got}) < 2:
        return None
    texts = [np.frombuffer(h, np.int32).reshape(2, -1) for h, _, _ in got]
    y = np.array([t for _, t, _ in got], np.float64)
    langs = sorted({x for _, _, x in got})
    tongue = np.array([langs.index(x) for _, _, x in got])
    part = np.arange(len(got)) % 5 == 0  # the calibration documents; the order is that of hashes
    seen = np.zeros((2, BUCKETS))
    speech = np.full((BUCKETS, len(langs)), 0.5)
    for x, t, k, held in zip(texts, y, tongue, part, strict=True):
        own = np.unique(x)
        speech[own, k] += 1
        if not held:
            seen[int(t), own] += 1
    n1, n0 = max(1, (y[~part] == 1).sum()), max(1, (y[~part] == 0).sum())
    odds = np.clip(np.log((seen[1] / n1 * 1000 + 2) / (seen[0] / n0 * 1000 + 2)), -3, 5)
    net = Net(odds.astype(np.float32), seen.sum(0) > 0)
    learn = np.flatnonzero(~part)
    weight = np.where(y == 1, max(1.0, (y == 0).sum() / max(1, (y == 1).sum()) / 2), 1.0)
    net.train([texts[i] for i in learn], y[learn], weight[learn])
    speech = np.log(speech / speech.sum(0)).astype(np.float32)
    z = np.array([net.logit(texts[i]) for i in np.flatnonzero(part)])
    guess = np.array([speaks(speech, texts[i]) for i in np.flatnonzero(part)])
    everywhere = best_cut(z, y[part])
    cuts = np.array([best_cut(z[guess == k], y[part][guess == k]) if (y[part][guess == k] == 1).sum() >= 10 else everywhere for k in range(len(langs))])
    return Model(net, speech, cuts)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that gives the best F1; among equals the middle of the widest gap."""
    if not len(z) or not (y == 1).any():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    mids = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    hits = np.concatenate([np.cumsum(y[::-1])[::-1], [0]])
    flagged = len(z) - np.arange(len(z) + 1)
    f1 = 2 * hits / (flagged + y.sum())
    gap = np.concatenate([[1], z[1:] - z[:-1], [1]])
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(mids[top[np.argmax(gap[top])]])


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labelled rows that are not held out, for all rows of docs."""
    spark = prepare(docs.sparkSession)
    held = F.coalesce(fold(id_column, 3) == 1, F.lit(False))
    marks = sample(labels.where(~F.coalesce(fold("doc_id", 3) == 1, F.lit(False))).select(F.col("doc_id").alias("__id"), F.col("toxic")))
    rows = docs.where(~held).select(F.col(id_column).alias("__id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    model = fit(rows.join(F.broadcast(marks), "__id"))  # POSITIVES and NEGATIVES bound what is broadcast
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score = np.array([m.score(x) if m else 0.0 for x in texts_of(b)], np.float64)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= FLAG).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = docs.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_column).alias("text"))
    return out.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
