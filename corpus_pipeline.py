"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, mixing, byte-level BPE.

Each stage is (name, function of (spark, docs, sf_dir)); docs has the columns of `documents`, and so has what
every stage but the last returns. Extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import FILE, encode_decode
from gridloom.llm.common import cut, table
from gridloom.llm.langid import UNKNOWN, learn, predict
from gridloom.llm.mixing import mixed
from gridloom.llm.simhash import firsts
from gridloom.llm.suffix_dedup import remove_repeats

#: Documents whose best cosine with a sketch is under this have hardly a trigram of any learned language.
LEAST_COSINE = 0.03


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; lang becomes what it predicts. Null and letterless texts go."""
    languages, prototypes = learn(docs, sketched=True)
    columns = docs.columns
    scored = predict(docs, languages, prototypes).where((F.col("lang_pred") != UNKNOWN) & (F.col("__known") >= LEAST_COSINE))
    return scored.withColumn("lang", F.col("lang_pred")).select(*columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least id (one without an id only where none has one), then text hash."""
    keep = firsts(docs).toDF("__no_id", "__id", "__text")
    keys = {"__no_id": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__text": F.xxhash64("text")}
    rows = docs.withColumns(keys).dropDuplicates(list(keys))
    return rows.join(keep, list(keys), "left_semi").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere."""
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words are not taken."""
    return mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that was taken."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path(FILE), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]
#: SQL cannot express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
