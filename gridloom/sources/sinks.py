"""Sinks: parquet tables, single JSON documents, stage manifests, exports with markers and fallback reads."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages in their order; a change to one makes it and all later ones stale.
STAGES = ("compile", "layout", "graph", "publish")


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, rows_per_file: int | None = None) -> None:
    """A parquet table, snappy; Spark's committer makes it appear as a whole."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_bytes(path: str, data: bytes) -> None:
    """A local file that is there as a whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def json_lines(df: DataFrame) -> Iterator[str]:
    """Rows as JSON without null fields, one at a time on the driver."""
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("j")).toLocalIterator():
        yield row.j


def etag(schema: str, content_sha256: str) -> str:
    return '"' + hashlib.sha256(f"{schema}:{content_sha256}".encode()).hexdigest() + '"'


def fingerprint(schema: str, settings: dict) -> str:
    return hashlib.sha256(json.dumps([schema, settings], sort_keys=True).encode()).hexdigest()


def stale_from(manifest: dict[str, str], wanted: dict[str, str]) -> str | None:
    """The first stage whose fingerprint is not the one wanted; null if all are good."""
    return next((s for s in STAGES if manifest.get(s) != wanted.get(s)), None)


def export(tables: dict[str, DataFrame], target: str, export_id: str) -> None:
    """Tables under a fresh folder each time; the marker that names the folder is written last."""
    for name, df in tables.items():
        write_table(df, f"{target}/{export_id}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(export_id, sorted(tables))], "export_id string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{target}/complete")


def read_published(spark: SparkSession, target: str, name: str, local: str) -> DataFrame:
    """A table of the last complete export, or the local one where no export lists it."""
    from pyspark.errors import AnalysisException

    try:
        marker = spark.read.schema("export_id string, tables array<string>").json(f"{target}/complete").first()
    except AnalysisException:
        marker = None
    return spark.read.parquet(f"{target}/{marker.export_id}/{name}" if marker and name in marker.tables else local)


def write_lines(path: str, lines: Iterator[str]) -> None:
    """A local text file of lines written as they come, there as a whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        for line in lines:
            f.write(line + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


JOB = "job_id string, filename string, status string, stage string, created string"


def session_jobs(spark: SparkSession, path: str, status: str | None = None, q: str | None = None) -> DataFrame:
    """The jobs whose meta files lie under a path, by id; unreadable files are left out."""
    jobs = spark.read.schema(JOB).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(path).where("job_id is not null")
    if status:
        jobs = jobs.where(F.col("status") == status)
    if q and q.strip():
        jobs = jobs.where(F.lower("filename").contains(q.strip().lower()))
    return jobs.orderBy("job_id")


def read_document(spark: SparkSession, path: str, schema: str, without: tuple[str, ...] = ()) -> DataFrame:
    """A JSON document as one row of a schema; fields left out are not parsed."""
    return spark.read.schema(schema).option("multiLine", True).json(path).drop(*without)
