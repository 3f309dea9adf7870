"""Session helpers: how Python workers find the package, and one local session for tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers started from now on import this package from the driver's path.

    On a cluster the package is installed or sent with --py-files; this only helps sessions
    that were started without it on PYTHONPATH.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows written to the checkpoint folder the session names (a temporary one where it names none)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridloom-"))
    return df.checkpoint(eager=True)


#: Rows of a partition that stay small in memory when sorted and grouped several times by one task.
SPREAD_ROWS = 250_000


def spread(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """df dealt by keys to a number of partitions that grows with rows, so that the memory of one task does not.

    Spark merges small shuffle partitions until there is one for each core; those of a fixed number it leaves alone.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // SPREAD_ROWS)), *keys)


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings used in tests and in the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
