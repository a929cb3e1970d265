"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits skewed join partitions and merges small shuffle partitions; times are in UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the session it gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tablewright")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
