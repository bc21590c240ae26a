"""Session settings shared by tests, the benchmark and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that suit any size of cluster; sizes of memory and parallelism are left to spark-submit.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8, name: str = "oremill") -> SparkSession:
    """A session on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
