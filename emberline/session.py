"""Session settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable; AQE joins by run-time sizes and splits skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, memory: str = "6g", partitions: int | None = None) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("emberline")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cpus))
    return builder.getOrCreate()
