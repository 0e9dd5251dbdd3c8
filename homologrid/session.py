"""Session defaults for local runs; a cluster brings its own settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "homologrid", cpus: int | None = None) -> SparkSession:
    """A ``local[n]`` session with partition counts fitted to one machine."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shuffle_width(spark: SparkSession) -> int:
    """How many ranges to cut a global order into: the shuffle width, at least 2."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
