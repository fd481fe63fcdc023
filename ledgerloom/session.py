"""Session helper for local runs, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A local session with the settings the queries are written for (UTC, AQE, few shuffle partitions)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
