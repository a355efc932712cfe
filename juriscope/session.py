"""Spark session for tests, benchmarks and scripts; library code takes the caller's session."""

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the oracle comparison relies on (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("juriscope")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
