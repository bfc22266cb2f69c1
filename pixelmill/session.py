"""Session settings the package relies on, and nothing else."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits skewed join partitions and merges small ones; UTC
# keeps timestamps comparable between engines; Arrow carries pixel batches.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Keyed stream state (`pixelmill.streaming.state`) needs this provider.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "pixelmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STREAM_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
