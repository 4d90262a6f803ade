"""Session settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A small session for tests and for the bench."""
    builder = (SparkSession.builder.master(f"local[{cpus or os.cpu_count() or 8}]").appName("auditspark")
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
