"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """UTC, ANSI and adaptive execution; everything else is the cluster's business."""
    b = (
        SparkSession.builder.appName("ledgerline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        b = b.master(master)
    return b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b
