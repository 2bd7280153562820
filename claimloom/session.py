"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "claimloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """AQE and UTC on; shuffle partitions only where given, since AQE merges small ones."""
    b = SparkSession.builder.appName(name)
    if master or not os.environ.get("MASTER"):
        b = b.master(master or "local[*]")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
