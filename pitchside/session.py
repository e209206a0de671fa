"""One place that builds the SparkSession, so that every entry point has the same semantics."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "pitchside", cores: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution.

    Nothing here fixes a size: shuffle partitions follow the cluster's own setting on a real
    master, and only a local session gets a small number of them.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", os.environ.get("PITCHSIDE_SHUFFLE", "8"))
            .config("spark.driver.memory", os.environ.get("PITCHSIDE_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
