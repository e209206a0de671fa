"""Intermediate tables of operators that run in passes."""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pitchside-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def written(frame: DataFrame, tag: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: what comes after does not run what came before, even if executors are lost."""
    path = f"{shared_folder(frame.sparkSession)}/{tag}-{uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
