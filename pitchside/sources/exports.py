"""Exports that are judged by what was counted while they were written (survey S27)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """The least bytes, rows and files of an export; with `by` its files are folders, one for each value of that column."""

    name: str
    min_bytes: int = 1
    min_rows: int = 1
    min_files: int = 1
    by: str | None = None


def export(rows: DataFrame, path: str, bounds: Bounds) -> dict:
    """Writes JSON lines and returns (name, rows, bytes, files, verdict): ok, missing, too small, too few rows or too few files.

    Rows are counted by the write itself, bytes and files are those of the folder's listing; nothing is read again.
    """
    seen = Observation(bounds.name)
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.partitionBy(bounds.by) if bounds.by else writer).json(path)
    found = listing(rows.sparkSession, path, bounds.by)
    return {"name": bounds.name, "rows": seen.get["rows"], **found, "verdict": judged(found, bounds, seen.get["rows"])}


def listing(spark: SparkSession, path: str, by: str | None = None) -> dict:
    """bytes and files (or folders of a partition column) under a path; None for both if there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {"bytes": None, "files": None}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {"bytes": fs.getContentSummary(at).getLength(), "files": sum(n.startswith(f"{by}=") if by else n.startswith("part-") for n in names)}


def judged(found: dict, bounds: Bounds, rows: int | None = None) -> str:
    if found["bytes"] is None:
        return "missing"
    if found["bytes"] < bounds.min_bytes:
        return "too small"
    if rows is not None and rows < bounds.min_rows:
        return "too few rows"
    return "too few files" if found["files"] < bounds.min_files else "ok"


def validate(spark: SparkSession, checks: dict[str, Bounds]) -> list[tuple[str, str]]:
    """(name, verdict) of exports that stand somewhere already."""
    return [(b.name, judged(listing(spark, path, b.by), b)) for path, b in checks.items()]
