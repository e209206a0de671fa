"""A table as numbered Parquet versions with a pointer, so that a rewrite is atomic and readers never see half of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were written to the end, in order."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def read(self, schema: StructType | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            if schema is None:
                raise ValueError(f"{self.path} has no version and no schema was given")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}")

    def write(self, rows: DataFrame, keep: int = 2) -> int:
        """Writes the next version and removes all but the newest ones."""
        found = self.versions()
        new = found[-1] + 1 if found else 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        for old in found[: max(0, len(found) + 1 - keep)]:
            self._fs.delete(self._at(f"{self.path}/v{old}"), True)
        return new
