"""A keyed table in buckets, of which a merge only rewrites those that its batch touches (survey §2.12).

A row's bucket is the hash of its key. Each merge writes the touched buckets in one go and swaps a manifest, which
names the folder of every bucket, so that readers see a merge whole or not at all.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitchside.operators.merge import Policy, upsert
from pitchside.sources.scratch import written
from pitchside.sources.table_set import TableSet


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.set = TableSet(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, names: list[str], manifest: dict) -> DataFrame:
        found = [f"{self.set.path}/{manifest[n]['path']}" for n in names if n in manifest]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def read(self, _: StructType | None = None) -> DataFrame:
        manifest = self.set.manifest()
        return self._rows(sorted(manifest), manifest)

    def merge(self, batch: DataFrame, order: list[Column], policies: dict[str, Policy] | None = None) -> list[int]:
        """Upserts the batch; the buckets that were rewritten. Merging a batch twice changes nothing the second time."""
        base = self.set.version()
        manifest = self.set.manifest(base)
        batch = written(batch.withColumn("_bucket", self._bucket()), "batch")
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return []
        old = self._rows([f"{b:05d}" for b in touched], manifest)
        merged = upsert(old, batch.drop("_bucket"), self.keys, order, policies)
        folder = f"merged/{uuid4().hex}"
        merged.select(*self.schema.names).withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.set.path}/{folder}")
        self.set.publish({f"{b:05d}": {"path": f"{folder}/_bucket={b}", "schema": 1} for b in touched}, base)
        return touched
