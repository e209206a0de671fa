"""Incremental ingest of landed files: a file-source stream that upserts each micro-batch.

The checkpoint is the ingest log. A batch that is delivered twice changes nothing, since the merge
is keyed and the table is swapped in as a whole. With a bucketed target a batch rewrites only the buckets
of its keys, else the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pitchside.operators.merge import Policy, upsert
from pitchside.sources.buckets import BucketedTable
from pitchside.sources.tables import VersionedTable


def ingest_files(
    spark: SparkSession, landed: str, schema: StructType, fmt: str, target: VersionedTable | BucketedTable, keys: list[str], order: list[Column], checkpoint: str, parse: Callable[[DataFrame], DataFrame] | None = None, policies: dict[str, Policy] | None = None
) -> StreamingQuery:
    """Runs over all files that are there and stops (availableNow)."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = parse(batch) if parse else batch
        if isinstance(target, BucketedTable):
            target.merge(rows, order, policies)
            return
        target.write(upsert(target.read(rows.schema), rows, keys, order, policies))

    return spark.readStream.format(fmt).schema(schema).load(landed).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
