"""Row numbers without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.sources.scratch import written


def numbered(rows: DataFrame, order: str | Column, name: str) -> DataFrame:
    """With `name`, 0, 1, ... in the order of a unique column or expression, nulls first.

    Rows are sorted by ranges; only the row counts of the ranges reach the driver, as offsets.
    """
    key = F.col(order) if isinstance(order, str) else order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.withColumn("_order", key).repartitionByRange(parts, F.col("_order").asc_nulls_first()).withColumn("_part", F.spark_partition_id()), "ranges")
    counts, first, at = dict(placed.groupBy("_part").count().collect()), [], 0
    for part in sorted(counts):
        first.append((part, at))
        at += counts[part]
    before = rows.sparkSession.createDataFrame(first, "_part int, _first long")  # one row for each range
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_order").asc_nulls_first())) - 1
    out = placed.withColumn("_place", nth).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_first") + F.col("_place")).cast("long")).drop("_part", "_first", "_place", "_order")
