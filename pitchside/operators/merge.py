"""Keyed upserts as full outer joins with one policy for each column (survey M1-M7), and mapping merges (D6-D8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.core import first_per

Policy = Callable[[Column, Column], Column]
NEW: Policy = lambda old, new: new
OLD: Policy = lambda old, new: old
KEEP: Policy = lambda old, new: F.coalesce(old, new)
REPLACE_IF_GIVEN: Policy = lambda old, new: F.coalesce(new, old)
LONGEST: Policy = lambda old, new: F.when(F.length(new) > F.length(old), new).otherwise(F.coalesce(old, new))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column], policies: dict[str, Policy] | None = None, default: Policy = NEW) -> DataFrame:
    """target after batch. Rows of the batch with one key are reduced to the first in `order`.

    A policy decides for keys on both sides; rows on one side only are taken as they are.
    """
    policies = policies or {}
    new = first_per(batch, keys, order).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in target.columns if c not in keys], F.lit(True).alias("_in"))
    both = target.withColumn("_was", F.lit(True)).join(new, keys, "full_outer")

    def value(c: str) -> Column:
        old, fresh = F.col(c), F.col(f"_new_{c}")
        return F.when(F.col("_was").isNull(), fresh).when(F.col("_in").isNull(), old).otherwise(policies.get(c, default)(old, fresh)).alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in target.columns])


def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-ignore."""
    return target.unionByName(first_per(batch, keys, order).join(target, keys, "left_anti").select(*target.columns))


def replace_partition(target: DataFrame, batch: DataFrame, partition: list[str]) -> DataFrame:
    """Rows of the partitions that the batch has give way to the batch."""
    return target.join(batch.select(*partition).distinct(), partition, "left_anti").unionByName(batch)


def redirect(rows: DataFrame, mapping: DataFrame, column: str, unique: list[str], order: list[Column]) -> DataFrame:
    """Re-keys rows by mapping (old, new) and drops what then collides on `unique`; rows that were there stay."""
    moved = rows.join(mapping, rows[column] == mapping["old"], "left").withColumn("_moved", F.col("new").isNotNull()).withColumn(column, F.coalesce("new", column)).drop("old", "new")
    return first_per(moved, unique, [F.col("_moved"), *order]).drop("_moved")
