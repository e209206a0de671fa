"""Declared schemas of tables, with numbered evolutions that are applied to what older versions wrote (survey S1, S2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Add:
    """A new column; older rows have the default: a value, or a column expression over the row."""

    name: str
    type: str
    default: object = None

    def apply(self, rows: DataFrame) -> DataFrame:
        value = self.default if isinstance(self.default, Column) else F.lit(self.default)
        return rows.withColumn(self.name, value.cast(self.type))


@dataclass(frozen=True)
class Rename:
    old: str
    new: str

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed(self.old, self.new)


@dataclass(frozen=True)
class Change:
    """A new type or content of a column."""

    name: str
    change: Callable[[Column], Column]

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.name, self.change(F.col(self.name)))


@dataclass(frozen=True)
class Drop:
    name: str

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.drop(self.name)


@dataclass
class TableSchema:
    """Version 1 as DDL; version n + 1 is what the n-th list of steps makes of version n. keys: the columns that identify a row."""

    name: str
    first: str
    keys: list[str]
    steps: list[list[Add | Rename | Change | Drop]] = field(default_factory=list)

    @property
    def version(self) -> int:
        return 1 + len(self.steps)

    def upgraded(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows that `version` wrote, in today's schema. Nothing is rewritten: the steps become part of the scan's projection."""
        if not 1 <= version <= self.version:
            raise ValueError(f"{self.name}: version {version} is unknown here, the newest is {self.version}")
        for steps in self.steps[version - 1 :]:
            for step in steps:
                rows = step.apply(rows)
        return rows

    def empty(self, spark) -> DataFrame:
        return self.upgraded(spark.createDataFrame([], StructType.fromDDL(self.first)), 1)

    def checked(self, rows: DataFrame) -> DataFrame:
        """The rows with the declared columns in the declared order; an error where one lacks or has another type."""
        want = self.empty(rows.sparkSession).schema
        have = {f.name: f.dataType for f in rows.schema.fields}
        wrong = [f"{f.name}: {have.get(f.name, 'missing')} for {f.dataType}" for f in want.fields if have.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"{self.name} doesn't have the declared columns: {'; '.join(wrong)}")
        return rows.select(*want.names)
