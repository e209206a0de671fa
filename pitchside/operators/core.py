"""Building blocks that the analytic operators share. All are column or frame rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_sided(games: DataFrame) -> DataFrame:
    """Each contest as two rows, one from each side's view, in a single pass over the input.

    A null score stays null on both sides, so that outcome columns skip it.
    """
    shared = ["game_date", "season", "postponed", "provenance"]

    def side(me: str, other: str, home: bool) -> Column:
        return F.struct(
            F.col(f"{me}_id").alias("team_id"), F.col(f"{other}_id").alias("opponent_id"), F.col(f"{me}_score").alias("gf"), F.col(f"{other}_score").alias("ga"), F.lit(home).alias("at_home")
        )

    return games.select(*shared, F.inline(F.array(side("home", "away", True), side("away", "home", False))))


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows by hash of the keys over at least all cores, before what costs far more than reading them: small files have few splits, and small shuffles are joined into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def once(rows: DataFrame) -> DataFrame:
    """The rows as they are; but what follows reads their columns, where the planner would make them again for a filter or put the filter before a distinct."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def counted(condition: Column) -> Column:
    """How many rows fulfil the condition (null counts as no)."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def total(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0)).cast("long")


def half_up(value: Column, places: int) -> Column:
    """Rounds .5 upward also below zero."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / scale


def safe_div(a: Column, b: Column) -> Column:
    """Zero where the quotient does not exist."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The pair in a fixed order; null if either side is."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def ranked(frame: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each group: the first in the given total order."""
    return ranked(frame, keys, order, "_rn").filter("_rn = 1").drop("_rn")


def with_mid_rank(frame: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Adds the mid-rank percentile within the group: 0.5 for a group of one, null for a null value.

    Half of (rows below plus rows at or below) over the number of rows, which differs from both
    percent_rank and cume_dist on ties. Rows are counted by value first, on the map side, so that the
    windows run over distinct values alone and a group of very many rows is no task of its own.
    """
    valued = frame.withColumn("_v", value)
    counts = valued.filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto, every = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), F.sum("_n").over(group)
    ranks = counts.withColumns({"_upto": upto, "_all": every}).select(*keys, "_v", F.when(F.col("_all") <= 1, 0.5).otherwise((2 * F.col("_upto") - F.col("_n")) / 2.0 / F.col("_all")).alias(name))
    return valued.join(ranks, [*keys, "_v"], "left").drop("_v")
