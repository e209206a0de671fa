"""Goals by period as dense running scores, and what they say about a contest (survey W6, W13, W15).

`periods` has game_id, period (from 1), at_home and goals. A contest's periods are few, so its rows are
gathered in one group and everything after that is array functions: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_scores(periods: DataFrame, regular: int = 4) -> DataFrame:
    """One row per contest and period from 0 (nothing scored) to the last; periods without goals are filled in.

    There are always the regular periods. Rows without a period or below 1 are left out.
    """
    rows = periods.filter("period >= 1").groupBy("game_id").agg(
        F.collect_list(F.struct("period", "at_home", F.coalesce("goals", F.lit(0)).cast("long").alias("goals"))).alias("rows"), F.max("period").cast("int").alias("last")
    )

    def upto(p: Column, home: bool) -> Column:
        mine = F.filter("rows", lambda x: (x.period <= p) & (x.at_home == F.lit(home)))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x.goals)

    grid = F.sequence(F.lit(0), F.greatest(F.lit(regular), F.col("last")))
    return rows.select("game_id", F.inline(F.transform(grid, lambda p: F.struct(p.alias("period"), upto(p, True).alias("home"), upto(p, False).alias("away")))))


def largest_leads(scores: DataFrame) -> DataFrame:
    """Final score and the largest lead at a period's end; the first such period counts."""
    lead = F.abs(F.col("home") - F.col("away"))
    best = F.max(F.struct(lead.alias("lead"), (-F.col("period")).alias("p")))
    return scores.groupBy("game_id").agg(F.max("home").alias("home"), F.max("away").alias("away"), best.alias("b")).select("game_id", "home", "away", F.col("b.lead").alias("lead"), (-F.col("b.p")).alias("lead_period"))
