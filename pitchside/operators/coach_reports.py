"""Reports for coaches, for all teams at once (survey A21-A24).

`points` is one row per team and contest: team_id, game_id, game_date, goals, goals_against, assists,
ground_balls, saves, fo_won, fo_taken. Null counts are zero. Recency is by date, then by game_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.core import ranked

COUNTS = ("goals", "goals_against", "assists", "ground_balls", "saves", "fo_won", "fo_taken")

#: Area, reason and priority of each rule.
RULES = {
    "faceoffs": ("Faceoffs", "Faceoff win rate is below 50 percent over the last 5 games.", "high"),
    "ground_balls": ("Ground Balls", "Ground balls per game are down over the last 3 games versus the previous sample.", "medium"),
    "defense": ("Defense", "Goals against are trending up in the most recent games.", "high"),
    "passing": ("Ball Movement / Passing", "Assists per game are below 3 over the last 5 games.", "medium"),
    "goalie": ("Goalie Training", "Save percentage is below 50 percent over the last 5 games.", "high"),
}


def trend_points(points: DataFrame, n: int = 10) -> DataFrame:
    """The latest n contests of each team, numbered from the latest (rn)."""
    known = points.select("team_id", "game_id", "game_date", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])
    return ranked(known, ["team_id"], [F.desc_nulls_last("game_date"), F.desc_nulls_last("game_id")]).filter(F.col("rn") <= n)


def scouting(points: DataFrame, n: int = 5) -> DataFrame:
    """Number of contests, mean goals for and against and differential over the latest n."""
    return trend_points(points, n).groupBy("team_id").agg(
        F.count(F.lit(1)).alias("games"), F.avg("goals").alias("goals_for"), F.avg("goals_against").alias("goals_against"), F.sum(F.col("goals") - F.col("goals_against")).alias("differential")
    )


def practice_focus(points: DataFrame) -> DataFrame:
    """What to practise: one row for each rule that a team's latest ten contests meet.

    Trends compare the latest three with the up to seven before, and need both.
    """
    rn = F.col("rn")

    def over(name: str, where: Column, how=F.sum) -> Column:
        return how(F.when(where, F.col(name)))

    last5, last3, before = rn <= 5, rn <= 3, rn > 3
    won, taken, saves, against = (over(c, last5) for c in ("fo_won", "fo_taken", "saves", "goals_against"))
    met = {
        "faceoffs": (taken > 0) & (2 * won < taken),
        "ground_balls": over("ground_balls", last3, F.avg) < over("ground_balls", before, F.avg),
        "defense": over("goals_against", last3, F.avg) > over("goals_against", before, F.avg),
        "passing": over("assists", last5, F.avg) < 3,
        "goalie": (saves + against > 0) & (2 * saves < saves + against),
    }
    flags = trend_points(points).groupBy("team_id").agg(*[c.alias(name) for name, c in met.items()])
    found = F.array(*[F.when(F.col(k), F.struct(*[F.lit(x).alias(n) for n, x in zip(("area", "reason", "priority"), RULES[k])])) for k in met])
    return flags.select("team_id", F.inline(F.array_compact(found)))


def stat_coverage(games: DataFrame, stats: DataFrame) -> DataFrame:
    """By team: contests, contests with any stat row, and the latest stat row's time.

    games: team_id, game_id; stats: game_id, updated_at. Stats are reduced to one row for each contest before the join.
    """
    seen = stats.groupBy("game_id").agg(F.max("updated_at").alias("latest"), F.lit(True).alias("seen"))
    return games.join(seen, "game_id", "left").groupBy("team_id").agg(
        F.count_distinct("game_id").alias("games"), F.count_distinct(F.when(F.col("seen"), F.col("game_id"))).alias("with_stats"), F.max("latest").alias("last_update")
    )


def games_without_stats(games: DataFrame, stats: DataFrame) -> DataFrame:
    return games.join(stats.select("game_id"), "game_id", "left_anti")
