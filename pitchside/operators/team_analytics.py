"""Records, head-to-head, rivalries, calendars and margins over contests (survey A7, A11-A16, A25, A34, J12, W9, W12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.core import counted, two_sided, unordered


def team_totals(games: DataFrame, postponed_policy: str = "scores_count") -> DataFrame:
    """games, W, L, T, goals for and against by team.

    postponed_policy: "scores_count" counts postponed contests in games and goals but not in
    W/L/T; "ignore" leaves them out of everything.
    """
    sides = two_sided(games)
    if postponed_policy == "ignore":
        sides = sides.filter(~F.col("postponed"))
    decided = ~F.col("postponed")
    return sides.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("games"),
        counted(decided & (F.col("gf") > F.col("ga"))).alias("wins"),
        counted(decided & (F.col("gf") < F.col("ga"))).alias("losses"),
        counted(decided & (F.col("gf") == F.col("ga"))).alias("ties"),
        F.coalesce(F.sum("gf"), F.lit(0)).alias("goals_for"),
        F.coalesce(F.sum("ga"), F.lit(0)).alias("goals_against"),
    )


def record_text(wins: Column, losses: Column, ties: Column) -> Column:
    """W-L, or W-L-T with ties."""
    return F.when(ties > 0, F.concat_ws("-", wins, losses, ties)).otherwise(F.concat_ws("-", wins, losses))


def rivalry_edges(games: DataFrame) -> DataFrame:
    """One row per unordered pair with its contests, margin sum and mean; grouped by the pair alone."""
    low, high = unordered(F.col("home_id"), F.col("away_id"))
    played = games.filter(~F.col("postponed") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & (F.col("home_id") != F.col("away_id")))
    margin = F.abs(F.col("home_score") - F.col("away_score"))
    return played.groupBy(low.alias("team_a"), high.alias("team_b")).agg(F.count(F.lit(1)).alias("games"), F.sum(margin).alias("margin_sum"), F.avg(margin).alias("mean_margin"))


def rivalry_nodes(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams with at least one contest."""
    return team_totals(games, "ignore").filter("games > 0").join(teams.select("team_id", "name"), "team_id").select("team_id", "name", "games", "wins", "losses", "ties")


def meetings(games: DataFrame, a: int, b: int) -> DataFrame:
    """Contests between two teams from the view of the first."""
    mine = two_sided(games).filter((F.col("team_id") == a) & (F.col("opponent_id") == b) & ~F.col("postponed"))
    result = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") < F.col("ga"), "L").otherwise("T")
    return mine.select("game_date", "gf", "ga", "at_home", result.alias("result"))


def head_to_head(games: DataFrame, a: int, b: int) -> DataFrame:
    """Overall records of both teams and their record against each other."""
    return team_totals(games, "ignore").filter(F.col("team_id").isin(a, b)).join(
        two_sided(games).filter(~F.col("postponed") & F.col("team_id").isin(a, b) & F.col("opponent_id").isin(a, b) & (F.col("team_id") != F.col("opponent_id")))
        .groupBy("team_id").agg(counted(F.col("gf") > F.col("ga")).alias("pair_wins"), counted(F.col("gf") < F.col("ga")).alias("pair_losses"), counted(F.col("gf") == F.col("ga")).alias("pair_ties")),
        "team_id", "left",
    )


def common_opponents(games: DataFrame, a: int, b: int) -> DataFrame:
    """Opponents of both teams other than the two."""
    sides = two_sided(games).filter(~F.col("postponed"))
    of = lambda t: sides.filter(F.col("team_id") == t).select("opponent_id")
    return of(a).intersect(of(b)).filter(~F.col("opponent_id").isin(a, b))


def calendar(games: DataFrame) -> DataFrame:
    return games.groupBy("game_date").agg(F.count(F.lit(1)).alias("games"))


def calendar_grid(games: DataFrame) -> DataFrame:
    """Every day from the Monday before the first to the Sunday after the last contest, with a colour bin: none, 1-2, 3-4, more."""
    days = calendar(games)
    span = days.agg(F.trunc(F.min("game_date"), "week").alias("lo"), F.date_add(F.trunc(F.max("game_date"), "week"), 6).alias("hi")).filter("lo IS NOT NULL")
    grid = span.select(F.explode(F.sequence("lo", "hi")).alias("game_date"))
    n = F.coalesce("games", F.lit(0))
    return grid.join(days, "game_date", "left").select("game_date", n.alias("games"), F.when(n == 0, 0).when(n <= 2, 1).when(n <= 4, 2).otherwise(3).alias("bin"))


def seasons(games: DataFrame) -> DataFrame:
    return games.groupBy("season").agg(F.count(F.lit(1)).alias("games")).withColumn("newest", F.col("season") == F.max("season").over(Window.partitionBy()))


def margin_buckets(games: DataFrame) -> DataFrame:
    """Wins by margin: 1-3, 4-6, 7-10, 11-15, 16+. A margin of zero has no bucket."""
    m = F.abs(F.col("home_score") - F.col("away_score"))
    label = F.when(m <= 3, "1-3").when(m <= 6, "4-6").when(m <= 10, "7-10").when(m <= 15, "11-15").otherwise("16+")
    return games.filter(~F.col("postponed") & (m > 0)).groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("games"))


def outliers(frame: DataFrame, key: str, value: str, k: float = 3.0, floor: float = 8.0) -> DataFrame:
    """Rows whose value exceeds both the floor and mean + k sample deviations of its group of three or more.

    A value at the bound is not above it, whichever way the deviation's last digits fell.
    """
    w = Window.partitionBy(key)
    x = F.col(value)
    flagged = frame.withColumns({"_n": F.count(x).over(w), "_hi": F.avg(x).over(w) + k * F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))})
    above = x - F.col("_hi") > 1e-12 * F.greatest(F.abs("_hi"), F.lit(1.0))
    return flagged.filter((F.col("_n") >= 3) & above & (x > floor)).drop("_n", "_hi")
