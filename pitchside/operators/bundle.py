"""What the front page shows, composed of the operators of its parts (survey A38)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.operators.core import two_sided
from pitchside.operators.leaderboards import player_leaders
from pitchside.operators.player_analytics import streaks
from pitchside.operators.team_analytics import team_totals


def bundle_teams(games: DataFrame, teams: DataFrame, official: DataFrame, season: int) -> DataFrame:
    """Every team with the season's record, goals and signed streak; official wins and losses come first.

    Teams without a contest have zeros and no streak. `official` has a unique team_id, wins and losses.
    """
    rows = games.filter(F.col("season") == season)
    totals = team_totals(rows).select("team_id", F.col("wins").alias("_w"), F.col("losses").alias("_l"), "goals_for", "goals_against")
    outcome = F.when(~F.col("postponed"), F.signum(F.col("gf") - F.col("ga")).cast("int"))
    streak = streaks(two_sided(rows), "team_id", [F.desc("game_date"), F.desc("_o")], outcome)
    wide = teams.select("team_id", "name").join(totals, "team_id", "left").join(official.select("team_id", "wins", "losses"), "team_id", "left").join(streak, "team_id", "left")
    zero = F.lit(0)
    return wide.select("team_id", "name", F.coalesce("wins", "_w", zero).alias("wins"), F.coalesce("losses", "_l", zero).alias("losses"), F.coalesce("goals_for", zero).alias("goals_for"), F.coalesce("goals_against", zero).alias("goals_against"), "streak")


def bundle_games(games: DataFrame, today: date, order: list[str], days: int = 7, limit: int = 200) -> DataFrame:
    """The newest contests from `days` ago to today, both included; `order` breaks ties within a day."""
    recent = games.filter((F.col("game_date") >= F.date_sub(F.lit(today), days)) & (F.col("game_date") <= F.lit(today)))
    return recent.orderBy(F.desc("game_date"), *order).limit(limit)


def bundle(games: DataFrame, teams: DataFrame, official: DataFrame, stats: DataFrame, season: int, today: date, order: list[str]) -> dict[str, DataFrame]:
    """The three parts: teams, games of the last days, and the first of the goal scorers with three contests."""
    top = player_leaders(stats, "goals", limit=1, min_games=3, season=season).select("player_id", "player_name", "team_id", "goals", "assists")
    return {"teams": bundle_teams(games, teams, official, season), "recent_games": bundle_games(games, today, order), "top_scorer": top}
