"""Teams and their official records, by name or alias (survey J5-J7, A5, A6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.operators.core import counted, two_sided
from pitchside.operators.team_analytics import record_text


def official_candidates(teams: DataFrame, aliases: DataFrame, official: DataFrame) -> DataFrame:
    """Every official row (official_id, key, ...) of each team: its key is the team's name in lower case or one of its aliases as it stands.

    The two ways are one equi-join on (team, key) pairs without repetition, so that no pair is made by an OR.
    """
    keys = teams.select("team_id", F.lower("name").alias("key")).unionByName(aliases.select("team_id", F.col("alias").alias("key"))).distinct()
    return keys.join(official, "key").join(teams.select("team_id"), "team_id", "left_semi")


def official_of(teams: DataFrame, aliases: DataFrame, official: DataFrame, by_ranking: bool = False) -> DataFrame:
    """One official row of each team that has any: that with the smallest id, or with the highest ranking (then the smallest id)."""
    met = official_candidates(teams, aliases, official)
    columns = [c for c in met.columns if c != "team_id"]
    order = F.struct(F.coalesce("ranking", F.lit(float("-inf"))), -F.col("official_id")) if by_ranking else -F.col("official_id")
    return met.groupBy("team_id").agg(F.max_by(F.struct(*columns), order).alias("o")).select("team_id", "o.*")


def derived_records(games: DataFrame) -> DataFrame:
    """team_id, games (all of them) and wins, losses and ties of those that weren't postponed; a null score is no result."""
    sides = two_sided(games).withColumn("_played", ~F.coalesce("postponed", F.lit(False)))
    won, lost, tied = (counted(F.col("_played") & c) for c in (F.col("gf") > F.col("ga"), F.col("gf") < F.col("ga"), F.col("gf") == F.col("ga")))
    return sides.groupBy("team_id").agg(F.count(F.lit(1)).alias("games"), won.alias("wins"), lost.alias("losses"), tied.alias("ties"))


def listed_teams(teams: DataFrame, games: DataFrame, people: DataFrame, aliases: DataFrame, official: DataFrame) -> DataFrame:
    """team_id, name, games, derived and official counts, record, source and coverage of each team that is no ghost.

    A team is shown if it has a contest, a person or an official row. record: the official one, else the derived one, with
    source saying which. coverage: contests that we have for each one of the official record; null without one.
    """
    derived = derived_records(games).select("team_id", "games", *[F.col(c).alias(f"derived_{c}") for c in ("wins", "losses", "ties")])
    of = official_of(teams, aliases, official).select("team_id", "official_id", *[F.col(c).alias(f"official_{c}") for c in ("wins", "losses", "ties")])
    staffed = people.select("team_id").distinct().withColumn("_people", F.lit(True))
    rows = teams.select("team_id", "name").join(derived, "team_id", "left").join(of, "team_id", "left").join(staffed, "team_id", "left")
    shown = rows.filter(F.col("games").isNotNull() | F.col("official_id").isNotNull() | F.col("_people"))
    known = F.col("official_id").isNotNull()
    pick = lambda c: F.coalesce(F.when(known, F.col(f"official_{c}")).otherwise(F.col(f"derived_{c}")), F.lit(0))
    listed = sum((F.coalesce(f"official_{c}", F.lit(0)) for c in ("losses", "ties")), F.coalesce("official_wins", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return shown.select(
        "team_id", "name", zero("games"), *[zero(f"derived_{c}") for c in ("wins", "losses", "ties")], "official_id", record_text(pick("wins"), pick("losses"), pick("ties")).alias("record"),
        F.when(known, "official").otherwise("derived").alias("source"), F.when(known & (listed > 0), F.coalesce("games", F.lit(0)) / listed).alias("coverage"),
    )
