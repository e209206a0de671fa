"""Same person or team under two spellings, and reports over them (survey A5, A6, A18, A27, A29, D4, D9, W16)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions.text import squeeze, team_key
from pitchside.operators.core import counted, ranked
from pitchside.operators.team_analytics import record_text, team_totals


def merge_plan(people: DataFrame, name_key: Column) -> DataFrame:
    """(drop_id, keep_id) of people of one team with one key: the longest name stays, of equal ones the smallest id.

    `people` has id, team_id and name. Aggregation alone: no pair of a group is formed. Rows without a key stay.
    """
    rows = people.withColumn("_key", name_key).filter("_key IS NOT NULL AND _key <> ''")
    best = rows.groupBy("team_id", "_key").agg(F.min(F.struct((-F.length("name")).alias("l"), "id")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(best, ["team_id", "_key"]).filter(F.col("id") != F.col("best.id")).select(F.col("id").alias("drop_id"), F.col("best.id").alias("keep_id"))


def surname_plan(people: DataFrame) -> DataFrame:
    """(drop_id, keep_id) of people known by their last name only, where the team has exactly one full name that ends in it."""
    words = F.split(F.lower(squeeze(F.col("name"))), " ")
    rows = people.select("id", "team_id", F.element_at(words, -1).alias("last"), F.size(words).alias("n")).filter("last <> ''")
    full = rows.filter("n > 1").groupBy("team_id", "last").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("found")).filter("found = 1")
    return rows.filter("n = 1").join(full, ["team_id", "last"]).select(F.col("id").alias("drop_id"), "keep_id")


def state_suffix_plan(teams: DataFrame, games_of: DataFrame) -> DataFrame:
    """(drop_id, keep_id, alias): teams whose name has a state in brackets, and the team of the same key without one.

    Of several bare ones that with the most contests stays, then the smallest id. `games_of` has team_id and games.
    """
    keyed = teams.select("team_id", "name", team_key(F.col("name")).alias("_key"), F.col("name").rlike(r"\([A-Za-z]{2}\)\s*$").alias("suffixed"))
    bare = keyed.filter("NOT suffixed").join(games_of, "team_id", "left")
    best = bare.groupBy("_key").agg(F.min(F.struct((-F.coalesce("games", F.lit(0))).alias("g"), "team_id")).alias("best"))
    return keyed.filter("suffixed").join(best, "_key").select(F.col("team_id").alias("drop_id"), F.col("best.team_id").alias("keep_id"), F.col("name").alias("alias"))


def team_list(games: DataFrame, teams: DataFrame, official: DataFrame) -> DataFrame:
    """Teams with contests and their record: the official one where it exists, else the derived one.

    `official` has team_id (unique), wins, losses and ties.
    """
    derived = team_totals(games, "ignore").filter("games > 0").select("team_id", "games", *[F.col(c).alias(f"_{c}") for c in ("wins", "losses", "ties")])
    rows = derived.join(teams.select("team_id", "name"), "team_id").join(official.select("team_id", "wins", "losses", "ties"), "team_id", "left")
    of = {c: F.when(F.col("wins").isNull(), F.col(f"_{c}")).otherwise(F.coalesce(c, F.lit(0))) for c in ("wins", "losses", "ties")}
    return rows.select("team_id", "name", "games", record_text(of["wins"], of["losses"], of["ties"]).alias("record"), F.col("wins").isNotNull().alias("official"))


def triage(rows: DataFrame, group: list[str], sample: str, top: int = 20, samples: int = 5) -> DataFrame:
    """The largest groups with a few samples each, smallest first; only rows of these groups are sorted."""
    best = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *group).limit(top)
    distinct = rows.join(F.broadcast(best), group).select(*group, "n", sample).distinct()  # at most `top` groups
    few = ranked(distinct.filter(F.col(sample).isNotNull()), group, [F.col(sample)]).filter(F.col("rn") <= samples)
    texts = few.groupBy(*group).agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    return best.join(texts, group, "left")


def career(stats: DataFrame, hat_trick: int = 3) -> DataFrame:
    """Totals of each player, how many games had three goals, and the best game by goals (the latest of equal ones)."""
    best = F.max(F.struct(F.coalesce("goals", F.lit(0)).alias("goals"), "game_date", "game_id"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("goals", "assists", "saves")]
    rows = stats.groupBy("player_id").agg(F.countDistinct("game_id").alias("games"), *sums, counted(F.col("goals") >= hat_trick).alias("hat_tricks"), best.alias("b"))
    return rows.select("player_id", "games", "goals", "assists", "saves", "hat_tricks", F.col("b.goals").alias("best_goals"), F.col("b.game_id").alias("best_game"))


def short_names(people: DataFrame, stats: DataFrame, longest: int = 3) -> DataFrame:
    """People whose name is suspiciously short, with their games and latest game; `people` has player_id and name."""
    sums = stats.groupBy("player_id").agg(F.countDistinct("game_id").alias("games"), F.max_by("game_id", F.struct("game_date", "game_id")).alias("latest"))
    short = people.filter(F.length(F.trim("name")) <= longest).select("player_id", "name")
    return short.join(sums, "player_id", "left").withColumn("games", F.coalesce("games", F.lit(0)))


def recent_games(games: DataFrame, today: date, days: int = 7) -> DataFrame:
    """Contests of the last days, today included, none from the future."""
    return games.filter((F.col("game_date") > F.date_sub(F.lit(today), days)) & (F.col("game_date") <= F.lit(today)))
