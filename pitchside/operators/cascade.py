"""Merges of people and teams that reach every table which refers to them (survey D6, D8, J11).

A merge is a mapping (old, new). Chains are followed to their end first, then each table is
re-keyed once. Where re-keyed rows collide on a unique key, the row that was there before wins, else
the smallest id; who refers to a row that goes is redirected (people) or goes with it (contests).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.core import first_per
from pitchside.sources.scratch import written


def chains(mapping: DataFrame) -> DataFrame:
    """(old, new): every old id with the end of its chain; ids in or before a circle are left out.

    Each pass doubles the length of what is followed (pointer jumping), so a chain of n links takes
    about log2(n) passes. Of several targets of one id the smallest counts; an id onto itself is none.
    """
    now = written(mapping.filter("old <> new").groupBy("old").agg(F.min("new").alias("new")), "merges")
    links, passes = now.count(), 0
    while True:
        onward = now.select(F.col("old").alias("new"), F.col("new").alias("next"))
        open_ = now.join(onward.select("new"), "new", "left_semi")
        if open_.isEmpty():
            return now
        if 1 << passes > links:  # longer than any chain: a circle
            return now.join(open_.select("old"), "old", "left_anti")
        now = written(now.join(onward, "new", "left").select("old", F.coalesce("next", "new").alias("new")), "merges")
        passes += 1


def rekeyed(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with old ids in `columns` replaced, and `_moved`: whether one was."""
    out = rows.withColumn("_moved", F.lit(False))
    for c in columns:
        out = out.join(mapping.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left")
        out = out.withColumns({c: F.coalesce("_new", c), "_moved": F.col("_moved") | F.col("_new").isNotNull()}).drop("_new")
    return out.select(*rows.columns, "_moved")


def collapsed(moved: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """Of moved rows that collide on `unique` the one that stays; rows that nothing has moved all stay."""
    mark = moved.withColumns({"_still": F.max(~F.col("_moved")).over(Window.partitionBy(*unique)), "_rn": F.row_number().over(Window.partitionBy(*unique).orderBy("_moved", *order))})
    return mark.filter(~F.col("_moved") | (~F.col("_still") & (F.col("_rn") == 1))).drop("_moved", "_still", "_rn")


def keep_rule(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """(old, new) for pairs (left_id, right_id) of people: who has more stat rows stays, of equals the smaller id; of an id's several targets the best."""
    n = stats.groupBy(F.col("player_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    sides = [F.col("left_id"), F.col("right_id")]
    for side in ("left", "right"):
        pairs = pairs.join(n.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n")), f"{side}_id", "left")
    left_n, right_n = (F.coalesce(f"{s}_n", F.lit(0)) for s in ("left", "right"))
    left_stays = (left_n > right_n) | ((left_n == right_n) & (sides[0] < sides[1]))
    to = F.struct(F.when(left_stays, left_n).otherwise(right_n).alias("n"), (-F.when(left_stays, sides[0]).otherwise(sides[1])).alias("minus"))
    chosen = pairs.filter("left_id <> right_id").select(F.when(left_stays, sides[1]).otherwise(sides[0]).alias("old"), to.alias("to"))
    return chosen.groupBy("old").agg((-F.max("to").getField("minus")).alias("new"))


@dataclass
class MergedPeople:
    people: DataFrame
    stats: DataFrame
    aliases: DataFrame


def merge_people(people: DataFrame, stats: DataFrame, aliases: DataFrame, mapping: DataFrame, source: str = "dedup", confidence: float = 1.0) -> MergedPeople:
    """people (player_id, name, ...), stats (game_id, player_id, ...) and aliases (alias, player_id, source, confidence) after the merges (old, new).

    Stat rows move unless their contest has one of the kept person; aliases move likewise; each dropped
    person's name becomes an alias. Merges of unknown people do nothing.
    """
    known = people.select("player_id")
    real = mapping.join(known.withColumnRenamed("player_id", "old"), "old", "left_semi").join(known.withColumnRenamed("player_id", "new"), "new", "left_semi")
    ends = written(chains(real), "merged-people")
    dropped = ends.withColumnRenamed("old", "player_id")
    tags = stats.withColumn("_was", F.col("player_id"))
    moved_stats = collapsed(rekeyed(tags, ends, ["player_id"]), ["game_id", "player_id"], ["_was"]).drop("_was")
    moved_aliases = collapsed(rekeyed(aliases, ends, ["player_id"]), ["alias", "player_id"], ["source"])
    names = people.join(dropped, "player_id").select(F.col("name").alias("alias"), F.col("new").alias("player_id")).distinct()
    fresh = names.join(moved_aliases, ["alias", "player_id"], "left_anti").select("alias", "player_id", F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    return MergedPeople(people.join(dropped, "player_id", "left_anti"), moved_stats, moved_aliases.unionByName(fresh))


@dataclass
class League:
    """The tables that refer to teams.

    teams (team_id), people (player_id, team_id, name_key), games (game_id, game_date, home_id, away_id), periods (game_id, team_id,
    period), stats (game_id, player_id), rankings (week, source, team_id), aliases (alias, team_id); each with more columns of its own.
    """

    teams: DataFrame
    people: DataFrame
    games: DataFrame
    periods: DataFrame
    stats: DataFrame
    rankings: DataFrame
    aliases: DataFrame


def merge_teams(league: League, mapping: DataFrame) -> tuple[League, DataFrame]:
    """The tables after team merges (old, new), and (table, gone): rows that gave way to one with their unique key.

    People of one name in the merged team become one: theirs of the kept team, whose stat rows win. A contest that
    becomes a copy goes with its periods and stat rows. Merges of unknown teams do nothing.
    """
    known = league.teams.select("team_id")
    real = mapping.join(known.withColumnRenamed("team_id", "old"), "old", "left_semi").join(known.withColumnRenamed("team_id", "new"), "new", "left_semi")
    ends = written(chains(real), "merged-teams")
    # people: those that collide hand their stat rows to who stays
    moved = rekeyed(league.people, ends, ["team_id"])
    stays = written(collapsed(moved, ["team_id", "name_key"], ["player_id"]), "people")
    in_place = first_per(stays.select("team_id", "name_key", F.col("player_id").alias("new")), ["team_id", "name_key"], [F.col("new")])
    gone_people = moved.join(stays.select("player_id"), "player_id", "left_anti").join(in_place, ["team_id", "name_key"]).select(F.col("player_id").alias("old"), "new")
    gone_people = written(gone_people, "gone-people")
    # contests: copies go, and with them what belongs to them
    games = written(collapsed(rekeyed(league.games, ends, ["home_id", "away_id"]), ["game_date", "home_id", "away_id"], ["game_id"]), "games")
    gone_games = written(league.games.select("game_id").join(games.select("game_id"), "game_id", "left_anti"), "gone-games")
    of_kept = lambda rows: rows.join(gone_games, "game_id", "left_anti")
    tagged = of_kept(league.stats).withColumn("_was", F.col("player_id"))
    stats = collapsed(rekeyed(tagged, gone_people, ["player_id"]), ["game_id", "player_id"], ["_was"]).drop("_was")
    tagged = of_kept(league.periods).withColumn("_was", F.col("team_id"))
    periods = collapsed(rekeyed(tagged, ends, ["team_id"]), ["game_id", "team_id", "period"], ["_was"]).drop("_was")
    out = [league.teams.join(ends.withColumnRenamed("old", "team_id"), "team_id", "left_anti"), stays, games, periods, stats]
    for rows, key in ((league.rankings, ["week", "source", "team_id"]), (league.aliases, ["alias", "team_id"])):
        tagged = rows.withColumn("_was", F.col("team_id"))
        out.append(collapsed(rekeyed(tagged, ends, ["team_id"]), key, ["_was"]).drop("_was"))
    after = League(*out)
    lost = lambda name: getattr(league, name).agg(F.count(F.lit(1)).alias("n")).join(getattr(after, name).agg(F.count(F.lit(1)).alias("m"))).select(F.lit(name).alias("table"), (F.col("n") - F.col("m")).alias("gone"))
    report = lost("people")
    for name in ("teams", "games", "periods", "stats", "rankings", "aliases"):
        report = report.unionByName(lost(name))
    return after, report
