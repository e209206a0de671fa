"""Player totals, sparklines, streaks, milestones and momentum (survey A2, A8-A10, A13, A14, A26, W1-W3, W5, W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.core import first_per, half_up, ranked, with_mid_rank

COUNTS = ["goals", "assists", "ground_balls", "caused_turnovers", "saves", "fo_won", "fo_taken"]


def season_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("player_id", "season").agg(F.countDistinct("game_id").alias("games"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def top_scorers(stats: DataFrame, per_team: int = 3) -> DataFrame:
    """The best of each team by goals and assists, filtered on the sums."""
    sums = stats.groupBy("team_id", "player_id", "player_name").agg(F.sum("goals").alias("goals"), F.sum("assists").alias("assists")).withColumn("points", F.col("goals") + F.col("assists"))
    best = ranked(sums.filter("points > 0"), ["team_id"], [F.desc("points"), F.desc("goals"), F.lower("player_name"), F.col("player_id")])
    return best.filter(F.col("rn") <= per_team)


def constellation(stats: DataFrame, season: int | None = None) -> DataFrame:
    """Per-game rates of each player, rounded to three places with .5 going up."""
    rows = stats if season is None else stats.filter(F.col("season") == season)
    agg = rows.groupBy("player_id", "player_name", "team_id").agg(F.countDistinct("game_id").alias("games"), *[F.sum(c).alias(c) for c in COUNTS[:4]])
    return agg.filter("games > 0").withColumns({f"{c}_pg": half_up(F.col(c) / F.col("games"), 3) for c in COUNTS[:4]})


def sparklines(stats: DataFrame, metric: str = "goals", top: int = 10) -> DataFrame:
    """Values by game, in order, of the players with the largest sums; rows of contests that are `postponed` count in neither."""
    stats = stats.filter(~F.coalesce("postponed", F.lit(False)))
    best = stats.groupBy("player_id").agg(F.sum(metric).alias("total")).orderBy(F.desc("total"), "player_id").limit(top)
    rows = stats.join(F.broadcast(best), "player_id")  # at most `top` rows
    series = F.sort_array(F.collect_list(F.struct("game_date", "game_id", F.col(metric).alias("v"))))
    return rows.groupBy("player_id", "total").agg(F.transform(series, lambda x: x["v"]).alias("series"))


def streaks(frame: DataFrame, key: str, order: list[Column], outcome: Column, last: int = 10) -> DataFrame:
    """Signed current streak over the last outcomes of each key; outcome is 1, -1 or 0, null rows are skipped.

    0 stands for a tie as the latest outcome; a key without outcomes has no row. The streak is at
    most `last` long.
    """
    recent = ranked(frame.withColumn("_o", outcome).filter("_o IS NOT NULL"), [key], order, "_n").filter(F.col("_n") <= last)
    latest = recent.withColumn("_first", F.first("_o").over(Window.partitionBy(key).orderBy("_n")))
    runs = latest.groupBy(key, "_first").agg(F.coalesce(F.min(F.when(F.col("_o") != F.col("_first"), F.col("_n"))) - 1, F.max("_n")).alias("_len"))
    return runs.select(key, (F.col("_first") * F.col("_len")).cast("long").alias("streak"))


def momentum(frame: DataFrame, key: str, order: list[Column], step: Column) -> DataFrame:
    return frame.withColumn("momentum", F.sum(step).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def milestones(stats: DataFrame) -> DataFrame:
    """Each player's best game by goals, assists and points, also where that is zero; of equal ones the latest."""
    long = stats.select("player_id", "game_id", "game_date", F.expr("stack(3, 'goals', goals, 'assists', assists, 'points', goals + assists) AS (stat, value)"))
    return first_per(long, ["player_id", "stat"], [F.desc("value"), F.desc("game_date"), F.desc("game_id")])


def concentration(stats: DataFrame, share: float = 0.6, least: int = 10) -> DataFrame:
    """Players whose best game holds more than a share of their season's goals."""
    w = Window.partitionBy("player_id", "season")
    rows = ranked(stats.withColumn("total", F.sum("goals").over(w)), ["player_id", "season"], [F.desc("goals"), F.desc("game_id")])
    return rows.filter((F.col("rn") == 1) & (F.col("total") >= least) & (F.col("goals") / F.col("total") > share)).select("player_id", "season", "game_id", "goals", "total")


def percentiles(frame: DataFrame, key: str, value: str) -> DataFrame:
    return with_mid_rank(frame, [key], F.col(value), "pct")


#: What two players are compared by, in order: five sums, points, and three rates by game.
CATEGORIES = ["goals", "assists", "points", "ground_balls", "caused_turnovers", "saves", "points_per_game", "goals_per_game", "assists_per_game"]


def compare_players(stats: DataFrame, a: int, b: int, leads: int = 3) -> DataFrame:
    """Category by category: both values, who leads and by how much; `lead` ranks a leader's categories by that, the first few only.

    Rates have two places, .5 going up. A player without games has zeros.
    """
    sums = stats.filter(F.col("player_id").isin(a, b)).groupBy("player_id").agg(F.count(F.lit(1)).alias("games"), *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in COUNTS[:5]]).withColumn("points", F.col("goals") + F.col("assists"))
    rates = {f"{c}_per_game": half_up(F.col(c) / F.col("games"), 2) for c in ("points", "goals", "assists")}
    long = sums.withColumns(rates).select("player_id", F.posexplode(F.array(*CATEGORIES)).alias("at", "value"))
    of = lambda p: F.coalesce(F.max(F.when(F.col("player_id") == p, F.col("value"))), F.lit(0.0))
    both = long.groupBy("at").agg(of(a).alias("a"), of(b).alias("b"))
    leader = F.when(F.col("a") > F.col("b"), "a").when(F.col("a") < F.col("b"), "b").otherwise("tie")
    names = F.get(F.array(*map(F.lit, CATEGORIES)), F.col("at"))
    rows = both.select("at", names.alias("category"), "a", "b", leader.alias("leader"), F.abs(F.col("a") - F.col("b")).alias("diff"))
    ranked_rows = ranked(rows, ["leader"], [F.desc(F.round("diff", 9)), F.col("at")])  # nine rows
    return ranked_rows.withColumn("lead", F.when((F.col("leader") != "tie") & (F.col("rn") <= leads), F.col("rn"))).drop("rn", "at")
