"""League standings, streak texts, podium, radar axes and closing runs (survey A31, W4, W8, W15, L6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.core import counted, safe_div, two_sided, with_mid_rank
from pitchside.operators.team_analytics import team_totals


def played_sides(games: DataFrame) -> DataFrame:
    """Both sides of every contest with a goal, with the outcome as 1, 0 or -1; 0-0 and null scores stand for unplayed."""
    return two_sided(games).filter("gf > 0 OR ga > 0").withColumn("outcome", F.signum(F.col("gf") - F.col("ga")).cast("int"))


def standings(games: DataFrame) -> DataFrame:
    """Games, results and goals by team over the contests that were played."""
    won, lost, tied = (counted(F.col("outcome") == x) for x in (1, -1, 0))
    return played_sides(games).groupBy("team_id").agg(F.count(F.lit(1)).alias("games"), won.alias("wins"), lost.alias("losses"), tied.alias("ties"), F.sum("gf").alias("pf"), F.sum("ga").alias("pa"))


def streak_texts(games: DataFrame, teams: DataFrame) -> DataFrame:
    """W3, L2 or T1 by team, W0 without a contest; contests of one day are in order of their outcome.

    Without a window: the streak is what comes after a team's last contest of another outcome, which
    combines on the map side whatever share of the contests one team has.
    """
    place = F.struct("game_date", "outcome")
    sides = played_sides(games)
    last = sides.groupBy("team_id", "outcome").agg(F.max(place).alias("at")).groupBy("team_id").agg(F.sort_array(F.collect_list("at"), asc=False).alias("at"))  # three entries at most
    ends = last.select("team_id", F.col("at")[0]["outcome"].alias("latest"), F.get("at", F.lit(1)).alias("before"))
    runs = sides.join(ends, "team_id").filter(F.col("before").isNull() | (place > F.col("before"))).groupBy("team_id", "latest").agg(F.count(F.lit(1)).alias("n"))
    letter = F.when(F.col("latest") == 1, "W").when(F.col("latest") == -1, "L").otherwise("T")
    return teams.select("team_id").join(runs, "team_id", "left").select("team_id", F.when(F.col("n").isNull(), "W0").otherwise(F.concat(letter, F.col("n").cast("string"))).alias("streak"))


def podium(games: DataFrame, teams: DataFrame, top: int = 10) -> DataFrame:
    """The first teams by wins, share of wins and name; only teams with a decided contest."""
    share = safe_div(F.col("wins"), F.col("wins") + F.col("losses"))
    rows = team_totals(games, "ignore").filter("wins + losses > 0").join(teams.select("team_id", "name"), "team_id").withColumn("win_pct", share)
    return rows.orderBy(F.desc("wins"), F.desc("win_pct"), "name", "team_id").limit(top).select("team_id", "name", "wins", "losses", "win_pct")


def radar_axes(games: DataFrame) -> DataFrame:
    """Six axes for each team: raw value and mid-rank percentile among all teams with contests.

    Goals count in postponed contests too, results do not. Defense shows goals allowed per game and
    ranks by its negative. The schedule axis is the mean share of wins of the opponents, 0.5 without one.
    """
    # both parts come from one table of pairs, so that contests are read once
    played = ~F.col("postponed")
    pairs = two_sided(games).groupBy("team_id", "opponent_id").agg(
        counted(played & (F.col("gf") > F.col("ga"))).alias("wins"), counted(played & (F.col("gf") < F.col("ga"))).alias("losses"), counted(played).alias("n"), F.coalesce(F.sum("gf"), F.lit(0)).alias("goals_for"), F.coalesce(F.sum("ga"), F.lit(0)).alias("goals_against")
    )
    wide = pairs.groupBy("team_id").agg(*[F.sum(c).alias(c) for c in ("wins", "losses", "goals_for", "goals_against")]).withColumn("decided", F.col("wins") + F.col("losses"))
    per = lambda x: safe_div(x, F.col("decided"))
    base = wide.select(
        "team_id", per(F.col("wins")).alias("win_pct"), per(F.col("goals_for")).alias("goals_for"), per(F.col("goals_against")).alias("defense"),
        per(F.col("goals_for") - F.col("goals_against")).alias("margin"), F.col("goals_for").cast("double").alias("goals_for_total"),
    )
    met = pairs.filter("n > 0 AND team_id <> opponent_id").select("team_id", "opponent_id", "n")
    schedule = met.join(base.select(F.col("team_id").alias("opponent_id"), "win_pct"), "opponent_id").groupBy("team_id").agg((F.sum(F.col("n") * F.col("win_pct")) / F.sum("n")).alias("sos"))
    axes = ["win_pct", "goals_for", "defense", "margin", "goals_for_total", "sos"]
    every = base.join(schedule, "team_id", "left").withColumn("sos", F.coalesce("sos", F.lit(0.5)))
    long = every.select("team_id", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])))
    # Sums of shares differ in their last bits with the order of rows; ties are taken at nine places.
    rank_by = F.round(F.when(F.col("axis") == "defense", -F.col("value")).otherwise(F.col("value")), 9) + F.lit(0.0)
    return with_mid_rank(long, ["axis"], rank_by, "percentile")


def closing_runs(scores: DataFrame, least: int = 3) -> DataFrame:
    """Contests whose last period one side won with `least` goals or more to none; `scores` are running scores."""
    last = F.slice(F.sort_array(F.collect_list(F.struct("period", "home", "away"))), -2, 2)  # a contest has few periods
    ends = scores.groupBy("game_id").agg(last.alias("ends")).filter(F.size("ends") == 2)
    gain = lambda side: F.col("ends")[1][side] - F.col("ends")[0][side]
    runs = ends.select("game_id", F.col("ends")[1]["period"].alias("period"), gain("home").alias("home"), gain("away").alias("away"))
    one_sided = runs.filter(((F.col("home") >= least) & (F.col("away") == 0)) | ((F.col("away") >= least) & (F.col("home") == 0)))
    return one_sided.select("game_id", "period", (F.col("home") > 0).alias("at_home"), F.greatest("home", "away").alias("goals"))


EVENT = "game_id long, sequence int, period int, at_home boolean, scorer string, assist string, home_after int, away_after int"


def scoring_events(periods: DataFrame, players: DataFrame) -> DataFrame:
    """Goals one by one, made up from (game_id, period, at_home, goals) and (game_id, at_home, name, goals, assists).

    Within a period the sides alternate, away first. Each goal goes to whoever of the side has most goals
    left, its assist to whoever but the scorer has most assists left; of equal ones to who has more
    goals in all, then by name. Goals beyond those of the players have no scorer. The choice of an assist depends on all before
    it, so one contest (some dozens of rows) is one group.
    """

    lists = [rows.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)) for rows, columns, name in ((periods, ["period", "at_home", "goals"], "periods"), (players, ["at_home", "name", "goals", "assists"], "players"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for game, of_periods, of_players in zip(batch["game_id"], batch["periods"], batch["players"]) for row in _events(game, of_periods, of_players if of_players is not None else [])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in EVENT.split(", ")])

    return lists[0].join(lists[1], "game_id", "left").select("game_id", "periods", "players").mapInPandas(run, EVENT)


def _events(game: int, periods: list, players: list) -> Iterator[tuple]:
    """The goals of one contest."""
    left: dict = {False: {}, True: {}}
    for p in sorted(players, key=lambda p: (-p["goals"], p["name"])):
        left[bool(p["at_home"])][p["name"]] = [p["goals"], p["assists"]]

    def take(side: bool, which: int, but: str | None = None) -> str | None:
        best = max((n for n in left[side] if left[side][n][which] > 0 and n != but), key=lambda n: left[side][n][which], default=None)
        if best is not None:
            left[side][best][which] -= 1
        return best

    goals: dict = {}
    for p in periods:
        goals.setdefault(p["period"], {False: 0, True: 0})[bool(p["at_home"])] += p["goals"]
    score, sequence = {False: 0, True: 0}, 0
    for period in sorted(goals):
        for nth in range(max(goals[period].values())):
            for side in (False, True):
                if nth < goals[period][side]:
                    score[side] += 1
                    scorer = take(side, 0)
                    yield game, sequence, period, side, scorer, take(side, 1, scorer), score[True], score[False]
                    sequence += 1


def league_rows(rows: DataFrame, order: list[Column], league: int | None = None) -> DataFrame:
    """Rows of one league, or of all, in an order."""
    return (rows if league is None else rows.filter(F.col("league_id") == league)).orderBy(*order)
