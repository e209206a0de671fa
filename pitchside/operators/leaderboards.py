"""Top-k leaderboards as aggregate, filter and TakeOrderedAndProject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.core import counted, ranked, total, two_sided

#: Sort keys by metric: column and whether it runs downward; then the name without case.
TEAM_ORDER = {
    "wins": [("wins", True), ("win_pct", True), ("goal_diff", True)],
    "losses": [("losses", True), ("games", True)],
    "win_pct": [("win_pct", True), ("wins", True)],
    "goals_for": [("goals_for", True), ("games", False)],
    "goals_against": [("goals_against", False), ("games", False)],
    "goal_diff": [("goal_diff", True), ("wins", True)],
    "gpg": [("gpg", True), ("games", False)],
    "gapg": [("gapg", False), ("games", False)],
}
PLAYER_ORDER = {
    "points": [("points", True), ("goals", True), ("games", False)],
    "goals": [("goals", True), ("assists", True)],
    "assists": [("assists", True), ("goals", True)],
    "ground_balls": [("ground_balls", True), ("games", False)],
    "caused_turnovers": [("caused_turnovers", True), ("games", False)],
    "saves": [("saves", True), ("games", False)],
    "fo_pct": [("fo_pct", True), ("fo_taken", True)],
    "ppg": [("ppg", True), ("points", True)],
}


def _sorted_by(order: list[tuple[str, bool]], name: str, key: str) -> list:
    """Downward keys have nulls last; the key makes the order total."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order] + [F.lower(name), F.col(key)]


def _top(frame: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows with their position. The window runs over the limited rows only."""
    return frame.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def team_leaders(games: DataFrame, teams: DataFrame, metric: str = "wins", limit: int = 25, season: int | None = None) -> DataFrame:
    """Teams with a contest by one metric. Postponed contests weigh nothing; ties leave win_pct's denominator, which must not be zero for that metric."""
    sides = two_sided(games if season is None else games.filter(F.col("season") == season))
    played = ~F.col("postponed")
    agg = sides.groupBy("team_id").agg(
        counted(played).alias("games"),
        counted(played & (F.col("gf") > F.col("ga"))).alias("wins"),
        counted(played & (F.col("gf") < F.col("ga"))).alias("losses"),
        counted(played & (F.col("gf") == F.col("ga"))).alias("ties"),
        total(played, F.col("gf")).alias("goals_for"),
        total(played, F.col("ga")).alias("goals_against"),
    )
    decided = F.col("wins") + F.col("losses")
    wide = (
        agg.filter(decided > 0 if metric == "win_pct" else F.col("games") > 0)
        .join(teams.select("team_id", "name"), "team_id")
        .withColumns(
            {
                "win_pct": F.when(decided > 0, F.col("wins") / decided),
                "gpg": F.col("goals_for") / F.col("games"),
                "gapg": F.col("goals_against") / F.col("games"),
                "goal_diff": F.col("goals_for") - F.col("goals_against"),
            }
        )
    )
    return _top(wide, _sorted_by(TEAM_ORDER[metric], "name", "team_id"), limit).select("rank", "team_id", "name", "games", "wins", "losses", "ties", "goals_for", "goals_against", "goal_diff", "win_pct", "gpg", "gapg")


def hot_streak(stats: DataFrame, last: int = 3, over: int = 2) -> DataFrame:
    """Players whose goals in their last contests that were played sum to more than a bound."""
    per_game = stats.filter(~F.col("postponed")).groupBy("player_id", "game_id").agg(F.max("game_date").alias("game_date"), F.sum("goals").alias("goals"))
    recent = ranked(per_game, ["player_id"], [F.desc("game_date"), F.desc("game_id")])
    return recent.filter(F.col("rn") <= last).groupBy("player_id").agg((F.sum("goals") > over).alias("hot"))


def player_leaders(stats: DataFrame, metric: str = "points", limit: int = 25, min_games: int = 1, min_attempts: int = 20, season: int | None = None) -> DataFrame:
    """Players with enough games by one metric, filtered on sums (never on a raw row of the group); zeros are ranked, too."""
    rows = stats if season is None else stats.filter(F.col("season") == season)
    cols = ["goals", "assists", "ground_balls", "caused_turnovers", "saves", "fo_won", "fo_taken"]
    agg = rows.groupBy("player_id", "player_name", "team_id").agg(
        F.count(F.lit(1)).alias("games"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols], F.coalesce(F.sum(F.col("goals") + F.col("assists")), F.lit(0)).alias("points")
    )
    wide = agg.withColumns({"fo_pct": F.when(F.col("fo_taken") > 0, F.col("fo_won") / F.col("fo_taken")), "ppg": F.col("points") / F.col("games")}).filter(F.col("games") >= min_games)
    if metric == "fo_pct":
        wide = wide.filter(F.col("fo_taken") >= min_attempts)
    order = _sorted_by(PLAYER_ORDER[metric], "player_name", "player_id")
    best = wide.orderBy(*order).limit(limit)
    # only the leaders' rows are ranked for the hot flag: at most `limit` ids are broadcast
    top = best.join(hot_streak(stats.join(F.broadcast(best.select("player_id")), "player_id", "left_semi")), "player_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "player_id", "player_name", "team_id", "games", *cols[:2], "points", *cols[2:], "fo_pct", "ppg", "hot")
