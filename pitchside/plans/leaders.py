"""Team and player leaderboards (survey A3, A4)."""

from __future__ import annotations

from pitchside.operators import leaderboards
from pitchside.plans import bindings as B

#: The orders in SQL, written out here and not taken from the operators.
TEAM_SQL = {
    "wins": "wins DESC, win_pct DESC NULLS LAST, goal_diff DESC",
    "losses": "losses DESC, games DESC",
    "win_pct": "win_pct DESC, wins DESC",
    "goals_for": "goals_for DESC, games",
    "goals_against": "goals_against, games",
    "goal_diff": "goal_diff DESC, wins DESC",
    "gpg": "gpg DESC, games",
    "gapg": "gapg, games",
}
PLAYER_SQL = {
    "points": "points DESC, goals DESC, games",
    "goals": "goals DESC, assists DESC",
    "assists": "assists DESC, goals DESC",
    "ground_balls": "ground_balls DESC, games",
    "caused_turnovers": "caused_turnovers DESC, games",
    "saves": "saves DESC, games",
    "fo_pct": "fo_pct DESC NULLS LAST, fo_taken DESC",
    "ppg": "ppg DESC, points DESC",
}


def _team(metric: str):
    return lambda spark, d: leaderboards.team_leaders(B.games(spark, d), B.teams(spark, d), metric=metric, limit=10)


def _team_sql(metric: str) -> str:
    order, keep = TEAM_SQL[metric], "wins + losses > 0" if metric == "win_pct" else "games > 0"
    return f"""WITH {B.GAMES_SQL}, {B.TEAMS_SQL}, {B.SIDES_SQL},
agg AS (
  SELECT team_id,
    CAST(sum(CASE WHEN NOT postponed THEN 1 ELSE 0 END) AS BIGINT) AS games,
    CAST(sum(CASE WHEN NOT postponed AND gf > ga THEN 1 ELSE 0 END) AS BIGINT) AS wins,
    CAST(sum(CASE WHEN NOT postponed AND gf < ga THEN 1 ELSE 0 END) AS BIGINT) AS losses,
    CAST(sum(CASE WHEN NOT postponed AND gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS ties,
    CAST(sum(CASE WHEN NOT postponed THEN gf ELSE 0 END) AS BIGINT) AS goals_for,
    CAST(sum(CASE WHEN NOT postponed THEN ga ELSE 0 END) AS BIGINT) AS goals_against
  FROM sides GROUP BY team_id),
wide AS (
  SELECT a.*, name, CASE WHEN wins + losses > 0 THEN wins * 1.0::DOUBLE / (wins + losses) END AS win_pct,
    goals_for * 1.0::DOUBLE / games AS gpg, goals_against * 1.0::DOUBLE / games AS gapg, goals_for - goals_against AS goal_diff
  FROM agg a JOIN teams USING (team_id) WHERE {keep})
SELECT CAST(row_number() OVER (ORDER BY {order}, lower(name), team_id) AS INTEGER) AS rank, team_id, name, games, wins, losses, ties, goals_for, goals_against, goal_diff, win_pct, gpg, gapg
FROM wide ORDER BY {order}, lower(name), team_id LIMIT 10"""


def _player(metric: str):
    return lambda spark, d: leaderboards.player_leaders(B.player_stats(spark, d), metric=metric, limit=25, min_games=1, min_attempts=20)


def _player_sql(metric: str) -> str:
    order, keep = PLAYER_SQL[metric], "fo_taken >= 20" if metric == "fo_pct" else "games >= 1"
    return f"""WITH {B.STATS_SQL},
recent AS (SELECT player_id, goals, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS rn FROM stats WHERE NOT postponed),
hot AS (SELECT player_id, sum(goals) AS last3 FROM recent WHERE rn <= 3 GROUP BY player_id),
agg AS (SELECT player_id, player_name, team_id, count(*) AS games,
  CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(goals + assists) AS BIGINT) AS points,
  CAST(sum(ground_balls) AS BIGINT) AS ground_balls, CAST(sum(caused_turnovers) AS BIGINT) AS caused_turnovers,
  CAST(sum(saves) AS BIGINT) AS saves, CAST(sum(fo_won) AS BIGINT) AS fo_won, CAST(sum(fo_taken) AS BIGINT) AS fo_taken
  FROM stats GROUP BY player_id, player_name, team_id),
wide AS (SELECT *, CASE WHEN fo_taken > 0 THEN fo_won * 1.0::DOUBLE / fo_taken END AS fo_pct, points * 1.0::DOUBLE / games AS ppg FROM agg)
SELECT CAST(row_number() OVER (ORDER BY {order}, lower(player_name), w.player_id) AS INTEGER) AS rank, w.player_id, player_name, team_id, games, goals, assists, points, ground_balls, caused_turnovers, saves, fo_won, fo_taken, fo_pct, ppg, coalesce(last3 > 2, FALSE) AS hot
FROM wide w LEFT JOIN hot USING (player_id) WHERE {keep} ORDER BY {order}, lower(player_name), w.player_id LIMIT 25"""


QUERIES = {f"a04_team_leaders_{m}": _team(m) for m in TEAM_SQL} | {f"a03_player_leaders_{m}": _player(m) for m in PLAYER_SQL}
ORACLES = {f"a04_team_leaders_{m}": _team_sql(m) for m in TEAM_SQL} | {f"a03_player_leaders_{m}": _player_sql(m) for m in PLAYER_SQL}
