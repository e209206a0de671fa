"""Coach reports and scores by period over the bindings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchside.operators import coach_reports as C
from pitchside.operators import period_flow as P
from pitchside.plans import bindings as B


def _points(spark, d):
    return B.player_stats(spark, d).withColumn("goals_against", F.col("caused_turnovers"))


def _contests(spark, d):
    return B.table(spark, d, "orders").join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("team_id"), F.col("o_orderkey").alias("game_id"))


def _stats(spark, d):
    return B.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("game_id"), F.to_date("l_shipdate").alias("updated_at"))


def _periods(spark, d):
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("period"), (F.col("l_linestatus") == "O").alias("at_home"), F.col("l_quantity").cast("long").alias("goals"))


POINTS = f"WITH {B.STATS_SQL}, points AS (SELECT *, caused_turnovers AS goals_against, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rn FROM stats)"
CONTESTS = """WITH g AS (SELECT CAST(c_nationkey AS BIGINT) AS team_id, o_orderkey AS game_id FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT l_orderkey AS game_id, CAST(max(l_shipdate) AS DATE) AS latest FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)"""
SCORES = """WITH p AS (SELECT l_orderkey AS game_id, l_linenumber AS period, l_linestatus = 'O' AS at_home, CAST(l_quantity AS BIGINT) AS goals FROM lineitem),
grid AS (SELECT game_id, CAST(unnest(range(0, greatest(4, max(period)) + 1)) AS INTEGER) AS period FROM p GROUP BY game_id),
scores AS (SELECT grid.game_id, grid.period, CAST(coalesce(sum(goals) FILTER (at_home), 0) AS BIGINT) AS home, CAST(coalesce(sum(goals) FILTER (NOT at_home), 0) AS BIGINT) AS away
FROM grid LEFT JOIN p ON grid.game_id = p.game_id AND p.period <= grid.period GROUP BY 1, 2)"""

SUITE = {
    "a21_stat_coverage": (
        lambda s, d: C.stat_coverage(_contests(s, d), _stats(s, d)),
        f"{CONTESTS} SELECT team_id, count(DISTINCT game_id) AS games, count(DISTINCT game_id) FILTER (latest IS NOT NULL) AS with_stats, max(latest) AS last_update FROM g LEFT JOIN s USING (game_id) GROUP BY team_id",
    ),
    "a21_games_without_stats": (lambda s, d: C.games_without_stats(_contests(s, d), _stats(s, d)), f"{CONTESTS} SELECT team_id, game_id FROM g WHERE game_id NOT IN (SELECT game_id FROM s)"),
    "a22_trend_points": (
        lambda s, d: C.trend_points(_points(s, d)).select("team_id", "game_id", "game_date", *C.COUNTS),
        f"{POINTS} SELECT team_id, game_id, game_date, {', '.join(C.COUNTS)} FROM points WHERE rn <= 10",
    ),
    "a23_scouting": (
        lambda s, d: C.scouting(_points(s, d)),
        f"{POINTS} SELECT team_id, count(*) AS games, avg(goals) AS goals_for, avg(goals_against) AS goals_against, CAST(sum(goals - goals_against) AS BIGINT) AS differential FROM points WHERE rn <= 5 GROUP BY team_id",
    ),
    "a24_practice_focus": (
        lambda s, d: C.practice_focus(_points(s, d)).select("team_id", "area", "priority"),
        f"""{POINTS}, a AS (SELECT team_id, sum(fo_won) FILTER (rn <= 5) AS won, sum(fo_taken) FILTER (rn <= 5) AS taken, sum(saves) FILTER (rn <= 5) AS saves, sum(goals_against) FILTER (rn <= 5) AS against, avg(assists) FILTER (rn <= 5) AS assists,
          avg(ground_balls) FILTER (rn <= 3) AS gb3, avg(ground_balls) FILTER (rn > 3) AS gb7, avg(goals_against) FILTER (rn <= 3) AS ga3, avg(goals_against) FILTER (rn > 3) AS ga7 FROM points WHERE rn <= 10 GROUP BY team_id)
        SELECT team_id, 'Faceoffs' AS area, 'high' AS priority FROM a WHERE taken > 0 AND 2 * won < taken UNION ALL SELECT team_id, 'Ground Balls', 'medium' FROM a WHERE gb3 < gb7
        UNION ALL SELECT team_id, 'Defense', 'high' FROM a WHERE ga3 > ga7 UNION ALL SELECT team_id, 'Ball Movement / Passing', 'medium' FROM a WHERE assists < 3
        UNION ALL SELECT team_id, 'Goalie Training', 'high' FROM a WHERE saves + against > 0 AND 2 * saves < saves + against""",
    ),
    "w15_running_scores": (lambda s, d: P.running_scores(_periods(s, d)), f"{SCORES} SELECT * FROM scores"),
    "w15_largest_leads": (
        lambda s, d: P.largest_leads(P.running_scores(_periods(s, d))),
        f"""{SCORES} SELECT game_id, final.home AS home, final.away AS away, lead, lead_period FROM (SELECT game_id, max(home) AS home, max(away) AS away FROM scores GROUP BY game_id) final
        JOIN (SELECT game_id, abs(home - away) AS lead, period AS lead_period, row_number() OVER (PARTITION BY game_id ORDER BY abs(home - away) DESC, period) AS rn FROM scores) USING (game_id) WHERE rn = 1""",
    ),
}

QUERIES = {name: fn for name, (fn, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
