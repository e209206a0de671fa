"""Merge plans and reports over the bindings, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pitchside.operators import entities as E
from pitchside.operators.team_analytics import team_totals
from pitchside.plans import bindings as B
from pitchside.plans.suite import TOTALS, WITH_GAMES, WITH_STATS

TODAY = date(1996, 6, 1)


def _people(spark, d):
    """Parts as people: the brand as team, the type as name."""
    return B.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("team_id"), F.col("p_type").alias("name"))


def _surnames(spark, d):
    """People of one team each by size and brand; those with an odd id have a first name."""
    size = B.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").alias("size"))
    name = F.when(F.col("id") % 2 == 1, F.concat(F.lit("Jo "), "name")).otherwise(F.col("name"))
    return _people(spark, d).join(size, "id").select("id", F.concat_ws("-", "team_id", "size").alias("team_id"), name.alias("name"))


def _suffixed(spark, d):
    t = B.teams(spark, d)
    return t.unionByName(t.filter("division <> 2").select((F.col("team_id") + 100).alias("team_id"), F.concat("name", F.lit(" (PA)")).alias("name"), "division"))


def _official(spark, d):
    return B.teams(spark, d).filter("division = 1").select("team_id", F.lit(7).cast("long").alias("wins"), F.lit(2).cast("long").alias("losses"), (F.col("team_id") % 2).alias("ties"))


SUITE = {
    "d04_merge_plan": (
        lambda s, d: E.merge_plan(_people(s, d), F.lower("name")),
        """WITH x AS (SELECT p_partkey AS id, first_value(p_partkey) OVER (PARTITION BY p_brand, lower(p_type) ORDER BY length(p_type) DESC, p_partkey) AS keep FROM part)
        SELECT CAST(id AS BIGINT) AS drop_id, CAST(keep AS BIGINT) AS keep_id FROM x WHERE id <> keep""",
    ),
    "d04_surname_plan": (
        lambda s, d: E.surname_plan(_surnames(s, d)),
        """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand || '-' || p_size AS team, lower(string_split(p_type, ' ')[-1]) AS last FROM part),
        f AS (SELECT team, last, min(id) AS keep_id FROM p WHERE id % 2 = 1 GROUP BY ALL HAVING count(*) = 1) SELECT id AS drop_id, keep_id FROM p JOIN f USING (team, last) WHERE id % 2 = 0""",
    ),
    "d09_state_suffix_plan": (
        lambda s, d: E.state_suffix_plan(_suffixed(s, d), team_totals(B.games(s, d)).select("team_id", "games")),
        "SELECT CAST(n_nationkey + 100 AS BIGINT) AS drop_id, CAST(n_nationkey AS BIGINT) AS keep_id, n_name || ' (PA)' AS alias FROM nation WHERE n_regionkey <> 2",
    ),
    "a05_team_list": (
        lambda s, d: E.team_list(B.games(s, d), B.teams(s, d), _official(s, d)),
        f"""{WITH_GAMES}, {TOTALS.format(where='WHERE NOT postponed')}, x AS (SELECT team_id, name, games, division = 1 AS official, CASE WHEN division = 1 THEN 7 ELSE wins END AS w, CASE WHEN division = 1 THEN 2 ELSE losses END AS l, CASE WHEN division = 1 THEN team_id % 2 ELSE ties END AS t FROM totals JOIN teams USING (team_id))
        SELECT team_id, name, games, CASE WHEN t > 0 THEN w || '-' || l || '-' || t ELSE w || '-' || l END AS record, official FROM x""",
    ),
    "a18_triage": (
        lambda s, d: E.triage(B.table(s, d, "part"), ["p_brand"], "p_type").select("p_brand", "n", F.array_join("samples", "|").alias("samples")),
        """WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 20), r AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS rn FROM (SELECT DISTINCT p_brand, p_type FROM part))
        SELECT p_brand, n, string_agg(p_type, '|' ORDER BY p_type) AS samples FROM b JOIN r USING (p_brand) WHERE rn <= 5 GROUP BY ALL""",
    ),
    "a27_career": (
        lambda s, d: E.career(B.player_stats(s, d)),
        f"""{WITH_STATS} SELECT player_id, count(DISTINCT game_id) AS games, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(saves) AS BIGINT) AS saves, count(*) FILTER (goals >= 3) AS hat_tricks,
        max(goals) AS best_goals, arg_max(game_id, {{'g': goals, 'd': game_date, 'k': game_id}}) AS best_game FROM stats GROUP BY player_id""",
    ),
    "a29_short_names": (
        lambda s, d: E.short_names(B.table(s, d, "customer").select(F.col("c_custkey").alias("player_id"), F.substring("c_name", 1, F.when(F.col("c_custkey") % 10 == 0, 3).otherwise(20)).alias("name")), B.player_stats(s, d)),
        f"{WITH_STATS} SELECT c_custkey AS player_id, c_name[1:3] AS name, count(DISTINCT game_id) AS games, arg_max(game_id, {{'d': game_date, 'k': game_id}}) AS latest FROM customer LEFT JOIN stats ON c_custkey = player_id WHERE c_custkey % 10 = 0 GROUP BY ALL",
    ),
    "w16_recent_games": (
        lambda s, d: E.recent_games(B.games(s, d), TODAY).groupBy("game_date").agg(F.count(F.lit(1)).alias("games")),
        f"{WITH_GAMES} SELECT game_date, count(*) AS games FROM games WHERE game_date > DATE '{TODAY}' - 7 AND game_date <= DATE '{TODAY}' GROUP BY 1",
    ),
}

QUERIES = {name: fn for name, (fn, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
