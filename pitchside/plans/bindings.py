"""Views of the driver's star schema in the shape of the sports tables, in Spark and in SQL.

One line item is one contest: the supplier's nation plays at home, the customer's nation away.
Contest ids do not exist in the source, so operators that need an order use columns that make
every tie an exact duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("division"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_date, season, home_id, away_id, home_score, away_score, postponed, provenance."""
    li, o, c, s, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "part"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.to_date("o_orderdate").alias("game_date"),
            F.year("o_orderdate").cast("long").alias("season"),
            F.col("s_nationkey").cast("long").alias("home_id"),
            F.col("c_nationkey").cast("long").alias("away_id"),
            F.col("l_quantity").cast("long").alias("home_score"),
            F.col("p_size").cast("long").alias("away_score"),
            (F.col("l_returnflag") == "R").alias("postponed"),
            F.col("l_linestatus").alias("provenance"),
        )
    )


def game_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_date and season of every contest, for what needs no more: two tables and four columns are read."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.to_date("o_orderdate").alias("game_date"), F.year("o_orderdate").cast("long").alias("season"))


def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order of a customer: game_id, player_id, team_id, season and seven counts."""
    li, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    per = li.groupBy(F.col("l_orderkey").alias("game_id")).agg(
        F.count("*").alias("goals"),
        F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).cast("long").alias("assists"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).cast("long").alias("ground_balls"),
        F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).cast("long").alias("caused_turnovers"),
        F.sum(F.when(F.col("l_tax") > 0.05, 1).otherwise(0)).cast("long").alias("saves"),
        F.sum(F.when(F.col("l_quantity") >= 25, F.col("l_quantity")).otherwise(0)).cast("long").alias("fo_won"),
        F.sum("l_quantity").cast("long").alias("fo_taken"),
    )
    return (
        per.join(o, per.game_id == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            "game_id",
            F.col("c_custkey").alias("player_id"),
            F.col("c_name").alias("player_name"),
            F.col("c_nationkey").cast("long").alias("team_id"),
            F.to_date("o_orderdate").alias("game_date"),
            F.year("o_orderdate").cast("long").alias("season"),
            "goals", "assists", "ground_balls", "caused_turnovers", "saves", "fo_won", "fo_taken",
            (F.col("o_orderstatus") == "P").alias("postponed"),
        )
    )


GAMES_SQL = """
games AS (
  SELECT CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS BIGINT) AS season,
         CAST(s_nationkey AS BIGINT) AS home_id, CAST(c_nationkey AS BIGINT) AS away_id,
         CAST(l_quantity AS BIGINT) AS home_score, CAST(p_size AS BIGINT) AS away_score,
         (l_returnflag = 'R') AS postponed, l_linestatus AS provenance
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
)"""

DAYS_SQL = "games AS (SELECT CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS BIGINT) AS season FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

TEAMS_SQL = """
teams AS (
  SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS division FROM nation
)"""

STATS_SQL = """
per_game AS (
  SELECT l_orderkey AS game_id, count(*) AS goals,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS assists,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS ground_balls,
         CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS caused_turnovers,
         CAST(sum(CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS saves,
         CAST(sum(CASE WHEN l_quantity >= 25 THEN l_quantity ELSE 0 END) AS BIGINT) AS fo_won,
         CAST(sum(l_quantity) AS BIGINT) AS fo_taken
  FROM lineitem GROUP BY l_orderkey
),
stats AS (
  SELECT game_id, c_custkey AS player_id, c_name AS player_name, CAST(c_nationkey AS BIGINT) AS team_id,
         CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS BIGINT) AS season,
         goals, assists, ground_balls, caused_turnovers, saves, fo_won, fo_taken, o_orderstatus = 'P' AS postponed
  FROM per_game JOIN orders ON game_id = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""

#: Both sides of every contest, one row each.
SIDES_SQL = """
sides AS (
  SELECT game_date, season, postponed, provenance, home_id AS team_id, away_id AS opponent_id, home_score AS gf, away_score AS ga, TRUE AS at_home FROM games
  UNION ALL
  SELECT game_date, season, postponed, provenance, away_id, home_id, away_score, home_score, FALSE FROM games
)"""
