"""A league's pages as rows, and their way into the tables (survey S12, M12).

All four tables and the log change in one commit. A scrape that fails or finds nobody only leaves a
line in the log.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions import pages
from pitchside.operators.merge import upsert
from pitchside.sources.schemas import TableSchema
from pitchside.sources.table_set import TableSet

COUNTS = ["teams", "players", "goalies", "games"]
TABLES = [
    TableSchema("teams", "league_id long, name string, gp long, wins long, losses long, ties long, otw long, otl long, pts long, pf long, pa long, diff long, streak string, scraped_at timestamp", ["league_id", "name"]),
    TableSchema("players", "league_id long, name string, team string, jersey long, gp long, goals long, assists long, points long, penalties long, pim long, scraped_at timestamp", ["league_id", "name", "team"]),
    TableSchema("goalies", "league_id long, name string, team string, jersey long, gp long, minutes double, goals_against long, average double, scraped_at timestamp", ["league_id", "name", "team"]),
    TableSchema("games", "league_id long, game_num long, day string, time string, home string, away string, home_score long, away_score long, location string, scraped_at timestamp", ["league_id", "game_num"]),
    TableSchema("scrapes", "league_id long, scraped_at timestamp, teams long, players long, goalies long, games long, status string, message string", []),
]


def scraped(found: DataFrame) -> dict[str, DataFrame]:
    """teams, players, goalies and games of a league's pages (nth, kind, html), each row with `nth`, its place.

    Teams' pages of scorers and goalies overlap: of rows with one name and team, in any case, the first stays.
    """

    def rows(kind: str, parse) -> DataFrame:
        each = found.filter(F.col("kind") == kind).select("nth", F.posexplode(parse(F.col("html"))).alias("pos", "r"))
        return each.select(F.struct("nth", "pos").alias("nth"), "r.*")

    def once(people: DataFrame) -> DataFrame:
        keyed = people.withColumns({"_name": F.lower("name"), "_team": F.lower("team")})
        first = keyed.groupBy("_name", "_team").agg(F.min_by(F.struct(*people.columns), "nth").alias("r"))
        return first.select("r.*")

    games = pages.schedule(found.filter("kind = 'schedule'"), "nth", "html").withColumn("nth", F.struct("nth", F.col("game_num").alias("pos")))
    return {"teams": rows("standings", pages.standings), "players": once(rows("scorers", pages.scorers)), "goalies": once(rows("goalies", pages.goalies)), "games": games}


def league_tables(tables_at: str, spark) -> TableSet:
    return TableSet(spark, tables_at, TABLES)


def sync_league(tables: TableSet, league_id: int, scraped_at: datetime, scrape: Callable[[], dict[str, DataFrame]]) -> str:
    """Runs a scrape and commits its rows with a line of the log; the status: success, empty or error."""
    spark = tables.spark

    def log(status: str, counts: list[int], message: str | None) -> DataFrame:
        line = spark.createDataFrame([(league_id, scraped_at, *counts, status, message)], TABLES[-1].first)
        return tables.read("scrapes").unionByName(line)

    try:
        found = scrape()
        counts = [found[c].count() for c in COUNTS]
    except Exception as error:  # whatever goes wrong with a page is a line of the log
        message = str(error).split("\n")[0]
        tables.update(lambda t: {"scrapes": log("error", [0] * 4, message)})
        return "error"
    if counts[0] == counts[1] == 0:
        tables.update(lambda t: {"scrapes": log("empty", counts, "no rows; perhaps not signed in")})
        return "empty"

    def merged(t: TableSet) -> dict[str, DataFrame]:
        out = {"scrapes": log("success", counts, None)}
        for schema in TABLES[:-1]:
            old = t.read(schema.name)
            batch = found[schema.name].withColumns({"league_id": F.lit(league_id).cast("long"), "scraped_at": F.lit(scraped_at)})
            typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields]
            out[schema.name] = upsert(old, batch.select(*typed, "nth"), schema.keys, [F.desc("nth")])  # of one key the last
        return out

    tables.update(merged)
    return "success"
