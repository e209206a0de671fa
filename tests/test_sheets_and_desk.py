"""Sheets by header, official records, and the editor's summaries."""

from datetime import date

from pyspark.sql import functions as F

from pitchside.operators import desk, officials
from pitchside.sources import sheets

rows_of = lambda f: sorted(map(tuple, f.collect()), key=repr)


def test_cells(spark):
    lines = ['a,b', '"x, y",""', 'a,"say ""hi""",', '', ' a , "b " ', '"open, end', 'a,,c']
    out = spark.createDataFrame([(x,) for x in lines], "l string").select(sheets.split_cells(F.col("l")).alias("c")).collect()
    assert [r.c for r in out] == [["a", "b"], ["x, y", ""], ["a", 'say "hi"', ""], [""], ["a", "b"], ["open, end"], ["a", "", "c"]]


def test_schedule_of_any_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"Visitor Team","Date","Home Team","Home Score","Game Completed","Visitor Score"\r\n"Elm","2026-04-01","Oak, East","3","YES","x"\r\n\r\nAsh,2026-4-1,Oak,1,no,2\r\n,2026-04-02,Oak,,,,surplus,more\n')
    (tmp_path / "b.csv").write_text("date,visitor team\n2026-04-01,Elm\n2026-04-02,Elm\n")
    (tmp_path / "c.csv").write_text("")
    good, bad = sheets.schedule_rows(sheets.read_texts(spark, f"{tmp_path}/*.csv"))
    assert rows_of(good.drop("path")) == [(2, "2026-04-01", "Oak, East", "Elm", True, 3.0, None)]
    assert [r[1:] for r in rows_of(bad.withColumn("path", F.substring_index("path", "/", -1)))] == [(3, "Ash,2026-4-1,Oak,1,no,2", 'bad date: "2026-4-1"'), (4, ",2026-04-02,Oak,,,,surplus,more", "missing home/away team"), (2, "2026-04-01,Elm", "header missing required columns")]


def test_uploads_with_known_headers(spark):
    texts = [("a", "Player,Date,Vs,G,GB's,FO-Won,Other,G\nJo,4/1/26,Oak,2,,1,z,9\n,,,,\nAl,2026-04-02,,x,1\nBo,soon,Elm,1\n,2026-04-03,Elm,1\n"), ("b", "name,goals\nJo,1"), ("c", None)]
    good, bad = sheets.upload_rows(spark.createDataFrame(texts, "path string, text string"))
    assert rows_of(good.select("path", "row", "player_name", "game_date", "opponent", "goals", "ground_balls", "fo_won")) == [("a", 2, "Jo", date(2026, 4, 1), "Oak", 2.0, 0.0, 1.0)]
    assert rows_of(bad) == [("a", 4, "Invalid goals"), ("a", 5, "Invalid game_date"), ("a", 6, "player_name is required"), ("b", 2, "game_date is required")]


def test_official_by_name_alias_and_ranking(spark):
    teams = spark.createDataFrame([(1, "Oak"), (2, "Elm"), (3, "DV"), (4, "Ash")], "team_id long, name string")
    aliases = spark.createDataFrame([(1, "oaks"), (1, "oak"), (2, "elms")], "team_id long, alias string")
    official = spark.createDataFrame([(10, "oak", 3, 1, 0, 5.0), (11, "oaks", 9, 9, 9, 7.0), (12, "elms", 0, 0, 0, None), (13, "Elm", 1, 1, 1, 1.0)], "official_id long, key string, wins long, losses long, ties long, ranking double")
    games = spark.createDataFrame([(1, 2, 5, 3, False), (2, 1, 4, 4, False), (1, 2, 9, 0, True), (2, 1, None, 2, False)], "home_id long, away_id long, home_score long, away_score long, postponed boolean")
    games = games.withColumns({"game_date": F.lit(None).cast("date"), "season": F.lit(1), "provenance": F.lit("")})
    people = spark.createDataFrame([(7, 4)], "player_id long, team_id long")
    assert rows_of(officials.official_candidates(teams, aliases, official).select("team_id", "official_id")) == [(1, 10), (1, 11), (2, 12)]
    assert rows_of(officials.official_of(teams, aliases, official, True).select("team_id", "official_id")) == [(1, 11), (2, 12)]
    got = {r.team_id: (r.games, r.derived_wins, r.derived_ties, r.record, r.source, r.coverage) for r in officials.listed_teams(teams, games, people, aliases, official).collect()}
    assert got == {1: (4, 1, 1, "3-1", "official", 1.0), 2: (4, 0, 1, "0-0", "official", None), 4: (0, 0, 0, "0-0", "derived", None)}


def test_scouting_leaves_out_postponed(spark):
    games = spark.createDataFrame([(1, date(2026, 4, 1), 2026, 1, 2, 5, 3, False), (2, date(2026, 4, 2), 2026, 2, 1, 4, 4, False), (3, date(2026, 4, 3), 2026, 2, 3, 9, 0, True), (4, date(2025, 4, 3), 2025, 2, 1, 7, 1, None)], "game_id long, game_date date, season long, home_id long, away_id long, home_score long, away_score long, postponed boolean")
    stats = spark.createDataFrame([(1, 20, "b", 2, 2026, 2, None), (2, 21, "A", 2, 2026, 2, 0), (3, 21, "A", 2, 2026, 9, 9), (4, 22, "c", 2, 2025, 9, 9), (1, 23, "d", 1, 2026, 9, 9)], "game_id long, player_id long, player_name string, team_id long, season long, goals long, assists long")
    out = desk.scouting_report(games, stats, 1, 2, 2026)
    assert rows_of(out["last_games"].select("game_id", "gf", "ga", "result")) == [(1, 3, 5, "L"), (2, 4, 4, "L")]
    assert rows_of(out["averages"]) == [(2, 3.5, 4.5)] and [r.player_id for r in out["scorers"].collect()] == [21, 20]
    assert rows_of(out["head_to_head"].select("game_id", "gf", "ga")) == [(1, 5, 3), (2, 4, 4), (4, 1, 7)]
    none = desk.scouting_report(games, stats, 1, 9, 2026)
    assert rows_of(none["averages"]) == [(0, 0.0, 0.0)] and none["scorers"].collect() == []


def test_quality_suite_of_nothing_and_of_errors(spark):
    schema = "game_id long, game_date date, home_id long, away_id long, home_score long, away_score long"
    teams = spark.createDataFrame([(1, "a"), (2, "b")], "team_id long, name string")
    people = spark.createDataFrame([(1, 1, "X", 100), (2, 1, "x", None)], "player_id long, team_id long, name string, jersey long")
    aliases = spark.createDataFrame([("A", 1), ("a", 2), ("b", 1)], "alias string, team_id long")
    stats = spark.createDataFrame([(1, 1), (1, 1), (9, 2)], "game_id long, player_id long")
    found = lambda games, day: {r.check: r.found for r in desk.quality_suite(spark.createDataFrame(games, schema), teams, people, aliases, stats, 2026, day).collect()}
    empty = found([], date(2026, 4, 1))
    assert empty["stale season"] == 1 and empty["team without a game"] == 2 and empty["orphaned stat"] == 3 and empty["null required field"] == 0
    d = date(2026, 4, 1)
    some = [(1, d, 1, 2, 31, 0), (2, d, 1, 2, -1, 0), (3, None, 1, 2, 1, 1), (4, date(2025, 4, 1), 1, 2, 40, 1), (5, d, 1, 7, 50, 1)]
    assert found(some, date(2026, 4, 8)) == {"suspicious score": 1, "negative score": 1, "duplicate game": 1, "team without a game": 0, "stale season": 0, "null required field": 1, "duplicate player": 1, "duplicate alias": 1, "orphaned stat": 1, "duplicate stat": 1, "invalid jersey": 1}
    assert found(some, date(2026, 4, 9))["stale season"] == 1 and found(some, date(2026, 7, 9))["stale season"] == 0
    suite = desk.quality_suite(spark.createDataFrame(some, schema), teams, people, aliases, stats, 2026, d)
    assert not desk.passes(suite) and desk.passes(suite.filter("severity = 'warning'"))
