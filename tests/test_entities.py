from datetime import date

from pyspark.sql import functions as F

from pitchside.operators import entities as E

PEOPLE = "id long, team_id long, name string"


def pairs(frame):
    return sorted((r.drop_id, r.keep_id) for r in frame.collect())


def test_longest_name_stays(spark):
    rows = spark.createDataFrame([(1, 1, "al bee"), (2, 1, "Al  Bee"), (3, 1, "al bee"), (4, 2, "al bee"), (5, 1, None), (6, 1, None)], PEOPLE)
    key = F.regexp_replace(F.lower("name"), r"\s+", " ")
    assert pairs(E.merge_plan(rows, key)) == [(1, 2), (3, 2)]
    assert E.merge_plan(rows.limit(0), key).count() == 0


def test_last_name_alone_needs_one_full_name(spark):
    rows = spark.createDataFrame([(1, 1, "Bee"), (2, 1, "Al Bee"), (3, 1, "Dee"), (4, 1, "Cy Dee"), (5, 1, "Ed Dee"), (6, 2, "Bee"), (7, 1, None), (8, 1, " ")], PEOPLE)
    assert pairs(E.surname_plan(rows)) == [(1, 2)]


def test_bare_team_with_most_games_stays(spark):
    teams = spark.createDataFrame([(1, "Ash (PA)"), (2, "Ash"), (3, "ash"), (4, "Oak (NJ)"), (5, None)], "team_id long, name string")
    games = spark.createDataFrame([(2, 1), (3, 4)], "team_id long, games long")
    assert [tuple(r) for r in E.state_suffix_plan(teams, games).collect()] == [(1, 3, "Ash (PA)")]


def test_official_record_comes_first(spark):
    games = spark.createDataFrame([(date(2026, 4, 1), 2026, 1, 2, 5, 3, False, "a")], "game_date date, season long, home_id long, away_id long, home_score long, away_score long, postponed boolean, provenance string")
    teams = spark.createDataFrame([(1, "Ash"), (2, "Oak"), (3, "Elm")], "team_id long, name string")
    official = spark.createDataFrame([(2, 4, 1, None), (3, 1, 1, 1)], "team_id long, wins long, losses long, ties long")
    assert {r.team_id: (r.record, r.official) for r in E.team_list(games, teams, official).collect()} == {1: ("1-0", False), 2: ("4-1", True)}


def test_triage_keeps_groups_without_samples(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), ("c", "z")], "g string, line string")
    assert [(r.g, r.n, r.samples) for r in E.triage(rows, ["g"], "line", top=2).orderBy("g").collect()] == [("a", 3, ["x", "y"]), ("b", 1, None)]


def test_career_with_nulls(spark):
    s = spark.createDataFrame([(1, 1, date(2026, 4, 1), 3, None, 0), (1, 2, date(2026, 4, 2), 3, 1, None), (1, 3, date(2026, 4, 3), None, 0, 0)], "player_id long, game_id long, game_date date, goals long, assists long, saves long")
    assert tuple(E.career(s).first()) == (1, 3, 6, 1, 0, 2, 3, 2)


def test_recent_games_end_today(spark):
    g = spark.createDataFrame([(date(2026, 4, n),) for n in (1, 2, 8, 9)], "game_date date")
    assert sorted(r[0].day for r in E.recent_games(g, date(2026, 4, 8)).collect()) == [2, 8]
