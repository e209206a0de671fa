from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pitchside.functions import parsers, text
from pitchside.operators import coach_reports, merge, period_flow, player_analytics, team_analytics
from pitchside.operators.core import two_sided, with_mid_rank
from pitchside.sources.tables import VersionedTable
from pitchside.streaming.ingest import ingest_files

GAME = "game_date date, season long, home_id long, away_id long, home_score long, away_score long, postponed boolean, provenance string"


@pytest.fixture(scope="module")
def games(spark):
    d = date(2026, 4, 1)
    rows = [(d, 2026, 1, 9, 10, 7, False, "a"), (d, 2026, 2, 9, 5, 5, False, "a"), (d, 2026, 9, 1, 8, 4, False, "b"), (d, 2026, 1, 2, 0, 0, True, "a")]
    return spark.createDataFrame(rows, GAME)


def test_pairs_that_share_a_team_and_sources_stay_apart(games):
    edges = {(r.team_a, r.team_b): (r.games, r.margin_sum, r.mean_margin) for r in team_analytics.rivalry_edges(games).collect()}
    assert edges == {(1, 9): (2, 7, 3.5), (2, 9): (1, 0, 0.0)}


def test_totals_by_policy(games):
    counts = {r.team_id: (r.games, r.wins, r.losses, r.ties) for r in team_analytics.team_totals(games).collect()}
    assert counts == {1: (3, 1, 1, 0), 2: (2, 0, 0, 1), 9: (3, 1, 1, 1)}
    assert {r.team_id: r.games for r in team_analytics.team_totals(games, "ignore").collect()} == {1: 2, 2: 1, 9: 3}


def test_two_sided_reads_once(games):
    assert two_sided(games).count() == 8


def test_scorers_are_filtered_on_sums(spark):
    s = spark.createDataFrame([(1, 1, "A", 5, 0), (2, 1, "A", 0, 0)], "game_id long, player_id long, player_name string, goals long, assists long").withColumn("team_id", F.lit(1))
    assert [r.points for r in player_analytics.top_scorers(s).collect()] == [5]


def test_streak_of_ties_and_full_length(spark):
    s = spark.createDataFrame([(1, i, o) for i, o in enumerate([0, 0, 1])] + [(2, i, -1) for i in range(12)], "k int, n int, o int")
    got = {r.k: r.streak for r in player_analytics.streaks(s, "k", [F.col("n")], F.col("o")).collect()}
    assert got == {1: 0, 2: -10}


def test_mid_rank_ties_and_single(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 7.0), ("a", None)], "k string, v double")
    got = sorted((r.k, r.v, r.p) for r in with_mid_rank(s, ["k"], F.col("v"), "p").collect() if r.v is not None)
    assert got == [("a", 1.0, 1 / 3), ("a", 1.0, 1 / 3), ("a", 3.0, 2.5 / 3), ("b", 7.0, 0.5)]


def test_upsert_policies_and_idempotence(spark):
    old = spark.createDataFrame([(1, "Jo", 3), (2, "Al", 1)], "k int, name string, v int")
    new = spark.createDataFrame([(1, "Joanna", None), (3, "Bo", 5), (3, "Zo", 9)], "k int, name string, v int")
    once = merge.upsert(old, new, ["k"], [F.col("name")], {"name": merge.LONGEST, "v": merge.REPLACE_IF_GIVEN})
    want = [Row(k=1, name="Joanna", v=3), Row(k=2, name="Al", v=1), Row(k=3, name="Bo", v=5)]
    assert sorted(once.collect()) == want
    assert sorted(merge.upsert(once, new, ["k"], [F.col("name")], {"name": merge.LONGEST, "v": merge.REPLACE_IF_GIVEN}).collect()) == want
    assert sorted(r.k for r in merge.insert_absent(old, new, ["k"], [F.col("name")]).collect()) == [1, 2, 3]


def test_redirect_keeps_what_was_there(spark):
    rows = spark.createDataFrame([(1, 10, 5), (1, 11, 7), (2, 11, 2)], "game int, player int, goals int")
    mapping = spark.createDataFrame([(11, 10)], "old int, new int")
    assert sorted(tuple(r) for r in merge.redirect(rows, mapping, "player", ["game", "player"], [F.col("goals")]).collect()) == [(1, 10, 5), (2, 10, 2)]


def test_dead_letters(spark):
    good, bad = parsers.split_parsed(spark.createDataFrame([("1. Radnor",), ("Radnor",), ("101 Radnor",)], "l string"), parsers.ranking_line(F.col("l")))
    assert [(r["rank"], r.team) for r in good.collect()] == [(1, "Radnor")] and bad.count() == 2


@pytest.mark.parametrize("cell,want", [("2026-04-01", date(2026, 4, 1)), ("4/1/2026", date(2026, 4, 1)), ("4/1/26", date(2026, 4, 1)), ("46113", date(2026, 4, 1)), ("soon", None), (None, None)])
def test_days(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(text.parse_day(F.col("c"))).first()[0] == want


def test_names(spark):
    row = spark.createDataFrame([("  Lower  Merion HS (PA)", "St. Joe's & Co", "https://x.org/a/b/?q=1")], "a string, b string, u string")
    got = row.select(text.team_key(F.col("a")), text.slug(F.col("b")), text.last_segment(F.col("u"))).first()
    assert tuple(got) == ("lower merion", "st-joes-and-co", "b")


def test_stream_is_idempotent(spark, tmp_path):
    schema = "k int, v int"
    spark.createDataFrame([(1, 1), (2, 2)], schema).write.json(str(tmp_path / "in"))
    target = VersionedTable(spark, str(tmp_path / "t"))
    run = lambda c: ingest_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "json", target, ["k"], [F.col("v")], str(tmp_path / c)).awaitTermination(60)
    run("c1")
    spark.createDataFrame([(2, 7), (3, 3)], schema).write.mode("append").json(str(tmp_path / "in"))
    run("c1")
    want = [(1, 1), (2, 7), (3, 3)]
    assert sorted(tuple(r) for r in target.read().collect()) == want
    run("c1")
    assert sorted(tuple(r) for r in target.read().collect()) == want and len(target.versions()) == 2


def test_practice_rules_need_three_recent_and_some_before(spark):
    fields = "team_id long, game_id long, game_date date, goals long, goals_against long, assists long, ground_balls long, saves long, fo_won long, fo_taken long"
    day = lambda i: date(2026, 3, i)
    rows = [(1, i, day(i), 5, i, 4, 20 - i, 30, 5, 10) for i in range(1, 6)] + [(2, i, day(i), 5, 2, None, 3, None, 4, 10) for i in range(1, 3)]
    found = {(r.team_id, r.area) for r in coach_reports.practice_focus(spark.createDataFrame(rows, fields)).collect()}
    assert found == {(1, "Ground Balls"), (1, "Defense"), (2, "Faceoffs"), (2, "Ball Movement / Passing"), (2, "Goalie Training")}


def test_running_scores_fill_periods_and_first_largest_lead_counts(spark):
    periods = spark.createDataFrame([(1, 1, True, 2), (1, 3, False, 4), (1, 5, True, 1), (1, None, True, 9)], "game_id long, period int, at_home boolean, goals int")
    scores = period_flow.running_scores(periods)
    assert [tuple(r)[1:] for r in scores.orderBy("period").collect()] == [(0, 0, 0), (1, 2, 0), (2, 2, 0), (3, 2, 4), (4, 2, 4), (5, 3, 4)]
    assert tuple(period_flow.largest_leads(scores).first()) == (1, 3, 4, 2, 1)
