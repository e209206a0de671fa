from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from pitchside.functions import text
from pitchside.operators import league, reconciliation as R
from pitchside.sources import files

GAME = "game_date date, season long, home_id long, away_id long, home_score long, away_score long, postponed boolean, provenance string"
TEAMS = [(1, "Ash"), (2, "Birch"), (3, "Cedar")]


@pytest.fixture(scope="module")
def games(spark):
    d = lambda n: date(2026, 4, n)
    rows = [
        (d(1), 2026, 1, 2, 5, 3, False, None), (d(2), 2026, 2, 1, 4, 6, False, None), (d(3), 2026, 1, 2, 0, 0, False, None), (d(4), 2026, 1, 2, None, None, False, None),
        (d(5), 2026, 2, 1, 7, 2, False, None), (d(6), 2026, 1, 2, 1, 1, False, None),
    ]
    return spark.createDataFrame(rows, GAME)


def test_standings_skip_unplayed(games):
    got = {r.team_id: (r.games, r.wins, r.losses, r.ties, r.pf, r.pa) for r in league.standings(games).collect()}
    assert got == {1: (4, 2, 1, 1, 14, 15), 2: (4, 1, 2, 1, 15, 14)}


def test_streak_texts(spark, games):
    teams = spark.createDataFrame(TEAMS, "team_id long, name string")
    of = lambda g: {r.team_id: r.streak for r in league.streak_texts(g, teams).collect()}
    assert of(games) == {1: "T1", 2: "T1", 3: "W0"}
    assert of(games.filter("game_date <= '2026-04-02'")) == {1: "W2", 2: "L2", 3: "W0"}
    assert of(games.limit(0)) == {1: "W0", 2: "W0", 3: "W0"}


def test_radar_of_one_pair(games):
    got = {(r.team_id, r.axis): (round(r.value, 3), r.percentile) for r in league.radar_axes(games).collect()}
    assert got[1, "win_pct"] == (0.667, 0.75) and got[2, "win_pct"] == (0.333, 0.25)
    assert got[1, "defense"] == (5.0, 0.25) and got[2, "defense"] == (4.667, 0.75)
    assert got[1, "sos"][0] == 0.333 and len(got) == 12
    assert league.radar_axes(games.limit(0)).count() == 0


def test_closing_runs(spark):
    s = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 2, 1), (1, 2, 5, 1), (2, 0, 0, 0), (2, 1, 4, 1), (3, 0, 0, 0)], "game_id long, period int, home long, away long")
    assert [tuple(r) for r in league.closing_runs(s).collect()] == [(1, 2, True, 3)]


def test_preview_confirm_revert(spark):
    schema = "k long, a string, b long"
    old = spark.createDataFrame([(1, "x", 1), (2, None, None), (3, "z", 3)], schema)
    batch = spark.createDataFrame([(1, "x", 1), (2, "new", None), (9, None, 9), (9, "later", 9)], schema)
    plan = R.preview(old, batch, ["k"], [F.col("a").asc_nulls_first()])
    assert {r.k: r.action for r in plan.collect()} == {1: "same", 2: "update", 9: "insert"}
    after = R.confirm(old, plan, ["k"])
    assert sorted(map(tuple, after.collect())) == [(1, "x", 1), (2, "new", None), (3, "z", 3), (9, None, 9)]
    assert sorted(map(tuple, R.revert(after, plan, ["k"]).collect())) == sorted(map(tuple, old.collect()))
    assert R.preview(old, batch.limit(0), ["k"], [F.col("a")]).count() == 0


def test_score_decision_and_correction(spark):
    rows = spark.createDataFrame([(1, 3, None), (3, 3, 4), (1, 3, 2), (1, 3, 8), (1, 3, 9)], "c long, s long, o long")
    assert [r[0] for r in rows.select(R.score_decision(F.col("c"), F.col("s"), F.col("o"))).collect()] == ["no_source", "not_suspect", "below_sum", "apply", "above_ceiling"]
    fix = spark.createDataFrame([("goals", 2, 10), ("goals", 2, 11), ("goals", 0, 15), ("goals", None, 16), ("saves", 1, 40), ("name", None, None)], "f string, o long, n long")
    assert [r[0] for r in fix.select(R.correction_status(F.col("f"), F.col("o"), F.col("n"))).collect()] == ["pending", "outlier", "pending", "outlier", "pending", "pending"]


def test_names_resolve_by_alias_first(spark):
    teams = spark.createDataFrame([(1, "Ash"), (2, "Birch"), (3, "Ash (PA)")], "team_id long, name string")
    aliases = spark.createDataFrame([("Birch", 7), ("BB", 2), (None, 4)], "alias string, team_id long")
    rows = spark.createDataFrame([("ash high school",), ("birch",), (" bb ",), ("oak",), (None,)], "raw string")
    assert {r.raw: r.team_id for r in R.resolve_names(rows, "raw", teams, aliases).collect()} == {"ash high school": 1, "birch": 7, " bb ": 2, "oak": None, None: None}


def test_stale_season(games):
    of = lambda day: tuple(R.stale_season(games, day).first())
    assert of(date(2026, 4, 10)) == (date(2026, 4, 6), 4, False)
    assert of(date(2026, 4, 14)) == (date(2026, 4, 6), 8, True)
    assert of(date(2026, 7, 14))[2] is False
    assert of(date(2027, 3, 1)) == (None, None, True)


def test_split_names(spark):
    rows = spark.createDataFrame([("Al Bee, Cy Dee, and Ed Fox",), ("Al Bee and Cy Dee",), ("Andy Sand",), ("Al Bee and two others",), ("  ",), (None,)], "n string")
    got = [r[0] for r in rows.select(text.split_names(F.col("n"))).collect()]
    assert got == [["Al Bee", "Cy Dee", "Ed Fox"], ["Al Bee", "Cy Dee"], ["Andy Sand"], ["Al Bee and two others"], [], [None]]


def test_csv_and_pages(spark, tmp_path):
    schema = StructType().add("name", StringType()).add("goals", IntegerType())
    (tmp_path / "in.csv").write_bytes('name,goals\r\n"Bee, ""Al""",3\r\nCy,x\r\n,4\r\n'.encode())
    good, bad = files.read_csv(spark, str(tmp_path / "in.csv"), schema, ["name"])
    assert [tuple(r) for r in good.collect()] == [('Bee, "Al"', 3)] and bad.count() == 2
    files.write_csv(good, str(tmp_path / "out"), sep="\t")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True, sep="\t", escape='"', schema=schema).collect()] == [('Bee, "Al"', 3)]
    files.write_json(good, str(tmp_path / "json"))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "json"), schema).collect()] == [('Bee, "Al"', 3)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "post-7.html").write_text("<p>ä</p>")
    page = files.read_pages(spark, str(tmp_path / "pages")).first()
    assert (page.post_id, page.html, len(page.sha256)) == ("post-7", "<p>ä</p>", 64)
    rows = spark.createDataFrame([("/a?x=1&y=2", date(2026, 4, 1)), ("/b", None)], "path string, modified date")
    assert [r[0] for r in files.sitemap_entries(rows, "https://e.org").collect()] == ["<url><loc>https://e.org/a?x=1&amp;y=2</loc><lastmod>2026-04-01</lastmod></url>", "<url><loc>https://e.org/b</loc></url>"]
