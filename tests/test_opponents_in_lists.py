"""A contest meets lists of its opponent's aliases; the last step makes a row of each."""

from pitchside.operators import feeds


def test_every_alias_of_every_contest(spark, monkeypatch):
    monkeypatch.setattr(feeds, "LIST", 3, raising=False)
    games = spark.range(40).selectExpr("id AS game_id", "current_date() AS game_date", "IF(id % 2 = 0, 3L, id % 8) AS home_id", "IF(id % 2 = 0, id % 8, 3L) AS away_id")
    teams = spark.range(8).selectExpr("id AS team_id", "concat('t', id) AS name")
    aliases = spark.range(50).selectExpr("id % 5 AS team_id", "IF(id = 4, NULL, concat('a', id % 30)) AS alias")  # some twice, one null, none of teams 5 to 7
    out = feeds.opponents_of(games, 3, teams, aliases)
    mine = games.selectExpr("game_id", "game_date", "IF(home_id = 3, away_id, home_id) AS team_id", "home_id", "away_id").filter("home_id = 3 OR away_id = 3")
    want = mine.join(teams, "team_id").join(aliases, "team_id", "left").select("game_id", "game_date", "name", "alias")
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    assert "Generate inline(aliases" in out._jdf.queryExecution().sparkPlan().toString()
