"""Steps whose work grew faster than their input, and ties at a bound."""

from pyspark.sql import functions as F

from pitchside.operators import cross_checks, feeds, imports, matching, prose, resolution, team_analytics, waterfall
from pitchside.operators.core import spread
from pitchside.plans import merge_suite, page_suite, registry, text_suite

SF = "/root/testdata/sf0.001"
#: Mean and one and a half deviations make exactly 8 and 7.
TIES = [[4, 4, 7, 1, 5, 5, 8, 6, 5], [2, 4, 1, 7, 5, 3, 8, 5, 3, 3, 4, 5, 2]]


def test_career_prose_makes_no_parts_of_all_names(spark):
    lines = spark.createDataFrame([(1, "Bee 2g (60 points)")], "post long, line string")
    stats = spark.createDataFrame([(1, 5, "amy bee", *[0] * 7), (2, 6, "amy bee", *[0] * 7)], "post long, player_id long, name_key string, " + ", ".join(f"{c} long" for c in prose.CAPS))
    out = prose.career_prose(lines, stats)
    assert [(r.player_id, r.category) for r in out.collect()] == [(5, "parsed-and-clean")]
    assert "sequence(" not in out._jdf.queryExecution().analyzed().toString()


def test_roster_with_one_first_name_does_not_meet_by_the_square(spark, monkeypatch):
    n, met, real = 200, [], matching.candidates
    last = F.concat(F.repeat(F.translate(F.lpad((F.col("id") * 49_731 % 10_000_000).cast("string"), 7, "0"), "0123456789", "abcdefghij"), 3), F.lit("z"))
    roster = spark.range(n).select(F.lit("T").alias("team_id"), F.col("id").alias("athlete_id"), F.col("id").alias("nth"), F.lit("Jonathan").alias("first"), last.alias("last"))

    def counted(*args):
        out = real(*args).cache()
        met.append(out.count())
        return out

    monkeypatch.setattr(matching, "candidates", counted)
    got = matching.match_roster(roster.select("team_id", F.expr("concat(first, ' ', substr(last, 3))").alias("name")), roster)
    assert got.filter("way = 'edits'").count() == n and sum(met) < n * n / 10


def test_value_at_the_bound_is_no_outlier(spark):
    rows = [(g, i, v) for g, values in enumerate(TIES) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "player_id int, game_id int, goals long").coalesce(1)
    assert team_analytics.outliers(frame, "player_id", "goals", 1.5, 5.0).collect() == [(1, 6, 8)]


def test_sheets_need_no_people(spark, monkeypatch):
    monkeypatch.setattr(imports, "resolve_people", None)
    assert registry.queries()["m13_sheets"](spark, SF).count() == 10


def test_lines_are_parsed_by_all_cores(spark):
    assert text_suite._parts(spark, SF).rdd.getNumPartitions() >= 4 and spread(spark.range(1), "id").rdd.getNumPartitions() >= 4


def test_names_meet_distinct_last_names_not_people(spark, monkeypatch):
    met, real = [], waterfall._canonical

    def counted(rows, *rest):
        met.append(rows.count())
        return real(rows, *rest)

    monkeypatch.setattr(waterfall, "_canonical", counted)
    people = spark.range(300).selectExpr("id AS player_id", "1 AS team_id", "concat(IF(id % 2 = 0, 'amy', 'bo'), ' stone') AS name", "id % 40 AS stat_rows")
    asked = spark.createDataFrame([(1, n) for n in ("stone", "stonee", "stne", "a stone", "b stone")], "team_id int, name string")
    got = {r.key: (r.kind, r.reason) for r in waterfall.resolve_people(asked, people).collect()}
    assert set(got.values()) == {("skipped", "several last names"), ("skipped", "several of this last name and initial")} and sum(met) <= 10


def test_cross_checks_sort_no_player_rows_or_contests(spark):
    page = lambda: page_suite.QUERIES["d23_cross_checks"](spark, SF)
    plan = page()._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    games = spark.createDataFrame([(1, 1996, True, 1, 2, 9, 9), (2, 1996, True, 1, 2, 9, 9)], "game_id long, season int, postponed boolean, home_id long, away_id long, home_score long, away_score long")
    rows = [(5, "amy bee", 1, g, 1996, n, 0) for g, n in ((2, 8), (1, 8), (3, 0))] + [(6, None, 1, 2, 1996, 9, 0), (6, None, 1, 1, 1996, 1, 0), (7, "bo cee", 1, 9, 1996, 12, 0)]
    stats = spark.createDataFrame(rows, "player_id long, player_name string, team_id long, game_id long, season int, goals long, assists long")
    got = {tuple(r) for r in cross_checks.cross_checks(stats, games, 1996).filter("strategy LIKE '%concentration'").select("player_id", "game_id", "found", "bound").collect()}
    assert got == {(6, 2, 9, 10)}


def test_logos_send_no_table_to_the_driver(spark, monkeypatch):
    plans, real = [], waterfall.written

    def seen(frame, tag):
        plans.append(frame._jdf.queryExecution().sparkPlan().toString())
        return real(frame, tag)

    monkeypatch.setattr(waterfall, "written", seen)
    matched, unmatched = merge_suite._logos(spark, SF)
    plans += [x._jdf.queryExecution().sparkPlan().toString() for x in (matched, unmatched)]
    assert not [p for p in plans if "Broadcast" in p]
    assert sum("RLIKE" in p or "regexp_replace" in p for p in plans) == 3  # keys of teams, of schools and of overrides are made once each


def test_pairs_of_one_key_are_made_in_shares(spark):
    people = spark.range(120).selectExpr("id", "1L AS team_id", "IF(id % 2 = 0, 'Peirce SMALL', 'Pierce SMALL') AS name")
    pairs = resolution.fuzzy_candidates(people, spark.range(5).selectExpr("id AS game_id", "id"))
    join = [x for x in pairs._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortMergeJoin" in x]
    assert pairs.count() == 3600 and pairs.select("left_id", "right_id").distinct().count() == 3600 and any("share#" in x for x in join)


def test_contests_are_dealt_by_opponent(spark):
    games = spark.range(400).coalesce(1).selectExpr("id AS game_id", "current_date() AS game_date", "3L AS home_id", "id % 20 AS away_id")
    teams, aliases = spark.range(20).selectExpr("id AS team_id", "concat('t', id) AS name"), spark.range(60).selectExpr("id % 20 AS team_id", "concat('a', id) AS alias")
    tasks = [n for n in feeds.opponents_of(games, 3, teams, aliases).select("opponent").rdd.map(lambda r: r[0]).glom().map(lambda x: (len(x), len(set(x)))).collect() if n[0]]
    assert sum(n for n, _ in tasks) == 1200 and len(tasks) >= 4 and max(t for _, t in tasks) <= 6
