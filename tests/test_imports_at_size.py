"""What an import does once for a header, a name or a length, however many lines there are."""

from pyspark.sql import functions as F

from pitchside.operators import imports, near_names, waterfall


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_headers_are_read_once_a_line(spark):
    cells = F.create_map(F.lit("Player"), F.lit("Amy"), F.lit("Goals"), F.col("id").cast("string"), F.lit("F/O"), F.lit("2 / 9"))
    lines = imports.sheet_lines(spark.range(3).select(F.lit("s").alias("sheet"), cells.alias("cells")))
    assert [(r.name, r.goals, r.fo_won, r.fo_taken) for r in lines.orderBy("goals").collect()] == [("Amy", n, 2, 9) for n in range(3)]
    assert _plan(lines).count("regexp_replace") == 1


def test_first_header_of_a_column_counts(spark):
    rows = spark.sql("SELECT 's' AS sheet, explode(array(map('NAME', ' Amy ', 'player', 'Bo', 'G', '2', 'Goals', '5'), map('Ground_Balls', '3', 'x', '4', 'Name!', 'Cy'), map('player', CAST(NULL AS STRING), 'g', '1'))) AS cells")
    assert sorted((r.name, r.goals, r.ground_balls) for r in imports.sheet_lines(rows).collect()) == [("Amy", 2, 0), ("Cy", 0, 3)]


def test_sheets_are_judged_after_they_are_told_apart(spark, monkeypatch):
    """Whether a sheet holds totals is asked of each sheet, not of each line."""
    seen = []
    monkeypatch.setattr(imports, "pick_opponents", lambda sheets, _: seen.append(sheets) or sheets.withColumn("team_id", F.lit(1)).withColumn("reason", F.lit(None)))
    rows = spark.range(9).select(F.when(F.col("id") % 3 == 0, "Totals").otherwise("Oaks").alias("sheet"))
    imports.picked_sheets(rows, spark.createDataFrame([(1, 7)], "team_id int, game_id int"))
    plan = _plan(seen[0])
    assert [r.sheet for r in seen[0].collect()] == ["Oaks"] and plan.index("regexp_replace") < plan.index("Aggregate")


def test_result_makes_no_key_or_pair_anew(spark):
    people = spark.range(20).selectExpr("id AS player_id", "1 AS team_id", "concat('amy stone', repeat('x', CAST(id AS INT))) AS name", "1 AS stat_rows")
    asked = spark.createDataFrame([(1, n) for n in ("stone", "amy stones", "bo reed", "amy stone", "a. stonex", "")], "team_id int, name string")
    plan = _plan(waterfall.resolve_people(asked, people))
    assert "regexp_replace" not in plan and "xxhash64" not in plan


def test_keys_are_made_for_lengths_that_there_are(spark, monkeypatch):
    rows, real = [], near_names.spread

    def counted(frame, *keys):
        if isinstance(keys[-1], str):
            rows.append(frame.count())
        return real(frame, *keys)

    monkeypatch.setattr(near_names, "spread", counted)
    cut = spark.createDataFrame([(1, "a" * 20), (1, "bc" * 11)], "t int, text string")
    told = spark.createDataFrame([(1, "d" * 24), (1, "e" * 29), (1, "bc" * 11)], "t int, text string")
    got = near_names.candidates(cut, told, ["t"], *near_names.within(2)).collect()
    alone = near_names.candidates(cut, told.filter("text LIKE 'e%'"), ["t"], *near_names.within(2))
    assert [(r.x, r.y) for r in got] == [("bc" * 11, "bc" * 11)] and alone.count() == 0 and rows[2] == 0


def test_lines_meet_people_without_a_sort(spark):
    nations = spark.createDataFrame([(1, "Oaks", "oaks", [], 1, 7)], "team_id long, name string, slug string, aliases array<string>, games int, game_id long")
    people = spark.createDataFrame([(5, 3, "Amy Bee", 0)], "player_id long, team_id long, name string, stat_rows long")
    rows = spark.range(6).select(F.lit("Oaks").alias("sheet"), F.create_map(F.lit("Player"), F.when(F.col("id") < 4, "Amy Bee").otherwise("Bo Cee"), F.lit("G"), F.lit("2")).alias("cells"))
    stats = imports.plan_import(rows, 3, nations, people).stats
    plan = stats._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.player_id, r.goals) for r in stats.collect()) == [(5, 8), (6, 4)] and "ShuffledHashJoin [name" in plan
