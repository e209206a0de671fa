"""Workbooks, rosters, re-attribution, exports, bucketed merges and numbering."""

import json

import pytest
from pyspark.sql import functions as F

from pitchside.operators import imports
from pitchside.sources import exports
from pitchside.sources.buckets import BucketedTable
from pitchside.sources.numbering import numbered
from pitchside.sources.table_set import TableSet
from pitchside.streaming.ingest import ingest_files

rows_of = lambda f: sorted(map(tuple, f.collect()), key=repr)


def test_sheet_lines(spark):
    rows = [
        ("Oak", {"Player": " Jo Bee ", "G": "2", "A": "x", "GBs": "3.9", "F/O": "4 / 9"}), ("Oak", {"NAME": "Al", "caused_turnovers": "-2", "Face-Offs": "7"}), ("Oak", {"Player": "Nil", "G": "0"}),
        ("Oak", {"Player": "", "G": "5"}), ("Oak", {"G": "5"}), ("Oak", None),
    ]
    got = rows_of(imports.sheet_lines(spark.createDataFrame(rows, "sheet string, cells map<string,string>")))
    assert got == [("Oak", "Al", 0, 0, 0, 0, 0, 7, 0), ("Oak", "Jo Bee", 2, 0, 3, 0, 0, 4, 9)]


@pytest.fixture(scope="module")
def book(spark):
    row = lambda sheet, name, **c: (sheet, {"Player": name, **{k: str(v) for k, v in c.items()}})
    rows = [row("Oaks", "Jo Bee", Goals=2), row("Oaks", "Bee", Goals=1), row("Oaks", "Zed Newman", G=4), row("Elms", "zed newman", G=1), row("Elms", "J Bee", Saves=3), row("Elms", "Kim Rue", A=1), row("Nowhere", "Jo Bee", G=9), row("Totals", "Jo Bee", G=99)]
    opponents = spark.createDataFrame([(7, "Oaks", "oaks", [], 1, 70), (8, "Elms", "elms", [], 1, 80), (9, "Ash", "ash", [], 1, 90)], "team_id long, name string, slug string, aliases array<string>, games int, game_id long")
    people = spark.createDataFrame([(1, 3, "Jo Bee", 5), (2, 3, "Kym Rose", 0), (3, 3, "Kym Roe", 0), (4, 3, "Kim Ro", 0), (10, 4, "Jo Bee", 1)], "player_id long, team_id long, name string, stat_rows long")
    return spark.createDataFrame(rows, "sheet string, cells map<string,string>"), opponents, people


def test_import_plans_and_replaces(spark, book):
    rows, opponents, people = book
    plan = imports.plan_import(rows, 3, opponents, people)
    assert rows_of(plan.sheets) == [("Elms", 80, None), ("Nowhere", None, "none"), ("Oaks", 70, None)]
    assert rows_of(plan.created) == [(11, 3, "Zed Newman", "zed newman")]
    assert rows_of(plan.aliases) == [("bee", 1, 0.91), ("j bee", 1, 0.94)] and rows_of(plan.skipped) == [("Elms", "Kim Rue", "several equally near")]
    assert rows_of(plan.stats.select("game_id", "player_id", "goals", "saves")) == [(70, 1, 3, 0), (70, 11, 4, 0), (80, 1, 0, 3), (80, 11, 1, 0)]
    zeros = [0] * 6
    before = spark.createDataFrame([(70, 1, 9, *zeros), (70, 2, 9, *zeros), (70, 10, 9, *zeros), (90, 1, 9, *zeros)], "game_id long, player_id long, " + ", ".join(f"{c} long" for c in imports.COUNTS))
    after = imports.apply_import(before, people, plan, 3)
    assert rows_of(after.select("game_id", "player_id", "goals")) == [(70, 1, 3), (70, 10, 9), (70, 11, 4), (80, 1, 0), (80, 11, 1), (90, 1, 9)]
    assert rows_of(imports.apply_import(after, people.unionByName(plan.created.select("player_id", "team_id", "name", F.lit(0).cast("long").alias("stat_rows"))), plan, 3)) == rows_of(after)


def test_roster_keeps_jerseys(spark):
    people = spark.createDataFrame([(1, 3, "Jo Bee", 7), (2, 3, "Al Roe", None), (3, 4, "Jo Bee", 9)], "player_id long, team_id long, name string, jersey long")
    roster = spark.createDataFrame([(3, "JO BEE", None, 1), (3, "Al Roe", 5, 2), (3, "New One", 8, 3), (3, "new  one", None, 4), (5, "Other", None, 5), (3, " ", 1, 6)], "team_id long, name string, jersey long, nth int")
    out = imports.upsert_roster(people, roster)
    assert rows_of(out) == [(1, 3, "JO BEE", 7), (2, 3, "Al Roe", 5), (3, 4, "Jo Bee", 9), (4, 3, "new  one", 8), (5, 5, "Other", None)]
    lines = spark.createDataFrame([(3, "jo bee", 5), (3, "Who", 5), (3, "Who", 99), (3, None, None), (4, "Jo Bee", 7)], "team_id long, name string, jersey long")
    assert rows_of(imports.match_people(lines, out)) == [(3, "Who", 5, 2), (3, "Who", 99, None), (3, "jo bee", 5, 1), (3, None, None, None), (4, "Jo Bee", 7, 3)]


def test_junk_is_judged_in_order(spark):
    people = spark.createDataFrame([(1, 1, "Goalie"), (2, 1, "Sub"), (3, 1, "Jo Bee"), (4, 1, "X"), (5, 1, "Al Roe"), (6, 1, "Team"), (7, 2, "Jo Bee"), (8, 1, "Two")], "player_id long, team_id long, name string")
    stats = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (12, 2), (10, 3), (13, 4), (14, 6), (12, 8), (15, 8)], "game_id long, player_id long")
    decisions = [
        (1, 1, "reattribute", "Jo Bee"), (2, 2, "reattribute", "Jo Bee"), (3, 8, "reattribute", "Jo Bee"), (4, 4, "rename", "Cy Dee"), (5, 6, "rename", "Cy Dee"), (6, 5, "rename", "Al Roe"),
        (7, 99, "rename", "Gone"), (8, 4, "rename", "--"), (9, 6, "rename", "al roe"), (10, 6, "flag", None), (11, 7, "reattribute", "Nobody Here"),
    ]
    judged = imports.judge_junk(spark.createDataFrame(decisions, "nth int, player_id long, kind string, name string"), people, stats)
    got = {r.nth: (r.verdict, r.reason, r.target_id) for r in judged.collect()}
    assert got == {
        1: ("rejected", "has rows of the contest", 3), 2: ("planned", None, 3), 3: ("rejected", "has rows of the contest", 3), 4: ("planned", None, None), 5: ("rejected", "name is taken", None), 6: ("done", None, None),
        7: ("done", None, None), 8: ("rejected", "empty key", None), 9: ("rejected", "name is taken", None), 10: ("planned", None, None), 11: ("rejected", "nobody has the name", None),
    }
    after, rows, flags = imports.apply_junk(judged, people, stats)
    assert rows_of(after.select("player_id", "name")) == [(1, "Goalie"), (3, "Jo Bee"), (4, "Cy Dee"), (5, "Al Roe"), (6, "Team"), (7, "Jo Bee"), (8, "Two")]
    assert rows_of(rows) == [(10, 1), (10, 3), (11, 1), (11, 3), (12, 3), (12, 8), (13, 4), (14, 6), (15, 8)] and rows_of(flags) == [(6, 14, "Team")]


def test_export_is_judged_by_its_write(spark, tmp_path):
    rows = spark.range(100).withColumn("team", F.col("id") % 25)
    ok = exports.export(rows, f"{tmp_path}/a", exports.Bounds("a", min_bytes=50, min_rows=100))
    assert (ok["rows"], ok["verdict"]) == (100, "ok") and ok["bytes"] > 50
    assert exports.export(rows, f"{tmp_path}/t", exports.Bounds("t", min_files=20, by="team"))["files"] == 25
    assert exports.export(rows.filter("team < 3"), f"{tmp_path}/t", exports.Bounds("t", min_files=20, by="team"))["verdict"] == "too few files"
    assert exports.export(rows.limit(0), f"{tmp_path}/z", exports.Bounds("z"))["verdict"] == "too small"
    assert exports.export(rows, f"{tmp_path}/r", exports.Bounds("r", min_rows=101))["verdict"] == "too few rows"
    assert exports.validate(spark, {f"{tmp_path}/a": exports.Bounds("a"), f"{tmp_path}/none": exports.Bounds("n"), f"{tmp_path}/t": exports.Bounds("t", 1_000_000)}) == [("a", "ok"), ("n", "missing"), ("t", "too small")]


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/b", spark.createDataFrame([], "k long, v string, at int").schema, ["k"], buckets=16)
    assert t.read().collect() == []
    rows = lambda data: spark.createDataFrame(data, "k long, v string, at int")
    assert len(t.merge(rows([(i, "old", 0) for i in range(200)]), [F.desc("at")])) == 16
    before = t.set.manifest()
    touched = t.merge(rows([(5, "a", 1), (5, "b", 2), (1000, "new", 1)]), [F.desc("at")])
    after = t.set.manifest()
    assert 1 <= len(touched) <= 2 and {n for n in after if after[n] != before[n]} == {f"{b:05d}" for b in touched}
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 201 == t.read().count() and got[5] == "b" and got[1000] == "new" and got[6] == "old"
    t.merge(rows([(5, "a", 1), (5, "b", 2), (1000, "new", 1)]), [F.desc("at")])
    assert {r.k: r.v for r in t.read().collect()} == got and t.merge(rows([]), [F.desc("at")]) == []


def test_stream_into_buckets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "k long, v string").schema
    t = BucketedTable(spark, f"{tmp_path}/s", schema, ["k"], buckets=8)
    run = lambda: ingest_files(spark, f"{tmp_path}/in", schema, "json", t, ["k"], [F.col("v")], f"{tmp_path}/c").awaitTermination(60)
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"k": i, "v": "a"}) for i in range(40)))
    run()
    first = t.set.manifest()
    (tmp_path / "in/2.json").write_text(json.dumps({"k": 3, "v": "z"}))
    run()
    assert {r.k: r.v for r in t.read().collect()} == {i: "z" if i == 3 else "a" for i in range(40)}
    assert sum(first[n] != e for n, e in t.set.manifest().items()) == 1


def test_numbering_is_gapless(spark):
    rows = spark.range(1000).withColumn("k", F.concat(F.lit("x"), (F.col("id") * 7919 % 1000).cast("string")))
    got = numbered(rows, "k", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert numbered(rows.filter("false"), "k", "n").collect() == []


def test_table_set_of_a_stream_is_readable_by_version(spark, tmp_path):
    t = TableSet(spark, f"{tmp_path}/v")
    t.commit({"a": spark.range(3)})
    t.commit({"a": spark.range(5)})
    assert [t.read("a", v).count() for v in (1, 2)] == [3, 5]
