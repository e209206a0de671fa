"""Declared schemas, tables that change together, league syncs, career prose and box scores."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitchside.functions import htmltables
from pitchside.operators import league_sync, prose
from pitchside.sources.schemas import Add, Change, Drop, Rename, TableSchema
from pitchside.sources.table_set import Conflict, TableSet

SCORES = TableSchema("scores", "id long, pts int", ["id"])


def test_evolutions_apply_on_read(spark, tmp_path):
    steps = [[Add("season", "long", 2026), Rename("pts", "points")], [Change("points", lambda c: c.cast("long")), Add("double_points", "long", F.col("points") * 2)], [Drop("season")]]
    newer = TableSchema("scores", "id long, pts int", ["id"], steps)
    rows = spark.createDataFrame([(1, 5), (2, None)], "id long, pts int")
    TableSet(spark, f"{tmp_path}/s", [SCORES]).commit({"scores": rows})
    later = TableSet(spark, f"{tmp_path}/s", [newer])
    assert later.read("scores").dtypes == [("id", "bigint"), ("points", "bigint"), ("double_points", "bigint")]
    assert sorted(map(tuple, later.read("scores").collect())) == [(1, 5, 10), (2, None, None)]
    later.commit({"scores": later.read("scores").withColumn("extra", F.lit(1))})  # columns that aren't declared are not written
    assert sorted(map(tuple, later.read("scores").collect())) == [(1, 5, 10), (2, None, None)]
    assert later.manifest()["scores"]["schema"] == 4
    with pytest.raises(ValueError, match="version 4 is unknown"):
        TableSet(spark, f"{tmp_path}/s", [SCORES]).read("scores")
    with pytest.raises(ValueError, match="points: IntegerType"):
        later.commit({"scores": spark.createDataFrame([(1, 2, 3)], "id long, points int, double_points long")})


def test_commits_are_all_or_nothing(spark, tmp_path):
    rows = lambda n: spark.range(n)
    t = TableSet(spark, f"{tmp_path}/t")
    assert t.commit({"a": rows(1), "b": rows(2)}) == 1
    broken = rows(3).withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        t.commit({"a": rows(9), "b": broken})
    assert (t.version(), t.read("a").count(), t.read("b").count()) == (1, 1, 2)
    assert t.commit({"b": rows(5)}) == 2  # tables that a commit doesn't name stay
    assert (t.read("a").count(), t.read("b").count(), t.read("b", 1).count()) == (1, 5, 2)
    with pytest.raises(ValueError, match="neither a version nor a schema"):
        t.read("c")


def test_one_of_two_writers_wins(spark, tmp_path):
    t, other = TableSet(spark, f"{tmp_path}/u"), TableSet(spark, f"{tmp_path}/u")
    base = t.commit({"a": spark.range(1)})
    other.commit({"a": spark.range(2)}, base)
    with pytest.raises(Conflict):
        t.commit({"a": spark.range(3)}, base)
    assert t.read("a").count() == 2
    seen = []

    def change(now):
        seen.append(now.read("a").count())
        if len(seen) == 1:  # another writer comes in between
            other.commit({"a": spark.range(7)})
        return {"a": spark.range(seen[-1] + 1)}

    assert t.update(change) == 4 and seen == [2, 7] and t.read("a").count() == 8
    t._created(f"{5:08d}.claim", "5")  # a writer that died
    with pytest.raises(Conflict):
        t.commit({"a": spark.range(1)})
    assert t.recover() == [5] and t.commit({"a": spark.range(1)}) == 5
    assert t.vacuum(1) == 4 and t.read("a").count() == 1


def test_sync_of_a_league(spark, tmp_path):
    tables = league_sync.league_tables(f"{tmp_path}/l", spark)
    row = '<tr class="tablecontent"><td>1</td><td><a href="{0}.asp">{1}</a></td><td>{2}</td><td>4</td><td>{3}</td><td>2</td><td>5</td><td>1</td><td>30</td></tr>'
    scorers = [row.format("Player", "7 - Jo Bee", "Reds", 3), row.format("Player", "9 - JO BEE", "reds", 8) + row.format("Player", "Cy Dee", "Blues", 1)]
    pages = spark.createDataFrame([(0, "scorers", scorers[0]), (1, "scorers", scorers[1]), (2, "standings", None)], "nth int, kind string, html string")
    day = [datetime(2026, 5, n) for n in (1, 2, 3, 4)]
    assert league_sync.sync_league(tables, 5, day[0], lambda: league_sync.scraped(pages)) == "success"
    players = lambda: sorted((r.name, r.team, r.jersey, r.goals, r.scraped_at) for r in tables.read("players").collect())
    first = [("Cy Dee", "Blues", None, 1, day[0]), ("Jo Bee", "Reds", 7, 3, day[0])]
    assert [(n, t, j if j != -1 else None, g, s) for n, t, j, g, s in players()] == first
    assert league_sync.sync_league(tables, 5, day[1], lambda: league_sync.scraped(pages.filter("false"))) == "empty"
    assert league_sync.sync_league(tables, 5, day[2], lambda: league_sync.scraped(pages.withColumn("html", F.raise_error(F.lit("gone")).cast("string")))) == "error"
    assert league_sync.sync_league(tables, 5, day[3], lambda: league_sync.scraped(pages.filter("nth = 1"))) == "success"
    assert [(n, g, s) for n, _, _, g, s in players()] == [("Cy Dee", 1, day[3]), ("JO BEE", 8, day[3]), ("Jo Bee", 3, day[0])]
    log = [(r.status, r.players) for r in tables.read("scrapes").orderBy("scraped_at").collect()]
    assert log == [("success", 2), ("empty", 0), ("error", 0), ("success", 2)] and tables.version() == 4


def test_career_prose(spark):
    lines = [
        ("p", "Amy Stone 3g, 1a (now has 173 career points)"), ("p", "Stone 2g (28)"), ("p", "Reed 1g (3 of 4) (a junior)"), ("p", "O'Hara 2g (41 overall)"), ("p", "Nobody 1g (first career)"),
        ("p", "Stone scored (career)"), ("p", "Reed 1g (2 of 3)"), ("q", "Stone 1g (record)"), ("p", "Li 9 goal (star)"), ("p", None),
    ]
    zero = dict.fromkeys(prose.CAPS, 0)
    stats = [("p", 1, "amy stone", zero | {"goals": 174}), ("p", 2, "stonewall jack", zero | {"goals": 3}), ("p", 3, "kim reed", zero | {"saves": 9}), ("p", 4, "tim ohara", zero | {"saves": 41}), ("p", 5, "lila", zero | {"assists": 5})]
    frame = spark.createDataFrame([(p, i, n, *c.values()) for p, i, n, c in stats], "post string, player_id int, name_key string, " + ", ".join(f"{c} long" for c in prose.CAPS))
    got = {(r.line, r.player_id): (r.category, r.marker, r.columns) for r in prose.career_prose(spark.createDataFrame(lines, "post string, line string"), frame).collect()}
    assert got == {
        (lines[0][1], 1): ("parsed-and-suspect", "now has", ["goals"]), (lines[0][1], 2): ("parsed-and-suspect", "now has", []),
        (lines[1][1], 1): ("parsed-and-suspect", None, ["goals"]), (lines[1][1], 2): ("parsed-and-suspect", None, []),
        (lines[2][1], 3): ("parsed-and-clean", "junior", []), (lines[3][1], 4): ("parsed-and-suspect", "overall", ["saves"]),
        (lines[4][1], None): ("not-parsed", "first career", None), (lines[7][1], None): ("not-parsed", "record", None),
        (lines[8][1], 5): ("parsed-and-clean", "star", []),
    }


def test_summary_posts(spark):
    rows = [("https://x/2026/a", "boys-summaries-4-1"), ("https://x/2025/a", "boys-summaries"), ("https://x/2026/a", "girls-boys-summaries"), ("https://x/2026/", "hs_boys_summary"), ("https://x/2026/", "hsboys-recaps"), ("https://x/2026/", "news")]
    out = spark.createDataFrame(rows, "url string, post string").select(prose.is_summary_post(F.col("url"), F.col("post")).alias("x")).collect()
    assert [r.x for r in out] == [True, False, False, False, True, False]


def test_cells_of_nested_spanning_and_broken_tables(spark):
    html = '<p>x<table><tr><th>A<th rowspan=2 colspan="2">B &amp; C<tr><td>1<table class=" in  ner "><td>i</table>2<td>3</tr><tr><td>4<td>5<td>6</table><table></table><td>stray</td><table><tr><td colspan="0">z'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<table>" * 3000)], "k int, html string")
    got = sorted(tuple(r) for r in htmltables.html_cells(pages, "k", "html").collect())
    assert got == [
        (1, 0, "", 0, 0, 0, "A", "A"), (1, 0, "", 0, 1, 1, "B & C", "B & C"), (1, 0, "", 1, 0, 0, "A", "12"), (1, 0, "", 1, 1, 3, "", "3"),
        (1, 0, "", 2, 0, 0, "A", "4"), (1, 0, "", 2, 1, 1, "B & C", "5"), (1, 0, "", 2, 2, 2, "B & C", "6"), (1, 1, "in ner", 0, 0, 0, "i", "i"), (1, 3, "", 0, 0, 0, "z", "z"),
    ]


def test_scores_by_containment(spark):
    rows = [("Spring-Ford", "Owen J.", "SPRING FORD Rams", "Owen J. Roberts", 1, 2), ("Oak", "Elm", "Elm", "Oak", 3, 4), ("Oak", "Elm", "Ash", "Elm", 5, 6)]
    frame = spark.createDataFrame(rows, "h string, a string, t1 string, t2 string, s1 int, s2 int")
    out = frame.select(htmltables.scores_of(F.col("h"), F.col("a"), (F.col("t1"), F.col("t2")), (F.col("s1"), F.col("s2"))).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in out] == [(1, 2), (4, 3), None]
