"""Restated cases of names, lines and posts."""

import pytest
from pyspark.sql import functions as F

from pitchside.functions import names, parsers, posts


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()
    return row.x


def every(spark, f, cases):
    rows = [(i, *((k,) if isinstance(k, str) else k)) for i, (k, _) in enumerate(cases)]
    n = len(rows[0]) - 1
    frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{i} string" for i in range(n)))
    got = [r.x for r in frame.select("i", f(*[F.col(f"c{i}") for i in range(n)]).alias("x")).orderBy("i").collect()]
    return got, [w for _, w in cases]


def check(spark, f, cases, pick=lambda x: x):
    got, want = every(spark, f, cases)
    assert [pick(x) for x in got] == want


def test_score_lines(spark):
    check(
        spark,
        parsers.score_line,
        [
            ("Lower Merion 10, Harriton 9", ("Lower Merion", 10, "Harriton", 9, 0, False, None)),
            ("Radnor 8, Conestoga 7 (OT)", ("Radnor", 8, "Conestoga", 7, 1, False, None)),
            ("Radnor 8, Conestoga 7 (3OT)", ("Radnor", 8, "Conestoga", 7, 3, False, None)),
            ("Radnor 8, Conestoga 7, 2OT", ("Radnor", 8, "Conestoga", 7, 2, False, None)),
            ("Avon Grove 9, West Chester East 8 2OT", ("Avon Grove", 9, "West Chester East", 8, 2, False, None)),
            ("Radnor 8, Conestoga 7. OT", ("Radnor", 8, "Conestoga", 7, 1, False, None)),
            ("Team A 7, Team B 4,", ("Team A", 7, "Team B", 4, 0, False, None)),
            ("Abington Heights (district 2) 12, Delaware Valley 5", ("Abington Heights", 12, "Delaware Valley", 5, 0, False, None)),
            ("Radnor 0, Conestoga 0, ppd", ("Radnor", 0, "Conestoga", 0, 0, True, None)),
            ("Avon Grove 9, Wissahickon 8 (Cole’s Goals Benefit)", ("Avon Grove", 9, "Wissahickon", 8, 0, False, None)),
            ("Twin Valley 17 Daniel Boone 1", ("Twin Valley", 17, "Daniel Boone", 1, 0, False, None)),
            ("Notre Dame (NJ) 21 Pennsbury 10", ("Notre Dame", 21, "Pennsbury", 10, 0, False, None)),
            ("Penn 10 Trinity 7 OT (Senior Day)", ("Penn", 10, "Trinity", 7, 1, False, None)),
            ("Easton: 6, 3, 3, 2 – 14", (None, None, None, None, None, False, "no score pattern")),
            ("PR 4, DV 2", (None, None, None, None, None, False, "no score pattern")),
            ("Radnor at Conestoga, ppd.", (None, None, None, None, None, False, "no score pattern")),
            ("  ", (None, None, None, None, None, False, "empty")),
        ],
        tuple,
    )


def test_rankings(spark):
    check(spark, parsers.ranking_line, [("1. Spring-Ford", (1, "Spring-Ford", None)), ("2) Boyertown (last week: 4)", (2, "Boyertown", None)), ("3 Easton 12-2", (3, "Easton", None)), ("4: Notre Dame (nj) (MAPL)", (4, "Notre Dame (NJ)", None)), ("0 Nobody", (None, None, "no rank")), ("Radnor", (None, None, "no rank")), ("5. (x)", (None, None, "empty team"))], tuple)


def test_stat_lines(spark):
    check(
        spark,
        parsers.stat_line,
        [
            ("Sean McPeek 3 goals, 2 assists", ("Sean McPeek", 3, 2, 0, 0, 0, 0, 0, 0.9, [], None)),
            ("Kropp: 4G, 1A", ("Kropp", 4, 1, 0, 0, 0, 0, 0, 0.6, [], None)),
            ("T.J. Bell (2g, 5 ground balls) (200 career points)", ("T.J. Bell", 2, 0, 5, 0, 0, 0, 0, 0.9, [], None)),
            ("Hunter Farren FO 12/13", ("Hunter Farren", 0, 0, 0, 0, 0, 12, 13, 0.9, [], None)),
            ("Mason Westwood 10-for-17 FO, 3 GBs", ("Mason Westwood", 0, 0, 3, 0, 0, 10, 17, 0.9, [], None)),
            ("Dylan Bella's 4 goals", ("Dylan Bella", 4, 0, 0, 0, 0, 0, 0, 0.9, [], None)),
            ("John Roe – 12 saves", ("John Roe", 0, 0, 0, 0, 12, 0, 0, 0.9, [], None)),
            ("Ann Lee 16 goals, 1 assist", ("Ann Lee", 0, 1, 0, 0, 0, 0, 0, 0.9, ["goals"], None)),
            ("Ann Lee 173 goals", (None,) * 8 + (None, ["goals"], "over cap")),
            ("Coach said it was cold", (None,) * 8 + (None, [], "no stat")),
        ],
        tuple,
    )


def test_lists(spark):
    got = one(spark, parsers.aggregated_list, "Easton assists: 4 Sean McPeek, Evan Placotaris 2, Bee, 3/4")
    assert [tuple(x) for x in got] == [("Easton", "assists", "Sean McPeek", 4, None), ("Easton", "assists", "Evan Placotaris", 2, None), ("Easton", "assists", "Bee", 1, None), ("Easton", "assists", None, None, "no item pattern")]
    assert one(spark, parsers.aggregated_list, "nothing here")[0].reason == "no list header"


def test_quarters(spark):
    check(spark, parsers.quarter_line, [("Radnor 3 2 1 4 - 10", ("Radnor", [3, 2, 1, 4], 10, True, None, None)), ("MHS: 3, 2 = 6", ("MHS", [3, 2], 6, False, "sum mismatch", None)), ("3 2 1", (None, None, None, None, None, "no team before the numbers")), ("Radnor 3", (None, None, None, None, None, "fewer than two numbers"))], tuple)


def test_names(spark):
    check(spark, names.player_key, [("José  Núñez Jr.", "jose nunez"), ("H. Moyer", "h moyer"), ("E. Harding, goalie,", "e harding"), ("O’Kane", "o'kane"), ("TBD", ""), ("N/A", ""), ("Bob (12) Roe III", "bob 12 roe"), ("jr", "jr")])
    check(spark, lambda c: names.player_key(names.player_key(c)), [("E. Harding, goalie, jr.", "e harding"), ("Ann-Marie O'Neil –", "ann-marie o'neil")])
    check(spark, names.fuzzy_key, [("#12 José Núñez-Roe (Sr.) goalie", "jose nunez roe")])
    check(spark, names.team_name, [("St. Anthony's (ny) (2)", "St. Anthony's (NY)"), ("Radnor (district 1)", "Radnor"), ("(x)", None)])
    check(spark, names.team_token, [("DV Scoring:", "DV"), ("Springfield Goalies:", "Springfield"), ("Goalies", ""), ("X Scoring Stats", "X"), ("CB South:", "CB South")])
    check(spark, names.official_key, [("St. Anthony's (NY)", "st anthonys (ny)"), ("Radnor  (PA)", "radnor")])
    check(spark, names.title_case, [("ST. JOSEPH'S OF THE HILLS", "St. Joseph's OF THE Hills"), ("Friends Of The hills", "Friends of the Hills"), ("MANHEIM-CENTRAL (NJ)", "Manheim-Central (NJ)"), ("THE HILL", "THE Hill")])
    check(spark, names.strip_prose, [("A 1G (Set School record 173 Goals)", "A 1G"), ("A (3G, 3A)", "A (3G, 3A)"), ("A (captain)", "A")])
    check(spark, names.partial_match, [(("haverford", "haverford school"), True), (("wc henderson", "henderson"), True), (("pv", "perkiomen valley"), True), (("umoreland", "upper moreland"), True), (("nhs", "new hope-solebury"), True), (("radnor", "conestoga"), False)])
    check(spark, names.osa_distance, [(("peirce", "pierce"), 1), (("merrill", "merill"), 1), (("ca", "abc"), 3), (("", "ab"), 2)])
    check(spark, names.swapped, [(("peirce", "pierce"), True), (("a", "a"), False), (("ab", "ba"), True), (("abc", "cba"), False)])
    check(spark, lambda h: names.resolve_hint(h, F.array(F.lit("Perkiomen Valley"), F.lit("Methacton"))), [("PV", "Perkiomen Valley"), ("Meth", "Methacton"), ("methacton", "Methacton"), ("Radnor", "Radnor")])
    check(spark, names.anomaly_token, [('x [unresolved sub-header: "DV"]', "DV"), ('teamHint="PR" y', "PR"), ("z", None)])


@pytest.mark.parametrize("label,want", [("Today", "2026-04-22"), ("yesterday", "2026-04-21"), ("April 3", "2026-04-03"), ("April 3, 2025.", "2025-04-03"), ("Smarch 3", "2026-04-22"), ("", "2026-04-22")])
def test_label_dates(spark, label, want):
    assert one(spark, posts.label_date, label, "2026-04-22") == want


def test_publish_dates(spark):
    check(spark, posts.publish_date, [('<meta property="article:published_time" content="2026-04-01T10:00">', "2026-04-01"), ('<time class="entry-time">May 3, 2025</time>', "2025-05-03"), ("Posted 4/7/26 by x", "2026-04-07"), ("none", None)])
    more = [
        ("<meta content='2026-04-02T1' data-x=1 property='article:published_time'>", "2026-04-02"), ('<meta property="og:x" content="2026-01-01"><meta property="article:published_time" content="soon"><p>posted 12 / 31 / 05</p>', "2005-12-31"),
        ('<time datetime="x" class="a entry-time b">March  9 , 2024 </time>', "2024-03-09"), ('<time class="entry-times">March 9, 2024</time>', None), ("Posted 13/1/26", None),
    ]
    check(spark, posts.publish_date, more)


def test_categories(spark):
    check(
        spark,
        posts.category,
        [
            (("monday-boys-hs-summaries-5", ""), "hs-summaries"), (("girls-rankings", ""), None), (("pa-state-rankings-week-2", ""), "rankings pa-state"), (("x", '<a rel="category tag">Philly Rankings</a>'), "rankings philly"),
            (("girls-scoreboard", ""), "scoreboard"), (("x", '<a rel="category tag">College</a>'), None), (("club-tryouts-rankings", ""), None), (("news", ""), None),
        ],
    )


def test_posts(spark):
    html = "<style>x</style><p>April 21</p><p>Girls</p><p>Radnor 3, Conestoga 2</p><div>Boys</div><p>Radnor 8, Conestoga 7 (OT)<br>Easton at Nazareth<br>Ridley 0, Strath Haven 0, ppd</p><p>12 x, 3</p>"
    lines = posts.post_lines(spark.createDataFrame([("p", html)], "id string, html string"), "id", "html")
    assert [(r.date_label, r.section, r.team_a, r.score_b, r.reason) for r in posts.scoreboard(lines).orderBy("pos").collect()] == [("April 21", "Boys", "Radnor", 7, None), ("April 21", "Boys", None, None, "no score pattern")]
    html = "<p>Intro 3 goals</p><p>Radnor 8, Conestoga 7</p><p>Radnor 2 2 2 2 - 8</p><p>Radnor goals: 3 Al Bee, Cy Dee</p><p>Conestoga Scoring:</p><p>Eve Fox and Gil Hay 2G, 1A</p><p>Ridley 0, Easton 0, ppd</p><p>Ira Jay 4 goals</p>"
    lines = posts.post_lines(spark.createDataFrame([("p", html)], "id string, html string"), "id", "html")
    got = [(r.block, r.kind, r.hint, r.name, r.stat, r["count"], r.confidence) for r in posts.summaries(lines).orderBy("pos", "name", "stat").collect()]
    assert got == [
        (1, "score", None, None, None, None, None),
        (1, "periods", "Radnor", None, "2 2 2 2", 8, None),
        (1, "list", "Radnor", "Al Bee", "goals", 3, 0.7),
        (1, "list", "Radnor", "Cy Dee", "goals", 1, 0.7),
        (1, "stat", "Conestoga Scoring:", "Eve Fox", "assists", 1, 0.5),
        (1, "stat", "Conestoga Scoring:", "Eve Fox", "goals", 2, 0.5),
        (1, "stat", "Conestoga Scoring:", "Gil Hay", "assists", 1, 0.5),
        (1, "stat", "Conestoga Scoring:", "Gil Hay", "goals", 2, 0.5),
    ]
