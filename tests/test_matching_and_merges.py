"""Staged matching and cascading merges against one-by-one versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchside.operators import cascade, waterfall
from pitchside.plans import merge_suite


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [last := i, *(last := min(row[j] + 1, last + 1, row[j - 1] + (x != y)) for j, y in enumerate(b, 1))]
    return row[-1]


def one_name(key, roster):
    """(kind, player) of a name; roster: (id, full, stats)."""

    def canonical(found):
        best = sorted(found, key=lambda p: (-p[2], p[0]))
        return best[:1] if len(best) > 1 and best[0][2] > best[1][2] else best

    if not key:
        return "skipped", None
    exact = [p for p in roster if p[1] == key]
    if len(exact) == 1:
        return "existing", exact[0][0]
    last = lambda full: full.split()[-1]
    if " " not in key:
        found = canonical([p for p in roster if edits(key, last(p[1])) <= 1])
        if found:
            return ("alias", found[0][0]) if len(found) == 1 else ("skipped", None)
        return ("skipped" if any(edits(key, last(p[1])) <= 2 for p in roster) else "created"), None
    found = canonical([p for p in roster if last(p[1]) == last(key) and p[1][0] == key[0]])
    if found:
        return ("alias", found[0][0]) if len(found) == 1 else ("skipped", None)
    near = [p for p in roster if edits(key, p[1]) <= 2]
    if len(near) == 1:
        return "alias", near[0][0]
    return ("skipped" if any(edits(key, p[1]) <= 3 for p in roster) else "created"), None


def test_people_equal_one_by_one(spark):
    r = random.Random(6)
    firsts, lasts = ["maria", "marla", "jon", "john", "amy", "bo"], ["stone", "stome", "store", "reed", "reid", "li"]
    people = [(i, i % 2, f"{r.choice(firsts)} {r.choice(lasts)}", r.randrange(3)) for i in range(24)] + [(90, 0, "stone", 1), (91, 3, "solo artist", 0)]
    asked = [(t, f"{f} {last}") for t in (0, 1) for f in ["maria", "m", "jn", "zed", "johnny"] for last in ["stone", "stne", "reeed", "qqqqq", "lx"]]
    asked += [(t, w) for t in (0, 1, 2) for w in ["stone", "stoone", "reedxx", "nobody", "", "--", "li", "lii"]] + [(3, "Solo  Artist"), (3, "solo artst"), (3, None)]
    out = waterfall.resolve_people(spark.createDataFrame(asked, "team_id int, name string"), spark.createDataFrame(people, "player_id long, team_id int, name string, stat_rows long"))
    rows = out.collect()
    assert len(rows) == len(set(asked))
    for row in rows:
        assert (row.kind, row.player_id) == one_name(row.key, [(i, n, s) for i, t, n, s in people if t == row.team_id]), row
    assert {x.kind for x in rows} == {"existing", "alias", "skipped", "created"} and {x.confidence for x in rows} == {None, 0.9, 0.91, 0.94}
    assert len({x.reason for x in rows}) >= 5


def test_every_stage_decides_rows(spark):
    rows = merge_suite.QUERIES["d19_workbook_people"](spark, "/root/testdata/sf0.01").groupBy("kind", "confidence", "reason").count().collect()
    assert {(x.kind, x.confidence, x.reason) for x in rows} >= {("existing", None, None), ("alias", 0.9, None), ("alias", 0.91, None), ("alias", 0.94, None), ("created", None, None)}
    assert {x.reason for x in rows} >= {"empty", "several last names", "close to a last name", "several of this last name and initial", "close but not unique"}


def test_school_keys(spark):
    names = ["St. Mary's Senior High School", "WC Rustin", "West Chester East (PA)", "Saint Joe&#x27;s Prep", "High School", "A &amp; B Area", ""]
    out = spark.createDataFrame([(n,) for n in names], "n string").select(waterfall.school_keys(F.col("n")).alias("k")).collect()
    assert [x.k for x in out] == [
        ["st mary s senior high school", "st mary s", "saint mary s"], ["wc rustin", "west chester rustin"], ["west chester east", "east"], ["saint joe s prep", "saint joe s", "st joe s"], ["high school", "high"], ["a b area", "a b"], [],
    ]


def one_by_one(teams, schools, keys, overrides):
    """The three rounds in the order of schools; keys: of a name."""
    strict, loose, by_key = {}, {}, {}
    of_team = {t: (keys[n], keys[s.replace("-", " ")]) for t, n, s in teams}
    for t, (a, b) in of_team.items():
        for k in {x[0] for x in (a, b) if x}:
            strict.setdefault(k, t)
        for k in dict.fromkeys([*a, *b]):
            loose.setdefault(k, []).append(t)
    got = {}
    for name, school in overrides:
        t = next((strict[k] for k in keys[name] if k in strict), None)
        if t is None and keys[name] and len(loose.get(keys[name][0], [])) == 1:
            t = loose[keys[name][0]][0]
        if t is not None and any(s == school for s, _, _ in schools):
            got[t] = (school, 0)
    left = []
    for s, n, _ in schools:
        t = next((strict[k] for k in keys[n] if k in strict), None)
        if t is None:
            left.append((s, n))
        else:
            got.setdefault(t, (s, 1))
        for k in keys[n]:
            by_key.setdefault(k, []).append(s)
    for s, n in left:
        for k in keys[n]:
            free = [t for t in loose.get(k, []) if t not in got]
            if len(free) == 1:
                got[free[0]] = (s, 2)
                break
    for t, (a, b) in of_team.items():
        if t not in got:
            found = next((by_key[k][0] for k in dict.fromkeys([*a, *b]) if len(by_key.get(k, [])) == 1), None)
            if found:
                got[t] = (found, 3)
    used = {s for s, _ in got.values()}
    return {(t, s, n) for t, (s, n) in got.items()}, {s for s, _ in left if s not in used}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_logos_equal_one_by_one(spark, seed):
    """Few words, so that schools compete for teams and what one gets depends on those before it."""
    r = random.Random(seed)
    word = lambda: " ".join(filter(None, [r.choice(["", "", "WC", "West Chester", "St", "Saint"]), r.choice(["Oak", "Elm", "Fir", "Ash"]), r.choice(["", "North"]), r.choice(["", "High School", "Area", "Prep", "HS"])]))
    teams = [(i, word(), word().lower().replace(" ", "-")) for i in range(25)]
    schools = [(f"s{i}", word(), f"{i}.gif") for i in range(30)]
    overrides = [("Fir North Prep", "s3"), ("No Such", "s4"), ("Oak", "gone")]
    names = spark.createDataFrame([(n,) for n in {n for _, n, _ in schools} | {n for _, n, _ in teams} | {s.replace("-", " ") for *_, s in teams} | {n for n, _ in overrides}], "n string")
    keys = {x.n: x.k for x in names.select("n", waterfall.school_keys(F.col("n")).alias("k")).collect()}
    frame = spark.createDataFrame([(s, n, g, i) for i, (s, n, g) in enumerate(schools)], "school string, name string, logo string, nth int")
    got, without = waterfall.match_logos(spark.createDataFrame(teams, "team_id int, name string, slug string"), frame, spark.createDataFrame(overrides, "name string, school string"))
    want, none = one_by_one(teams, schools, keys, overrides)
    assert {(x.team_id, x.school, x["round"]) for x in got.collect()} == want and {x.school for x in without.collect()} == none


def test_chains(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (99, 100), (7, 7), (50, 60), (50, 55), (200, 20)]
    got = {tuple(x) for x in cascade.chains(spark.createDataFrame(links, "old long, new long")).collect()}
    assert got == {(i, 20) for i in range(20)} | {(50, 55), (200, 20)}  # circles and what leads into them are left out
    assert cascade.chains(spark.createDataFrame([], "old long, new long")).collect() == []


def test_team_merge_cascades(spark):
    """a > b > c; a contest that becomes a copy goes with its rows; the row that was there wins."""
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    league = cascade.League(
        rows([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "team_id long, name string"),
        rows([(10, 1, "jo"), (11, 2, "jo"), (12, 3, "al"), (13, 2, "al"), (14, 1, "new"), (15, 4, "jo")], "player_id long, team_id long, name_key string"),
        rows([(100, "d1", 1, 4), (101, "d1", 3, 4), (102, "d2", 1, 4), (103, "d2", 2, 4), (104, "d3", 4, 2)], "game_id long, game_date string, home_id long, away_id long"),
        rows([(100, 1, 1, 5), (101, 3, 1, 6), (102, 1, 1, 7), (102, 2, 1, 8), (104, 2, 1, 9)], "game_id long, team_id long, period int, goals int"),
        rows([(100, 10, 1), (101, 13, 2), (101, 12, 3), (102, 10, 4), (102, 11, 5), (104, 11, 6)], "game_id long, player_id long, goals int"),
        rows([("w1", "x", 1), ("w1", "x", 3), ("w2", "x", 2)], "week string, source string, team_id long"),
        rows([("A", 1), ("A", 3), ("B", 2)], "alias string, team_id long"),
    )
    mapping = rows([(1, 2), (2, 3), (8, 3), (4, 9)], "old long, new long")
    after, report = cascade.merge_teams(league, mapping)
    got = lambda f: sorted(map(tuple, f.collect()))
    assert got(after.teams.select("team_id")) == [(3,), (4,)]
    assert got(after.people) == [(10, 3, "jo"), (12, 3, "al"), (14, 3, "new"), (15, 4, "jo")]
    assert got(after.games) == [(101, "d1", 3, 4), (102, "d2", 3, 4), (104, "d3", 4, 3)]
    assert got(after.stats) == [(101, 12, 3), (102, 10, 4), (104, 10, 6)]
    assert got(after.periods) == [(101, 3, 1, 6), (102, 3, 1, 7), (104, 3, 1, 9)]
    assert got(after.rankings) == [("w1", "x", 3), ("w2", "x", 3)] and got(after.aliases) == [("A", 3), ("B", 3)]
    assert dict(map(tuple, report.collect())) == {"people": 2, "teams": 2, "games": 2, "periods": 2, "stats": 3, "rankings": 1, "aliases": 1}
    again, _ = cascade.merge_teams(after, mapping)  # once merged, merging again changes nothing
    assert got(again.stats) == got(after.stats) and got(again.people) == got(after.people)


def test_people_merge(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    people = rows([(1, "Al"), (2, "Alan"), (3, "Allan"), (4, "Bo")], "player_id long, name string")
    stats = rows([(1, 1, "x"), (1, 2, "y"), (2, 2, "z"), (2, 3, "u"), (3, 3, "v"), (4, 3, "w")], "game_id long, player_id long, v string")
    aliases = rows([("A", 1, "s", 0.5), ("A", 3, "t", 0.6), ("Al", 3, "t", 0.7)], "alias string, player_id long, source string, confidence double")
    mapping = cascade.keep_rule(rows([(1, 2), (2, 3), (4, 9), (3, 3)], "left_id long, right_id long"), stats)
    assert sorted(map(tuple, mapping.collect())) == [(1, 2), (2, 3), (9, 4)]
    out = cascade.merge_people(people, stats, aliases, mapping)
    got = lambda f: sorted(map(tuple, f.collect()))
    assert got(out.people) == [(3, "Allan"), (4, "Bo")]
    assert got(out.stats) == [(1, 3, "x"), (2, 3, "u"), (3, 3, "v"), (4, 3, "w")]
    assert got(out.aliases) == [("A", 3, "t", 0.6), ("Al", 3, "t", 0.7), ("Alan", 3, "dedup", 1.0)]
