"""Joins by edit distance: nothing is lost against all pairs, and few pairs are examined."""

import random

import pytest
from pyspark.sql import functions as F

from pitchside.operators import matching, near_names as N, quality_checks as Q, resolution as R


def edited(r, name, k):
    for _ in range(k):
        i = r.randrange(len(name) + 1)
        name = r.choice([name[:i] + r.choice("abcd") + name[i:], name[:i] + name[i + 1 :], name[:i] + r.choice("abcd") + name[i + 1 :]])
    return name


def names(seed, n, low, high, alphabet="abcd"):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(low, high))) for _ in range(n)]
    return sorted({edited(r, b, k) for b in base for k in range(4)} | {"", "a"})


@pytest.mark.parametrize(("low", "high", "rule", "allowed", "shorter"), [
    (2, 9, N.within(1), lambda x, y: 1, False), (4, 14, N.within(2), lambda x, y: 2, False), (8, 30, N.within(3), lambda x, y: 3, False),
    (4, 30, N.within_share(0.85), lambda x, y: int(max(len(x), len(y)) * 0.15 + 1e-9), True), (3, 26, N.within_own(3, 0.25), lambda x, y: max(3, len(x) // 4), False),
])
def test_no_pair_is_lost(spark, low, high, rule, allowed, shorter):
    texts = names(high, 60, low, high)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    met = {(r.x, r.y) for r in N.candidates(frame, frame, [], *rule).collect()}
    both = frame.select(F.col("text").alias("x")).crossJoin(frame.select(F.col("text").alias("y"))).withColumn("d", F.levenshtein("x", "y"))
    want = {(r.x, r.y) for r in both.filter("d <= 8").collect() if r.d <= allowed(r.x, r.y)}
    if shorter:
        want = {(x, y) for x, y in want if len(x) <= len(y)}
    assert want <= met


def people(n, teams=5, seed=1):
    """Names of two random words; every tenth has a partner one or two edits away in its team."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 9)))
    rows = []
    for i in range(n):
        name, team = f"{word()} {word()}", i % teams
        rows.append((2 * i, team, name))
        if i % 10 == 0:
            first, last = name.split()
            rows.append((2 * i + 1, team, [f"{first[1:]} {last}", f"{first[:2]}{first[3]}{first[2]}{first[4:]} {last}", f"{first} {last[0]}xx{last[1:]}"][i // 10 % 3]))
    return rows


@pytest.mark.parametrize("n", [400, 1600])
def test_pairs_examined_grow_with_matches(spark, n):
    """Four times the names: four times the pairs, not sixteen times."""
    rows = people(n)
    frame = spark.createDataFrame([(t, name) for _, t, name in rows], "team_id int, text string")
    met = N.candidates(frame, frame, ["team_id"], *N.within(2)).filter("x < y").count()
    assert n // 30 <= met <= n // 10 + n // 50


def slow_candidates(people, stats):
    """All pairs of a team, by the rule of the operator."""
    from pitchside.functions.names import fuzzy_key, swapped

    keyed = people.select("id", "team_id", fuzzy_key(F.col("name")).alias("key")).filter("key <> ''").withColumn("w", F.split("key", " "))
    a, b = (keyed.select("team_id", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "key", "w")]) for s in ("l", "r"))
    x, y = F.col("l_w"), F.col("r_w")
    pairs = a.join(b, "team_id").filter("l_id < r_id AND l_key <> r_key").withColumn("e", F.levenshtein("l_key", "r_key"))
    short = F.exists(F.zip_with(x, y, lambda p, q: (p != q) & (F.least(F.length(p), F.length(q)) < 5)), lambda v: v)
    near = (F.col("e") <= 2) & (F.least(F.length("l_key"), F.length("r_key")) >= 5) & ((F.size(x) != F.size(y)) | ~short)
    word = lambda w, i: F.try_element_at(w, F.lit(i))
    ok = lambda i, n: (F.least(F.length(word(x, i)), F.length(word(y, i))) >= n) & ((F.levenshtein(word(x, i), word(y, i)) <= 1) | swapped(word(x, i), word(y, i)))
    crossed = (F.size(x) == 2) & (F.size(y) == 2) & ok(1, 4) & ok(2, 3) & (swapped(word(x, 1), word(y, 1)) | swapped(word(x, 2), word(y, 2)))
    medium = (F.size(x) >= 2) & (F.size(y) >= 2) & (F.substring(word(x, -1), 1, 1) == F.substring(word(y, -1), 1, 1)) & (F.least(F.length(word(x, 1)), F.length(word(y, 1))) >= 4) & (F.levenshtein(word(x, 1), word(y, 1)) <= 2)
    return pairs.select("l_id", "r_id", F.when(near | crossed, "high").when(medium, "medium").alias("c")).filter("c IS NOT NULL")


def test_same_team_candidates_equal_all_pairs(spark):
    r = random.Random(4)
    rows = people(60, 2, 3)
    firsts, lasts = ["Maria", "Mraia", "Marie", "Jon", "John", "Johnny", "Pierce", "Peirce"], ["Smith", "Simth", "Smyth", "Snow", "Li", "Lee", "Ng", "O'Hara Lee"]
    rows += [(1000 + i, i % 2, f"{r.choice(firsts)} {r.choice(lasts)}") for i in range(80)] + [(2000, 0, ""), (2001, 0, None), (2002, 1, "Cher"), (2003, 1, "Cherr")]
    frame = spark.createDataFrame(rows, "id long, team_id int, name string")
    stats = spark.createDataFrame([(1, 1000)], "game_id long, id long")
    got = {(x.left_id, x.right_id, x.confidence) for x in R.fuzzy_candidates(frame, stats).collect()}
    want = {tuple(x) for x in slow_candidates(frame, stats).collect()}
    assert got == want and {c for *_, c in got} == {"high", "medium"}


def test_fuzzy_pairs_equal_all_pairs(spark):
    rows = people(80, 3, 8) + [(5000, 1, "same name"), (5001, 2, "Same Name "), (5002, 2, "same name"), (5003, 0, "abc"), (5004, 0, None)]
    frame = spark.createDataFrame([(i, i % 3, n) for i, _, n in rows], "id long, team int, name string")
    got = {(r.a_id, r.b_id, round(r.sim, 9)) for r in Q.fuzzy_pairs(frame, "id", "name", "team").collect()}
    base = frame.select("id", "team", F.lower(F.trim("name")).alias("n")).filter("length(n) >= 4 AND (n LIKE '% %' OR length(n) >= 6)")
    a, b = (base.select(*[F.col(c).alias(f"{s}_{c}") for c in base.columns]) for s in "ab")
    slow = a.crossJoin(b).filter("a_id < b_id AND a_team <> b_team AND substr(a_n, 1, 1) = substr(b_n, 1, 1)").selectExpr("a_id", "b_id", "1 - levenshtein(a_n, b_n) / greatest(length(a_n), length(b_n)) AS sim").filter("sim >= 0.85")
    assert got == {(r.a_id, r.b_id, round(r.sim, 9)) for r in slow.collect()} and len(got) > 5


def test_roster_ways(spark):
    """Each way decides a name; ties go to the place on the roster; what fits nobody has no row."""
    roster = spark.createDataFrame([(1, 1, 1, "Jon", "Smith"), (1, 2, 2, "Jonathan", "Smyth"), (1, 3, 3, "Alexander", "Hamilton"), (1, 4, 4, "Bo", "Li"), (2, 5, 1, "Jon", "Smith"), (1, 6, 5, "Alexandre", "Hamiltan")], "team_id int, athlete_id int, nth int, first string, last string")
    asked = spark.createDataFrame([(1, x) for x in ("JON SMITH", "Smyth", "Jonny Smyth", "Alexnder Hamltn", "Zz Top", "", "Bo-Li")] + [(2, "Jon Smith"), (3, "Jon Smith")], "team_id int, name string")
    got = {(r.team_id, r.name): (r.athlete_id, r.way) for r in matching.match_roster(asked, roster).collect()}
    assert got == {(1, "JON SMITH"): (1, "exact"), (1, "Smyth"): (2, "surname"), (1, "Jonny Smyth"): (1, "nickname"), (1, "Alexnder Hamltn"): (3, "edits"), (1, "Bo-Li"): (4, "exact"), (2, "Jon Smith"): (5, "exact")}
