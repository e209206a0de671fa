"""Sheets to opponents and names to rosters (survey D20, F18).

Opponents are found by equi-joins on parts of tokens, names of a roster by stages of equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.near_names import candidates, within, within_own
from pitchside.sources.scratch import written

# Scores of equal tokens, of one that begins the other, and of one within the other; the least that is taken.
EQUAL, BEGINS, WITHIN, LEAST = 100, 82, 64, 75


def token(raw: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "")


def _short_forms(raw: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    initials = lambda a: F.array_join(F.transform(a, lambda w: F.substring(w, 1, 1)), "")
    many = F.size(words) > 1
    whole, front = F.array_join(words, ""), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    last = F.get(words, F.size(words) - 1)
    return F.array(whole, F.when(many, initials(words)), F.when(many, F.concat(initials(front), last)), F.get(words, F.lit(0)), last)


def opponent_tokens(name: Column, slug: Column, aliases: Column) -> Column:
    """Distinct forms of a team's names: together, initials, initials before the last word, first and last word."""
    forms = F.flatten(F.transform(F.concat(F.array(name, slug), F.coalesce(aliases, F.array().cast("array<string>"))), _short_forms))
    return F.array_distinct(F.filter(forms, lambda t: t.isNotNull() & (t != "")))


def _pieces(t: Column) -> Column:
    """All distinct parts of a token."""
    n = F.length(t)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: t.substr(i, k)))))


def pick_opponents(sheets: DataFrame, groups: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(sheet, team_id, confidence, reason) for each sheet: the opponent whose tokens fit best, or why there is none.

    `sheets` has a unique sheet; `groups` has a unique team_id, name, slug, aliases (array) and games,
    the number of contests against it. An override names a part of the tokens of the right opponent
    and decides where any team has it. reason: empty, none, low, ambiguous, several_games, null where one is chosen.
    """
    wanted = sheets.select("sheet", token(F.col("sheet")).alias("t"))
    teams = groups.select("team_id", "games", F.explode(opponent_tokens(F.col("name"), F.col("slug"), F.col("aliases"))).alias("c"))
    # one token lies within another: each side's parts meet the other side's whole tokens
    of_team = teams.select("team_id", "games", "c", F.explode(_pieces(F.col("c"))).alias("piece"))
    of_sheet = wanted.filter("t <> ''").select("sheet", "t", F.explode(_pieces(F.col("t"))).alias("piece"))
    columns = ["sheet", "t", "team_id", "games", "c"]
    hits = wanted.join(of_team, F.col("t") == F.col("piece")).select(*columns).unionByName(of_sheet.join(teams, F.col("piece") == F.col("c")).select(*columns))
    score = F.when(F.col("t") == F.col("c"), EQUAL).when(F.startswith("t", "c") | F.startswith("c", "t"), BEGINS).otherwise(WITHIN)
    best = _best(hits.groupBy("sheet", "team_id", "games").agg(F.max(score).alias("score")))
    if overrides:
        renamed = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])[F.col("t")]
        sure = wanted.withColumn("piece", renamed).filter("piece IS NOT NULL").join(of_team.select("team_id", "games", "piece").distinct(), "piece").select("sheet", "team_id", "games", F.lit(EQUAL).alias("score"))
        sure = _best(sure)
        best = sure.unionByName(best.join(sure, "sheet", "left_anti"))
    reason = (
        F.when(F.col("t") == "", "empty").when(F.col("score").isNull(), "none").when(F.col("score") < LEAST, "low").when(F.col("n") > 1, "ambiguous").when(F.col("games") != 1, "several_games")
    )
    out = wanted.join(best, "sheet", "left").withColumn("reason", reason)
    return out.select("sheet", F.when(F.col("reason").isNull(), F.col("team_id")).alias("team_id"), (F.coalesce("score", F.lit(0)) / 100).alias("confidence"), "reason")


def _best(scored: DataFrame) -> DataFrame:
    """Each sheet's highest score, how many teams have it, and the smallest of them."""
    by_score = scored.groupBy("sheet", "score").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("team_id", "games")).alias("team"))
    return by_score.groupBy("sheet").agg(F.max(F.struct("score", "n", "team")).alias("b")).select("sheet", "b.score", "b.n", "b.team.team_id", "b.team.games")


def match_roster(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(team_id, name, athlete_id, way): the athlete each name of a team stands for; names that fit none have no row.

    exact: equal letters; surname: the name is the last name alone; nickname: last names within one
    edit and first names that share three letters and are within three edits or begin alike; edits: the
    fewest edits, at most three or a quarter of the name. The first way that fits counts, then the
    fewest edits, then the place on the roster. `roster` has team_id, athlete_id, nth, first and last.

    Each way is an equi-join (the last two on pieces of names) that only sees names which no earlier one settled. Edits are
    tried one by one up to three and then all that the length allows: who is found within few edits is not compared with those
    farther off, whom the long common parts of a team's names (a frequent first name) would bring along by the square.
    """
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    words = F.split(F.trim("name"), r"\s+")
    mine = names.select("team_id", "name").distinct().select(
        "team_id", "name", letters(F.col("name")).alias("key"), letters(F.get(words, F.lit(0))).alias("f"), letters(F.array_join(F.slice(words, 2, F.size(words)), "")).alias("l"), (F.size(words) >= 2).alias("two")
    )
    theirs = roster.select("team_id", "athlete_id", "nth", letters(F.concat("first", "last")).alias("full"), letters(F.col("first")).alias("af"), letters(F.col("last")).alias("al"))

    def exact(left: DataFrame) -> DataFrame:
        return left.join(theirs.withColumn("key", F.col("full")), ["team_id", "key"]).withColumn("d", F.lit(0))

    def surname(left: DataFrame) -> DataFrame:
        return left.join(theirs.withColumn("key", F.col("al")), ["team_id", "key"]).withColumn("d", F.lit(0))

    def nickname(left: DataFrame) -> DataFrame:
        asked, listed = left.filter("two").withColumn("f3", F.substring("f", 1, 3)), theirs.withColumn("f3", F.substring("af", 1, 3))
        met = candidates(listed.select("team_id", "f3", F.col("al").alias("text")), asked.select("team_id", "f3", F.col("l").alias("text")), ["team_id", "f3"], *within(1))
        met = met.filter(F.levenshtein("x", "y") <= 1).select("team_id", "f3", F.col("x").alias("l"), F.col("y").alias("al"))
        both = asked.join(met, ["team_id", "f3", "l"]).join(listed, ["team_id", "f3", "al"])
        begin = F.col("f").substr(F.lit(1), F.least(F.length("f"), F.length("af")) - 1)
        return both.filter((F.levenshtein("f", "af") <= 3) | F.startswith("af", begin)).withColumn("d", F.lit(0))

    def edits(left: DataFrame, bound: tuple) -> DataFrame:
        met = candidates(theirs.select("team_id", F.col("full").alias("text")), left.select("team_id", F.col("key").alias("text")), ["team_id"], *bound)
        met = met.withColumn("d", F.levenshtein("x", "y")).filter(F.col("d") <= F.greatest(F.lit(3), F.floor(F.length("x") * 0.25).cast("int")))
        return left.join(met.select("team_id", F.col("x").alias("key"), F.col("y").alias("full"), "d"), ["team_id", "key"]).join(theirs, ["team_id", "full"])

    done, left = [], mine
    steps = [("exact", exact), ("surname", surname), ("nickname", nickname)] + [("edits", lambda left, b=b: edits(left, b)) for b in (within(1), within(2), within(3), within_own(3, 0.25))]
    for n, (way, step) in enumerate(steps):
        if n == len(steps) - 1:
            left = left.filter(F.length("key") >= 16)  # shorter ones have had all of their three edits
        best = step(left).groupBy("team_id", "name").agg(F.min(F.struct("d", "nth", "athlete_id")).alias("b")).select("team_id", "name", F.col("b.athlete_id").alias("athlete_id"), F.lit(way).alias("way"))
        best = written(best, "best")
        done.append(best)
        left = written(left.join(best.select("team_id", "name"), ["team_id", "name"], "left_anti"), "left")
    return reduce(DataFrame.unionByName, done)
