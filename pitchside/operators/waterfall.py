"""Staged matching: each stage settles what is unique to it and hands the rest on (survey D18, D19).

Names are compared with their own team's roster only, by equi-joins on words or on pieces of names. Logos
are given to teams by keys that both sides explode into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions.names import player_key
from pitchside.functions.tables import school_keys
from pitchside.operators.core import once, spread
from pitchside.operators.near_names import candidates, within
from pitchside.sources.scratch import written

# How sure each way of finding a person is.
BY_LAST_NAME, BY_INITIAL, BY_EDITS = 0.91, 0.94, 0.9


def _settled(rows: DataFrame, kind: str, reason: str | None = None, player: Column | None = None, confidence: float | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select("team_id", "key", F.lit(kind).alias("kind"), (none if player is None else player).cast("long").alias("player_id"), F.lit(confidence).cast("double").alias("confidence"), F.lit(reason).cast("string").alias("reason"))


def _levels(roster: DataFrame, by: list[str]) -> DataFrame:
    """For each team and name part: how many people have it (met), the most stat rows of one (stat_rows), how many have so many (n), and the first of them."""
    level = roster.groupBy("team_id", *by, "stat_rows").agg(F.count(F.lit(1)).alias("n"), F.min("player_id").alias("player_id"))
    top = level.groupBy("team_id", *by).agg(F.sum("n").alias("met"), F.max(F.struct("stat_rows", "n", "player_id")).alias("top"))
    return top.select("team_id", *by, "met", "top.*")


def _canonical(met: DataFrame) -> DataFrame:
    """For each name, from the _levels that it met: how many people, and the only one, or the only one with the most stat rows."""
    level = met.groupBy("team_id", "key", "stat_rows").agg(F.sum("met").alias("met"), F.sum("n").alias("n"), F.min("player_id").alias("player_id"))
    top = level.groupBy("team_id", "key").agg(F.sum("met").alias("met"), F.max(F.struct("stat_rows", "n", "player_id")).alias("top"))
    return top.select("team_id", "key", "met", F.when(F.col("top.n") == 1, F.col("top.player_id")).alias("player_id"))


def resolve_people(names: DataFrame, people: DataFrame) -> DataFrame:
    """(team_id, name, key, kind, player_id, confidence, reason) for each distinct name (team_id, name) of a sheet.

    people: player_id, team_id, name, stat_rows. kind: existing, alias (the name is to be an alias of
    player_id), created (a new person) or skipped (somebody must look). Stages, each for what is left:

    1. no key: skipped;  2. one person of the team has the key: existing;
    3. one word: people whose last name is within one edit; one, or one with more stat rows than all others: alias,
       several: skipped; none, but a last name within two edits: skipped; else created;
    4. several words: people with the same last word and first initial, judged likewise;
    5. keys within two edits: just one: alias; several, of which two are equally near: skipped;
    6. a key within three edits: skipped; else created.

    Names meet distinct last names and keys; people who share one are summed up before, so that pairs don't grow with the square of them.
    Keys are made once, on all cores, and what each stage finds is written once: the stages after it and the result read it several times.
    """
    asked = written(spread(names.select("team_id", "name").distinct(), F.hash("name")).withColumn("key", player_key(F.col("name"))), "asked")
    each = asked.select("team_id", "key").distinct()
    words = F.split("key", " ")
    roster = once(spread(people, F.hash("player_id")).select("team_id", "player_id", "stat_rows", player_key(F.col("name")).alias("full"))).filter("full <> ''")
    roster = written(roster.withColumns({"last": F.element_at(F.split("full", " "), -1), "initial": F.substring("full", 1, 1)}), "roster")
    done = [_settled(each.filter("key = ''"), "skipped", "empty")]
    left = each.filter("key <> ''")

    alike = roster.groupBy("team_id", "full").agg(F.count(F.lit(1)).alias("n"), F.min("player_id").alias("player_id"))
    same = alike.filter("n = 1").select("team_id", F.col("full").alias("key"), "player_id")
    left = written(left.join(same, ["team_id", "key"], "left"), "known")
    done.append(_settled(left.filter("player_id IS NOT NULL"), "existing", player=F.col("player_id")))
    left = left.filter("player_id IS NULL").select("team_id", "key")

    one = left.filter(F.size(words) == 1)
    near = _near(roster.select("team_id", F.col("last").alias("text")), one, 2).withColumnRenamed("y", "last")
    by_last = written(_canonical(near.filter("d <= 1").join(_levels(roster, ["last"]), ["team_id", "last"])), "by-last")
    done += [_settled(by_last.filter("player_id IS NOT NULL"), "alias", None, F.col("player_id"), BY_LAST_NAME), _settled(by_last.filter("player_id IS NULL"), "skipped", "several last names")]
    close = near.select("team_id", "key").distinct().join(by_last, ["team_id", "key"], "left_anti")
    done += [_settled(close, "skipped", "close to a last name"), _settled(one.join(near, ["team_id", "key"], "left_anti"), "created")]

    left = left.filter(F.size(words) > 1)
    ends = left.withColumns({"last": F.element_at(words, -1), "initial": F.substring("key", 1, 1)})
    by_initial = written(_canonical(ends.join(_levels(roster, ["last", "initial"]), ["team_id", "last", "initial"])), "by-initial")
    done += [_settled(by_initial.filter("player_id IS NOT NULL"), "alias", None, F.col("player_id"), BY_INITIAL), _settled(by_initial.filter("player_id IS NULL"), "skipped", "several of this last name and initial")]
    left = written(left.join(by_initial, ["team_id", "key"], "left_anti"), "left")

    near = _near(roster.select("team_id", F.col("full").alias("text")), left, 3).withColumnRenamed("y", "full")
    level = near.join(alike, ["team_id", "full"]).groupBy("team_id", "key", "d").agg(F.sum("n").alias("n"), F.min("player_id").alias("player_id"))
    level = level.groupBy("team_id", "key").agg(F.min(F.struct("d", "n", "player_id")).alias("best"), F.sum(F.when(F.col("d") <= 2, F.col("n")).otherwise(0)).alias("within_two"))
    level = written(level.withColumn("tie", (F.col("best.d") <= 2) & (F.col("best.n") > 1)), "level")
    done += [
        _settled(level.filter("within_two = 1"), "alias", None, F.col("best.player_id"), BY_EDITS),
        _settled(level.filter("tie"), "skipped", "several equally near"),
        _settled(level.filter("within_two <> 1 AND NOT tie"), "skipped", "close but not unique"),
        _settled(left.join(level, ["team_id", "key"], "left_anti"), "created"),
    ]
    return asked.join(reduce(DataFrame.unionByName, done), ["team_id", "key"]).select("team_id", "name", "key", "kind", "player_id", "confidence", "reason")


def _near(cut: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(team_id, key, y, d): asked keys (team_id, key) with the texts of their team within k edits; written."""
    met = candidates(cut, asked.select("team_id", F.col("key").alias("text")), ["team_id"], *within(k)).withColumn("d", F.levenshtein("x", "y", k))
    return written(met.filter("d >= 0").select("team_id", F.col("x").alias("key"), "y", "d"), "near")


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def match_logos(teams: DataFrame, schools: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((team_id, school, logo, round), schools that no team has): one school for each team as far as keys tell.

    teams: team_id, name, slug; schools: school, name, logo, nth, the order of preference; overrides: name, school.

    round 0: an override names the team by a strict key (its name or slug as it stands), or by a loose key of
    one team. 1: the first strict key of the school that a team has (of several, the first); of
    several schools the first. 2: schools left over, in order: the first loose key that just one team
    without a school has. 3: teams left over share the school, if one of their keys is that of just one.

    Keys are made once, on all cores, and written. Both sides of every join grow with the input, so none is broadcast.
    """
    by_slug = F.replace("slug", F.lit("-"), F.lit(" "))
    of_team = written(spread(teams, "team_id").select("team_id", school_keys(F.col("name")).alias("n"), school_keys(by_slug).alias("s")), "team-keys")
    strict = of_team.select("team_id", F.explode(F.filter(F.array(F.get("n", F.lit(0)), F.get("s", F.lit(0))), lambda k: k.isNotNull())).alias("key")).groupBy("key").agg(F.min("team_id").alias("team_id"))
    loose = of_team.select("team_id", F.posexplode(F.array_distinct(F.concat("n", "s"))).alias("pos", "key"))
    of_school = written(spread(schools, "school").select("school", "nth", F.posexplode(school_keys(F.col("name"))).alias("pos", "key")), "school-keys")

    def strictly(keyed: DataFrame, by: str) -> DataFrame:
        return _met(keyed, strict, "key").groupBy(by).agg(F.min(F.struct("pos", "team_id")).alias("b")).select(by, F.col("b.team_id").alias("team_id"))

    first = _met(strictly(of_school, "school"), schools.select("school", "nth"), "school")
    owned = first.groupBy("team_id").agg(F.min(F.struct("nth", "school")).alias("b")).select("team_id", F.col("b.school").alias("school"), F.lit(1).alias("round"))
    if overrides is not None:
        named = overrides.select("name", "school", F.posexplode(school_keys(F.col("name"))).alias("pos", "key"))
        alone = loose.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("team_id").alias("team_id")).filter("n = 1")
        by_strict = strictly(named, "name")
        by_loose = _met(_met(named.filter("pos = 0"), alone, "key"), by_strict, "name", "left_anti").select("name", "team_id")
        told = _met(_met(by_strict.unionByName(by_loose), overrides, "name"), schools.select("school"), "school").groupBy("team_id").agg(F.max(F.struct("name", "school")).alias("b"))
        told = told.select("team_id", F.col("b.school").alias("school"), F.lit(0).alias("round"))
        owned = told.unionByName(_met(owned, told, "team_id", "left_anti"))
    owned = written(owned, "owned")
    waiting = written(_met(schools, first, "school", "left_anti").select("school", "nth"), "waiting")
    owned, unmatched = _loosely(owned, waiting, of_school, loose)
    # teams that are left may share a school
    alone = of_school.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("school").alias("school")).filter("n = 1")
    shared = _met(_met(loose, owned, "team_id", "left_anti"), alone, "key").groupBy("team_id").agg(F.min(F.struct("pos", "school")).alias("b")).select("team_id", F.col("b.school").alias("school"), F.lit(3).alias("round"))
    matched = _met(owned.unionByName(shared), schools.select("school", "logo"), "school").select("team_id", "school", "logo", "round")
    return matched, _met(unmatched, matched, "school", "left_anti").select("school")


def _loosely(owned: DataFrame, waiting: DataFrame, of_school: DataFrame, loose: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Round 2, with the result of taking schools one by one in their order.

    What a school gets depends on the schools before it that could take one of its teams. So each pass decides
    at once all schools that are first in line at all of their free teams.
    """
    unmatched = waiting.filter("false").select("school")
    while not waiting.isEmpty():
        free = _met(loose, owned.select("team_id"), "team_id", "left_anti")
        options = written(_met(_met(waiting, of_school.select("school", "pos", "key"), "school"), free.select("key", "team_id"), "key"), "options")
        line = options.groupBy("team_id").agg(F.min(F.struct("nth", "school")).alias("f")).select("team_id", F.col("f.school").alias("in_front"))
        blocked = _met(options, line, "team_id").filter("school <> in_front").select("school").distinct()
        ready = written(_met(waiting, blocked, "school", "left_anti").select("school"), "ready")
        unique = options.groupBy("school", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("team_id").alias("team_id")).filter("n = 1")
        taken = _met(unique, ready, "school").groupBy("school").agg(F.min(F.struct("pos", "team_id")).alias("b")).select(F.col("b.team_id").alias("team_id"), "school", F.lit(2).alias("round"))
        taken = written(taken, "taken")
        unmatched = written(unmatched.unionByName(_met(ready, taken, "school", "left_anti").select("school")), "unmatched")
        waiting = written(_met(waiting, ready, "school", "left_anti"), "waiting")
        owned = written(owned.unionByName(taken), "owned")
    return owned, unmatched
