"""Entity resolution: names to teams, people to people, aliases (survey D2, D5, D7, D10-D13, D15-D17, D28, D31, J19, M6).

Comparisons by distance run on what meets by pieces of names, or against a dimension table. Plans are
tables; nothing is changed until a plan is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.names import anomaly_token, best_similarity, bonus_key, bonus_similarity, fuzzy_key, partial_match, similarity_key, swapped, team_token
from pitchside.functions.text import slug, split_names, squeeze, team_key
from pitchside.operators.core import first_per, ranked, spread
from pitchside.operators.near_names import candidates, one_step_forms, within
from pitchside.sources.numbering import numbered
from pitchside.sources.scratch import written

# Into how many shares the people of one key are dealt before pairs are made, and how many of them go together.
SHARES, BLOCK = 8, 128


def resolve_or_create(names: DataFrame, teams: DataFrame, aliases: DataFrame, strict: bool = False) -> DataFrame:
    """(raw, team_id, name, slug, created): each distinct name's team, by alias, then by key; the rest are new teams with the next ids and free slugs.

    strict (names out of score lines): before a team is made, a name that partly matches exactly one
    team is that team, and names of up to three capitals or under three characters are refused (null id).
    """
    cleaned = names.select("raw").distinct().withColumn("clean", team_token(F.col("raw"))).withColumn("key", team_key(F.col("clean")))
    by_alias = aliases.select(F.lower("alias").alias("key"), F.col("team_id").alias("_alias_id")).dropDuplicates(["key"])
    by_key = first_per(teams.select(team_key(F.col("name")).alias("key"), F.col("team_id").alias("_key_id")), ["key"], [F.col("_key_id")])
    known = cleaned.join(by_alias, "key", "left").join(by_key, "key", "left").withColumn("team_id", F.coalesce("_alias_id", "_key_id"))
    found = known.filter("team_id IS NOT NULL").select("raw", "team_id").withColumn("created", F.lit(False))
    rest = known.filter("team_id IS NULL AND key <> ''").select("raw", "clean", "key")
    refused = rest.limit(0).select("raw")
    if strict:
        some = _partly(rest, teams.select(F.col("team_id").alias("_t"), team_key(F.col("name")).alias("_k")))
        unique = some.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("team_id")).filter("n = 1").select("raw", "team_id", F.lit(False).alias("created"))
        found, rest = found.unionByName(unique), rest.join(unique, "raw", "left_anti")
        ghost = F.col("clean").rlike("^[A-Z]{1,3}$") | (F.length("key") < 3)
        refused, rest = rest.filter(ghost).select("raw"), rest.filter(~ghost)
    fresh = first_per(rest, ["key"], [F.col("raw")]).select("key", squeeze(F.col("clean")).alias("name"), slug(F.col("key")).alias("base"))
    newest = teams.agg(F.coalesce(F.max("team_id"), F.lit(-1))).first()[0]
    taken = teams.select(slug(team_key(F.col("name"))).alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("_taken"))
    made = numbered(fresh, "key", "_nth").withColumn("team_id", F.col("_nth") + newest + 1).join(taken, "base", "left")
    nth_slug = F.coalesce("_taken", F.lit(0)) + F.row_number().over(Window.partitionBy("base").orderBy("key"))
    made = made.withColumn("slug", F.when(nth_slug == 1, F.col("base")).otherwise(F.concat_ws("-", "base", nth_slug.cast("string")))).select("key", "team_id", "name", "slug")
    new = rest.select("raw", "key").join(made, "key").select("raw", "team_id", "name", "slug", F.lit(True).alias("created"))
    old = found.join(teams.select("team_id", "name", slug(team_key(F.col("name"))).alias("slug")), "team_id").select("raw", "team_id", "name", "slug", "created")
    none = F.lit(None)
    return old.unionByName(new).unionByName(refused.select("raw", none.cast("long").alias("team_id"), none.cast("string").alias("name"), none.cast("string").alias("slug"), F.lit(False).alias("created")))


def _partly(names: DataFrame, teams: DataFrame) -> DataFrame:
    """names (key) with the teams (_t, _k) that they partly match: both begin alike, or their last words do, so they meet by one of these letters."""
    last = lambda s: F.element_at(F.filter(F.split(s, r"[\s\-]+"), lambda w: w != ""), -1)
    first = lambda s: F.substring(F.regexp_replace(s, r"^[\s\-]+", ""), 1, 1)
    ends = lambda s: F.array(F.concat(F.lit("<"), first(s)), F.concat(F.lit(">"), F.coalesce(F.substring(last(s), 1, 1), F.lit(""))))
    met = names.withColumn("_end", F.explode(ends(F.col("key")))).join(teams.withColumn("_end", F.explode(ends(F.col("_k")))), "_end").drop("_end").distinct()
    return met.filter(partial_match(F.col("key"), F.col("_k")))


def fuzzy_candidates(people: DataFrame, stats: DataFrame, most_edits: int = 2, least_length: int = 5) -> DataFrame:
    """Pairs within a team that may be one person: left_id < right_id, edits, confidence, numbers of stat rows.

    high: at most two edits, both keys of five characters or more, and every differing word of equal
    word counts of five or more; or two words, each the same but for a swap of neighbours or one edit,
    at least one by a swap. medium: equal last initials and first names of four or more within two edits.

    Each rule has an equi-join that finds its pairs of distinct keys, so pairs grow with what is alike and not
    with the square of a roster; people of one key are one row until the last step.
    """
    keyed = people.select("id", "team_id", "name", fuzzy_key(F.col("name")).alias("key")).filter("key <> ''")
    counts = stats.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed.join(counts, "id", "left").select("id", "team_id", "key", F.coalesce("n", F.lit(0)).alias("n"))
    keys = keyed.select("team_id", "key").distinct().withColumn("w", F.split("key", " "))
    met = _alike_keys(keys, most_edits, least_length)
    x, y = F.split("x", " "), F.split("y", " ")
    edits = F.levenshtein("x", "y")
    short = F.exists(F.zip_with(x, y, lambda p, q: (p != q) & (F.least(F.length(p), F.length(q)) < least_length)), lambda v: v)
    near = (edits <= most_edits) & (F.least(F.length("x"), F.length("y")) >= least_length) & ((F.size(x) != F.size(y)) | ~short)
    first = lambda w: F.element_at(w, 1)
    medium = (F.size(x) >= 2) & (F.size(y) >= 2) & (F.substring(F.element_at(x, -1), 1, 1) == F.substring(F.element_at(y, -1), 1, 1))
    medium = medium & (F.least(F.length(first(x)), F.length(first(y))) >= 4) & (F.levenshtein(first(x), first(y)) <= 2)

    def close(i: int, least: int) -> tuple[Column, Column]:
        p, q = F.try_element_at(x, F.lit(i)), F.try_element_at(y, F.lit(i))
        swap = swapped(p, q)
        return (F.least(F.length(p), F.length(q)) >= least) & ((F.levenshtein(p, q) <= 1) | swap), swap

    (ok1, swap1), (ok2, swap2) = close(1, 4), close(2, 3)
    crossed = (F.size(x) == 2) & (F.size(y) == 2) & ok1 & ok2 & (swap1 | swap2)
    judged = met.select("team_id", "x", "y", edits.alias("edits"), F.when(near | crossed, "high").when(medium, "medium").alias("confidence")).filter("confidence IS NOT NULL")
    # A row for each pair of people, and few keys hold very many. So people go to the join in blocks by their ids, each key is SHARES keys, dealt over all cores whatever their bytes,
    # and pairs are made block by block: but for few pairs of blocks one side's ids are all below the other's, so that columns stay or recur and the result is stored in a fraction of a byte or two a row.
    place = F.row_number().over(Window.partitionBy("team_id", "key").orderBy("id")) - 1
    blocks = keyed.withColumn("block", F.floor(place / BLOCK).cast("int")).groupBy("team_id", "key", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("people"))
    blocks = written(blocks, "blocks")
    a, b = (blocks.select("team_id", F.col("key").alias(k), "block", F.col("people").alias(s)) for k, s in (("x", "a"), ("y", "b")))
    a = judged.join(a, ["team_id", "x"]).withColumn("share", F.pmod("block", F.lit(SHARES))).drop("block", "x")
    b = b.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).drop("block")
    key = ["team_id", "y", "share"]
    both = spread(a, *key).join(spread(b, *key).hint("merge"), key).select("team_id", "edits", "confidence", "a", "b")
    both = both.select("team_id", "edits", "confidence", "b", F.inline("a").alias("a_id", "a_stats")).select("team_id", "edits", "confidence", "a_id", "a_stats", F.inline("b").alias("b_id", "b_stats"))
    turned = F.col("a_id") > F.col("b_id")
    side = lambda of, other, name: F.when(turned, F.col(other)).otherwise(F.col(of)).alias(name)
    ends = [side("a_id", "b_id", "left_id"), side("b_id", "a_id", "right_id"), "edits", "confidence", side("a_stats", "b_stats", "left_stats"), side("b_stats", "a_stats", "right_stats")]
    return both.select("team_id", *ends)


def _alike_keys(keys: DataFrame, most_edits: int, least_length: int) -> DataFrame:
    """Distinct (team_id, x, y) with x < y: keys (team_id, key, w) that one of the rules of fuzzy_candidates may call alike."""
    text = keys.filter(F.length("key") >= least_length).select("team_id", F.col("key").alias("text"))
    near = candidates(text, text, ["team_id"], *within(most_edits)).filter("x < y")
    forms = keys.filter(F.size("w") == 2).select("team_id", "key", F.explode(one_step_forms(F.element_at("w", 1))).alias("f"), "w").select("team_id", "key", "f", F.explode(one_step_forms(F.element_at("w", 2))).alias("g"))
    a, b = (forms.select("team_id", F.xxhash64("f", "g").alias("h"), F.col("key").alias(c)) for c in ("x", "y"))
    crossed = a.join(b, ["team_id", "h"]).filter("x < y").select("team_id", "x", "y")
    named = keys.filter((F.size("w") >= 2) & (F.length(F.element_at("w", 1)) >= 4)).select("team_id", "key", F.element_at("w", 1).alias("text"), F.substring(F.element_at("w", -1), 1, 1).alias("initial"))
    firsts = candidates(named, named, ["team_id", "initial"], *within(2)).filter((F.levenshtein("x", "y") <= 2) & (F.col("x") <= F.col("y")))
    a, b = (named.select("team_id", "initial", F.col("text").alias(t), F.col("key").alias(c)) for t, c in (("x", "p"), ("y", "q")))
    medium = firsts.join(a, ["team_id", "initial", "x"]).join(b, ["team_id", "initial", "y"]).filter("p <> q").select("team_id", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    return near.unionByName(crossed).unionByName(medium).distinct()


def cross_team_plan(people: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, keep_id) for people of one name in two teams or more: the one with most stat rows stays, of equal ones the smallest id."""
    counts = stats.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    keyed = people.select("id", "team_id", F.lower(F.trim("name")).alias("key")).join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    groups = keyed.groupBy("key").agg(F.countDistinct("team_id").alias("teams"), F.max_by("id", F.struct("n", -F.col("id"))).alias("keep_id")).filter("teams >= 2")
    return keyed.join(groups, "key").filter("id <> keep_id").select("id", "keep_id")


def apply_cross_team(stats: DataFrame, plan: DataFrame) -> DataFrame:
    """Stat rows (game_id, id, ...) moved to who stays; rows of a contest in which that one has a row already are left where they are."""
    moved = stats.join(plan, "id", "left")
    mine = stats.select("game_id", F.col("id").alias("keep_id")).distinct().withColumn("_taken", F.lit(True))
    out = moved.join(mine, ["game_id", "keep_id"], "left")
    one = F.row_number().over(Window.partitionBy("game_id", "keep_id").orderBy("id"))  # of several that would move, the first
    free = F.col("keep_id").isNotNull() & F.col("_taken").isNull()
    return out.withColumn("_nth", F.when(free, one)).withColumn("id", F.when(free & (F.col("_nth") == 1), F.col("keep_id")).otherwise(F.col("id"))).select(*stats.columns)


def split_composites(people: DataFrame) -> DataFrame:
    """(id, team_id, nth, name) of people whose name is a list of names; the first gets the stat rows."""
    parts = split_names(F.col("name"))
    return people.select("id", "team_id", F.posexplode(F.when(F.size(parts) > 1, parts)).alias("nth", "name"))


def ghost_teams(teams: DataFrame, games: DataFrame, people: DataFrame) -> DataFrame:
    """Teams with a name of up to three characters, with their contests and people; deletable where both are none."""
    sides = games.select(F.explode(F.array("home_id", "away_id")).alias("team_id")).groupBy("team_id").agg(F.count(F.lit(1)).alias("games"))
    rosters = people.groupBy("team_id").agg(F.count(F.lit(1)).alias("people"))
    short = teams.filter(F.length(F.trim("name")).between(1, 3)).join(sides, "team_id", "left").join(rosters, "team_id", "left")
    g, p = (F.coalesce(c, F.lit(0)) for c in ("games", "people"))
    return short.select("team_id", "name", g.alias("games"), p.alias("people"), ((g == 0) & (p == 0)).alias("deletable"))


def ghost_repoints(teams: DataFrame, games: DataFrame, people: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, from_team, to_team), (team_id, name, verdict)) for teams whose name is no more than an abbreviation.

    games: game_id, home_id, away_id; people: id, team_id; stats: game_id, id. A ghost without contests and people is deletable. One
    without contests is repointed, and then deletable, if each of its people has a stat row in a contest of a team whose
    name the ghost's partly matches (of several the one of the smallest contest, home first). All others are skipped.
    """
    ghosts = teams.filter(F.length(F.trim("name")).between(1, 3)).select("team_id", "name")
    playing = games.select(F.explode(F.array("home_id", "away_id")).alias("team_id")).distinct()
    idle = ghosts.join(playing, "team_id", "left_anti")
    members = people.join(idle, "team_id").select("id", "team_id", F.col("name").alias("ghost"))
    seen = members.join(stats.select("id", "game_id").distinct(), "id").join(games.select("game_id", F.posexplode(F.array("home_id", "away_id")).alias("side", "other")), "game_id").filter("other <> team_id")
    named = seen.join(teams.select(F.col("team_id").alias("other"), F.col("name").alias("sibling")), "other")
    met = named.filter(partial_match(team_key(F.col("ghost")), team_key(F.col("sibling")))).groupBy("id", "team_id").agg(F.min(F.struct("game_id", "side", "other")).alias("b"))
    target = met.select("id", F.col("team_id").alias("from_team"), F.col("b.other").alias("to_team"))
    whole = members.join(target.select("id", "to_team"), "id", "left").groupBy("team_id").agg(F.count(F.lit(1)).alias("people"), F.count("to_team").alias("found"))
    judged = ghosts.join(idle.select("team_id").withColumn("_idle", F.lit(True)), "team_id", "left").join(whole, "team_id", "left")
    verdict = F.when(F.col("_idle").isNull(), "skipped").when(F.col("people").isNull(), "deletable").when(F.col("people") == F.col("found"), "repointed").otherwise("skipped")
    verdicts = judged.select("team_id", "name", verdict.alias("verdict"))
    return target.join(verdicts.filter("verdict = 'repointed'").select(F.col("team_id").alias("from_team")), "from_team", "left_semi").select("id", "from_team", "to_team"), verdicts


def junk_people(people: DataFrame, stats: DataFrame) -> DataFrame:
    """People whose name is none or a possessive; deletable where they have no stat rows."""
    junk = people.filter(F.col("name").isin("None", "No name provided") | F.col("name").rlike(r"'s$|'s "))
    with_rows = stats.select("id").distinct().withColumn("_has", F.lit(True))
    return junk.join(with_rows, "id", "left").select("id", "name", F.col("_has").isNull().alias("deletable"))


def orphan_aliases(aliases: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return aliases.join(owners.select(key), key, "left_anti")


def mine_aliases(anomalies: DataFrame, games: DataFrame, teams: DataFrame, aliases: DataFrame, people: DataFrame) -> DataFrame:
    """(alias, team_id, posts, occurrences, purity, confidence, rejected) from names that posts (post, line, game_id) left unresolved.

    Every anomaly votes for both sides of its contest; a side's purity is its share of the token's
    posts. Pure tokens of three posts have .95, of two .80, all others .5. `rejected` is the first reason that holds.
    """
    token = F.lower(squeeze(anomaly_token(F.col("line"))))
    votes = anomalies.select("post", "game_id", token.alias("alias")).filter("alias <> ''").join(games.select("game_id", "home_id", "away_id"), "game_id")
    long = votes.select("post", "alias", F.explode(F.array("home_id", "away_id")).alias("team_id"))
    sides = long.groupBy("alias", "team_id").agg(F.countDistinct("post").alias("posts"), F.count(F.lit(1)).alias("occurrences"))
    total = votes.groupBy("alias").agg(F.countDistinct("post").alias("_posts"))
    scored = sides.join(total, "alias").withColumn("purity", F.col("posts") / F.col("_posts"))
    confidence = F.when(F.col("purity") < 1, 0.5).when(F.col("posts") >= 3, 0.95).when(F.col("posts") >= 2, 0.8).otherwise(0.5)
    pure = F.sum(F.when(F.col("purity") >= 1, 1).otherwise(0)).over(Window.partitionBy("alias"))
    known = lambda rows, name: rows.select(F.lower(squeeze(F.col("name"))).alias("alias")).distinct().withColumn(name, F.lit(True))
    flagged = scored.withColumns({"confidence": confidence, "_pure": pure})
    flagged = flagged.join(aliases.select("alias").distinct().withColumn("_aliased", F.lit(True)), "alias", "left").join(known(teams, "_team"), "alias", "left").join(known(people, "_person"), "alias", "left")
    words = F.size(F.filter(F.split("alias", " "), lambda w: w != ""))
    rejected = (
        F.when(F.col("_aliased"), "already aliased")
        .when(F.col("_team"), "name of a team")
        .when(F.col("_person"), "name of a player")
        .when(F.col("alias").rlike(r"\d") | (words > 3), "looks like a player")
        .when((F.col("_pure") > 1) & (F.col("purity") >= 1), "ambiguous")
        .when(F.col("confidence") < 0.8, "too few posts")
    )
    return flagged.select("alias", "team_id", "posts", "occurrences", "purity", "confidence", rejected.alias("rejected"))


def top_matches(names: DataFrame, candidates: DataFrame, top: int = 3) -> DataFrame:
    """(name, position, candidate, score): the best candidates for each distinct unknown name, with how often it occurs.

    candidates is a dimension table (teams) that is broadcast if it is small; the names are what is left unresolved.
    """
    seen = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", bonus_key(F.col("name")))
    keyed = candidates.select(F.col("name").alias("candidate")).distinct().withColumn("_c", bonus_key(F.col("candidate")))
    scored = seen.join(keyed, how="inner").select("name", "n", "candidate", F.round(bonus_similarity(F.col("_k"), F.col("_c")), 9).alias("score"))
    return ranked(scored, ["name"], [F.desc("score"), F.col("candidate")], "position").filter(F.col("position") <= top)


def score_disagreements(games: DataFrame, teams: DataFrame, team: int, external: DataFrame, most_edits: int = 5) -> DataFrame:
    """Contests of one team whose scores differ from an external schedule (game_date, opponent, own, other).

    The day is the join key; of the day's contests the first whose opponent contains the external
    name, is contained in it, or is within some edits.
    """
    home = F.col("home_id") == team
    other = F.when(home, F.col("away_id")).otherwise(F.col("home_id"))
    mine = games.filter(home | (F.col("away_id") == team)).select("game_id", "game_date", other.alias("team_id"), F.when(home, F.col("home_score")).otherwise(F.col("away_score")).alias("db_own"), F.when(home, F.col("away_score")).otherwise(F.col("home_score")).alias("db_other"))
    named = mine.join(teams.select("team_id", team_key(F.col("name")).alias("_name")), "team_id")
    listed = external.filter("own IS NOT NULL AND other IS NOT NULL").withColumn("_asked", team_key(F.col("opponent")))
    same = F.contains("_name", "_asked") | F.contains("_asked", "_name") | (F.levenshtein("_name", "_asked") <= most_edits)
    met = first_per(listed.join(named, "game_date").filter(same), ["game_date", "opponent", "own", "other"], [F.col("game_id")])
    return met.filter((F.col("db_own") != F.col("own")) | (F.col("db_other") != F.col("other"))).select("game_id", "game_date", "opponent", "own", "other", "db_own", "db_other")


def branding_updates(teams: DataFrame, entries: DataFrame) -> DataFrame:
    """(team_id, outcome) of entries with a first colour and perhaps a second: invalid, missing, unchanged or updated."""
    hexadecimal = lambda c: F.coalesce(F.col(c), F.lit("#000000")).rlike("^#[0-9A-Fa-f]{6}$")
    valid = F.col("e.first").isNotNull() & hexadecimal("e.first") & hexadecimal("e.second")
    same = F.lit(True)
    for c in ("first", "second", "nickname"):
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}"))
    outcome = F.when(~valid, "invalid").when(F.col("t.team_id").isNull(), "missing").when(same, "unchanged").otherwise("updated")
    return entries.alias("e").join(teams.alias("t"), F.col("e.team_id") == F.col("t.team_id"), "left").select(F.col("e.team_id").alias("team_id"), outcome.alias("outcome"))


def fill_gaps(games: DataFrame, batch: DataFrame) -> DataFrame:
    """The plan for results (game_date, home_id, away_id, scores): fill contests that are 0-0 (also if stored the other way round), insert unknown ones, leave the rest."""
    key = ["game_date", "home_id", "away_id"]
    forward = games.select("game_id", *key, "home_score", "away_score", F.lit(False).alias("reversed"))
    backward = games.select("game_id", "game_date", F.col("away_id").alias("home_id"), F.col("home_id").alias("away_id"), "home_score", "away_score", F.lit(True).alias("reversed"))
    stored = first_per(forward.unionByName(backward), key, [F.col("reversed"), F.col("game_id")]).select(*key, "game_id", "reversed", (F.greatest("home_score", "away_score") > 0).alias("_scored"))
    met = batch.join(stored, key, "left")
    action = F.when(F.col("game_id").isNull(), "insert").when(F.col("_scored"), "complete").otherwise("fill")
    turned = F.coalesce("reversed", F.lit(False))
    new = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("home_score", "away_score"), ("away_score", "home_score"))]
    return met.select(*key, "game_id", action.alias("action"), *new)


def seed_aliases(mined: DataFrame, teams: DataFrame, aliases: DataFrame, least: float = 0.8) -> DataFrame:
    """(alias, team_id) of mined candidates to be taken over: not rejected, sure enough, of a known team, new; of several the surest, then the smallest team."""
    sure = mined.filter(F.col("rejected").isNull() & (F.col("confidence") >= least)).join(teams.select("team_id"), "team_id", "left_semi").join(aliases.select("alias"), "alias", "left_anti")
    return first_per(sure, ["alias"], [F.desc("confidence"), F.col("team_id")]).select("alias", "team_id")


def judge_unknown(names: DataFrame, teams: DataFrame) -> DataFrame:
    """(name, n, team_id, score, verdict) of unknown names against the teams, a dimension table.

    seed: the best similarity is .9 or more, or else just one team is within one edit (.9); review:
    .6 or more; no match: less.
    """
    seen = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", similarity_key(F.col("name")))
    keyed = teams.select("team_id", similarity_key(F.col("name")).alias("_t"))
    scored = seen.join(keyed, how="inner").select("name", "n", "team_id", F.round(best_similarity(F.col("_k"), F.col("_t")), 9).alias("score"), F.levenshtein("_k", "_t").alias("_edits"))
    best = scored.groupBy("name", "n").agg(F.max_by(F.struct("team_id", "score"), F.struct("score", -F.col("team_id"))).alias("b"), F.sum(F.when(F.col("_edits") <= 1, 1).otherwise(0)).alias("_near"), F.min(F.when(F.col("_edits") <= 1, F.col("team_id"))).alias("_near_id"))
    sure, near = F.col("b.score") >= 0.9, F.col("_near") == 1
    verdict = F.when(sure | near, "seed").when(F.col("b.score") >= 0.6, "review").otherwise("no match")
    return best.select("name", "n", F.when(~sure & near, F.col("_near_id")).otherwise(F.col("b.team_id")).alias("team_id"), F.when(~sure & near, 0.9).otherwise(F.col("b.score")).alias("score"), verdict.alias("verdict"))
