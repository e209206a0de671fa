"""Lookups, reviews and reversible changes (survey D1, D21, D22, D27, A33, J16, J18, L9, L11, M8, M9, S25)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions.text import team_key
from pitchside.operators.core import first_per, unordered

# The largest plausible value of a field, and how many times the old value a new one may be.
HARD_CAPS = {"goals": 15, "assists": 15, "ground_balls": 30, "caused_turnovers": 20, "saves": 40, "fo_won": 40, "fo_taken": 50, "home_score": 30, "away_score": 30}
MULTIPLIERS = {"goals": 5, "assists": 5, "home_score": 10, "away_score": 10}


def resolve_names(rows: DataFrame, raw: str, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with team_id: by alias first, else by name, of several the smallest id; null where nothing fits.

    `teams` has team_id and name, `aliases` has alias and team_id. All three are compared by key.
    """
    known = aliases.select(team_key(F.col("alias")).alias("_key"), F.struct(F.lit(0).alias("way"), "team_id").alias("hit")).unionByName(teams.select(team_key(F.col("name")).alias("_key"), F.struct(F.lit(1).alias("way"), "team_id").alias("hit")))
    best = known.groupBy("_key").agg(F.min("hit").alias("_hit"))
    return rows.withColumn("_key", team_key(F.col(raw))).join(best, "_key", "left").withColumn("team_id", F.col("_hit.team_id")).drop("_key", "_hit")


def suspect_scores(goals: DataFrame, scores: DataFrame) -> DataFrame:
    """Sides whose players scored more than the side; both inputs are by game_id and team_id."""
    sums = goals.groupBy("game_id", "team_id").agg(F.sum("goals").alias("player_goals"))
    return sums.join(scores.select("game_id", "team_id", "score"), ["game_id", "team_id"]).filter(F.col("player_goals") > F.col("score"))


def score_decision(current: Column, summed: Column, offered: Column, slack: int = 5) -> Column:
    """Whether another source's score replaces a suspect one: it must lie from the players' sum up to `slack` above it."""
    return F.when(offered.isNull(), "no_source").when(current >= summed, "not_suspect").when(offered < summed, "below_sum").when(offered > summed + slack, "above_ceiling").otherwise("apply")


# The longest name, and the least and greatest jersey, that a correction may give.
NAME_LENGTH, JERSEYS = 100, (0, 99)


def correction_status(field: Column, old: Column, new: Column) -> Column:
    """outlier over the field's cap or over its multiple of a positive old value, else pending."""
    cap, times = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair])[field] for m in (HARD_CAPS, MULTIPLIERS))
    return F.when((new > cap) | ((old > 0) & (new > old * times)), "outlier").otherwise("pending")


def judge_correction(field: Column, old: Column, new: Column) -> Column:
    """The status of a correction whose values are texts: outlier, pending, or unknown for a field that can't be corrected.

    A name is an outlier if it is blank or has over 100 characters, a jersey if it doesn't begin with a number from 0 to 99, a count
    or a score by correction_status; a value of these that is no number is an outlier, too.
    """
    number = F.regexp_extract(F.trim(new), r"^[+-]?\d+", 0).try_cast("int")
    bad_name = (F.trim(F.coalesce(new, F.lit(""))) == "") | (F.length(new) > NAME_LENGTH)
    bad_jersey = ~F.coalesce(number.between(*JERSEYS), F.lit(False))
    value = new.try_cast("double")
    status = F.when(value.isNull(), "outlier").otherwise(correction_status(field, old.try_cast("double"), value))
    flagged = lambda bad: F.when(bad, "outlier").otherwise("pending")
    return F.when(field == "name", flagged(bad_name)).when(field == "jersey_number", flagged(bad_jersey)).when(field.isin(*HARD_CAPS), status).otherwise("unknown")


def existing_games(rows: DataFrame, games: DataFrame) -> DataFrame:
    """rows with the id of the contest of the same day and pair, and whether its sides are swapped; the smallest id of several."""
    low, high = unordered(F.col("home_id"), F.col("away_id"))
    keys = ["game_date", "_low", "_high"]
    known = games.withColumns({"_low": low, "_high": high}).groupBy(*keys).agg(F.min(F.struct("game_id", "home_id")).alias("_hit"))
    found = rows.withColumns({"_low": low, "_high": high}).join(known, keys, "left")
    return found.withColumn("found_id", F.col("_hit.game_id")).withColumn("reversed", F.col("_hit.home_id") != F.col("home_id")).drop("_low", "_high", "_hit")


def snapshot_diff(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """What changed by game_num: new_game, teams_changed, new_result (was 0-0), score_changed or removed; the first that fits.

    Both have game_num (unique), home, away, home_score and away_score. Unchanged contests have no row.
    """
    fields = ["home", "away", "home_score", "away_score"]
    old, new = (f.select("game_num", F.struct(*fields).alias(name)) for f, name in ((snapshot, "old"), (live, "new")))
    differs = lambda *names: ~F.struct(*[F.col(f"old.{n}") for n in names]).eqNullSafe(F.struct(*[F.col(f"new.{n}") for n in names]))
    unplayed, scored = F.col("old.home_score") + F.col("old.away_score") == 0, F.greatest("new.home_score", "new.away_score") > 0
    kind = F.when(F.col("old").isNull(), "new_game").when(F.col("new").isNull(), "removed").when(differs("home", "away"), "teams_changed").when(unplayed & scored, "new_result").when(differs("home_score", "away_score"), "score_changed")
    return old.join(new, "game_num", "full_outer").select("game_num", kind.alias("change"), *[F.col(f"{s}.{n}").alias(f"{s}_{n}") for s in ("old", "new") for n in fields[2:]]).filter("change IS NOT NULL")


def latest_state(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The status of each key's last event; `order` names the columns that make the order total."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status), F.count(F.lit(1)).alias("events"))


def latest_rows(frame: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows of each group's newest value of `at` (week, snapshot)."""
    newest = frame.groupBy(*keys).agg(F.max(at).alias(at)) if keys else frame.agg(F.max(at).alias(at))
    return frame.join(newest, [*keys, at], "left_semi")


def in_order_of(frame: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows of the ids asked for, in the order asked; ids without a row are left out."""
    asked = frame.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("position", key))
    return frame.join(asked, key).orderBy("position")


def beyond_newest(files: DataFrame, keep: int) -> DataFrame:
    """Files (path, modified) that go when the newest `keep` stay; equal times go by path."""
    stay = files.orderBy(F.desc("modified"), F.desc("path")).limit(keep)
    return files.join(stay, "path", "left_anti")


def stale_season(games: DataFrame, today: date, days: int = 7) -> DataFrame:
    """One row: the season's last contest, its age in days and whether that is too old (March to June only)."""
    last = games.filter(F.col("season") == today.year).agg(F.max("game_date").alias("last_game"))
    age = F.datediff(F.lit(today), "last_game")
    return last.select("last_game", age.alias("age"), (F.lit(3 <= today.month <= 6) & (F.col("last_game").isNull() | (age > days))).alias("stale"))


def preview(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The plan of an upload: for each key of the batch insert, update or same, with the old and new values.

    Write it before the change is made: `confirm` applies it and `revert` takes it back.
    """
    values = [c for c in target.columns if c not in keys]
    new = first_per(batch, keys, order).select(*keys, F.struct(*values).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return new.join(target.select(*keys, F.struct(*values).alias("old")), keys, "left").withColumn("action", action)


def confirm(target: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    changed = plan.filter("action <> 'same'")
    return target.join(changed, keys, "left_anti").unionByName(changed.select(*keys, "new.*"))


def revert(target: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """target with inserted keys gone and updated ones as they were; keys outside the plan stay."""
    changed = plan.filter("action <> 'same'")
    return target.join(changed, keys, "left_anti").unionByName(changed.filter("action = 'update'").select(*keys, "old.*"))


def roster_differences(ours: DataFrame, live: DataFrame) -> DataFrame:
    """(team, name, side) of names that only one of two rosters (team, name) has; case and white space don't count. side: ours or live."""
    key = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    a, b = (r.groupBy("team", key.alias("key")).agg(F.min("name").alias("name")) for r in (ours, live))
    only = lambda x, y, side: x.join(y.select("team", "key"), ["team", "key"], "left_anti").select("team", "name", F.lit(side).alias("side"))
    return only(a, b, "ours").unionByName(only(b, a, "live"))


def score_drift(snapshot: DataFrame, ours: DataFrame) -> DataFrame:
    """snapshot's played contests with `state`: missing, drift or ok against ours, by (game_date, home, away); of several of ours the last by scores."""
    key = ["game_date", "home", "away"]
    mine = ours.groupBy(*key).agg(F.max(F.struct("home_score", "away_score")).alias("_o"))
    played = snapshot.filter((F.col("home_score") > 0) | (F.col("away_score") > 0)).join(mine, key, "left")
    same = (F.col("_o.home_score") == F.col("home_score")) & (F.col("_o.away_score") == F.col("away_score"))
    return played.select(*snapshot.columns, F.when(F.col("_o").isNull(), "missing").when(same, "ok").otherwise("drift").alias("state"))


def day_signatures(games: DataFrame) -> DataFrame:
    """(game_date, signature): id:away:home:postponed of a day's contests in the order of ids, joined by |; it changes when any of them does."""
    one = F.concat_ws(":", F.col("game_id").cast("string"), F.coalesce(F.col("away_score").cast("string"), F.lit("")), F.coalesce(F.col("home_score").cast("string"), F.lit("")), F.coalesce(F.col("postponed"), F.lit(False)).cast("int").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("game_id", one.alias("s"))))  # the contests of one day
    return games.groupBy("game_date").agg(F.array_join(F.transform(listed, lambda x: x["s"]), "|").alias("signature"))
