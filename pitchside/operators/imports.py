"""Sheets and rosters into the tables: plans first, then one change (survey M13, M14, D14).

Nothing here writes. A plan is a set of tables; applying it gives the new tables, which a TableSet
commits together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.names import player_key
from pitchside.functions.posts import face_off_cell
from pitchside.functions.text import let
from pitchside.operators.core import first_per, once
from pitchside.operators.matching import pick_opponents, token
from pitchside.operators.waterfall import resolve_people
from pitchside.sources.numbering import numbered
from pitchside.sources.scratch import written

# The names that a sheet's columns go by.
COLUMNS = {"name": ["player", "name"], "goals": ["goals", "g"], "assists": ["assists", "a"], "ground_balls": ["gbs", "groundballs", "ground_balls", "gb"], "caused_turnovers": ["cts", "causedturnovers", "caused_turnovers", "ct"], "saves": ["saves", "sv"], "face_offs": ["fo", "faceoff", "faceoffs"]}
TOTALS = "totals"
COUNTS = ["goals", "assists", "ground_balls", "caused_turnovers", "saves", "fo_won", "fo_taken"]


def _cells(row: Column) -> Column:
    """A struct: for each column the first cell of the row (a map by header) whose header is one of the column's names, whatever its case and signs; each header is read once."""
    known = {"".join(a for a in n if a.isalnum()): c for c, names in COLUMNS.items() for n in names}
    column = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    heads = F.transform(F.map_keys(row), lambda k: F.coalesce(F.try_element_at(column, F.lower(k)), F.try_element_at(column, token(k))))
    return let(heads, lambda h: F.struct(*[F.get(F.map_values(row), F.array_position(h, F.lit(c)).cast("int") - 1).alias(c) for c in COLUMNS]))


def sheet_lines(rows: DataFrame) -> DataFrame:
    """(sheet, name, counts) of sheet rows (sheet, cells map by header) with a name and at least one count; a count is a whole number from 0, a face-off cell won/taken."""
    whole = lambda c: F.greatest(F.coalesce(F.regexp_extract(F.trim(c), r"^[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("double").cast("long"), F.lit(0)), F.lit(0)).cast("long")
    read = once(rows.select("sheet", _cells(F.col("cells")).alias("c"))).select("sheet", "c.*")
    both = face_off_cell(F.coalesce("face_offs", F.lit("")))
    counts = [whole(F.col(c)).alias(c) for c in COUNTS[:5]] + [F.greatest(both["won"], F.lit(0)).cast("long").alias("fo_won"), both["taken"].cast("long").alias("fo_taken")]
    named = once(read.select("sheet", F.trim("name").alias("name"), *counts))
    return named.filter((F.col("name") != "") & (sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])) > 0))


@dataclass
class ImportPlan:
    """sheets (sheet, game_id, reason), stats (game_id, player_id, counts), created (player_id, team_id, name, name_key), aliases (alias, player_id, confidence), skipped (sheet, name, reason)."""

    sheets: DataFrame
    stats: DataFrame
    created: DataFrame
    aliases: DataFrame
    skipped: DataFrame


def picked_sheets(rows: DataFrame, opponents: DataFrame) -> DataFrame:
    """(sheet, game_id, reason) for each sheet but totals: its contest, or why there is none."""
    sheets = once(rows.select("sheet").distinct()).filter(token(F.col("sheet")) != TOTALS)
    return pick_opponents(sheets, opponents).join(opponents.select("team_id", "game_id"), "team_id", "left").select("sheet", "game_id", "reason")


def plan_import(rows: DataFrame, team_id: int, opponents: DataFrame, people: DataFrame) -> ImportPlan:
    """What the sheets of one team's workbook mean: a sheet for each opponent, a row for each person.

    rows: sheet, cells. opponents: team_id, name, slug, aliases, games, game_id. people: player_id, team_id, name,
    stat_rows. Lines of one person in a contest are added up. Names are judged against the people there were before
    the import; a new name is one new person, with an id after all others, however many sheets have it. Of several sheets of
    one contest the last by name counts.
    """
    picked = written(picked_sheets(rows, opponents), "sheets")
    last = picked.filter("game_id IS NOT NULL").groupBy("game_id").agg(F.max("sheet").alias("sheet"))
    lines = written(sheet_lines(rows).join(last, "sheet").withColumn("team_id", F.lit(team_id).cast("long")), "lines")
    found = written(resolve_people(lines.select("team_id", "name"), people.filter(F.col("team_id") == team_id)), "resolved")
    fresh = first_per(found.filter("kind = 'created'"), ["key"], [F.col("name")]).select("key", F.col("name").alias("new_name"))
    newest = people.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("n")).first()[0]
    created = numbered(fresh, "key", "nth").select((F.col("nth") + newest + 1).alias("player_id"), F.lit(team_id).cast("long").alias("team_id"), F.col("new_name").alias("name"), F.col("key").alias("name_key"))
    who = found.join(created.select(F.col("name_key").alias("key"), F.col("player_id").alias("_new")), "key", "left").withColumn("player_id", F.coalesce("player_id", F.when(F.col("kind") == "created", F.col("_new"))))
    read = lines.join(who.select("name", "kind", "player_id", "reason").hint("shuffle_hash"), "name")  # the lines, many to a name, are not sorted
    stats = read.filter("player_id IS NOT NULL").groupBy("game_id", "player_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    aliases = who.filter("kind = 'alias'").select(F.col("key").alias("alias"), "player_id", "confidence").distinct()
    return ImportPlan(picked, stats, created, aliases, read.filter("kind = 'skipped'").select("sheet", "name", "reason").distinct())


def apply_import(stats: DataFrame, people: DataFrame, plan: ImportPlan, team_id: int) -> DataFrame:
    """Stat rows (game_id, player_id, counts) after the plan: those of the team's people in the plan's contests give way."""
    mine = people.filter(F.col("team_id") == team_id).select("player_id")
    replaced = stats.join(plan.stats.select("game_id").distinct(), "game_id", "left_semi").join(mine, "player_id", "left_semi").select("game_id", "player_id")
    return stats.join(replaced, ["game_id", "player_id"], "left_anti").unionByName(plan.stats.select(*stats.columns))


def upsert_roster(people: DataFrame, roster: DataFrame) -> DataFrame:
    """people (player_id, team_id, name, jersey) with a roster (team_id, name, jersey, nth): a name's spelling is the roster's, its jersey too unless it has none; new names get the next ids.

    Names are the same by player_key within their team; of several the last counts for the spelling, and the last with a jersey for that.
    """
    keyed = roster.withColumn("key", player_key(F.col("name"))).filter("key <> ''")
    new = keyed.groupBy("team_id", "key").agg(F.max_by("name", "nth").alias("_name"), F.max_by("jersey", F.when(F.col("jersey").isNotNull(), F.col("nth"))).alias("_jersey"))
    old = people.withColumn("key", player_key(F.col("name")))
    both = old.join(new, ["team_id", "key"], "left").select("player_id", "team_id", F.coalesce("_name", "name").alias("name"), F.coalesce("_jersey", "jersey").alias("jersey"))
    newest = people.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("n")).first()[0]
    fresh = new.join(old.select("team_id", "key"), ["team_id", "key"], "left_anti").withColumn("place", F.struct("team_id", "key"))
    added = numbered(fresh, "place", "nth").select((F.col("nth") + newest + 1).alias("player_id"), "team_id", F.col("_name").alias("name"), F.col("_jersey").alias("jersey"))
    return both.unionByName(added)


def match_people(lines: DataFrame, people: DataFrame) -> DataFrame:
    """lines (team_id, name, jersey, ...) with player_id: by name within the team, else by jersey; null if neither tells. Of several people of one key the newest."""
    keyed = people.withColumn("key", player_key(F.col("name")))
    by_name = keyed.filter("key <> ''").groupBy("team_id", "key").agg(F.max("player_id").alias("_by_name"))
    by_jersey = keyed.filter("jersey IS NOT NULL").groupBy("team_id", "jersey").agg(F.max("player_id").alias("_by_jersey"))
    out = lines.withColumn("key", player_key(F.col("name"))).join(by_name, ["team_id", "key"], "left").join(by_jersey, ["team_id", "jersey"], "left")
    return out.select(*lines.columns, F.coalesce("_by_name", "_by_jersey").alias("player_id"))


def judge_junk(decisions: DataFrame, people: DataFrame, stats: DataFrame) -> DataFrame:
    """(nth, player_id, kind, name, target_id, verdict, reason) for an ordered table of decisions (nth, player_id, kind, name) on people who aren't any.

    people: player_id, team_id, name; stats: game_id, player_id. verdict: done (nothing left to do), planned, rejected.
    rename: the person gets the name, unless its key is empty or somebody of the team has it, before or by an earlier
    decision. reattribute: the stat rows go to the person of the team with that name, unless there is none or he
    has rows of the same contests, before or by an earlier decision. flag: always. Decisions that bear on one person
    or name are judged in their order, one a pass; all others at once.
    """
    keyed = people.withColumn("key", player_key(F.col("name"))).select("player_id", "team_id", F.col("name").alias("now"), "key")
    d = decisions.join(keyed, "player_id", "left").withColumn("wanted", player_key(F.col("name")))
    holder = keyed.filter("key <> ''").groupBy("team_id", F.col("key").alias("wanted")).agg(F.min("player_id").alias("first"), F.max("player_id").alias("last"))
    d = d.join(holder, ["team_id", "wanted"], "left")
    other = F.when(F.col("first") != F.col("player_id"), F.col("first")).when(F.col("last") != F.col("player_id"), F.col("last"))
    d = d.withColumn("target_id", F.when(F.col("kind") != "flag", other))
    gone, renaming, moving = F.col("now").isNull(), F.col("kind") == "rename", F.col("kind") == "reattribute"
    early = (
        F.when(gone | (renaming & (F.col("now") == F.col("name")) & (F.col("key") == F.col("wanted"))), "done").when(renaming & ((F.col("wanted") == "") | F.col("target_id").isNotNull()), "rejected").when(moving & F.col("target_id").isNull(), "rejected").when(F.col("kind") == "flag", "planned")
    )
    why = F.when(~gone & renaming & (F.col("wanted") == ""), "empty key").when(~gone & renaming & F.col("target_id").isNotNull(), "name is taken").when(~gone & moving & F.col("target_id").isNull(), "nobody has the name")
    d = written(d.withColumns({"verdict": early, "reason": F.when(early == "rejected", why)}), "decisions")
    settled, open_ = d.filter("verdict IS NOT NULL"), d.filter("verdict IS NULL")
    # decisions on one target are a queue; a name that an earlier rename took is taken, so renames are judged at once
    queue = Window.partitionBy("kind", "team_id", "wanted").orderBy("nth")
    open_ = written(open_.withColumn("turn", F.row_number().over(queue)), "queue")
    late = F.col("turn") > 1
    renames = open_.filter("kind = 'rename'").withColumns({"verdict": F.when(late, "rejected").otherwise("planned"), "reason": F.when(late, "name is taken")})
    parts = [settled, renames.drop("turn")]
    # each pass judges the first move of each queue
    moving = open_.filter("kind = 'reattribute'")
    turns = moving.agg(F.max("turn")).first()[0] or 0
    taken = stats.withColumnRenamed("player_id", "target_id").join(moving.select("target_id").distinct(), "target_id", "left_semi").select("game_id", "target_id")
    for turn in range(1, turns + 1):
        now = moving.filter(F.col("turn") == turn)
        moves = now.select("nth", "player_id", "target_id").join(stats, "player_id")
        clash = moves.join(taken, ["game_id", "target_id"], "left_semi").select("nth").distinct().withColumn("_clash", F.lit(True))
        refused = F.col("_clash").isNotNull()
        judged = now.join(clash, "nth", "left").withColumns({"verdict": F.when(refused, "rejected").otherwise("planned"), "reason": F.when(refused, "has rows of the contest")})
        judged = written(judged.drop("_clash", "turn"), "judged")
        parts.append(judged)
        if turn < turns:
            won = judged.filter("verdict = 'planned'").select("player_id", "target_id").join(stats, "player_id").select("game_id", "target_id")
            taken = written(taken.unionByName(won), "taken")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("nth", "player_id", "kind", "name", F.when(F.col("kind") == "reattribute", F.col("target_id")).alias("target_id"), "verdict", "reason")


def apply_junk(judged: DataFrame, people: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, stats, flags) after the planned decisions: renamed, moved and dropped, and (player_id, game_id, name) to look at."""
    plan = judged.filter("verdict = 'planned'")
    renamed = plan.filter("kind = 'rename'").select("player_id", F.col("name").alias("_to"))
    moved = plan.filter("kind = 'reattribute'").select("player_id", "target_id")
    after = people.join(renamed, "player_id", "left").withColumn("name", F.coalesce("_to", "name")).drop("_to").join(moved.select("player_id"), "player_id", "left_anti").select(*people.columns)
    rows = stats.join(moved, "player_id", "left").withColumn("player_id", F.coalesce("target_id", "player_id")).select(*stats.columns)
    flags = plan.filter("kind = 'flag'").select("player_id").join(people, "player_id").join(stats, "player_id").select("player_id", "game_id", F.col("name"))
    return after, rows, flags
