"""Stat lines that tell a career and not a contest (survey X10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.text import let

# How a stat line begins, what marks a bracket as narration, the least number that does, and the most of each count in one contest.
HEAD = r"(?i)\b([A-Z][A-Za-z'’\-]{1,}(?:\s+[A-Z][A-Za-z'’\-]+)?)\s*[-–.,]?\s*(\d{1,3})\s*(?:g|a|gb|sv|cto|fo|goal|assist|save|ground)\b"
MARKERS = [
    "career", "season", "school record", "state record", "all[- ]?time", "milestone", "now has", "now with", "set [a-z]+ record", "broke", "broken", "reached", "on (?:his|her|the)", "for (?:his|her|the)", "in (?:his|her|the)",
    "lifetime", "overall", "committed", "commit", "signed", "tied", "ties", "previous", "former", "earlier", "matched", "surpass(?:es|ed)?", "pass(?:es|ed)", "reach(?:es|ed)", "notch(?:es|ed)", "tally", "record-tying", "record-setting", "history",
    "all-time leader", "leader[s]?", "hat trick", "four-goal", "five-goal", "six-goal", "standout", "star", "veteran", "senior", "junior", "sophomore", "freshman", r"\brecord\b", r"\bpoint(?:s)?\b",
    r"\bgoal(?:s)?\b(?=[^)]*\b(?:career|season|all|history|record|leader|tied)\b)", "become[s]? .*leader", "first[- ]team", "all[- ](?:state|league|county|conference|america|american)", "won the", r"\bMVP\b", "program record", "school[- ]?record",
    "first career", "1st career", r"\d{2,3}(?:st|nd|rd|th)\s+(?:career|point|goal|save|assist|gb|ground|face)", "saves on the", "goals on the", "points on the",
]
BIG = 25
CAPS = {"goals": 15, "assists": 15, "ground_balls": 30, "caused_turnovers": 20, "saves": 40, "fo_won": 40, "fo_taken": 50}
#: A count of the contest that repeats a number from here on; one that is up to `SMALL` above a number from `SUM` on.
EQUAL, SUM, SMALL = 5, 20, 10



def is_summary_post(url: Column, post: Column) -> Column:
    """A boys' summary, scoreboard or recap of 2026."""
    p = F.lower(post)
    return F.contains(F.lower(url), F.lit("/2026/")) & ~p.rlike(r"\b(girls|women|wlax)\b") & p.rlike(r"boys[-_]?(?:summari|scoreboard|recap)|hs[-_]?boys[-_]?summari")


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), "’'", ""), r"[^a-z0-9 \-]", " "), r"\s+", " "))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,4})\b"), F.lit(1)), lambda n: n.cast("long"))


def narration(line: Column) -> Column:
    """(who, bracket, marker, numbers) of a stat line's first bracket with a marker or a big number; null for other lines.

    who: the name at the head as written, the surname being its last word.
    """
    marker = lambda b: F.regexp_extract(b, f"(?i)(?:{'|'.join(MARKERS)})", 0)
    brackets = F.regexp_extract_all(line, F.lit(r"\(([^()]+)\)"), F.lit(1))
    first = F.get(F.filter(brackets, lambda b: (marker(b) != "") | F.exists(numbers(b), lambda n: n >= BIG)), F.lit(0))
    told = let(first, lambda b: F.struct(F.regexp_extract(line, HEAD, 1).alias("who"), b.alias("bracket"), F.nullif(marker(b), F.lit("")).alias("marker"), numbers(b).alias("numbers")))
    return F.when(line.rlike(HEAD) & first.isNotNull(), told)


def career_prose(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """One row for each suspect line and each of its stat rows: post, line, who, bracket, marker, numbers, player_id, columns, category.

    lines: post, line. stats: post, player_id, name_key and the counts of CAPS. A stat row is the line's if it is of the
    same post and its name has the surname in it. columns: counts over their cap; a number of the
    bracket from 5 on; over their cap and up to ten above a number from 20 on. category: of the line, not-parsed without a
    stat row, parsed-and-suspect with a suspect column, else parsed-and-clean.

    A post's lines meet its rows by the surname's first letters (three at most): a row is repeated for those starts of
    its post's surnames that its name has, so neither all parts of names nor all pairs of a post are made.
    """
    told = lines.withColumn("t", narration(F.col("line"))).filter("t IS NOT NULL").select("post", "line", "t.*")
    told = told.withColumn("surname", name_key(F.element_at(F.split("who", r"\s+"), -1)))
    told = told.withColumn("start", F.nullif(F.substring("surname", 1, 3), F.lit(""))).dropDuplicates(["post", "start", "line"])
    starts = told.groupBy("post").agg(F.collect_set("start").alias("starts"))
    listed = stats.join(starts, "post").withColumn("start", F.explode(F.filter("starts", lambda s: F.contains(F.lower("name_key"), s)))).drop("starts")
    met = told.alias("l").join(listed.alias("r"), (F.col("l.post") == F.col("r.post")) & (F.col("l.start") == F.col("r.start")) & F.contains(F.lower("r.name_key"), F.col("l.surname")), "left")
    met = met.select("l.*", "r.player_id", *[f"r.{c}" for c in CAPS])

    def suspect(c: str, cap: int) -> Column:
        v = F.coalesce(c, F.lit(0))
        near = F.exists("numbers", lambda n: (n >= SUM) & (v >= n) & (v <= n + SMALL))
        return F.when((v > cap) | ((v >= EQUAL) & F.array_contains("numbers", v)) | (near & (v > cap)), F.lit(c))

    columns = F.filter(F.array(*[suspect(c, cap) for c, cap in CAPS.items()]), lambda c: c.isNotNull())
    judged = met.withColumn("columns", F.when(F.col("player_id").isNotNull(), columns))
    # a line tells its start, so rows stay where the join put them
    any_ = F.max(F.size("columns") > 0).over(Window.partitionBy("post", "start", "line"))
    category = F.when(F.max("player_id").over(Window.partitionBy("post", "start", "line")).isNull(), "not-parsed").when(any_, "parsed-and-suspect").otherwise("parsed-and-clean")
    return judged.select("post", "line", "who", "bracket", "marker", "numbers", "player_id", "columns", category.alias("category"))
