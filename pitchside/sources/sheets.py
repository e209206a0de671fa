"""CSV sheets whose columns are known by their headers (survey S16, S17).

Sheets are small files, each with its own headers, read as whole texts (path, text); lines and cells are
taken apart by column expressions, so many files are read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions.tables import HEADERS
from pitchside.functions.text import count_or_zero, let, parse_day

# Headers of a schedule, and what its column of completed contests says for yes.
SCHEDULE = {"date": "date", "completed": "game completed", "home": "home team", "home_score": "home score", "away": "visitor team", "away_score": "visitor score"}
REQUIRED, YES = ("date", "home", "away"), ("yes", "true", "1")
COUNTS = [c for c in HEADERS if c not in ("player_name", "game_date", "opponent")]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_cells(line: Column) -> Column:
    """The cells of a CSV line without white space around them; a quoted cell may have commas and doubled quotes."""
    cut = F.regexp_extract_all(line, F.lit(r'((?:[^",]|"(?:[^"]|"")*"?)*)(?:,|$)'), F.lit(1))
    n = F.size(cut)
    kept = F.when(F.endswith(line, F.lit(",")) | (line == ""), cut).otherwise(F.slice(cut, 1, F.greatest(n - 1, F.lit(1))))  # the pattern also finds the empty end
    bare = lambda c: F.replace(F.regexp_replace(c, r'"((?:[^"]|"")*)"?', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(kept, lambda c: F.trim(bare(c)))


def sheet_rows(texts: DataFrame, squeeze_headers: bool = False) -> DataFrame:
    """(path, row, line, cells) of each line that isn't blank but the first; cells is a map from header, in lower case, to cell.

    row is the line's number among those that aren't blank, the headers being 1. Of two columns with one header the first counts; cells
    beyond the headers have none and are left out. squeeze_headers: signs in headers are blanks.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "^\\uFEFF", ""), r"\r\n?", "\n")
    lines = texts.select("path", F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("lines"))
    lower = lambda h: F.lower(h)
    plain = (lambda h: F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", " "))) if squeeze_headers else lower
    headed = lines.withColumn("headers", F.transform(split_cells(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))), plain))
    rows = headed.select("path", "headers", F.posexplode("lines").alias("row", "line")).filter("row > 0")

    def by_header(cells: Column) -> Column:
        named = F.transform(F.sequence(F.lit(0), F.size("headers") - 1), lambda i: F.struct(F.get("headers", i).alias("key"), F.coalesce(F.get(cells, i), F.lit("")).alias("value")))
        first = F.filter(named, lambda e, i: F.array_position(F.col("headers"), e.key) == i + 1)
        return F.map_from_entries(first)

    return rows.select("path", (F.col("row") + 1).alias("row"), "line", "headers", let(split_cells(F.col("line")), by_header).alias("cells"))


def schedule_rows(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, row, date, home, away, completed, home_score, away_score), (path, row, line, reason)) of schedules, whatever the order of their columns.

    Malformed: a date that isn't ISO, a missing team, and the headers of a sheet that lacks one of the three needed.
    """
    rows = sheet_rows(texts)
    needed = F.forall(F.array(*[F.lit(SCHEDULE[c]) for c in REQUIRED]), lambda h: F.array_contains("headers", h))
    cell = {c: F.coalesce(F.col("cells")[h], F.lit("")) for c, h in SCHEDULE.items()}
    reason = F.when(~needed, "header missing required columns").when(~cell["date"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit('bad date: "'), cell["date"], F.lit('"'))).when((cell["home"] == "") | (cell["away"] == ""), "missing home/away team")
    judged = rows.withColumn("reason", reason)
    score = lambda c: F.nullif(cell[c], F.lit("")).try_cast("double").alias(c)
    good = judged.filter("reason IS NULL").select("path", "row", cell["date"].alias("date"), cell["home"].alias("home"), cell["away"].alias("away"), F.lower(cell["completed"]).isin(*YES).alias("completed"), score("home_score"), score("away_score"))
    lacking = F.when(F.col("reason") == "header missing required columns", F.col("row") == 2).otherwise(F.col("reason").isNotNull())  # said once for a sheet
    return good, judged.filter(lacking).select("path", "row", "line", "reason")


def upload_rows(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, row, player_name, game_date, opponent, counts), (path, row, message)) of uploaded sheets, with any of the known headers.

    A count that is blank or has no column is 0. Errors, the first that holds: a count that is no number, in the order of the
    counts, a date that is none, a missing player; a sheet without a column of dates has none.
    """
    rows = sheet_rows(texts, squeeze_headers=True).filter(F.regexp_replace("line", r'[\s,"]', "") != "")
    alias = lambda a: " ".join("".join(x if x.isalnum() else " " for x in a.lower()).split())
    found = {c: F.coalesce(*[F.col("cells")[h] for h in dict.fromkeys(map(alias, names))]) for c, names in HEADERS.items()}
    counts = {c: F.coalesce(count_or_zero(F.coalesce(found[c], F.lit(""))), F.lit(None)) for c in COUNTS}
    day, name = parse_day(F.coalesce(found["game_date"], F.lit(""))), F.coalesce(found["player_name"], F.lit(""))
    message = F.when(F.lit(False), "")
    for c in COUNTS:
        message = message.when(counts[c].isNull(), f"Invalid {c}")
    message = message.when(found["game_date"].isNotNull() & day.isNull(), "Invalid game_date").when(name == "", "player_name is required").when(day.isNull(), "game_date is required")
    judged = rows.withColumn("message", message)
    good = judged.filter("message IS NULL").select("path", "row", name.alias("player_name"), day.alias("game_date"), F.coalesce(found["opponent"], F.lit("")).alias("opponent"), *[v.alias(c) for c, v in counts.items()])
    return good, judged.filter("message IS NOT NULL").select("path", "row", "message")
