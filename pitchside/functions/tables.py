"""Tables in text: uploads with header aliases, pasted columns, feeds of videos, keys of school names (survey S17, S19, S22, F19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions.posts import MONTH_NAMES
from pitchside.functions.text import squeeze

# Headers that uploads may have for each column, endings of school names.
HEADERS = {
    "player_name": ["player", "name", "player_name"],
    "game_date": ["game date", "date", "game_date"],
    "opponent": ["opponent", "vs", "opp"],
    "goals": ["goals", "g"],
    "assists": ["assists", "a"],
    "ground_balls": ["ground balls", "gbs", "groundballs", "ground_balls", "gb"],
    "caused_turnovers": ["caused turnovers", "cts", "causedturnovers", "caused_turnovers", "ct"],
    "saves": ["saves", "sv"],
    "fo_won": ["fo won", "faceoffs won", "fo_won"],
    "fo_taken": ["fo taken", "faceoffs", "fo_taken", "fo"],
}
SCHOOL_ENDINGS = "senior high school|senior high|high school|high|school|academy|area|hs|prep|preparatory|college|township|hebrew"


def known_columns(upload: DataFrame) -> DataFrame:
    """The columns of an upload whose headers are known, by their own names; of two for one column the first."""
    of = {alias: column for column, aliases in HEADERS.items() for alias in aliases}
    found: dict[str, str] = {}
    for header in upload.columns:
        column = of.get(" ".join(header.lower().split()))
        if column and column not in found:
            found[column] = header
    return upload.select(*[F.col(f"`{h}`").alias(c) for c, h in found.items()])


def cells(line: Column) -> Column:
    """The columns of a pasted line: between tabs, or where it has none between two blanks or more."""
    return F.transform(F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(F.split(line, r"\s{2,}")), lambda x: F.trim(x))


def _row(line: Column, least: int, names: list[str]) -> Column:
    """(jersey, name, team, numbers...) of a ranked line; null for headers, footers and short lines."""
    c = cells(line)
    who = F.get(c, F.lit(1))
    jersey = F.regexp_extract(who, r"^(\d+)\s*-\s*(.+)$", 1).try_cast("int")
    name = F.coalesce(F.nullif(F.trim(F.regexp_extract(who, r"^(\d+)\s*-\s*(.+)$", 2)), F.lit("")), who)
    numbers = [F.regexp_extract(F.get(c, F.lit(3 + i)), r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias(n) for i, n in enumerate(names)]
    return F.when((F.size(c) >= least) & F.get(c, F.lit(0)).rlike(r"^\d+$"), F.struct(jersey.alias("jersey"), name.alias("name"), F.get(c, F.lit(2)).alias("team"), *numbers))


def player_row(line: Column) -> Column:
    """Rank, `jersey - name`, team, games and counts in ten columns or more; null without a jersey."""
    row = _row(line, 10, ["games", "goals", "assists", "points", "penalties", "minutes"])
    return F.when(row["jersey"].isNotNull(), row)


def goalie_row(line: Column) -> Column:
    """Rank, perhaps a jersey, name, team, games, minutes, goals allowed and their average in seven columns or more; jersey 0 where there is none."""
    row = _row(line, 7, ["games", "minutes", "goals_allowed", "average"])
    return F.when(row.isNotNull(), row.withField("jersey", F.coalesce(row["jersey"], F.lit(0))))


def feed_entries(xml: Column, year: int) -> Column:
    """(day, video, title) of each entry of a feed whose title has a date of that year after a colon."""

    def one(block: Column) -> Column:
        part = lambda p, i=1: F.nullif(F.regexp_extract(block, p, i), F.lit(""))
        title = part(r"<title>(.*?)</title>")
        date = rf":\s+({'|'.join(MONTH_NAMES)})\s+(\d{{1,2}}),\s+(\d{{4}})"
        month = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.initcap(F.regexp_extract(title, "(?i)" + date, 1)))
        day = F.concat_ws("-", F.regexp_extract(title, "(?i)" + date, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(title, "(?i)" + date, 2), 2, "0"))
        return F.struct(F.when(month > 0, day).alias("day"), part(r"<yt:videoId>(.*?)</yt:videoId>").alias("video"), title.alias("title"))

    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>")), one)
    return F.filter(found, lambda x: x["day"].startswith(str(year)) & x["video"].isNotNull() & x["title"].isNotNull())


def school_keys(name: Column) -> Column:
    """Keys under which a school may be listed: whole, without its endings, with WC and West Chester, St and Saint exchanged."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "&#x27;", "'"), "&amp;", "&")
    base = squeeze(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", ""), "[^a-z0-9]+", " "))
    bare = F.regexp_replace(base, rf"^(.+?)(?: (?:{SCHOOL_ENDINGS}))+$", "$1")
    swap = lambda start, new: F.when(F.startswith(bare, F.lit(start)), F.concat(F.lit(new), F.substring(bare, len(start) + 1, 1 << 30)))
    keys = F.array(base, bare, swap("wc ", "west chester "), swap("west chester ", ""), swap("st ", "saint "), swap("saint ", "st "))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))
