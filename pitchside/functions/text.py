"""Text and name functions as builtin column chains (survey F1, F4, F7, F21, F23, F25, S7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it; keeps plans of nested text rules small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def straight_quotes(s: Column) -> Column:
    return F.translate(s, "‘’“”", "''\"\"")


def squeeze(s: Column) -> Column:
    """White space of any kind, no-break space included, as single blanks."""
    return F.trim(F.regexp_replace(s, r"[\s ]+", " "))


def team_key(name: Column) -> Column:
    """Lower case, without a trailing state in brackets and a high-school suffix."""
    s = F.regexp_replace(F.lower(squeeze(name)), r"\s*\([a-z]{2}\)$", "")
    s = F.regexp_replace(s, r"\s+(high school|hs|h\.s\.)$", "")
    return F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def state_suffix(name: Column) -> Column:
    """(name, state) of a name that ends in a state in brackets; the state is null otherwise."""
    state = F.regexp_extract(name, r"\(([A-Za-z]{2})\)\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(name, r"\s*\([A-Za-z]{2}\)\s*$", "")).alias("name"), F.when(state != "", F.upper(state)).alias("state"))


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "'", ""), "&", " and ")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def last_segment(url: Column) -> Column:
    """The last non-empty part of a URL's path, null if there is none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    part = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(part != "", part)


def season_of_url(url: Column) -> Column:
    """A year from 2000 on that stands alone in the path."""
    return F.regexp_extract(url, r"/(20\d\d)(?:[/-]|$)", 1).try_cast("int")


def monday(day: Column) -> Column:
    return F.trunc(day, "week")


def parse_day(cell: Column) -> Column:
    """ISO, m/d/yyyy, m/d/yy or a spreadsheet serial; null for anything else."""
    serial = F.when(cell.rlike(r"^\d{4,5}(\.0+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), cell.try_cast("double").cast("int")))
    slash = F.regexp_replace(cell, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "$1/$2/20$3")
    return F.coalesce(F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(cell, "yyyy-MM-dd")), F.when(slash.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(slash, "M/d/yyyy")), serial)


def count_or_zero(cell: Column) -> Column:
    """Blank is 0; what is no number is null."""
    return F.when(F.trim(cell) == "", 0).otherwise(F.trim(cell).try_cast("double")).cast("double")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def split_names(name: Column) -> Column:
    """The people of a cell like `A. Bee, C. Dee and E. Eff`; the whole cell unless every part looks like a name."""
    return let(squeeze(name), _people)


def _people(whole: Column) -> Column:
    parts = F.filter(F.split(whole, r"(?i)\s*,\s+and\s+|\s*,\s*|\s+and\s+"), lambda p: p != "")
    each = F.forall(parts, lambda p: p.rlike(r"^[A-Z][A-Za-z'.-]+"))
    return F.when(whole == "", F.array().cast("array<string>")).when((F.size(parts) > 1) & each, parts).otherwise(F.array(whole))
