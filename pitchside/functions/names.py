"""Keys and comparisons of team and player names, as builtin column expressions (survey F2, F3, F5, F8-F11, F13-F17, X11)."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pitchside.functions.text import let, squeeze

# Which state codes stay, words that are no part of a name, and markers of prose.
LISTED_STATES = "NJ NY DE MD VA CT MA OH"
SUFFIX_WORDS = r"scorers?|scoring|stats?|goals?|assists?|saves?|leaders?|notes?"
SECTION_WORDS = r"goalies?|faceoffs?|ground\s*balls?|gbs?|ctos?|caused\s*turnovers?|shots?"
SMALL_WORDS = ["of", "and", "the", "in", "for", "at"]
NOT_NAMES = ["", "none", "no name provided", "no names provided", "tbd", "unknown", "n/a", "n a", "na"]
POSITIONS_AND_SUFFIXES = "goalie|attack|midfield|defense|jr|sr|ii|iii|iv"
PROSE = (
    r"(?i)\b(?:career|season|school record|state record|program record|all[- ]?time|milestone|now has|now with|set [a-z]+ record|broke|reached|on (his|her|the)|for (his|her|the)|in (his|her|the)"
    r"|lifetime|overall|committed|commit|signed|tied|ties|history|leader[s]?|surpass(?:es|ed)?|notch(?:es|ed)?|hat trick|passed [A-Z]|\d+(?:st|nd|rd|th)\s+(?:career|point|goal|save|assist|gb|ground|face))\b"
)


@cache
def _marks() -> tuple[str, str]:
    """Letters with marks and what is left without them, of the Latin blocks."""
    plain = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    single = {c: p for c, p in plain.items() if len(p) == 1 and p != c}
    return "".join(single), "".join(single.values())


def without_marks(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, *_marks()), "[̀-ͯ]", "")


def strip_prose(line: Column) -> Column:
    """Drops a trailing bracket unless it holds a stat; words of prose always lose."""
    inner, head = F.regexp_extract(line, r"^(.*?)\s*\(([^()]*)\)\s*$", 2), F.trim(F.regexp_extract(line, r"^(.*?)\s*\(([^()]*)\)\s*$", 1))
    keeps = inner.rlike(r"(?i)\d+\s*(?:g|a|gb|sv|cto|fo|goal|assist|save|ground)") & ~inner.rlike(PROSE)
    return F.when(~line.rlike(r"^.*?\s*\([^()]*\)\s*$") | keeps, line).otherwise(head)


def team_name(raw: Column) -> Column:
    """Without trailing brackets, but for the state nearest to the end among the listed ones; null if nothing is left."""
    return let(squeeze(raw), _peeled)


def _peeled(s: Column) -> Column:
    tail = F.regexp_extract(s, r"((?:\s*\([^()]*\))*)\s*$", 1)
    head = F.trim(F.regexp_replace(s, r"(?:\s*\([^()]*\))+\s*$", ""))
    codes = F.filter(F.transform(F.regexp_extract_all(tail, F.lit(r"\(([^()]*)\)")), lambda x: F.upper(F.trim(x))), lambda x: x.isin(*LISTED_STATES.split()))
    state = F.when(F.size(codes) > 0, F.concat(F.lit(" ("), F.element_at(codes, -1), F.lit(")"))).otherwise("")
    return F.when(head != "", F.concat(head, state))


def team_token(raw: Column) -> Column:
    """A sub-header without its section words, up to three times; a section word alone is empty."""
    s = F.trim(F.regexp_replace(raw, " ", " "))
    for _ in range(3):
        s = F.trim(F.regexp_replace(F.regexp_replace(s, rf"(?i)\s+(?:{SUFFIX_WORDS})\s*:?\s*$", ""), rf"(?i)\s+(?:{SECTION_WORDS})\s*:?\s*$", ""))
    return F.when(s.rlike(rf"(?i)^(?:{SECTION_WORDS}|saves?)\s*:?\s*$"), "").otherwise(F.trim(F.regexp_replace(s, r"[\s:.,;]+$", "")))


def official_key(raw: Column) -> Column:
    """Lower case without brackets and punctuation; (nj) and (ny) stay at the end."""
    s = F.lower(squeeze(raw))
    state = F.regexp_extract(s, r"\((nj|ny)\)", 1)
    bare = squeeze(F.regexp_replace(F.regexp_replace(s, r"\s*\([^)]*\)", ""), "[^a-z0-9 ]+", ""))
    return F.when(state == "", bare).otherwise(F.concat(bare, F.lit(" ("), state, F.lit(")")))


def title_case(raw: Column) -> Column:
    """Small words stay small but in front; short all-capital words stay as they are; capitals follow hyphens and periods."""

    def one(word: Column, i: Column) -> Column:
        low = F.lower(word)
        parts = F.transform(F.split(low, r"(?<=[-.])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
        return F.when(F.regexp_replace(word, r"^\(|\)$", "").rlike("^[A-Z]{2,3}$"), word).when((i > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.array_join(parts, ""))

    return F.array_join(F.transform(F.split(squeeze(raw), " "), one), " ")


def player_key(raw: Column) -> Column:
    """The key of a player within a team: no marks, case, initials' periods, trailing positions or suffixes; empty for what is no name. Applying it twice changes nothing."""
    s = F.lower(without_marks(F.coalesce(raw, F.lit(""))))
    s = F.regexp_replace(F.regexp_replace(F.translate(s, "‘’", "''"), "[–—]", " "), "[^a-z0-9 .'-]", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"(\b[a-z])\.", "$1"), r"\s+", " "))
    for _ in range(3):  # suffixes after suffixes
        s = F.regexp_replace(s, rf"^(\S.*?)(?: (?:{POSITIONS_AND_SUFFIXES})[.'-]*)+$", "$1")
    return let(F.trim(F.regexp_replace(s, r"[.'-]+$", "")), lambda s: F.when(s.isin(*NOT_NAMES), "").otherwise(s))


def fuzzy_key(raw: Column) -> Column:
    """For comparison by distance: also without brackets, numbers, hyphens, positions and suffixes anywhere."""
    s = F.translate(F.lower(without_marks(F.coalesce(raw, F.lit("")))), "‘’–—-", "''   ")
    for pattern in (r"\([^)]*\)", r"#?\b\d+\b", r"[^a-z\s']"):
        s = F.regexp_replace(s, pattern, " ")
    words = F.filter(F.split(squeeze(s), " "), lambda w: (w != "") & ~w.rlike(rf"^(?:{POSITIONS_AND_SUFFIXES})$"))
    return F.array_join(words, " ")


def swapped(a: Column, b: Column) -> Column:
    """Whether two strings differ by one swap of neighbours."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return (F.length(a) == F.length(b)) & (a != b) & F.exists(at, lambda i: swap(i) == b)


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which a swap of neighbours is one step and nothing is edited twice (optimal string alignment)."""

    def one(x, y):
        if x is None or y is None:
            return None
        older, last = [], list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i]
            for j, d in enumerate(y, 1):
                step = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    step = min(step, older[j - 2] + (c != d))
                row.append(step)
            older, last = last, row
        return last[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def _ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _words(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, " "), lambda w: w != ""))


def similarity_key(raw: Column) -> Column:
    """Lower case, letters and digits only, & spelled out."""
    s = F.lower(F.coalesce(team_name(team_token(raw)), F.lit("")))
    return squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[.'’]", ""), "&", " and "), "[^a-z0-9]+", " "))


def best_similarity(a: Column, b: Column) -> Column:
    """The best of edit ratio, shared words and containment, of two similarity keys; 1 for equal ones."""
    x, y = _words(a), _words(b)
    most = F.greatest(F.size(x), F.size(y))
    shared = F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / most)
    inside = F.when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(_ratio(a, b), shared, inside))


def bonus_key(raw: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(raw), "[.'`’]", ""), "[-_/]+", " "))


def bonus_similarity(a: Column, b: Column) -> Column:
    """Edit ratio plus .25 for equal keys, .15 for containment or .05 for each of up to three shared words; at most 1, 0 for an empty key."""
    shared = F.least(F.size(F.array_intersect(_words(a), _words(b))), F.lit(3))
    bonus = F.when(a == b, 0.25).when(F.contains(a, b) | F.contains(b, a), 0.15).otherwise(shared * 0.05)
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.least(F.lit(1.0), _ratio(a, b) + bonus))


def _aligned(short: Column, long: Column, at_end: bool) -> Column:
    """Every word of the shorter list starts the word beside it in the longer one."""
    n = F.size(short)
    part = F.slice(long, F.greatest(F.size(long) - n + 1, F.lit(1)) if at_end else F.lit(1), F.greatest(n, F.lit(1)))
    return (n <= F.size(long)) & F.forall(F.zip_with(part, short, lambda w, p: F.coalesce(F.startswith(w, p), F.lit(False))), lambda ok: ok)


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def partial_match(sub: Column, team: Column) -> Column:
    """Whether two team keys may mean one team: words or word beginnings aligned at either end, initials, or an initial before the second word."""
    words = [F.filter(F.split(s, r"[\s\-]+"), lambda w: w != "") for s in (sub, team)]
    return let(F.struct(words[0].alias("x"), words[1].alias("y")), lambda v: _partial(sub, team, v["x"], v["y"]))


def _partial(sub: Column, team: Column, x: Column, y: Column) -> Column:
    found = F.lit(False)
    for a, b in ((x, y), (y, x)):
        one = F.get(a, F.lit(0))
        found = found | _aligned(a, b, False) | _aligned(a, b, True)
        found = found | ((F.size(a) == 1) & one.rlike("^[a-z]{2,5}$") & (F.size(b) >= 2) & (_initials(b) == one))
        spelled = F.concat(F.substring(F.get(b, F.lit(0)), 1, 1), F.get(b, F.lit(1)))
        found = found | ((F.size(a) == 1) & (F.size(b) == 2) & (F.length(one) >= 3) & F.coalesce(one == spelled, F.lit(False)))
    return F.when((sub == team) | (F.size(x) == 0) | (F.size(y) == 0), sub == team).otherwise(found)


def resolve_hint(hint: Column, teams: Column) -> Column:
    """The first known team that equals the hint, has it as initials, or starts as it does; the hint itself if none."""
    low = F.lower(hint)
    first = lambda test: F.get(F.filter(teams, test), F.lit(0))
    initials = F.upper(F.regexp_replace(hint, "[^A-Za-z]", ""))
    by_initials = first(lambda t: F.upper(_initials(F.split(t, r"[\s\-]+"))) == initials)
    by_start = first(lambda t: F.startswith(F.lower(t), low) | F.startswith(low, F.lower(F.get(F.split(t, r"\s"), F.lit(0)))))
    return F.when(hint == "", hint).otherwise(F.coalesce(first(lambda t: F.lower(t) == low), by_initials, by_start, hint))


def anomaly_token(line: Column) -> Column:
    """The name that an anomaly's text says was not resolved, null if it names none."""
    part = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    return F.coalesce(part(r'(?i)\[unresolved sub-header:\s*"([^"]+)"\]'), part(r'(?i)teamHint="([^"]+)"'))
