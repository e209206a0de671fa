"""Posts as lines, and what their lines say in order: scoreboards, summaries, category (survey S9, X7-X9, F20, F22, F30).

A post's state (date, section, contest, sub-header) is carried down its lines by windows over one
post, so a post is the unit of parallelism.
"""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pitchside.functions import parsers
from pitchside.functions.names import team_name
from pitchside.functions.text import split_names, squeeze, straight_quotes

# Elements without lines of their own, elements that end a line, months.
LEFT_OUT = frozenset("script style noscript template svg header footer nav aside".split())
ENDS_LINE = frozenset("br p div li h1 h2 h3 h4 h5 h6 tr hr blockquote section article".split())
MONTH_NAMES = "January February March April May June July August September October November December".split()
MONTHS = rf"(?:{'|'.join(MONTH_NAMES)}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skipped, self.open = [], [], []

    def _implied_end(self, tag, within):
        """The end of an open element that the page leaves out."""
        if tag in self.open and not any(t in within for t in self.open[len(self.open) - self.open[::-1].index(tag) :]):
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if tag in LEFT_OUT:
            self.skipped.append(tag)
        elif tag in ("br", "hr"):
            self.out.append("\n")
        elif tag in ("ul", "ol", "table") or tag in ENDS_LINE:
            self._implied_end("p", ("table", "td"))
            if tag in ("li", "tr"):
                self._implied_end(tag, ("ul", "ol", "table"))
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            at = len(self.open) - 1 - self.open[::-1].index(tag)
            inner, self.open = self.open[at + 1 :], self.open[:at]
            self.out += ["\n" for t in inner if t in ENDS_LINE]
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag in ENDS_LINE:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """The text of a page with line ends after blocks; Spark has no function that decodes character references."""

    def one(page):
        if page is None:
            return None
        lines = _Lines()
        lines.feed(page)
        lines.close()
        return "".join(lines.out)

    return html.map(one)


def html_lines(html: Column) -> Column:
    """The non-empty lines of a page, with straight quotes and single blanks."""
    return F.filter(F.transform(F.split(html_text(html), r"\r?\n"), lambda x: squeeze(straight_quotes(x))), lambda x: x != "")


def post_lines(posts: DataFrame, post: str, html: str) -> DataFrame:
    """(post, pos, line)"""
    return posts.select(F.col(post).alias("post"), F.posexplode(html_lines(F.col(html))).alias("pos", "line"))


def scoreboard(lines: DataFrame) -> DataFrame:
    """Played contests of boys' sections from (post, pos, line), with the date and section above each; `reason` for lines that look like scores but are none."""
    line = F.col("line")
    is_date = line.rlike(rf"(?i)^(?:Today\b|Yesterday\b|{MONTHS}\s+\d{{1,2}}(?:,\s*\d{{4}})?\s*\.?$)")
    is_section = (F.length(line) <= 40) & line.rlike(r"(?i)^(?:(?:Boys|Girls|NLL|MLL|PLL)\.?$|(?:Men'?s|Women'?s)\s+D[123]\b|D[123]\b\.?$|Big\s+\d+\b)")
    down = Window.partitionBy("post").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.withColumns(
        {
            "date_label": F.last(F.when(is_date, F.trim(F.regexp_replace(line, r"[:.]+$", ""))), ignorenulls=True).over(down),
            "section": F.last(F.when(is_date, "").when(is_section, line), ignorenulls=True).over(down),
            "_header": is_date | is_section,
        }
    )
    inside = seen.filter(~F.col("_header") & F.col("section").rlike("(?i)^Boys") & (F.col("date_label") != ""))
    inside = inside.filter(~(line.rlike("(?i) at ") & ~line.rlike(r",\s*\d")) & ~line.rlike(r"(?i),\s*(?:ppd|postponed)\b")).withColumn("p", parsers.score_line(line))
    kept = inside.filter(F.col("p.reason").isNull() | line.rlike(r",\s*\d"))
    return kept.select("post", "pos", "date_label", "section", *_contest(F.col("p")), F.col("p.reason").alias("reason"))


def _contest(p: Column) -> list[Column]:
    name = lambda c: F.coalesce(team_name(p[c]), p[c]).alias(c)
    return [name("team_a"), p["score_a"].alias("score_a"), name("team_b"), p["score_b"].alias("score_b"), p["ot_periods"].alias("ot_periods")]


def summaries(lines: DataFrame) -> DataFrame:
    """Contests with their periods and player counts, from (post, pos, line): a row for each line or name that says something.

    A score line opens a block; a postponed one closes it. Other lines are, in this order: lists by
    stat, periods, sub-headers (carried to the stat lines below them, up to the next score), stat
    lines. `kind` is score, list, periods or stat; joint names get the line each, at confidence .5.
    """
    line = F.col("line")
    # where a line could be a score at all; the parser decides
    probe = line.rlike(r"^[A-Za-z][^,:=\d]*\d+\s*,\s*[A-Za-z][^,:=\d]*\d+") | line.rlike(r"^[A-Z][A-Za-z'.\-]*(?:\s+[A-Za-z'.\-]+)*(?:\s*\([A-Z]{2,3}\))?\s+\d+\s+[A-Z][A-Za-z'.\-]*(?:\s+[A-Za-z'.\-]+)*(?:\s*\([A-Z]{2,3}\))?\s+\d+\.?$")
    down = Window.partitionBy("post").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    scored = lines.withColumns({"p": parsers.score_line(line), "_stat": parsers.stat_line(line)}).withColumn("is_score", probe & F.col("p.reason").isNull())
    blocks = scored.withColumns({"block": F.sum(F.col("is_score").cast("int")).over(down), "head": F.last(F.when(F.col("is_score"), F.col("p")), ignorenulls=True).over(down)})
    blocks = blocks.filter((F.col("block") > 0) & ~F.col("head.postponed"))
    is_list = line.rlike(r"(?i)^[A-Za-z][A-Za-z'.\-\s&]*?\s+(?:goals?|assists?|saves?|gbs?|ground\s*balls?|ctos?)\s*:")
    numbers = F.size(F.regexp_extract_all(line, F.lit(r"(\d+)")))
    quarters = ~line.rlike(r"\(") & ~line.rlike(r"(?i)\b(?:goal|assist|save|sv|gb|cto|fo)s?\b") & (numbers >= 3) & line.rlike(r"\d[\s\-–—=,.]+\d")
    blocks = blocks.withColumn("_q", parsers.quarter_line(line, F.array("head.team_a", "head.team_b")))
    q, stat = F.col("_q"), F.col("_stat")
    is_header = line.rlike(r"^[A-Za-z][A-Za-z'.\-\s&]*\s*:?$") & (F.length(line) < 60)
    kind = F.when(F.col("is_score"), "score").when(is_list, "list").when(quarters & q["reason"].isNull(), "periods").when(is_header, "header").when(stat["reason"].isNull(), "stat")
    within = Window.partitionBy("post", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = blocks.withColumn("kind", kind).withColumn("sub_header", F.last(F.when(F.col("kind") == "header", line), ignorenulls=True).over(within)).filter("kind <> 'header'")
    names = split_names(stat["name"])
    none = lambda t: F.lit(None).cast(t)
    empty = F.struct(none("string").alias("hint"), none("string").alias("name"), none("string").alias("stat"), none("int").alias("count"), none("double").alias("confidence"))
    of_list = F.transform(F.filter(parsers.aggregated_list(line), lambda x: x["reason"].isNull()), lambda x: F.struct(x["team"].alias("hint"), x["name"].alias("name"), x["stat"].alias("stat"), x["count"].alias("count"), F.lit(0.7).alias("confidence")))
    counts = F.filter(F.array(*[F.struct(F.lit(c).alias("stat"), stat[c].alias("count")) for c in parsers.CAPS]), lambda x: x["count"] > 0)
    sure = F.when(F.size(names) > 1, F.least(stat["confidence"], F.lit(0.5))).otherwise(stat["confidence"])
    of_stat = F.flatten(F.transform(names, lambda n: F.transform(counts, lambda x: F.struct(F.col("sub_header").alias("hint"), n.alias("name"), x["stat"].alias("stat"), x["count"].alias("count"), sure.alias("confidence")))))
    of_periods = F.array(F.struct(q["team_hint"].alias("hint"), none("string").alias("name"), F.array_join(q["periods"].cast("array<string>"), " ").alias("stat"), q["total"].alias("count"), none("double").alias("confidence")))
    rows = F.when(F.col("kind") == "list", of_list).when(F.col("kind") == "stat", of_stat).when(F.col("kind") == "periods", of_periods).otherwise(F.array(empty))
    return told.select("post", "block", "pos", "kind", *_contest(F.col("head")), F.explode(rows).alias("r")).select("post", "block", "pos", "kind", "team_a", "score_a", "team_b", "score_b", "ot_periods", "r.*")


# What a post's tags (lower case) and slug say, and the category that they make. The first rule counts whose
# signs are all there and whose exceptions are not; a post without a category is left out, and so is one that no rule fits.
SIGNS = {
    "scoreboard": {"tag": "scoreboard", "slug": "scoreboard"},
    "women": {"tag": "girl|women|female", "slug": "(?:^|-)(?:girls|womens|women)(?:-|$)"},
    "college series": {"slug": "mens-college|college-super-7"},
    "college": {"tag": "college"},
    "high school": {"tag": r"high\s*school"},
    "tryouts": {"slug": "tryouts"},
    "honours": {"slug": "named-to-all|all-(?:big|acc|conference)"},
    "ranking": {"tag": "ranking", "slug": "rankings?"},
    "state": {"tag": "state", "slug": "pa-(?:lacrosse-)?state-rankings|pa-state"},
    "summary": {"tag": r"hs\s*summaries|high\s*school\s*summaries", "slug": "-summaries?(?:-|$)|^(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)-boys"},
}
CATEGORIES = [
    (None, ["women"], ["scoreboard"]), (None, ["college series"], ["scoreboard"]), (None, ["college"], ["scoreboard", "high school"]), (None, ["tryouts"], []), (None, ["honours"], []),
    ("rankings pa-state", ["ranking", "state"], []), ("rankings philly", ["ranking"], []), ("hs-summaries", ["summary"], []), ("scoreboard", ["scoreboard"], []),
]


def category(slug: Column, html: Column) -> Column:
    """rankings (philly or pa-state), hs-summaries, scoreboard; null for posts that are left out."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(r'(?i)rel="category tag"[^>]*>([^<]+)<')), lambda x: F.lower(F.trim(x)))

    def has(name: str) -> Column:
        where = {"tag": lambda p: F.exists(tags, lambda t: t.rlike(p)), "slug": lambda p: F.lower(slug).rlike(p)}
        return reduce(or_, [where[place](pattern) for place, pattern in SIGNS[name].items()])

    rules = [(verdict, reduce(and_, [*map(has, needed), *(~has(x) for x in unless)])) for verdict, needed, unless in CATEGORIES]
    first = reduce(lambda found, rule: found.when(rule[1], F.lit(rule[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0]).cast("string")))
    return first.otherwise(F.lit(None))


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m.lower()) for m in MONTH_NAMES]), F.lower(name)), F.lit(0).cast("long"))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))


def label_date(label: Column, fallback: Column) -> Column:
    """Today, Yesterday or a month with a day and perhaps a year as an ISO date; the fallback (ISO) for anything else."""
    s = F.trim(F.coalesce(label, F.lit("")))
    pattern = r"^([A-Za-z]+)\s+(\d{1,2})(?:,\s*(\d{4}))?\.?$"
    month, day = _month(F.regexp_extract(s, pattern, 1)), F.regexp_extract(s, pattern, 2).try_cast("int")
    year = F.coalesce(F.regexp_extract(s, pattern, 3).try_cast("int"), F.regexp_extract(fallback, r"^(\d{4})-", 1).try_cast("int"))
    named = F.when(month.isNotNull() & (day > 0), _iso(year, month, day))
    return F.when(s.rlike(r"(?i)^Today\b"), fallback).when(s.rlike(r"(?i)^Yesterday\b"), F.date_sub(F.to_date(fallback), 1).cast("string")).otherwise(F.coalesce(named, fallback))


def _elements(html: Column, tag: str, name: str, value: str) -> Column:
    """The openings of a tag, with the text behind them, that have a value among the words of an attribute, wherever it stands."""
    found = F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\b[^>]*>[^<]*"), F.lit(0))
    return F.filter(found, lambda e: F.array_contains(F.split(F.lower(_attribute(e, name)), r"\s+"), value))


def _attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def publish_date(html: Column) -> Column:
    """From the page's metadata, else its entry time, else a `Posted m/d/yy`; null if it has none."""
    no = F.lit("")
    stamp = F.regexp_extract(F.get(F.transform(_elements(html, "meta", "property", "article:published_time"), lambda e: _attribute(e, "content")), F.lit(0)), r"^\d{4}-\d{2}-\d{2}", 0)
    written = F.regexp_replace(F.coalesce(F.get(_elements(html, "time", "class", "entry-time"), F.lit(0)), no), "^<[^>]*>", "")
    words = F.split(F.trim(F.regexp_replace(written, r"[\s,]+", " ")), " ")  # month, day, year
    month, day, year = _month(F.get(words, F.lit(0))), F.get(words, F.lit(1)).try_cast("int"), F.get(words, F.lit(2)).try_cast("int")
    timed = F.when(month.isNotNull() & (day > 0) & year.isNotNull() & (F.size(words) == 3), _iso(year, month, day))
    numbers = F.transform(F.split(F.regexp_extract(html, r"(?i)posted\s+(\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4})", 1), "/"), lambda n: F.trim(n).try_cast("int"))
    m, d, y = (F.get(numbers, F.lit(i)) for i in range(3))
    marked = F.when(m.between(1, 12) & d.between(1, 31) & y.isNotNull(), _iso(F.when(y < 100, y + 2000).otherwise(y), m, d))
    return F.coalesce(F.nullif(stamp, no), timed, marked)


def compact_date(s: Column) -> Column:
    """yyyyMMdd as ISO."""
    return F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))


def days_between(since: Column, until: Column) -> Column:
    """All days from one to the other, both included; none if they run backward."""
    return F.when(since <= until, F.sequence(since, until)).otherwise(F.array().cast("array<date>"))


def face_off_cell(cell: Column) -> Column:
    """`won/taken` as two numbers; a single number is won, nothing taken."""
    s, pattern = F.trim(cell), r"^(\d+)\s*/\s*(\d+)$"
    both = s.rlike(pattern)
    won = F.when(both, F.regexp_extract(s, pattern, 1).try_cast("int")).otherwise(F.coalesce(s.try_cast("double").cast("int"), F.lit(0)))
    return F.struct(won.alias("won"), F.when(both, F.regexp_extract(s, pattern, 2).try_cast("int")).otherwise(0).alias("taken"))
