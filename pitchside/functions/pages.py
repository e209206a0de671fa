"""Tables and links of result pages as records, in builtin column expressions (survey S10, S11, S14, S15, F30)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.names import title_case
from pitchside.functions.text import squeeze, team_key
from pitchside.operators.core import first_per

# References that are decoded (in this order), and what marks a sponsor's image.
REFERENCES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&amp;": "&"}
IMAGE_REFERENCES = {"&amp;": "&", "&#038;": "&", "&quot;": '"', "&#8217;": "'", "&apos;": "'"}
SPONSORS = "sponsor granite-run fusion-lacrosse fusion.jpg beyourbest byb blackbear true-final spring_26 limitless truelacrosse logo.png webclip performance-academy".split()

ROW = r"(?is)<tr\b{0}[^>]*>.*?(?=<tr\b|</tr>|</table>|\z)"
CELL = r"(?is)<td\b[^>]*>.*?(?=<td\b|</td>|\z)"


def _decoded(s: Column, references: dict[str, str]) -> Column:
    for reference, character in references.items():
        s = F.replace(s, F.lit(reference), F.lit(character))
    return s


def text_of(html: Column) -> Column:
    """The text of a fragment without tags, white space as single blanks."""
    return squeeze(_decoded(F.regexp_replace(html, "(?s)<[^>]*>", ""), REFERENCES))


def integer(text: Column) -> Column:
    """Digits and signs as a number; 0 where there is none."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(text, "[^-0-9]", ""), r"^-?\d+", 0).try_cast("long"), F.lit(0).cast("long"))


def rows_of(html: Column, least: int, mark: str = "") -> Column:
    """(html, fields, cells) of each table row with enough cells: the row, its cells as they stand, and their texts."""
    cut = lambda r: F.regexp_extract_all(r, F.lit(CELL), F.lit(0))
    rows = F.transform(F.regexp_extract_all(html, F.lit(ROW.format(mark)), F.lit(0)), lambda r: F.struct(r.alias("html"), cut(r).alias("fields"), F.transform(cut(r), text_of).alias("cells")))
    return F.filter(rows, lambda r: F.size(r["cells"]) >= least)


def _link(row: Column, page: str, group: int = 2) -> Column:
    """The text (or with group 1 the address) of a row's first link to a page."""
    return F.regexp_extract(row, rf"""(?s)<[aA]\b[^>]*href=["']?([^"'>]*{page}[^"'>]*)["']?[^>]*>(.*?)</[aA]>""", group)


def _records(html: Column, least: int, one: Callable[[Column, Callable[[int], Column], Callable[[int], Column]], dict[str, Column]]) -> Column:
    """A struct for each content row of a league page; rows without a name or a team go."""

    def record(r: Column) -> Column:
        cell = lambda i: F.coalesce(F.get(r["cells"], F.lit(i)), F.lit(""))
        return F.struct(*[v.alias(n) for n, v in one(r["html"], cell, lambda i: integer(cell(i))).items()])

    found = F.transform(rows_of(html, least, r"[^>]*\btablecontent\b"), record)
    return F.filter(found, lambda x: (x["name"] != "") & (x["team"] != ""))


def standings(html: Column) -> Column:
    """Rows of a standings page: team (link), games, record, streak in brackets and counts."""

    def one(row, cell, number):
        name, record = text_of(_link(row, r"Team\.asp")), text_of(_link(row, r"Schedule\.asp"))
        part = lambda i: F.coalesce(F.regexp_extract(record, r"(\d+)-(\d+)-(\d+)", i).try_cast("long"), F.lit(0))
        team_id = F.coalesce(F.regexp_extract(_link(row, r"Team\.asp", 1), r"TmID=(\d+)", 1).try_cast("long"), F.lit(0))
        counts = {n: number(i) for n, i in {"gp": 2, "otw": 4, "otl": 5, "pts": 6, "pf": 7, "pa": 8, "diff": 9}.items()}
        return {"team_id": team_id, "name": name, "team": name, "wins": part(1), "losses": part(2), "ties": part(3), "streak": F.regexp_extract(cell(3), r"\(([WLT]\d+)\)", 1)} | counts

    return F.transform(_records(html, 6, one), lambda x: x.dropFields("team"))


def _player(row: Column) -> dict[str, Column]:
    who = text_of(_link(row, r"Player\.asp"))
    split = r"^(\d+)\s*-\s*(.+)$"
    return {"jersey": F.regexp_extract(who, split, 1).try_cast("long"), "name": F.when(who.rlike(split), F.trim(F.regexp_extract(who, split, 2))).otherwise(who)}


def scorers(html: Column) -> Column:
    """Rows of a scorers page; jersey -1 where the player's link has none."""

    def one(row, cell, number):
        player = _player(row)
        player["jersey"] = F.coalesce(player["jersey"], F.lit(-1))
        return player | {"team": cell(2)} | {n: number(i) for i, n in enumerate(["gp", "goals", "assists", "points", "penalties", "pim"], start=3)}

    return _records(html, 7, one)


def goalies(html: Column) -> Column:
    """Rows of a goalies page; players without a jersey are left out."""

    def one(row, cell, number):
        average = F.coalesce(F.regexp_extract(cell(6), r"^-?\d*\.?\d+", 0).try_cast("double"), F.lit(0.0))
        return _player(row) | {"team": cell(2)} | {n: number(i) for i, n in enumerate(["gp", "minutes", "goals_against"], start=3)} | {"average": average}

    return F.filter(_records(html, 6, one), lambda x: x["jersey"].isNotNull())


def schedule(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Contests of schedule pages by key: game_num, day, time, teams, scores and location.

    A row without a date has that of the row before it, which a window over one page carries down.
    Contests that were not played have scores 0.
    """
    rows = pages.select(key, F.posexplode(rows_of(F.col(html), 6, r"[^>]*\btablecontent\b")).alias("pos", "row"))
    cell = lambda i: F.get(F.col("row.cells"), F.lit(i))
    dated = rows.withColumn("date", F.last(F.when(cell(0) != "", cell(0)), ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    both = text_of(_link(F.col("row.html"), r"Game\.asp"))
    played, open_ = r"^(.+?)\s+(\d+)\s+at\s+(.+?)\s+(\d+)$", r"^(.+?)\s+at\s+(.+)$"
    side = lambda p, q: F.when(both.rlike(played), F.regexp_extract(both, played, p)).otherwise(F.regexp_extract(both, open_, q))
    score = lambda i: F.coalesce(F.regexp_extract(both, played, i).try_cast("long"), F.lit(0))
    day = F.regexp_extract("date", r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    out = dated.select(key, integer(cell(2)).alias("game_num"), F.date_format(F.try_to_date(day, "M/d/yyyy"), "yyyy-MM-dd").alias("day"), cell(1).alias("time"), side(1, 1).alias("away"), side(3, 2).alias("home"), score(2).alias("away_score"), score(4).alias("home_score"), cell(5).alias("location"), "date")
    return out.filter("date IS NOT NULL AND game_num <> 0 AND home <> ''").drop("date")


def rankings(html: Column, heading: str = r"(?i)D1\s+(\d+A)\s+Boys\s+Lacrosse") -> Column:
    """Rows of the first table after each matching heading: classification, seed, name, key, record, points, ranking.

    Columns are known by their data-field, else by position; the last two numbers of a row are points and ranking.
    """

    def section(s: Column) -> Column:
        of = F.upper(F.regexp_extract(text_of(F.regexp_extract(s, r"(?is)^<h3\b[^>]*>(.*?)</h3>", 1)), heading, 1))
        table = F.regexp_extract(s, r"(?is)<table\b.*?</table>", 0)

        def one(r: Column) -> Column:
            def named(name: str, i: int) -> Column:
                marked = F.get(F.filter(r["fields"], lambda f: f.rlike(f"^<[tT][dD][^>]*data-field=\"{name}\"")), F.lit(0))
                return F.coalesce(text_of(marked), F.get(r["cells"], F.lit(i)))

            numbers = F.filter(r["cells"], lambda c: c.rlike(r"^-?\d+(\.\d+)?$"))
            nth = lambda i: F.coalesce(F.get(numbers, F.size(numbers) - i).try_cast("double"), F.lit(0.0))
            school, seed = title_case(named("schoolName", 1)), F.get(r["cells"], F.lit(0))
            return F.struct(
                of.alias("classification"), F.when(seed.rlike(r"^\d+$"), seed.try_cast("long")).alias("seed"), school.alias("name"), team_key(school).alias("key"),
                *[integer(named(n, i)).alias(n) for n, i in (("wins", 2), ("losses", 3), ("ties", 4))], F.when(F.size(numbers) >= 2, nth(2)).otherwise(0.0).alias("points"), nth(1).alias("ranking"),
            )

        return F.when(of != "", F.filter(F.transform(rows_of(table, 6), one), lambda x: x["name"] != ""))

    return F.flatten(F.array_compact(F.transform(F.split(html, r"(?i)(?=<h3\b)"), section)))


def game_links(html: Column, sport: str = "[a-z0-9-]+") -> Column:
    """(day, first, second, path) of each distinct link to a contest, in page order."""
    link = rf"(/games/(\d{{2}})-(\d{{2}})-(\d{{4}})/{sport}/([a-z0-9-]+)-vs-([a-z0-9-]+)\.htm\?c=[A-Za-z0-9_-]+)"
    paths = F.array_distinct(F.regexp_extract_all(html, F.lit(rf'href="(?:https?://[a-z.]+)?{link}"'), F.lit(1)))
    part = lambda p, i: F.regexp_extract(p, link, i)
    return F.transform(paths, lambda p: F.struct(F.concat_ws("-", part(p, 4), part(p, 2), part(p, 3)).alias("day"), part(p, 5).alias("first"), part(p, 6).alias("second"), p.alias("path")))


def find_game(links: Column, day: Column, own: Column, other: Column) -> Column:
    """The first link of that day whose two slugs fit: one any of `own`, the other any of `other` (arrays of slugs, part of or around the link's)."""
    candidates = lambda a: F.filter(F.transform(a, F.lower), lambda c: c != "")
    fits = lambda slug, a: F.exists(candidates(a), lambda c: F.contains(slug, c) | F.contains(c, slug))
    either = lambda x: (fits(x["first"], own) & fits(x["second"], other)) | (fits(x["second"], own) & fits(x["first"], other))
    return F.get(F.filter(links, lambda x: (x["day"] == day) & either(x)), F.lit(0))


def full_size(url: Column) -> Column:
    """An image's address without the parameters that make it smaller."""
    s = F.regexp_replace(F.replace(url, F.lit("&amp;"), F.lit("&")), r"(?<=[?&])(?:width=\d+|height=\d+|auto=[^&]+|format=[^&]+)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[?&]+$", ""), "&&+", "&"), r"\?&", "?")


def schools(pages: DataFrame, key: str, html: str, state: str = "pa", sport: str = "lacrosse") -> DataFrame:
    """Cards of a directory page by key and slug, the first of a slug: name, city, state and the image's address."""
    cards = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(rf'(?is)<a\b[^>]*href="/{state}/[^"]*"[^>]*>.*?</a>'), F.lit(0))).alias("pos", "card"))
    card = F.col("card")
    block = lambda name: text_of(F.regexp_extract(card, rf'(?is)class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</', 1))
    href = rf'^<[aA]\b[^>]*href="/{state}/([^/"]+)/([^/"]+)/{sport}/?"'
    titled = F.coalesce(F.nullif(block("title"), F.lit("")), text_of(F.regexp_extract(card, r'^<[aA]\b[^>]*\btitle="([^"]*)"', 1)))
    parts = F.filter(F.transform(F.split(block("description"), ","), lambda p: F.trim(p)), lambda p: p != "")
    whole = F.size(parts) >= 2
    source = F.regexp_extract(card, r'(?is)<img\b[^>]*?\bsrc="([^"]*)"', 1)
    rows = cards.filter(card.rlike(href)).select(
        key, "pos", F.concat_ws("/", F.regexp_extract(card, href, 1), F.regexp_extract(card, href, 2)).alias("slug"), titled.alias("name"),
        F.when(whole, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ", ")).otherwise(block("description")).alias("city"),
        F.when(whole, F.upper(F.element_at(parts, -1))).otherwise("").alias("state"), F.when(source != "", full_size(source)).alias("logo"),
    )
    return first_per(rows.filter("name <> ''"), [key, "slug"], [F.col("pos")]).drop("pos")


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(_decoded(F.regexp_extract(tag, rf"""(?i){name}=["']([^"']+)["']""", 1), IMAGE_REFERENCES), F.lit(""))


def post_image(html: Column) -> Column:
    """(url, alt, width, height, source) of a post's image: the page's own, the featured one, else the body's first that is no sponsor's; null without one."""
    none, number = F.lit(None), lambda tag, n: F.when(_attribute(tag, n).rlike(r"^\d+$"), _attribute(tag, n).try_cast("long"))
    image = lambda url, source, alt=none, width=none, height=none: F.struct(url.alias("url"), alt.cast("string").alias("alt"), width.cast("long").alias("width"), height.cast("long").alias("height"), F.lit(source).alias("source"))
    own = _attribute(F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:image["'][^>]*>""", 0), "content")
    featured = F.nullif(F.replace(_decoded(F.regexp_extract(html, r'(?i)"featured_media_src_url"\s*:\s*"([^"]+)"', 1), IMAGE_REFERENCES), F.lit("\\/"), F.lit("/")), F.lit(""))
    inner = r'(?is)class="entry-content"[^>]*>(.*?)(?:</section>|</article>|<aside)'
    body = F.when(html.rlike(inner), F.regexp_extract(html, inner, 1)).otherwise(html)

    def wanted(tag: Column) -> Column:
        hay = F.lower(F.concat_ws(" ", _attribute(tag, "src"), _attribute(tag, "alt")))
        return _attribute(tag, "src").isNotNull() & ~F.exists(F.array(*map(F.lit, SPONSORS)), lambda n: F.contains(hay, n))

    tags = F.filter(F.regexp_extract_all(body, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0)), wanted)
    first = F.get(F.transform(tags, lambda t: image(_attribute(t, "src"), "body-img", _attribute(t, "alt"), number(t, "width"), number(t, "height"))), F.lit(0))
    return F.when(own.isNotNull(), image(own, "og")).when(featured.isNotNull(), image(featured, "featured-media")).otherwise(first)
