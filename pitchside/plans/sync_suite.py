"""League scrapes and their sync, career prose and box scores over the driver's tables, with their SQL."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from pitchside.functions import htmltables
from pitchside.operators import league_sync, prose
from pitchside.plans import bindings as B
from pitchside.plans.page_suite import GOALIES, SCHEDULE, SCORERS, STANDINGS, _page
from pitchside.plans.text_suite import PARTS, _parts
from pitchside.sources.scratch import shared_folder

LEAGUE, FIRST_DAY, SECOND_DAY = 50731, datetime(2026, 5, 1), datetime(2026, 5, 2)
PAGES = {"standings": STANDINGS, "scorers": SCORERS, "goalies": GOALIES, "schedule": SCHEDULE}


def _league_pages(spark, d):
    """Every part as four pages of a league."""
    each = [_page(html)(spark, d).select(F.col("k").alias("nth"), F.lit(kind).alias("kind"), "html") for kind, html in PAGES.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def _synced(spark, d):
    """Three scrapes: all pages; pages without rows; one that fails; then all pages a day later, in which every scorer has another goal."""
    tables = league_sync.league_tables(f"{shared_folder(spark)}/league-{uuid4().hex}", spark)
    pages = _league_pages(spark, d)
    later = league_sync.scraped(pages)
    later["players"] = later["players"].withColumn("goals", F.col("goals") + 1)

    def fails():
        raise OSError("no route")

    scrapes = [lambda: league_sync.scraped(pages), lambda: league_sync.scraped(pages.withColumn("html", F.lit("<p>Sign in</p>"))), fails, lambda: later]
    for at, scrape in zip((FIRST_DAY, FIRST_DAY, SECOND_DAY, SECOND_DAY), scrapes):
        league_sync.sync_league(tables, LEAGUE, at, scrape)
    return tables


# rows of the pages, from the parts; of a name and team (or a league key) the part that counts
PLAYERS = f"""p AS ({PARTS}), sc AS (SELECT k, CASE WHEN v % 2 = 0 THEN n ELSE -1 END AS jersey, p_type || ' Roe' AS name, a AS team, m AS goals FROM p), one AS (SELECT arg_min(sc, k) AS r FROM sc GROUP BY lower(name), lower(team)), players AS (SELECT r.* FROM one)"""
SYNCED_PLAYERS = f"""WITH {PLAYERS} SELECT r.name, r.team, r.jersey, r.goals + 1 AS goals, 2 AS assists, r.goals + 2 AS points, TIMESTAMP '{SECOND_DAY}' AS scraped_at FROM (SELECT arg_max(players, k) AS r FROM players GROUP BY name, team)"""

# ---- career prose: what a post said of the player, by part

LINE = """CASE k % 6 WHEN 0 THEN concat(first, ' ', last, ' 3g, 2a (now has ', goals, ' career goals)') WHEN 1 THEN concat(last, ' 2g (', goals + 60, ' points)') WHEN 2 THEN concat(last, ' 1g (', 30 + k % 50, ')')
 WHEN 3 THEN concat(last, ' - 4sv (first half) (senior)') WHEN 4 THEN concat(last, ' 2g (', k % 9, ' of ', k % 9, ')') ELSE concat('Stranger 2g (all-time ', last, ')') END"""
CALLED = "concat('Q', translate(CAST(k AS {text}), '0123456789', 'bdgkmpqvxz')) AS last"


def _prose(spark, d):
    li = B.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_linenumber").cast("long").alias("goals"), F.sum("l_quantity").cast("long").alias("saves"))
    rows = li.selectExpr("CAST(l_orderkey AS BIGINT) AS post", "CAST(l_partkey AS BIGINT) AS k", "goals * 3 AS goals", "saves").selectExpr("*", "'Amy' AS first", CALLED.format(text="STRING"))
    stats = rows.selectExpr("post", "k AS player_id", "lower(concat(first, ' ', last)) AS name_key", "goals", *[f"CAST(0 AS BIGINT) AS {c}" for c in ("assists", "ground_balls", "caused_turnovers", "fo_won", "fo_taken")], "saves")
    return prose.career_prose(rows.selectExpr("post", f"{LINE} AS line"), stats)


PROSE = f"""WITH r AS (SELECT CAST(l_orderkey AS BIGINT) AS post, CAST(l_partkey AS BIGINT) AS k, CAST(sum(l_linenumber) * 3 AS BIGINT) AS goals, CAST(sum(l_quantity) AS BIGINT) AS saves FROM lineitem GROUP BY 1, 2), x AS (SELECT *, 'Amy' AS first, {CALLED.format(text='VARCHAR')} FROM r),
t AS (SELECT post, {LINE} AS line, k, last, k % 6 AS f, CASE k % 6 WHEN 0 THEN first || ' ' || last WHEN 5 THEN 'Stranger' ELSE last END AS who, CASE k % 6 WHEN 0 THEN 'now has ' || goals || ' career goals' WHEN 1 THEN (goals + 60) || ' points' WHEN 2 THEN CAST(30 + k % 50 AS VARCHAR) WHEN 3 THEN 'senior' WHEN 4 THEN NULL ELSE 'all-time ' || last END AS bracket,
  CASE k % 6 WHEN 0 THEN 'now has' WHEN 1 THEN 'points' WHEN 3 THEN 'senior' WHEN 5 THEN 'all-time' END AS marker, CASE k % 6 WHEN 0 THEN [goals] WHEN 1 THEN [goals + 60] WHEN 2 THEN [30 + k % 50] ELSE [] END AS numbers FROM x),
l AS (SELECT DISTINCT post, line, f, last, who, bracket, marker, numbers FROM t WHERE bracket IS NOT NULL),
j AS (SELECT l.*, x.k AS player_id, list_filter([CASE WHEN goals > 15 OR (goals >= 5 AND list_contains(numbers, goals)) THEN 'goals' END, CASE WHEN saves > 40 OR (saves >= 5 AND list_contains(numbers, saves)) THEN 'saves' END], lambda c: c IS NOT NULL) AS columns
  FROM l JOIN x ON x.post = l.post AND f < 5 AND contains(lower(first || ' ' || x.last), lower(l.last))), c AS (SELECT post, line, max(len(columns) > 0) AS any_hit FROM j GROUP BY 1, 2)
SELECT l.post, l.line, l.who, l.bracket, l.marker, array_to_string(l.numbers, ',') AS numbers, player_id, array_to_string(columns, ',') AS columns, CASE WHEN any_hit IS NULL THEN 'not-parsed' WHEN any_hit THEN 'parsed-and-suspect' ELSE 'parsed-and-clean' END AS category FROM l LEFT JOIN c USING (post, line) LEFT JOIN j USING (post, line)"""

# ---- box scores: a page for each part, in eight shapes

BOX = """CASE k % 8 WHEN 0 THEN concat('<table class="x boxscore"><tr><th></th><th>1</th><th>Final</th></tr><tr><td>', a, ' Rams</td><td>1</td><td>', n, '</td></tr><tr><td>', b, '</td><td>2</td><td> ', m, ' </td></tr></table>')
 WHEN 1 THEN concat('<title>404</title><table class="boxscore"><tr><th></th><th>Final</th></tr><tr><td>', a, '</td><td>1</td></tr><tr><td>', b, '</td><td>2</td></tr></table>')
 WHEN 2 THEN concat('<table class=boxscore><tr><td>Final score</td></tr><tr><td>', a, '</td></tr></table><table class="boxscore"><tr><td>Team</td><td>FINAL</td><td>q</td></tr><tr><td>Note</td><td>n/a</td></tr><tr><td>', b, '</td><td>', n, '</td></tr><tr><td>', a, '</td><td>', m, '</td></tr></table>')
 WHEN 3 THEN concat('<table class="boxscore"><tr><th>T</th><th>Final</th></tr><tr><td>', a, '<table><tr><td>inner</td></tr></table></td><td>', n, '</td></tr><tr><td>', b, ' &amp; Co</td><td>', m, '</td></tr></table>')
 WHEN 4 THEN concat('<table class="boxscore"><tr><th>T</th><th>Final</th></tr><tr><td>', a, '</td><td>', n, '</td></tr><tr><td>', b, '</td><td>0', m, '</td></tr></table>')
 WHEN 5 THEN concat('<table><tr><th>T</th><th>Final</th></tr><tr><td>', a, '</td><td>', n, '</td></tr><tr><td>', b, '</td><td>', m, '</td></tr></table>')
 WHEN 6 THEN concat('<table class="boxscore"><tr><th>T<th>Final<tr><td>Else<td>', n, '<tr><td>', b, '<td>', m, '</table>') ELSE NULL END"""


def _boxes(spark, d):
    pages = _parts(spark, d).withColumn("html", F.expr(BOX))
    found = htmltables.box_scores(pages, "k", "html").join(pages.select("k", "a", "b"), "k")
    both = htmltables.scores_of(F.col("a"), F.col("b"), (F.col("team_1"), F.col("team_2")), (F.col("score_1"), F.col("score_2")))
    return found.withColumn("s", both).select("k", "team_1", "team_2", "s.home_score", "s.away_score")


BOXES = f"""WITH p AS ({PARTS}) SELECT k, CASE k % 8 WHEN 0 THEN a || ' Rams' WHEN 2 THEN b WHEN 3 THEN a WHEN 6 THEN 'Else' END AS team_1, CASE k % 8 WHEN 2 THEN a WHEN 3 THEN b || ' & Co' ELSE b END AS team_2,
CASE k % 8 WHEN 0 THEN n WHEN 2 THEN m WHEN 3 THEN n END AS home_score, CASE k % 8 WHEN 0 THEN m WHEN 2 THEN n WHEN 3 THEN m END AS away_score FROM p WHERE k % 8 IN (0, 2, 3, 6)"""

GRID = """concat('<table class="a  b"><tr><th colspan="2">Na&amp;me</th><th>', n, '</th></tr><tr><td rowspan=2>', a, '</td><td>x<b>y</b>', m, '</td></tr><tr><td>', b, '<table><tr><td>in</td></tr></table></td><td> z  z </td></tr></table>')"""
GRID_SQL = f"""WITH p AS ({PARTS}) SELECT k, t.c[1]::INTEGER AS "table", CASE WHEN t.c[1] = '0' THEN 'a b' ELSE '' END AS classes, t.c[2]::INTEGER AS row, t.c[3]::INTEGER AS cell, t.c[4]::INTEGER AS "column", t.c[5] AS header, t.c[6] AS text
FROM p, LATERAL (SELECT unnest([['0', '0', '0', '0', 'Na&me', 'Na&me'], ['0', '0', '1', '2', '' || n, '' || n], ['0', '1', '0', '0', 'Na&me', a], ['0', '1', '1', '1', 'Na&me', 'xy' || m], ['0', '2', '0', '1', 'Na&me', b], ['0', '2', '1', '2', '' || n, 'z z'], ['1', '0', '0', '0', 'in', 'in']]) AS c) t"""

SUITE = {
    "s12_scraped_players": (lambda s, d: league_sync.scraped(_league_pages(s, d))["players"].select("name", "team", "jersey", "goals"), f"WITH {PLAYERS} SELECT name, team, jersey, goals FROM players"),
    "m12_synced_players": (lambda s, d: _synced(s, d).read("players").select("name", "team", "jersey", "goals", "assists", "points", "scraped_at"), SYNCED_PLAYERS),
    "m12_scrape_log": (
        lambda s, d: _synced(s, d).read("scrapes").select("scraped_at", "teams", "players", "goalies", "games", "status", "message"),
        f"""WITH {PLAYERS}, c AS (SELECT (SELECT count(*) FROM p) AS t, (SELECT count(*) FROM players) AS p, (SELECT count(DISTINCT (p_type, lower(b))) FROM p WHERE v % 2 = 0) AS g, (SELECT count(*) FROM p WHERE n > 0) + (SELECT count(*) FROM p) AS s)
        SELECT TIMESTAMP '{FIRST_DAY}' AS scraped_at, t AS teams, p AS players, g AS goalies, s AS games, 'success' AS status, NULL AS message FROM c UNION ALL SELECT TIMESTAMP '{FIRST_DAY}', 0, 0, 0, 0, 'empty', 'no rows; perhaps not signed in'
        UNION ALL SELECT TIMESTAMP '{SECOND_DAY}', 0, 0, 0, 0, 'error', 'no route' UNION ALL SELECT TIMESTAMP '{SECOND_DAY}', t, p, g, s, 'success', NULL FROM c""",
    ),
    "x10_career_prose": (lambda s, d: _prose(s, d).withColumns({"numbers": F.array_join(F.col("numbers").cast("array<string>"), ","), "columns": F.array_join("columns", ",")}), PROSE),
    "s13_box_scores": (_boxes, BOXES),
    "s13_html_cells": (lambda s, d: htmltables.html_cells(_page(GRID)(s, d), "k", "html"), GRID_SQL),
}

QUERIES = {name: q for name, (q, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
