"""Result pages, checks across tables, matching and the front page over the driver's tables, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pitchside.functions import pages
from pitchside.operators import bundle, matching
from pitchside.operators.cross_checks import cross_checks
from pitchside.plans import bindings as B
from pitchside.plans.entity_suite import _official
from pitchside.plans.suite import TOTALS, WITH_GAMES, WITH_STATS
from pitchside.plans.text_suite import PARTS, _parts

SEASON, TODAY = 1996, date(1996, 6, 1)
GAME_ORDER = ["home_id", "away_id", "home_score", "away_score", "postponed", "provenance"]


def _page(html):
    return lambda s, d: _parts(s, d).withColumn("html", F.expr(html))


def _rows(html, parser):
    return lambda s, d: _page(html)(s, d).select("k", F.inline(parser(F.col("html"))))


RANKING = """concat('<h3>State  D1 ', v % 3 + 1, 'a Boys <b>Lacrosse</b></h3><table><tr><th>Seed</th></tr><tr><td>', n, '</td><td data-field="schoolName">OAKS &amp; ', p_type, '</td><td>', m, '</td><td data-field="losses">3</td><td>1</td><td>10.5</td><td>', m, '.25</td></tr>',
 '<tr><td>-</td><td> GLENN  PARK</td><td>1</td><td>2</td><td>x</td><td>7</td></tr></table><h3>Girls</h3><table><tr><td>1</td><td>A</td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table>')"""
STANDINGS = """concat('<table><tr class="tablecontent"><td>1</td><td><a href="Team.asp?LgID=5&TmID=', k, '">', a, '</a></td><td>9</td><td><a href="Schedule.asp?x">', n, '-', m, '-1</a> (W', n, ')</td><td>0</td><td>1</td><td>', m, '</td><td>88</td><td>77</td><td>-11</td></tr>',
 '<tr class="other"><td>1</td><td><a href="Team.asp">z</a></td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table>')"""
SCORERS = """concat('<tr class=tablecontent><td>1</td><td><a href="Player.asp?p=1">', CASE WHEN v % 2 = 0 THEN concat(n, ' - ') ELSE '' END, p_type, ' Roe</a></td><td>', a, '</td><td>4</td><td>', m, '</td><td>2</td><td>', m + 2, '</td><td>1</td><td>30</td></tr>')"""
GOALIES = """concat('<tr class=tablecontent><td>1</td><td><a href="Player.asp?p=1">', CASE WHEN v % 2 = 0 THEN concat(n, ' - ') ELSE '' END, p_type, ' Roe</a></td><td>', b, '</td><td>4</td><td>60</td><td>', m, '</td><td>7.25</td></tr>')"""
SCHEDULE = """concat('<tr class=tablecontent><td>Mon 5/', 1 + m, '/2026</td><td>7pm</td><td>', n, '</td><td><a href="Game.asp?g=1">', a, ' ', m, ' at ', b, ' ', n, '</a></td><td></td><td>Field ', v, '</td></tr>',
 '<tr class=tablecontent><td></td><td>8pm</td><td>', n + 1, '</td><td><a href="Game.asp?g=2">', b, ' at ', a, '</a></td><td></td><td>F</td></tr><tr class=tablecontent><td></td><td>9pm</td><td>-</td><td><a href="Game.asp">x at y</a></td><td></td><td>F</td></tr>')"""
LINKS = """concat('<a href="/games/04-', lpad(CAST(1 + m AS STRING), 2, '0'), '-2026/lacrosse-26/old-', k, '-vs-new-park.htm?c=x', k, '">a</a><a href="https://www.example.com/games/04-', lpad(CAST(1 + m AS STRING), 2, '0'), '-2026/lacrosse-26/old-', k, '-vs-new-park.htm?c=x', k, '">b</a>')"""
SCHOOLS = """concat('<a href="/pa/x/', k, '/lacrosse/"><img src="l.png?version=', n, '&amp;width=64&height=64&auto=webp"><div class="title big">', a, '</div><div class="description">West, ', b, ', pa</div></a><a href="/pa/x/', k, '/lacrosse" title="again"></a><a href="/pa/y/', k, '/lacrosse/" title="', b, '"></a><a href="/pa/z/">no</a>')"""
IMAGE = """CASE v % 4 WHEN 0 THEN concat('<meta property="og:image" content="a.jpg?x=1&amp;k=', k, '"><img src="b.jpg">') WHEN 1 THEN concat('{"featured_media_src_url":"https:\\\\/\\\\/x\\\\/', k, '.jpg"}')
 WHEN 2 THEN concat('<img src="out.jpg"><div class="entry-content"><img src="logo.png"><img alt="Sponsor" src="c.jpg"><img width="', n, '" height="auto" src="', k, '.jpg"></div></article>') ELSE concat('<p>', a) END"""


def _lines(spark, d):
    """Each line item as a player's row: the part as player, of one of 25 teams, with one to seven goals."""
    li, o, p = B.table(spark, d, "lineitem"), B.table(spark, d, "orders"), B.table(spark, d, "part")
    k = F.col("l_partkey").cast("long")
    name = F.when(k % 50 == 0, "Al").when(k % 50 == 1, "Saves").when(k % 50 == 2, "Jo Goalie").otherwise(F.col("p_name"))
    rows = li.join(o.hint("shuffle_hash"), li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return rows.select(k.alias("player_id"), name.alias("player_name"), (k % 25).alias("team_id"), F.col("l_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.col("l_linenumber").cast("long").alias("goals"), F.lit(0).cast("long").alias("assists"))


def _contests(spark, d):
    k = F.col("o_custkey").cast("long")
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), (F.col("o_orderstatus") == "P").alias("postponed"), (k % 25).alias("home_id"), ((k + 1) % 25).alias("away_id"), (k % 6).alias("home_score"), (k % 4).alias("away_score"))


CHECKS = f"""WITH ps AS (SELECT CAST(l_partkey AS BIGINT) AS player_id, CASE l_partkey % 50 WHEN 0 THEN 'Al' WHEN 1 THEN 'Saves' WHEN 2 THEN 'Jo Goalie' ELSE p_name END AS name, CAST(l_partkey % 25 AS BIGINT) AS team_id, l_orderkey AS game_id, year(o_orderdate) AS season, CAST(l_linenumber AS BIGINT) AS goals
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT o_orderkey AS game_id, o_custkey % 25 AS home, (o_custkey + 1) % 25 AS away, CAST(o_custkey % 6 AS BIGINT) AS hs, CAST(o_custkey % 4 AS BIGINT) AS aws FROM orders WHERE year(o_orderdate) = {SEASON} AND o_orderstatus <> 'P'),
sc AS (SELECT ps.*, CASE WHEN home = team_id THEN hs ELSE aws END AS score FROM ps JOIN g USING (game_id) WHERE team_id IN (home, away)),
one AS (SELECT player_id, name, min(game_id) AS game_id, sum(goals) AS total, max(goals) AS best, arg_min(game_id, [-goals, game_id]) AS best_game FROM ps WHERE season = {SEASON} GROUP BY ALL)
SELECT 'cross-check-player-exceeds-team' AS strategy, player_id, team_id, game_id, goals AS found, score AS bound FROM sc WHERE goals > score
UNION ALL SELECT 'cross-check-sum-exceeds-team', NULL, team_id, game_id, CAST(sum(goals) AS BIGINT), any_value(score) FROM sc GROUP BY team_id, game_id HAVING sum(goals) > any_value(score) + 3
UNION ALL SELECT 'cross-check-suspect-name', player_id, NULL, game_id, NULL, NULL FROM one WHERE name IN ('Al', 'Saves')
UNION ALL SELECT 'cross-check-goalie-as-scorer', player_id, NULL, game_id, CAST(total AS BIGINT), NULL FROM one WHERE name = 'Jo Goalie'
UNION ALL SELECT 'cross-check-season-concentration', player_id, NULL, best_game, best, CAST(total AS BIGINT) FROM one WHERE total >= 10 AND best > 0.6 * total"""


def _sheets(spark, d):
    k, n = F.col("n_nationkey"), F.col("n_name")
    text = F.when(k % 4 == 0, F.initcap(n)).when(k % 4 == 1, F.concat(n, F.lit(" game"))).when(k % 4 == 2, F.concat(F.substring(n, 1, 1), F.lit("z")))
    return B.table(spark, d, "nation").select(F.coalesce(text, F.concat(F.lit("Q"), k.cast("string"))).alias("sheet"))


def _roster(spark, d):
    """Parts as athletes named by their key in letters, the brand as team.

    The middle one of the three copies of the key has letters of its own: a name without its first letters could else be as near to a key whose digits are shifted (100483, 48301).
    """
    p = B.table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("long").alias("k"))
    letters = lambda by: F.translate(F.lpad(F.col("k").cast("string"), 7, "0"), "0123456789", by)
    last = F.concat(letters("abcdefghij"), letters("klmnopqrst"), letters("abcdefghij"), F.lit("z"))
    return p.select(F.col("p_brand").alias("team_id"), F.col("k").alias("athlete_id"), F.col("k").alias("nth"), F.lit("Jonathan").alias("first"), last.alias("last"))


SUITE = {
    "s10_ranking_tables": (
        _rows(RANKING, pages.rankings),
        f"""WITH p AS ({PARTS}), x AS (SELECT k, (v % 3 + 1) || 'A' AS classification, n, m, 'Oaks & ' || upper(p_type[1]) || lower(p_type[2:]) AS name FROM p)
        SELECT k, classification, n AS seed, name, lower(name) AS key, m AS wins, 3 AS losses, 1 AS ties, 10.5::DOUBLE AS points, (m + 0.25)::DOUBLE AS ranking FROM x
        UNION ALL SELECT k, classification, NULL, 'Glenn Park', 'glenn park', 1, 2, 0, 2, 7 FROM x""",
    ),
    "s11_standings": (_rows(STANDINGS, pages.standings), f"WITH p AS ({PARTS}) SELECT k, k AS team_id, a AS name, n AS wins, m AS losses, 1 AS ties, 'W' || n AS streak, 9 AS gp, 0 AS otw, 1 AS otl, m AS pts, 88 AS pf, 77 AS pa, -11 AS diff FROM p"),
    "s11_scorers": (_rows(SCORERS, pages.scorers), f"WITH p AS ({PARTS}) SELECT k, CASE WHEN v % 2 = 0 THEN n ELSE -1 END AS jersey, p_type || ' Roe' AS name, a AS team, 4 AS gp, m AS goals, 2 AS assists, m + 2 AS points, 1 AS penalties, 30 AS pim FROM p"),
    "s11_goalies": (_rows(GOALIES, pages.goalies), f"WITH p AS ({PARTS}) SELECT k, n AS jersey, p_type || ' Roe' AS name, b AS team, 4 AS gp, 60 AS minutes, m AS goals_against, 7.25 AS average FROM p WHERE v % 2 = 0"),
    "s11_schedule": (
        lambda s, d: pages.schedule(_page(SCHEDULE)(s, d), "k", "html"),
        f"""WITH p AS ({PARTS}), x AS (SELECT *, CAST(DATE '2026-05-01' + m AS VARCHAR) AS day FROM p) SELECT k, n AS game_num, day, '7pm' AS time, a AS away, b AS home, m AS away_score, n AS home_score, 'Field ' || v AS location FROM x WHERE n > 0
        UNION ALL SELECT k, n + 1, day, '8pm', b, a, 0, 0, 'F' FROM x""",
    ),
    "s14_game_links": (
        lambda s, d: _page(LINKS)(s, d).withColumn("hit", pages.find_game(pages.game_links(F.col("html"), "lacrosse-26"), F.lit("2026-04-05"), F.array(F.lit("New-Park-Rams")), F.array(F.lit("old")))).select("k", F.size(pages.game_links(F.col("html"))).alias("links"), "hit.path"),
        f"WITH p AS ({PARTS}) SELECT k, 1 AS links, CASE WHEN m = 4 THEN '/games/04-05-2026/lacrosse-26/old-' || k || '-vs-new-park.htm?c=x' || k END AS path FROM p",
    ),
    "s15_schools": (
        lambda s, d: pages.schools(_page(SCHOOLS)(s, d), "k", "html"),
        f"WITH p AS ({PARTS}) SELECT k, 'x/' || k AS slug, a AS name, 'West, ' || b AS city, 'PA' AS state, 'l.png?version=' || n AS logo FROM p UNION ALL SELECT k, 'y/' || k, b, '', '', NULL FROM p",
    ),
    "f30_post_images": (
        lambda s, d: _page(IMAGE)(s, d).withColumn("i", pages.post_image(F.col("html"))).select("k", "i.*"),
        f"""WITH p AS ({PARTS}) SELECT k, CASE v % 4 WHEN 0 THEN 'a.jpg?x=1&k=' || k WHEN 1 THEN 'https://x/' || k || '.jpg' WHEN 2 THEN k || '.jpg' END AS url, NULL AS alt, CASE WHEN v % 4 = 2 THEN n END AS width, NULL AS height,
        CASE v % 4 WHEN 0 THEN 'og' WHEN 1 THEN 'featured-media' WHEN 2 THEN 'body-img' END AS source FROM p""",
    ),
    "d23_cross_checks": (lambda s, d: cross_checks(_lines(s, d), _contests(s, d), SEASON), CHECKS),
    "d20_roster_matches": (
        lambda s, d: matching.match_roster(_roster(s, d).select("team_id", F.expr("CASE nth % 5 WHEN 0 THEN concat(first, ' ', last) WHEN 1 THEN last WHEN 2 THEN concat('Jon ', last) WHEN 3 THEN concat(first, ' ', substr(last, 3)) ELSE concat('Qq ', nth) END").alias("name")), _roster(s, d)).select("athlete_id", "way"),
        "SELECT CAST(p_partkey AS BIGINT) AS athlete_id, CASE p_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'surname' WHEN 2 THEN 'nickname' ELSE 'edits' END AS way FROM part WHERE p_partkey % 5 < 4",
    ),
    "f18_opponents": (
        lambda s, d: matching.pick_opponents(_sheets(s, d), B.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("n_nationkey") == 8, 2).otherwise(1).alias("games"))),
        """SELECT CASE k % 4 WHEN 0 THEN upper(n_name[1]) || lower(n_name[2:]) WHEN 1 THEN n_name || ' game' WHEN 2 THEN n_name[1] || 'z' ELSE 'Q' || k END AS sheet, CASE WHEN k % 4 = 0 AND k <> 8 THEN CAST(k AS BIGINT) END AS team_id,
        CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.82 WHEN 2 THEN 0 ELSE 0.64 END AS confidence, CASE WHEN k = 8 THEN 'several_games' WHEN k % 4 = 1 THEN 'ambiguous' WHEN k % 4 = 2 THEN 'none' WHEN k % 4 = 3 THEN 'low' END AS reason FROM (SELECT *, n_nationkey AS k FROM nation)""",
    ),
    "a38_bundle_teams": (
        lambda s, d: bundle.bundle_teams(B.games(s, d), B.teams(s, d), _official(s, d), SEASON),
        f"""{WITH_GAMES}, {TOTALS.format(where=f'WHERE season = {SEASON}')}, r AS (SELECT team_id, sign(gf - ga) AS o, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, sign(gf - ga) DESC) AS n FROM sides WHERE season = {SEASON} AND NOT postponed),
        f AS (SELECT *, first_value(o) OVER (PARTITION BY team_id ORDER BY n) AS first FROM r WHERE n <= 10), x AS (SELECT team_id, CAST(first * coalesce(min(n) FILTER (o <> first) - 1, max(n)) AS BIGINT) AS streak FROM f GROUP BY team_id, first)
        SELECT team_id, name, CASE WHEN division = 1 THEN 7 ELSE coalesce(wins, 0) END AS wins, CASE WHEN division = 1 THEN 2 ELSE coalesce(losses, 0) END AS losses, coalesce(goals_for, 0) AS goals_for, coalesce(goals_against, 0) AS goals_against, streak FROM teams LEFT JOIN totals USING (team_id) LEFT JOIN x USING (team_id)""",
    ),
    "a38_bundle_games": (
        lambda s, d: bundle.bundle_games(B.games(s, d), TODAY, GAME_ORDER),
        f"{WITH_GAMES} SELECT * FROM games WHERE game_date BETWEEN DATE '{TODAY}' - 7 AND DATE '{TODAY}' ORDER BY game_date DESC, {', '.join(GAME_ORDER)} LIMIT 200",
    ),
    "a38_bundle_top_scorer": (
        lambda s, d: bundle.bundle(B.games(s, d), B.teams(s, d), _official(s, d), B.player_stats(s, d), SEASON, TODAY, GAME_ORDER)["top_scorer"],
        f"{WITH_STATS} SELECT player_id, player_name, team_id, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists FROM stats WHERE season = {SEASON} GROUP BY player_id, player_name, team_id HAVING count(*) >= 3 ORDER BY sum(goals) DESC, sum(assists) DESC, lower(player_name), player_id LIMIT 1",
    ),
}

QUERIES = {name: q for name, (q, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
