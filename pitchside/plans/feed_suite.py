"""Feeds, verdicts and entity resolution over the bindings, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pitchside.operators import feeds as D
from pitchside.operators import merge as M
from pitchside.operators import quality_checks as Q
from pitchside.operators import resolution as R
from pitchside.operators.league import league_rows, scoring_events, standings
from pitchside.plans import bindings as B
from pitchside.plans.league_suite import PLAYED
from pitchside.plans.suite import TOTALS, WITH_GAMES

TEAM, DAY = 3, date(1998, 1, 1)


def _schedule(spark, d):
    """Orders as contests: the customer's nation at home, the last two digits of the key as away team (some unknown), names as written."""
    o, c = B.table(spark, d, "orders"), B.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "CAST(o_orderkey AS BIGINT) AS game_id", "to_date(o_orderdate) AS game_date", "CAST(c_nationkey AS BIGINT) AS home_id", "CAST(o_custkey % 30 AS BIGINT) AS away_id", "concat('home ', c_nationkey) AS home_raw", "concat('away ', o_custkey % 30) AS away_raw",
        "CAST(o_orderkey % 7 AS BIGINT) AS home_score", "CAST(o_orderkey % 5 AS BIGINT) AS away_score", "o_orderstatus = 'P' AS postponed", "CAST(year(o_orderdate) AS BIGINT) AS season", "o_orderstatus AS provenance")


SCHEDULE = """g AS (SELECT CAST(o_orderkey AS BIGINT) AS game_id, CAST(o_orderdate AS DATE) AS game_date, CAST(c_nationkey AS BIGINT) AS home_id, CAST(o_custkey % 30 AS BIGINT) AS away_id, 'home ' || c_nationkey AS home_raw, 'away ' || (o_custkey % 30) AS away_raw,
  CAST(o_orderkey % 7 AS BIGINT) AS home_score, CAST(o_orderkey % 5 AS BIGINT) AS away_score, o_orderstatus = 'P' AS postponed FROM orders JOIN customer ON o_custkey = c_custkey)"""
WITH_SCHEDULE = f"WITH {SCHEDULE}, {B.TEAMS_SQL}"


def _aliases(spark, d):
    return B.table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS alias_id", "s_name AS alias", "CAST(s_nationkey AS BIGINT) AS team_id")


def _people(spark, d):
    """Parts as people: two given names by size, the part's type as family name, the brand's number as team."""
    return B.table(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS id", "concat(CASE p_size % 5 WHEN 0 THEN 'Peirce' WHEN 1 THEN 'Pierce' WHEN 2 THEN 'Pearce' WHEN 3 THEN 'None' ELSE 'Jo' END, CASE WHEN p_size % 5 = 3 THEN '' ELSE concat(' ', p_type) END) AS name", "CAST(substr(p_brand, 7) AS BIGINT) AS team_id")


PEOPLE = "people AS (SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_size % 5 WHEN 0 THEN 'Peirce ' || p_type WHEN 1 THEN 'Pierce ' || p_type WHEN 2 THEN 'Pearce ' || p_type WHEN 3 THEN 'None' ELSE 'Jo ' || p_type END AS name, CAST(substr(p_brand, 7) AS BIGINT) AS team_id FROM part)"


def _stats(spark, d):
    return B.table(spark, d, "lineitem").selectExpr("CAST(l_orderkey AS BIGINT) AS game_id", "CAST(l_partkey AS BIGINT) AS id").distinct()


STATS = "stats AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS game_id, CAST(l_partkey AS BIGINT) AS id FROM lineitem)"


def _large_stats(spark, d):
    """Large items alone, so that some parts have none."""
    return B.table(spark, d, "lineitem").filter("l_quantity >= 48").selectExpr("CAST(l_orderkey AS BIGINT) AS game_id", "CAST(l_partkey AS BIGINT) AS id").distinct()


LARGE_STATS = "stats AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS game_id, CAST(l_partkey AS BIGINT) AS id FROM lineitem WHERE l_quantity >= 48)"


def _official(spark, d):
    return B.table(spark, d, "nation").filter("n_regionkey <> 2").selectExpr("CAST(n_nationkey AS BIGINT) AS team_id", "CAST(n_nationkey * 9 AS BIGINT) AS wins", "CAST(n_nationkey * 8 AS BIGINT) AS losses", "CAST(1000 + n_nationkey AS BIGINT) AS points")


OFFICIAL = "official AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, CAST(n_nationkey * 9 AS BIGINT) AS wins, CAST(n_nationkey * 8 AS BIGINT) AS losses, CAST(1000 + n_nationkey AS BIGINT) AS points FROM nation WHERE n_regionkey <> 2)"


def _commitments(spark, d):
    rows = B.table(spark, d, "orders").filter("o_orderstatus <> 'P'").selectExpr("CAST(o_orderkey AS BIGINT) AS commit_id", "CAST(o_custkey AS BIGINT) AS player_id", "CASE WHEN o_orderkey % 2 = 0 THEN to_date(o_orderdate) END AS commit_date", "to_date(o_orderdate) - 3 AS created_at", "o_orderstatus AS status")
    people = B.table(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", "c_name AS name", "CASE WHEN c_nationkey > 2 THEN CAST(c_nationkey AS BIGINT) + 2 END AS team_id")
    return rows, people, B.teams(spark, d)


def _anomalies(spark, d):
    """Events as anomalies of posts: each names one of a few tokens, and an order as the contest."""
    return B.table(spark, d, "events").selectExpr("CAST(event_id AS BIGINT) AS game_id", "concat('post', event_id % 40) AS post", "concat('[unresolved sub-header: \"', CASE event_id % 9 WHEN 0 THEN 'NATION_4' WHEN 1 THEN 'Supplier#000000001' WHEN 2 THEN 'Jo  SMALL' WHEN 3 THEN 'four words are many' WHEN 4 THEN concat('t', user_id) WHEN 5 THEN 'dv' ELSE concat('u ', translate(CAST(user_id % 4 AS STRING), '0123', 'abcd')) END, '\"]') AS line")


ANOMALIES = "anomalies AS (SELECT CAST(event_id AS BIGINT) AS game_id, 'post' || (event_id % 40) AS post, CASE event_id % 9 WHEN 0 THEN 'nation_4' WHEN 1 THEN 'supplier#000000001' WHEN 2 THEN 'jo small' WHEN 3 THEN 'four words are many' WHEN 4 THEN 't' || user_id WHEN 5 THEN 'dv' ELSE 'u ' || translate(CAST(user_id % 4 AS VARCHAR), '0123', 'abcd') END AS alias FROM events)"


def _external(spark, d):
    g = _schedule(spark, d).filter(F.col("home_id") == TEAM)
    return g.selectExpr("game_date", "concat('Nation_', away_id) AS opponent", "home_score AS own", "CASE WHEN game_id % 3 = 0 THEN away_score + 1 WHEN game_id % 3 = 1 THEN away_score END AS other")


def _results(spark, d):
    g = _schedule(spark, d)
    turned = g.selectExpr("game_date", "away_id AS home_id", "home_id AS away_id", "home_score + 1 AS home_score", "away_score + 2 AS away_score")
    new = g.selectExpr("date_add(game_date, 20000) AS game_date", "home_id", "away_id", "home_score", "away_score")
    return turned.unionByName(new).distinct()


def _target(spark, d):
    return B.table(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS k", "CAST(p_size AS BIGINT) AS size", "p_brand AS brand", "CAST(p_partkey % 50 AS BIGINT) AS day")


def _batch(spark, d):
    """Changes to the smaller parts, each twice with an order of arrival, and as many new keys."""
    p = B.table(spark, d, "part").filter("p_size <= 25").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2))))
    old = p.selectExpr("CAST(p_partkey AS BIGINT) AS k", "CAST(p_size + at AS BIGINT) AS size", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('B', at) END AS brand", "CAST(p_partkey % 50 AS BIGINT) AS day", "at")
    return old.unionByName(old.withColumn("k", -F.col("k") - 1))


BATCH = """t AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS size, p_brand AS brand, CAST(p_partkey % 50 AS BIGINT) AS day FROM part),
o AS (SELECT k, size + 2 AS size, CASE WHEN k % 4 = 0 THEN NULL ELSE 'B2' END AS brand, day FROM t WHERE size <= 25), b AS (SELECT * FROM o UNION ALL SELECT -k - 1, size, brand, day FROM o)"""

SUITE = {
    "s08_watermarks": (lambda s, d: D.watermark(B.table(s, d, "events"), "props", "ts", '{"k": 1'), "SELECT max(ts) AS watermark FROM events WHERE props LIKE '{\"k\": 1%'"),
    "p08_parameters": (
        lambda s, d: B.table(s, d, "orders").select("o_orderkey", D.limit_parameter(F.expr("CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey AS STRING) WHEN 2 THEN '12.7' ELSE 'x' END"), 25, 100).alias("rows"), D.season_parameter(F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN CAST(1990 + o_orderkey % 40 AS STRING) WHEN 2 THEN NULL ELSE '2020.5' END"), F.lit(2026).cast("long")).alias("x")).select("o_orderkey", "rows", "x.*"),
        """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN least(o_orderkey, 100) WHEN 2 THEN 12 ELSE 25 END AS rows, CASE WHEN o_orderkey % 4 = 1 AND 1990 + o_orderkey % 40 BETWEEN 2000 AND 2100 THEN 1990 + o_orderkey % 40 WHEN o_orderkey % 4 = 2 THEN 2026 END AS season,
        o_orderkey % 4 IN (0, 2) OR (o_orderkey % 4 = 1 AND 1990 + o_orderkey % 40 BETWEEN 2000 AND 2100) AS valid FROM orders""",
    ),
    "p09_validation": (
        lambda s, d: D.win_counts(B.games(s, d)).join(_official(s, d).select("team_id", (F.col("wins") % 4 + 1).alias("ow"), (F.col("losses") % 4).alias("ol")), "team_id", "left").select("team_id", D.validation(F.col("wins") % 4, F.col("losses") % 4, F.col("ow"), F.col("ol")).alias("x")).select("team_id", "x.*"),
        f"""{WITH_GAMES}, {OFFICIAL}, w AS (SELECT team_id, count(*) FILTER (gf > ga) % 4 AS w, count(*) FILTER (gf < ga) % 4 AS l FROM sides WHERE NOT postponed GROUP BY team_id), j AS (SELECT w.team_id, wins % 4 + 1 - w AS win_diff, losses % 4 - l AS loss_diff FROM w LEFT JOIN official USING (team_id))
        SELECT team_id, CASE WHEN win_diff IS NULL THEN 'unmapped' WHEN abs(win_diff) + abs(loss_diff) = 0 THEN 'match' WHEN abs(win_diff) + abs(loss_diff) <= 2 THEN 'close' ELSE 'divergent' END AS status, win_diff, loss_diff, abs(win_diff) + abs(loss_diff) AS total_diff FROM j""",
    ),
    "p10_confidence": (lambda s, d: B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", D.confidence_level(F.col("l_discount") * 10).alias("level")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.9 THEN 'high' WHEN l_discount * 10 >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM lineitem"),
    "p11_sources": (lambda s, d: B.table(s, d, "part").select("p_partkey", D.source_name(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'phillylax' WHEN 1 THEN 'pa-state' WHEN 2 THEN p_name END")).alias("source")), "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'philly' WHEN 1 THEN 'pa-state' END AS source FROM part"),
    "p12_text_filter": (lambda s, d: D.containing(B.table(s, d, "part"), " RING e", ["p_name", "p_type"]).select("p_partkey"), "SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%ring e%'"),
    "p13_enough_games": (lambda s, d: D.enough_games(standings(B.games(s, d)), 300).select("team_id", "games"), f"{PLAYED} SELECT team_id, count(*) AS games FROM played GROUP BY 1 HAVING count(*) >= 300"),
    "j02_both_names": (lambda s, d: D.with_team_names(_schedule(s, d), B.teams(s, d)).select("game_id", "home_name", "away_name"), f"{WITH_SCHEDULE} SELECT game_id, coalesce(h.name, home_raw) AS home_name, coalesce(a.name, away_raw) AS away_name FROM g LEFT JOIN teams h ON h.team_id = home_id LEFT JOIN teams a ON a.team_id = away_id"),
    "j13_opponents": (
        lambda s, d: D.opponents_of(_schedule(s, d), TEAM, B.teams(s, d), _aliases(s, d)),
        f"{WITH_SCHEDULE} SELECT game_id, game_date, name AS opponent, s_name AS alias FROM g JOIN teams ON team_id = CASE WHEN home_id = {TEAM} THEN away_id ELSE home_id END LEFT JOIN supplier ON s_nationkey = team_id WHERE home_id = {TEAM} OR away_id = {TEAM}",
    ),
    "j14_first_images": (lambda s, d: D.first_of_each(B.table(s, d, "part").select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey"), "SELECT p_name, min(p_partkey) AS p_partkey, min_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name"),
    "j15_pair_rows": (
        lambda s, d: D.pair_rows(B.table(s, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS a_id", "CAST(p_partkey + 1 AS BIGINT) AS b_id"), _people(s, d), B.teams(s, d), _stats(s, d)),
        f"WITH {PEOPLE}, {STATS}, {B.TEAMS_SQL}, c AS (SELECT id, count(*) AS n FROM stats GROUP BY id), f AS (SELECT people.id, people.name, teams.name AS team, coalesce(n, 0) AS stats FROM people JOIN teams USING (team_id) LEFT JOIN c USING (id)) SELECT a.id AS a_id, b.id AS b_id, a.name AS a_name, a.team AS a_team, a.stats AS a_stats, b.name AS b_name, b.team AS b_team, b.stats AS b_stats FROM f a JOIN f b ON b.id = a.id + 1",
    ),
    "a32_totals_mismatches": (
        lambda s, d: D.totals_mismatches(B.games(s, d), B.teams(s, d), _official(s, d)),
        f"{WITH_GAMES}, {OFFICIAL}, {TOTALS.format(where='WHERE NOT postponed')} SELECT team_id, name, coalesce(t.wins, 0) - o.wins AS delta_wins, coalesce(t.losses, 0) - o.losses AS delta_losses, coalesce(goals_for, 0) - points AS delta_points FROM official o JOIN teams USING (team_id) LEFT JOIN totals t USING (team_id) WHERE t.wins <> o.wins OR t.losses <> o.losses OR goals_for <> points",
    ),
    "a35_legend": (lambda s, d: D.top_groups(_people(s, d), "team_id"), f"WITH {PEOPLE} SELECT team_id, count(*) AS n FROM people GROUP BY team_id ORDER BY n DESC, team_id LIMIT 8"),
    "a36_season_summary": (
        lambda s, d: D.season_summary(standings(B.games(s, d)), B.table(s, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", "c_name AS name", "CAST(floor(c_acctbal / 1000) AS BIGINT) AS points")),
        f"{PLAYED} SELECT (SELECT CAST(sum(gf) AS BIGINT) FROM played) AS goals, CAST(floor(max(c_acctbal / 1000)) AS BIGINT) AS top_points, (SELECT c_name FROM customer ORDER BY floor(c_acctbal / 1000) DESC, c_custkey LIMIT 1) AS top_player FROM customer",
    ),
    "a39_upcoming_records": (
        lambda s, d: D.upcoming_records(_schedule(s, d), _schedule(s, d), TEAM, DAY),
        f"""{WITH_SCHEDULE}, m AS (SELECT game_id, game_date, CASE WHEN home_id = {TEAM} THEN away_id ELSE home_id END AS opponent_id FROM g WHERE (home_id = {TEAM} OR away_id = {TEAM}) AND game_date >= DATE '{DAY}' ORDER BY game_date, game_id LIMIT 5),
        r AS (SELECT CASE WHEN home_id = {TEAM} THEN home_score - away_score ELSE away_score - home_score END AS x FROM g WHERE NOT postponed AND home_id = {TEAM} UNION ALL SELECT away_score - home_score FROM g WHERE NOT postponed AND away_id = {TEAM})
        SELECT m.*, (SELECT count(*) FILTER (x > 0) || '-' || count(*) FILTER (x < 0) || CASE WHEN count(*) FILTER (x = 0) > 0 THEN '-' || count(*) FILTER (x = 0) ELSE '' END FROM r) AS record FROM m""",
    ),
    "w10_score_trend": (
        lambda s, d: D.score_trend(_schedule(s, d), TEAM),
        f"{WITH_SCHEDULE} SELECT game_id, game_date, CASE WHEN home_id = {TEAM} THEN home_score ELSE away_score END AS gf, CASE WHEN home_id = {TEAM} THEN away_score ELSE home_score END AS ga FROM g WHERE NOT postponed AND (home_id = {TEAM} OR away_id = {TEAM})",
    ),
    "w14_chips": (
        lambda s, d: _schedule(s, d).select("game_id", D.streak_chip(F.col("home_score") - F.col("away_score")).alias("chip"), D.day_text(F.expr("CASE WHEN game_id % 5 = 0 THEN 'soon' ELSE CAST(game_date AS STRING) END")).alias("day")),
        f"{WITH_SCHEDULE} SELECT game_id, CASE WHEN home_score - away_score >= 2 THEN 'W' || (home_score - away_score) WHEN away_score - home_score >= 2 THEN 'L' || (away_score - home_score) END AS chip, CASE WHEN game_id % 5 = 0 THEN 'soon' ELSE month(game_date) || '/' || day(game_date) || '/' || year(game_date) END AS day FROM g",
    ),
    "l05_sorted_teams": (
        lambda s, d: D.sorted_teams(B.teams(s, d).join(_official(s, d).select("team_id", (F.col("wins") % 5).alias("gap")), "team_id", "left"), "gap").select("team_id", "position"),
        f"WITH {B.TEAMS_SQL}, {OFFICIAL} SELECT team_id, CAST(row_number() OVER (ORDER BY wins % 5 DESC NULLS LAST, lower(name), team_id) AS INTEGER) AS position FROM teams LEFT JOIN official USING (team_id)",
    ),
    "l07_league_rank": (
        lambda s, d: D.league_rank(standings(B.games(s, d)).join(B.teams(s, d).select("team_id", "name"), "team_id")).select("team_id", "position", "pts"),
        f"{PLAYED}, totals AS (SELECT team_id, count(*) FILTER (o = 1) AS wins, count(*) FILTER (o = 0) AS ties, sum(gf) AS goals_for, sum(ga) AS goals_against FROM played GROUP BY team_id) SELECT team_id, CAST(row_number() OVER (ORDER BY 2 * wins + ties DESC, goals_for - goals_against DESC, goals_for DESC, goals_against, name, team_id) AS INTEGER) AS position, 2 * wins + ties AS pts FROM totals JOIN teams USING (team_id)",
    ),
    "l10_commitments": (
        lambda s, d: D.commitments(*_commitments(s, d), status="F", limit=50).select("commit_id", "name", "team"),
        f"WITH {B.TEAMS_SQL} SELECT CAST(o_orderkey AS BIGINT) AS commit_id, c_name AS name, teams.name AS team FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN teams ON c_nationkey > 2 AND team_id = c_nationkey + 2 WHERE o_orderstatus = 'F' ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) - 3 END DESC, CAST(o_orderdate AS DATE) - 3 DESC, lower(c_name), o_orderkey LIMIT 50",
    ),
    "l13_schedule": (
        lambda s, d: D.schedule_list(_schedule(s, d), since=DAY, team=TEAM, limit=40).select("game_id", "game_date"),
        f"{WITH_SCHEDULE} SELECT game_id, game_date FROM g WHERE (home_id = {TEAM} OR away_id = {TEAM}) AND game_date >= DATE '{DAY}' ORDER BY game_date, game_id LIMIT 40",
    ),
    "l13_by_date": (lambda s, d: D.by_date(_schedule(s, d)).select("game_date", F.array_join(F.col("games").cast("array<string>"), ",").alias("games")), f"{WITH_SCHEDULE} SELECT game_date, string_agg(CAST(game_id AS VARCHAR), ',' ORDER BY game_id) AS games FROM g GROUP BY 1"),
    "d02_resolve_or_create": (
        lambda s, d: R.resolve_or_create(B.table(s, d, "customer").selectExpr("CASE c_custkey % 4 WHEN 0 THEN concat('Nation_', c_nationkey, ' Scoring:') WHEN 1 THEN concat('SUPPLIER#', lpad(CAST(c_custkey % 50 AS STRING), 9, '0')) WHEN 2 THEN concat('New Town ', c_nationkey) ELSE 'DV' END AS raw"), B.teams(s, d), _aliases(s, d), strict=True).select("raw", "team_id", "slug", "created"),
        f"""WITH {B.TEAMS_SQL}, r AS (SELECT DISTINCT c_custkey % 4 AS f, c_nationkey AS n, CASE c_custkey % 4 WHEN 0 THEN 'Nation_' || c_nationkey || ' Scoring:' WHEN 1 THEN 'SUPPLIER#' || lpad(CAST(c_custkey % 50 AS VARCHAR), 9, '0') WHEN 2 THEN 'New Town ' || c_nationkey ELSE 'DV' END AS raw FROM customer),
        x AS (SELECT DISTINCT f, CASE WHEN f IN (0, 2) THEN n END AS n, raw FROM r), new AS (SELECT raw, 24 + row_number() OVER (ORDER BY lower(raw)) AS team_id, CASE f WHEN 2 THEN 'new-town-' || n ELSE replace(lower(raw), '#', '-') END AS slug FROM x WHERE f = 2 OR (f = 1 AND lower(raw) NOT IN (SELECT lower(s_name) FROM supplier)))
        SELECT raw, CAST(n AS BIGINT) AS team_id, 'nation-' || n AS slug, FALSE AS created FROM x WHERE f = 0 UNION ALL SELECT raw, CAST(s_nationkey AS BIGINT), 'nation-' || s_nationkey, FALSE FROM x JOIN supplier ON lower(s_name) = lower(raw) WHERE f = 1
        UNION ALL SELECT raw, team_id, slug, TRUE FROM new UNION ALL SELECT raw, NULL, NULL, FALSE FROM x WHERE f = 3""",
    ),
    "d05_same_team_candidates": (
        lambda s, d: R.fuzzy_candidates(_people(s, d), _stats(s, d)),
        f"""WITH {PEOPLE}, {STATS}, c AS (SELECT id, count(*) AS n FROM stats GROUP BY id), k AS (SELECT id, team_id, lower(name) AS key, string_split(lower(name), ' ') AS w, coalesce(n, 0) AS n FROM people LEFT JOIN c USING (id)),
        p AS (SELECT a.team_id, a.id AS left_id, b.id AS right_id, levenshtein(a.key, b.key) AS edits, a.key AS x, b.key AS y, a.w AS u, b.w AS v, a.n AS left_stats, b.n AS right_stats FROM k a JOIN k b ON a.team_id = b.team_id AND a.id < b.id AND a.key <> b.key),
        q AS (SELECT *, CASE WHEN edits <= 2 AND least(length(x), length(y)) >= 5 AND (len(u) <> len(v) OR NOT ((u[1] <> v[1] AND least(length(u[1]), length(v[1])) < 5) OR (len(u) = 2 AND u[2] <> v[2] AND least(length(u[2]), length(v[2])) < 5))) THEN 'high'
          WHEN len(u) = 2 AND len(v) = 2 AND least(length(u[1]), length(v[1])) >= 4 AND least(length(u[2]), length(v[2])) >= 3 AND damerau_levenshtein(u[1], v[1]) <= 1 AND damerau_levenshtein(u[2], v[2]) <= 1 AND (damerau_levenshtein(u[1], v[1]) < levenshtein(u[1], v[1]) OR damerau_levenshtein(u[2], v[2]) < levenshtein(u[2], v[2])) THEN 'high'
          WHEN len(u) >= 2 AND len(v) >= 2 AND u[-1][1] = v[-1][1] AND least(length(u[1]), length(v[1])) >= 4 AND levenshtein(u[1], v[1]) <= 2 THEN 'medium' END AS confidence FROM p)
        SELECT team_id, left_id, right_id, edits, confidence, left_stats, right_stats FROM q WHERE confidence IS NOT NULL""",
    ),
    "d07_cross_team_merge": (
        lambda s, d: R.cross_team_plan(_people(s, d), _stats(s, d)),
        f"""WITH {PEOPLE}, {STATS}, c AS (SELECT id, count(*) AS n FROM stats GROUP BY id), k AS (SELECT id, team_id, lower(trim(name)) AS key, coalesce(n, 0) AS n FROM people LEFT JOIN c USING (id)), g AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT team_id) > 1),
        r AS (SELECT *, first_value(id) OVER (PARTITION BY key ORDER BY n DESC, id) AS keep_id FROM k JOIN g USING (key)) SELECT id, keep_id FROM r WHERE id <> keep_id""",
    ),
    "d10_composites": (
        lambda s, d: R.split_composites(_people(s, d).withColumn("name", F.expr("CASE WHEN id % 3 = 0 THEN concat(name, ' and Al Roe') ELSE name END"))),
        f"WITH {PEOPLE} SELECT id, team_id, CAST(nth AS INTEGER) AS nth, CASE WHEN nth = 0 THEN name ELSE 'Al Roe' END AS name FROM people, range(2) r(nth) WHERE id % 3 = 0",
    ),
    "d11_ghost_teams": (
        lambda s, d: R.ghost_teams(B.teams(s, d).withColumn("name", F.expr("CASE WHEN team_id % 2 = 0 THEN concat('T', team_id) ELSE name END")).unionByName(B.teams(s, d).selectExpr("team_id + 100 AS team_id", "'DV' AS name", "division")), _schedule(s, d), _people(s, d)),
        f"{WITH_SCHEDULE}, {PEOPLE}, t AS (SELECT team_id, 'T' || team_id AS name FROM teams WHERE team_id % 2 = 0 UNION ALL SELECT team_id + 100, 'DV' FROM teams) SELECT team_id, name, (SELECT count(*) FROM g WHERE home_id = t.team_id) + (SELECT count(*) FROM g WHERE away_id = t.team_id) AS games, (SELECT count(*) FROM people WHERE people.team_id = t.team_id) AS people, team_id >= 100 AS deletable FROM t",
    ),
    "d12_junk_people": (lambda s, d: R.junk_people(_people(s, d), _large_stats(s, d)), f"WITH {PEOPLE}, {LARGE_STATS} SELECT id, name, id NOT IN (SELECT id FROM stats) AS deletable FROM people WHERE name = 'None'"),
    "d13_orphan_aliases": (lambda s, d: R.orphan_aliases(_aliases(s, d).withColumn("team_id", F.col("team_id") + 5), B.teams(s, d), "team_id"), "SELECT CAST(s_suppkey AS BIGINT) AS alias_id, s_name AS alias, CAST(s_nationkey + 5 AS BIGINT) AS team_id FROM supplier WHERE s_nationkey + 5 NOT IN (SELECT n_nationkey FROM nation)"),
    "d15_mined_aliases": (
        lambda s, d: R.mine_aliases(_anomalies(s, d), _schedule(s, d), B.teams(s, d), _aliases(s, d).withColumn("alias", F.lower("alias")), _people(s, d)),
        f"""WITH {SCHEDULE}, {ANOMALIES}, {PEOPLE}, v AS (SELECT post, alias, home_id, away_id FROM anomalies JOIN g USING (game_id)), l AS (SELECT post, alias, home_id AS team_id FROM v UNION ALL SELECT post, alias, away_id FROM v),
        s AS (SELECT alias, team_id, count(DISTINCT post) AS posts, count(*) AS occurrences FROM l GROUP BY 1, 2), n AS (SELECT alias, count(DISTINCT post) AS total FROM v GROUP BY 1), x AS (SELECT *, posts::DOUBLE / total AS purity FROM s JOIN n USING (alias)),
        y AS (SELECT *, CASE WHEN purity = 1 AND posts >= 3 THEN 0.95::DOUBLE WHEN purity = 1 AND posts >= 2 THEN 0.8 ELSE 0.5 END AS confidence, count(*) FILTER (purity = 1) OVER (PARTITION BY alias) AS pure FROM x)
        SELECT alias, team_id, posts, occurrences, purity, confidence, CASE WHEN alias IN (SELECT lower(s_name) FROM supplier) THEN 'already aliased' WHEN alias IN (SELECT lower(n_name) FROM nation) THEN 'name of a team' WHEN alias IN (SELECT lower(name) FROM people) THEN 'name of a player'
          WHEN regexp_matches(alias, '[0-9]') OR len(string_split(alias, ' ')) > 3 THEN 'looks like a player' WHEN pure > 1 AND purity = 1 THEN 'ambiguous' WHEN confidence < 0.8 THEN 'too few posts' END AS rejected FROM y""",
    ),
    "d17_top_matches": (
        lambda s, d: R.top_matches(B.table(s, d, "part").select(F.col("p_name").alias("name")), B.table(s, d, "part").select(F.concat("p_type", F.lit(" ring")).alias("name"))),
        """WITH n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1), c AS (SELECT DISTINCT p_type || ' ring' AS candidate, lower(p_type) || ' ring' AS k FROM part),
        s AS (SELECT name, n, candidate, round(least(1, 1 - levenshtein(name, k)::DOUBLE / greatest(length(name), length(k)) + CASE WHEN name = k THEN 0.25 WHEN contains(name, k) OR contains(k, name) THEN 0.15 ELSE 0.05 * least(3, len(list_intersect(string_split(name, ' '), string_split(k, ' ')))) END), 9) AS score FROM n, c)
        SELECT name, n, candidate, score, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS INTEGER) AS position FROM s) WHERE position <= 3""",
    ),
    "d28_score_disagreements": (
        lambda s, d: R.score_disagreements(_schedule(s, d), B.teams(s, d), TEAM, _external(s, d), most_edits=0),
        f"""{WITH_SCHEDULE}, e AS (SELECT DISTINCT game_date, 'Nation_' || away_id AS opponent, away_id, home_score AS own, CASE WHEN game_id % 3 = 0 THEN away_score + 1 ELSE away_score END AS other FROM g WHERE home_id = {TEAM} AND game_id % 3 < 2),
        m AS (SELECT game_id, game_date, CASE WHEN home_id = {TEAM} THEN away_id ELSE home_id END AS o, CASE WHEN home_id = {TEAM} THEN home_score ELSE away_score END AS db_own, CASE WHEN home_id = {TEAM} THEN away_score ELSE home_score END AS db_other FROM g WHERE home_id = {TEAM} OR away_id = {TEAM}),
        j AS (SELECT game_id, e.game_date, opponent, own, other, db_own, db_other, row_number() OVER (PARTITION BY e.game_date, opponent, own, other ORDER BY game_id) AS rn FROM e JOIN m ON e.game_date = m.game_date JOIN teams ON team_id = o WHERE contains(lower(name), lower(opponent)) OR contains(lower(opponent), lower(name)))
        SELECT game_id, game_date, opponent, own, other, db_own, db_other FROM j WHERE rn = 1 AND (own <> db_own OR other <> db_other)""",
    ),
    "d31_branding": (
        lambda s, d: R.branding_updates(
            B.table(s, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS team_id", "'#00ff00' AS first", "CASE WHEN n_nationkey % 2 = 0 THEN '#FFFFFF' END AS second", "n_name AS nickname"),
            B.table(s, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS team_id", "CASE WHEN s_suppkey % 5 = 0 THEN 'green' ELSE '#00ff00' END AS first", "CASE WHEN s_suppkey % 2 = 0 THEN '#FFFFFF' END AS second", "concat('NATION_', CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE CAST(s_suppkey AS STRING) END) AS nickname"),
        ),
        "SELECT CAST(s_suppkey AS BIGINT) AS team_id, CASE WHEN s_suppkey % 5 = 0 THEN 'invalid' WHEN s_suppkey > 24 THEN 'missing' WHEN s_suppkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM supplier",
    ),
    "m06_fill_gaps": (
        lambda s, d: R.fill_gaps(_schedule(s, d), _results(s, d)),
        f"""{WITH_SCHEDULE}, b AS (SELECT DISTINCT * FROM (SELECT game_date, away_id AS home_id, home_id AS away_id, home_score + 1 AS home_score, away_score + 2 AS away_score FROM g UNION ALL SELECT CAST(game_date + 20000 AS DATE), home_id, away_id, home_score, away_score FROM g)),
        s AS (SELECT *, FALSE AS r FROM (SELECT game_id, game_date, home_id, away_id, home_score + away_score > 0 AS scored FROM g) UNION ALL SELECT game_id, game_date, away_id, home_id, home_score + away_score > 0, TRUE FROM g), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_date, home_id, away_id ORDER BY r, game_id) AS rn FROM s) WHERE rn = 1)
        SELECT b.game_date, b.home_id, b.away_id, game_id, CASE WHEN game_id IS NULL THEN 'insert' WHEN scored THEN 'complete' ELSE 'fill' END AS action, CASE WHEN coalesce(r, FALSE) THEN away_score ELSE home_score END AS home_score, CASE WHEN coalesce(r, FALSE) THEN home_score ELSE away_score END AS away_score
        FROM b LEFT JOIN k ON b.game_date = k.game_date AND b.home_id = k.home_id AND b.away_id = k.away_id""",
    ),
    "m05_insert_absent": (lambda s, d: M.insert_absent(_target(s, d), _batch(s, d).drop("at"), ["k"], [F.desc("size")]), f"WITH {BATCH} SELECT * FROM t UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM t)"),
    "m07_replace_partition": (lambda s, d: M.replace_partition(_target(s, d), _batch(s, d).filter("at = 2 AND day < 10").drop("at"), ["day"]), f"WITH {BATCH} SELECT * FROM t WHERE day NOT IN (SELECT day FROM b WHERE day < 10) UNION ALL SELECT * FROM b WHERE day < 10"),
    "m01_upsert": (lambda s, d: M.upsert(_target(s, d), _batch(s, d), ["k"], [F.desc("at")]), f"WITH {BATCH} SELECT k, CASE WHEN b.k IS NULL THEN t.size ELSE b.size END AS size, CASE WHEN b.k IS NULL THEN t.brand ELSE b.brand END AS brand, coalesce(b.day, t.day) AS day FROM t FULL JOIN b USING (k)"),
    "m02_upsert_keeps": (lambda s, d: M.upsert(_target(s, d), _batch(s, d), ["k"], [F.desc("at")], {"brand": M.KEEP, "size": M.OLD}), f"WITH {BATCH} SELECT k, coalesce(t.size, b.size) AS size, coalesce(t.brand, b.brand) AS brand, coalesce(b.day, t.day) AS day FROM t FULL JOIN b USING (k)"),
    "m03_upsert_if_given": (lambda s, d: M.upsert(_target(s, d), _batch(s, d), ["k"], [F.desc("at")], {"brand": M.REPLACE_IF_GIVEN}), f"WITH {BATCH} SELECT k, coalesce(b.size, t.size) AS size, coalesce(b.brand, t.brand) AS brand, coalesce(b.day, t.day) AS day FROM t FULL JOIN b USING (k)"),
    "m04_upsert_longest": (
        lambda s, d: M.upsert(_target(s, d), _batch(s, d).withColumn("brand", F.expr("CASE WHEN k % 6 = 0 THEN 'a longer brand' ELSE brand END")), ["k"], [F.desc("at")], {"brand": M.LONGEST}),
        f"WITH {BATCH}, c AS (SELECT k, size, CASE WHEN k % 6 = 0 THEN 'a longer brand' ELSE brand END AS brand, day FROM b) SELECT k, coalesce(c.size, t.size) AS size, CASE WHEN length(c.brand) > length(t.brand) THEN c.brand ELSE coalesce(t.brand, c.brand) END AS brand, coalesce(c.day, t.day) AS day FROM t FULL JOIN c USING (k)",
    ),
    "d06_redirected_stats": (
        lambda s, d: M.redirect(_stats(s, d), B.table(s, d, "part").filter("p_size <= 25 AND p_partkey > 0").selectExpr("CAST(p_partkey AS BIGINT) AS old", "CAST(p_partkey - 1 AS BIGINT) AS new"), "id", ["game_id", "id"], []),
        f"WITH {STATS} SELECT DISTINCT game_id, CASE WHEN p_size <= 25 AND id > 0 THEN id - 1 ELSE id END AS id FROM stats JOIN part ON p_partkey = id",
    ),
    "d16_seeded_aliases": (
        lambda s, d: R.seed_aliases(R.mine_aliases(_anomalies(s, d), _schedule(s, d), B.teams(s, d), _aliases(s, d), _people(s, d)).withColumn("rejected", F.expr("CASE WHEN rejected = 'too few posts' THEN NULL ELSE rejected END")), B.teams(s, d), _aliases(s, d), 0.5),
        f"""WITH {SCHEDULE}, {ANOMALIES}, {PEOPLE}, v AS (SELECT post, alias, home_id, away_id FROM anomalies JOIN g USING (game_id)), l AS (SELECT post, alias, home_id AS team_id FROM v UNION ALL SELECT post, alias, away_id FROM v),
        s AS (SELECT alias, team_id, count(DISTINCT post) AS posts FROM l GROUP BY 1, 2), n AS (SELECT alias, count(DISTINCT post) AS total FROM v GROUP BY 1), x AS (SELECT alias, team_id, posts, posts = total AS pure FROM s JOIN n USING (alias)),
        y AS (SELECT *, CASE WHEN pure AND posts >= 3 THEN 3 WHEN pure AND posts >= 2 THEN 2 ELSE 1 END AS c, count(*) FILTER (pure) OVER (PARTITION BY alias) AS pures FROM x),
        z AS (SELECT * FROM y WHERE alias NOT IN (SELECT lower(n_name) FROM nation) AND alias NOT IN (SELECT lower(name) FROM people) AND NOT regexp_matches(alias, '[0-9]') AND len(string_split(alias, ' ')) <= 3 AND NOT (pures > 1 AND pure) AND team_id IN (SELECT n_nationkey FROM nation))
        SELECT alias, team_id FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY c DESC, team_id) AS rn FROM z) WHERE rn = 1""",
    ),
    "d16_judged_names": (
        lambda s, d: R.judge_unknown(B.table(s, d, "customer").selectExpr("CASE c_custkey % 3 WHEN 0 THEN concat('nation ', c_nationkey) WHEN 1 THEN concat('natio ', c_nationkey, c_nationkey) ELSE 'zz' END AS name"), B.teams(s, d).withColumn("name", F.regexp_replace("name", "_", " "))),
        """WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, 'nation ' || n_nationkey AS t FROM nation), n AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'nation ' || c_nationkey WHEN 1 THEN 'natio ' || c_nationkey || c_nationkey ELSE 'zz' END AS name, count(*) AS n FROM customer GROUP BY 1),
        s AS (SELECT *, levenshtein(name, t) AS e, CASE WHEN name = t THEN 1.0::DOUBLE ELSE round(greatest(1 - levenshtein(name, t)::DOUBLE / greatest(length(name), length(t)), len(list_intersect(string_split(name, ' '), string_split(t, ' ')))::DOUBLE / greatest(len(string_split(name, ' ')), len(string_split(t, ' '))), CASE WHEN contains(name, t) OR contains(t, name) THEN least(length(name), length(t))::DOUBLE / greatest(length(name), length(t)) ELSE 0 END), 9) END AS score FROM n, t),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, team_id) AS rn, count(*) FILTER (e <= 1) OVER (PARTITION BY name) AS near, min(team_id) FILTER (e <= 1) OVER (PARTITION BY name) AS near_id FROM s)
        SELECT name, n, CASE WHEN score < 0.9 AND near = 1 THEN near_id ELSE team_id END AS team_id, CASE WHEN score < 0.9 AND near = 1 THEN 0.9 ELSE score END AS score, CASE WHEN score >= 0.9 OR near = 1 THEN 'seed' WHEN score >= 0.6 THEN 'review' ELSE 'no match' END AS verdict FROM r WHERE rn = 1""",
    ),
    "w11_scoring_events": (
        lambda s, d: scoring_events(
            B.table(s, d, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS game_id", "explode(array(named_struct('period', 1, 'at_home', true, 'goals', CAST(o_orderkey % 3 AS INT)), named_struct('period', 1, 'at_home', false, 'goals', CAST(o_orderkey % 4 AS INT)), named_struct('period', 2, 'at_home', true, 'goals', 1))) AS p").select("game_id", "p.*"),
            B.table(s, d, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS game_id", "explode(array(named_struct('at_home', true, 'name', 'A', 'goals', 2, 'assists', 0), named_struct('at_home', true, 'name', 'B', 'goals', 1, 'assists', 9), named_struct('at_home', false, 'name', 'C', 'goals', 2, 'assists', 0))) AS p").select("game_id", "p.*"),
        ),
        """WITH s AS (SELECT o_orderkey AS k, 1 AS period, unnest(range(o_orderkey % 3)) AS nth, TRUE AS h FROM orders UNION ALL SELECT o_orderkey, 1, unnest(range(o_orderkey % 4)), FALSE FROM orders UNION ALL SELECT o_orderkey, 2, 0, TRUE FROM orders),
        o AS (SELECT *, row_number() OVER w - 1 AS seq, count(*) FILTER (h) OVER w AS home, count(*) FILTER (NOT h) OVER w AS away FROM s WINDOW w AS (PARTITION BY k ORDER BY period, nth, h ROWS UNBOUNDED PRECEDING))
        SELECT CAST(k AS BIGINT) AS game_id, CAST(seq AS INTEGER) AS sequence, CAST(period AS INTEGER) AS period, h AS at_home, CASE WHEN h THEN CASE home WHEN 1 THEN 'A' WHEN 2 THEN 'A' WHEN 3 THEN 'B' END WHEN away <= 2 THEN 'C' END AS scorer, CASE WHEN h AND home <= 2 THEN 'B' END AS assist,
        CAST(home AS INTEGER) AS home_after, CAST(away AS INTEGER) AS away_after FROM o""",
    ),
    "l08_league_players": (
        lambda s, d: league_rows(B.table(s, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", "CAST(c_nationkey AS BIGINT) AS league_id", "c_acctbal AS points"), [F.desc("points"), F.col("id")], league=3),
        "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS league_id, c_acctbal AS points FROM customer WHERE c_nationkey = 3",
    ),
    "d24_caps_and_zero_rows": (
        lambda s, d: Q.capped(B.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS BIGINT) AS goals", "CAST(l_linenumber AS BIGINT) AS saves"), {"goals": 15, "saves": 3}),
        "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 15 THEN 0 ELSE l_quantity END AS BIGINT) AS goals, CAST(CASE WHEN l_linenumber > 3 THEN 0 ELSE l_linenumber END AS BIGINT) AS saves FROM lineitem WHERE l_quantity <= 15 OR l_linenumber <= 3",
    ),
}

QUERIES = {name: q for name, (q, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
