"""Analytic queries over the bindings with their SQL: contests, players, text, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchside.functions import text as T
from pitchside.operators import player_analytics as P
from pitchside.operators import quality_checks as Q
from pitchside.operators import team_analytics as A
from pitchside.operators.core import two_sided, with_mid_rank
from pitchside.plans import bindings as B

TEAM_A, TEAM_B, PLAYER_A, PLAYER_B = 3, 7, 1, 2

WITH_GAMES, WITH_STATS = f"WITH {B.GAMES_SQL}, {B.TEAMS_SQL}, {B.SIDES_SQL}", f"WITH {B.STATS_SQL}"
TOTALS = """totals AS (SELECT team_id, count(*) AS games, CAST(sum(CASE WHEN NOT postponed AND gf > ga THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(sum(CASE WHEN NOT postponed AND gf < ga THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN NOT postponed AND gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS ties,
  CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against FROM sides {where} GROUP BY team_id)"""
COUNTS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in P.COUNTS)


def _outcome():
    """A player's game as won, lost or tied: goals against a fixed mark."""
    return F.when(F.col("goals") > 4, 1).when(F.col("goals") < 4, -1).otherwise(0)


def _people(spark, d):
    return B.table(spark, d, "supplier")


def _names(spark, d):
    """The distinct part names, with their smallest part as id and brand as group."""
    return B.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("grp"))


SUITE = {
    "a02_season_totals": (lambda s, d: P.season_totals(B.player_stats(s, d)), f"{WITH_STATS} SELECT player_id, season, count(DISTINCT game_id) AS games, {COUNTS} FROM stats GROUP BY player_id, season"),
    "a07_team_totals": (lambda s, d: A.team_totals(B.games(s, d)), f"{WITH_GAMES}, {TOTALS.format(where='')} SELECT * FROM totals"),
    "a25_records": (
        lambda s, d: A.team_totals(B.games(s, d), "ignore").select("team_id", A.record_text(F.col("wins"), F.col("losses"), F.col("ties")).alias("record")),
        f"{WITH_GAMES}, {TOTALS.format(where='WHERE NOT postponed')} SELECT team_id, CASE WHEN ties > 0 THEN wins || '-' || losses || '-' || ties ELSE wins || '-' || losses END AS record FROM totals",
    ),
    "a08_top_scorers": (
        lambda s, d: P.top_scorers(B.player_stats(s, d)).select("team_id", "rn", "player_id", "points"),
        f"""{WITH_STATS}, x AS (SELECT team_id, player_id, player_name, sum(goals) AS goals, sum(goals) + sum(assists) AS points FROM stats GROUP BY ALL)
        SELECT team_id, CAST(rn AS INTEGER) AS rn, player_id, CAST(points AS BIGINT) AS points FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY points DESC, goals DESC, lower(player_name), player_id) AS rn FROM x WHERE points > 0) WHERE rn <= 3""",
    ),
    "a10_constellation": (
        lambda s, d: P.constellation(B.player_stats(s, d)).select("player_id", "games", "goals", "goals_pg", "assists_pg"),
        f"""{WITH_STATS} SELECT player_id, count(DISTINCT game_id) AS games, CAST(sum(goals) AS BIGINT) AS goals, floor(sum(goals)::DOUBLE / count(DISTINCT game_id) * 1000 + 0.5) / 1000 AS goals_pg,
        floor(sum(assists)::DOUBLE / count(DISTINCT game_id) * 1000 + 0.5) / 1000 AS assists_pg FROM stats GROUP BY player_id, player_name, team_id""",
    ),
    "a11_rivalry_edges": (
        lambda s, d: A.rivalry_edges(B.games(s, d)),
        f"{WITH_GAMES} SELECT least(home_id, away_id) AS team_a, greatest(home_id, away_id) AS team_b, count(*) AS games, CAST(sum(abs(home_score - away_score)) AS BIGINT) AS margin_sum, avg(abs(home_score - away_score)) AS mean_margin FROM games WHERE NOT postponed AND home_id <> away_id GROUP BY 1, 2",
    ),
    "a11_rivalry_nodes": (
        lambda s, d: A.rivalry_nodes(B.games(s, d), B.teams(s, d)),
        f"{WITH_GAMES}, {TOTALS.format(where='WHERE NOT postponed')} SELECT team_id, name, games, wins, losses, ties FROM totals JOIN teams USING (team_id)",
    ),
    "a12_head_to_head": (
        lambda s, d: A.head_to_head(B.games(s, d), TEAM_A, TEAM_B),
        f"""{WITH_GAMES}, {TOTALS.format(where='WHERE NOT postponed')}, pair AS (SELECT team_id, CAST(sum(CASE WHEN gf > ga THEN 1 ELSE 0 END) AS BIGINT) AS pair_wins, CAST(sum(CASE WHEN gf < ga THEN 1 ELSE 0 END) AS BIGINT) AS pair_losses,
        CAST(sum(CASE WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS pair_ties FROM sides WHERE NOT postponed AND team_id IN ({TEAM_A}, {TEAM_B}) AND opponent_id IN ({TEAM_A}, {TEAM_B}) AND team_id <> opponent_id GROUP BY team_id)
        SELECT * FROM totals LEFT JOIN pair USING (team_id) WHERE team_id IN ({TEAM_A}, {TEAM_B})""",
    ),
    "a12_meetings": (
        lambda s, d: A.meetings(B.games(s, d), TEAM_A, TEAM_B),
        f"{WITH_GAMES} SELECT game_date, gf, ga, at_home, CASE WHEN gf > ga THEN 'W' WHEN gf < ga THEN 'L' ELSE 'T' END AS result FROM sides WHERE team_id = {TEAM_A} AND opponent_id = {TEAM_B} AND NOT postponed",
    ),
    "a13_compare_players": (
        lambda s, d: P.compare_players(B.player_stats(s, d), PLAYER_A, PLAYER_B),
        f"""{WITH_STATS}, s AS (SELECT player_id, count(*) AS n, sum(goals)::DOUBLE AS g, sum(assists)::DOUBLE AS a, sum(ground_balls)::DOUBLE AS gb, sum(caused_turnovers)::DOUBLE AS ct, sum(saves)::DOUBLE AS sv FROM stats WHERE player_id IN ({PLAYER_A}, {PLAYER_B}) GROUP BY player_id),
        l AS (SELECT player_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS pos, unnest(['goals', 'assists', 'points', 'ground_balls', 'caused_turnovers', 'saves', 'points_per_game', 'goals_per_game', 'assists_per_game']) AS category,
          unnest([g, a, g + a, gb, ct, sv, floor((g + a) / n * 100 + 0.5) / 100, floor(g / n * 100 + 0.5) / 100, floor(a / n * 100 + 0.5) / 100]) AS v FROM s),
        x AS (SELECT pos, category, coalesce(max(v) FILTER (player_id = {PLAYER_A}), 0) AS a, coalesce(max(v) FILTER (player_id = {PLAYER_B}), 0) AS b FROM l GROUP BY pos, category),
        y AS (SELECT *, CASE WHEN a > b THEN 'a' WHEN a < b THEN 'b' ELSE 'tie' END AS leader, abs(a - b) AS diff FROM x),
        r AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY round(diff, 9) DESC, pos) AS rn FROM y)
        SELECT category, a, b, leader, diff, CASE WHEN leader <> 'tie' AND rn <= 3 THEN CAST(rn AS INTEGER) END AS lead FROM r""",
    ),
    "a14_sparklines": (
        lambda s, d: P.sparklines(B.player_stats(s, d)).select("player_id", "total", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series")),
        f"""{WITH_STATS}, played AS (SELECT * FROM stats WHERE NOT postponed), best AS (SELECT player_id, CAST(sum(goals) AS BIGINT) AS total FROM played GROUP BY player_id ORDER BY total DESC, player_id LIMIT 10)
        SELECT player_id, total, string_agg(CAST(goals AS VARCHAR), ',' ORDER BY game_date, game_id) AS series FROM played JOIN best USING (player_id) GROUP BY player_id, total""",
    ),
    "a15_calendar": (lambda s, d: A.calendar(B.game_days(s, d)), f"WITH {B.DAYS_SQL} SELECT game_date, count(*) AS games FROM games GROUP BY game_date"),
    "w12_calendar_grid": (
        lambda s, d: A.calendar_grid(B.game_days(s, d)),
        f"""WITH {B.DAYS_SQL}, c AS (SELECT game_date, count(*) AS games FROM games GROUP BY game_date),
        grid AS (SELECT CAST(unnest(generate_series(date_trunc('week', min(game_date))::TIMESTAMP, date_trunc('week', max(game_date))::TIMESTAMP + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS game_date FROM c)
        SELECT game_date, coalesce(games, 0) AS games, CASE WHEN coalesce(games, 0) = 0 THEN 0 WHEN games <= 2 THEN 1 WHEN games <= 4 THEN 2 ELSE 3 END AS bin FROM grid LEFT JOIN c USING (game_date)""",
    ),
    "a16_seasons": (lambda s, d: A.seasons(B.game_days(s, d)), f"WITH {B.DAYS_SQL} SELECT season, count(*) AS games, season = max(season) OVER () AS newest FROM games GROUP BY season"),
    "a17_anomaly_groups": (
        lambda s, d: Q.grouped_anomalies(B.table(s, d, "events"), F.col("event_type"), F.col("props"), F.col("user_id").cast("string"), 20),
        "SELECT event_type AS reason, props AS line, count(*) AS n, max(CAST(user_id AS VARCHAR)) AS url FROM events GROUP BY 1, 2 ORDER BY n DESC, reason, line LIMIT 20",
    ),
    "a19_event_shares": (lambda s, d: Q.shares(B.table(s, d, "events"), "event_type"), "SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type"),
    "a20_freshness": (lambda s, d: Q.freshness(B.table(s, d, "events"), "event_type", "ts"), "SELECT event_type, max(ts) AS latest, count(*) AS n FROM events GROUP BY event_type"),
    "a26_milestones": (
        lambda s, d: P.milestones(B.player_stats(s, d)),
        f"""{WITH_STATS}, l AS (SELECT player_id, game_id, game_date, 'goals' AS stat, goals AS value FROM stats UNION ALL SELECT player_id, game_id, game_date, 'assists', assists FROM stats UNION ALL SELECT player_id, game_id, game_date, 'points', goals + assists FROM stats)
        SELECT player_id, game_id, game_date, stat, value FROM (SELECT *, row_number() OVER (PARTITION BY player_id, stat ORDER BY value DESC, game_date DESC, game_id DESC) AS rn FROM l) WHERE rn = 1""",
    ),
    "a30_duplicated_names": (
        lambda s, d: Q.duplicated_names(B.table(s, d, "part"), "p_type", "p_brand"),
        "SELECT lower(p_type) AS name, count(DISTINCT p_brand) AS groups, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2",
    ),
    "a34_margins": (
        lambda s, d: A.margin_buckets(B.games(s, d)),
        f"""{WITH_GAMES} SELECT CASE WHEN m <= 3 THEN '1-3' WHEN m <= 6 THEN '4-6' WHEN m <= 10 THEN '7-10' WHEN m <= 15 THEN '11-15' ELSE '16+' END AS bucket, count(*) AS games
        FROM (SELECT abs(home_score - away_score) AS m FROM games WHERE NOT postponed) WHERE m > 0 GROUP BY 1""",
    ),
    "j12_common_opponents": (
        lambda s, d: A.common_opponents(B.games(s, d), TEAM_A, TEAM_B),
        f"{WITH_GAMES} SELECT opponent_id FROM sides WHERE team_id = {TEAM_A} AND NOT postponed AND opponent_id NOT IN ({TEAM_A}, {TEAM_B}) INTERSECT SELECT opponent_id FROM sides WHERE team_id = {TEAM_B} AND NOT postponed",
    ),
    "j17_categorise": (
        lambda s, d: Q.categorise(
            B.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v")), B.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v")), ["k"], ["v"]
        ),
        """SELECT coalesce(c_custkey, s_suppkey) AS k, c_nationkey AS v_left, s_nationkey AS v_right, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'extra' WHEN c_nationkey = s_nationkey THEN 'equal' ELSE 'mismatched' END AS kind
        FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
    ),
    "w01_streaks": (
        lambda s, d: P.streaks(B.player_stats(s, d), "player_id", [F.desc("game_date"), F.desc("game_id")], _outcome()),
        f"""{WITH_STATS}, r AS (SELECT player_id, CASE WHEN goals > 4 THEN 1 WHEN goals < 4 THEN -1 ELSE 0 END AS o, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS n FROM stats),
        f AS (SELECT *, first_value(o) OVER (PARTITION BY player_id ORDER BY n) AS first FROM r WHERE n <= 10)
        SELECT player_id, CAST(first * coalesce(min(n) FILTER (o <> first) - 1, max(n)) AS BIGINT) AS streak FROM f GROUP BY player_id, first""",
    ),
    "w03_concentration": (
        lambda s, d: P.concentration(B.player_stats(s, d), 0.5, 7),
        f"""{WITH_STATS} SELECT player_id, season, game_id, goals, total FROM (SELECT *, CAST(sum(goals) OVER (PARTITION BY player_id, season) AS BIGINT) AS total, row_number() OVER (PARTITION BY player_id, season ORDER BY goals DESC, game_id DESC) AS rn FROM stats)
        WHERE rn = 1 AND total >= 7 AND goals::DOUBLE / total > 0.5""",
    ),
    "w05_momentum": (
        lambda s, d: P.momentum(B.player_stats(s, d), "player_id", [F.col("game_date"), F.col("game_id")], _outcome()).select("player_id", "game_id", "momentum"),
        f"{WITH_STATS} SELECT player_id, game_id, CAST(sum(CASE WHEN goals > 4 THEN 1 WHEN goals < 4 THEN -1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS momentum FROM stats",
    ),
    "w07_percentiles": (
        lambda s, d: with_mid_rank(B.table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], F.floor(F.col("c_acctbal") / 100), "pct").select("c_custkey", "pct"),
        """WITH x AS (SELECT c_custkey, c_nationkey, floor(c_acctbal / 100) AS v FROM customer), r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY c_nationkey, v) AS peers, count(*) OVER (PARTITION BY c_nationkey) AS n FROM x)
        SELECT c_custkey, CASE WHEN n <= 1 THEN 0.5::DOUBLE ELSE (below + below + peers) / 2.0::DOUBLE / n END AS pct FROM r""",
    ),
    "w09_outliers": (
        lambda s, d: A.outliers(B.player_stats(s, d).select("player_id", "game_id", "goals"), "player_id", "goals", 1.5, 5.0),
        f"{WITH_STATS} SELECT player_id, game_id, goals FROM (SELECT *, count(*) OVER w AS n, avg(goals) OVER w + 1.5 * coalesce(stddev_samp(goals) OVER w, 0) AS hi FROM stats WINDOW w AS (PARTITION BY player_id)) WHERE n >= 3 AND goals > greatest(hi, 5.0)",
    ),
    "d03_fuzzy_pairs": (
        lambda s, d: Q.fuzzy_pairs(_names(s, d), "id", "name", "grp", 0.6),
        """WITH p AS (SELECT min(p_partkey) AS id, lower(trim(p_name)) AS name, min(p_brand) AS grp FROM part GROUP BY p_name)
        SELECT a.id AS a_id, b.id AS b_id, CASE WHEN greatest(length(a.name), length(b.name)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) END AS sim
        FROM p a JOIN p b ON a.id < b.id AND a.grp <> b.grp AND a.name[1] = b.name[1] WHERE length(a.name) >= 4 AND (contains(a.name, ' ') OR length(a.name) >= 6) AND length(b.name) >= 4 AND (contains(b.name, ' ') OR length(b.name) >= 6) AND 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.6 - 1e-12""",
    ),
    "d26_findings": (
        lambda s, d: Q.findings(
            no_lines=("error", B.table(s, d, "orders").join(B.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")),
            negative_balance=("warning", B.table(s, d, "customer").filter("c_acctbal < 0")),
            self_pairs=("warning", B.games(s, d).filter("home_id = away_id")),
        ),
        f"""{WITH_GAMES} SELECT 'no_lines' AS "check", 'error' AS severity, count(*) AS found FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
        UNION ALL SELECT 'negative_balance', 'warning', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'self_pairs', 'warning', count(*) FROM games WHERE home_id = away_id""",
    ),
    "d25_caps": (
        lambda s, d: Q.capped(B.player_stats(s, d), {"goals": 5, "assists": 3}).select("game_id", "goals", "assists"),
        f"{WITH_STATS} SELECT game_id, CASE WHEN goals > 5 THEN 0 ELSE goals END AS goals, CASE WHEN assists > 3 THEN 0 ELSE assists END AS assists FROM stats WHERE (goals BETWEEN 1 AND 5) OR (assists BETWEEN 1 AND 3)",
    ),
    "p05_perspective": (
        lambda s, d: two_sided(B.games(s, d)).groupBy("team_id", "at_home").agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga")),
        f"{WITH_GAMES} SELECT team_id, at_home, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga FROM sides GROUP BY 1, 2",
    ),
    "p06_search": (
        lambda s, d: B.table(s, d, "customer").filter(F.lower("c_name").contains("00001")).orderBy(F.lower("c_name").startswith("customer#00").desc(), F.lower("c_name"), "c_custkey").limit(20).select("c_custkey", "c_name"),
        "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') ORDER BY starts_with(lower(c_name), 'customer#00') DESC, lower(c_name), c_custkey LIMIT 20",
    ),
    "l02_paging": (
        lambda s, d: B.table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice"),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40",
    ),
    "f07_slugs": (
        lambda s, d: B.table(s, d, "part").select("p_partkey", T.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug")),
        "SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(lower(p_name || ' & ' || p_brand), '''', ''), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    ),
    "f21_mondays": (lambda s, d: B.table(s, d, "orders").select("o_orderkey", T.monday(F.to_date("o_orderdate")).alias("week")), "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders"),
    "f29_hashes": (lambda s, d: B.table(s, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"), F.md5("url").alias("md5")), "SELECT page_id, sha256(html) AS sha, md5(url) AS md5 FROM pages"),
    "s07_url_ids": (
        lambda s, d: B.table(s, d, "pages").select("page_id", T.last_segment(F.col("url")).alias("post_id")),
        r"SELECT page_id, nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '([^/]+)/*$', 1), '') AS post_id FROM pages",
    ),
}

QUERIES = {name: fn for name, (fn, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
