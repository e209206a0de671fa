"""Official records, anomalies, scouting and the checks of all tables over the driver's tables, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pitchside.operators import desk, officials
from pitchside.operators import reconciliation as Z
from pitchside.operators import resolution as R
from pitchside.operators.core import spread
from pitchside.plans import bindings as B
from pitchside.sources import sheets

TEAM, OPPONENT, SEASON, TODAY, YEAR = 3, 7, 1996, date(1998, 5, 20), 1998


def _t(spark, d, name, *columns):
    return B.table(spark, d, name).selectExpr(*columns)


def _games(spark, d):
    """Orders as contests of 25 teams and some that are unknown; scores by the days of the year and quantities."""
    return _t(
        spark, d, "orders", "CAST(o_orderkey AS BIGINT) AS game_id", "to_date(o_orderdate) AS game_date", "CAST(year(o_orderdate) AS BIGINT) AS season", "CAST(o_custkey % 25 AS BIGINT) AS home_id", "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderkey % 26 AS BIGINT) END AS away_id",
        "CAST(floor(o_totalprice / 15000) - 1 AS BIGINT) AS home_score", "CASE WHEN o_orderstatus = 'F' THEN CAST(dayofmonth(o_orderdate) AS BIGINT) END AS away_score", "o_orderstatus = 'P' AS postponed", "o_orderstatus AS provenance")


GAMES = """g AS (SELECT CAST(o_orderkey AS BIGINT) AS game_id, CAST(o_orderdate AS DATE) AS game_date, year(o_orderdate) AS season, CAST(o_custkey % 25 AS BIGINT) AS home_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderkey % 26 AS BIGINT) END AS away_id,
  CAST(floor(o_totalprice / 15000) - 1 AS BIGINT) AS hs, CASE WHEN o_orderstatus = 'F' THEN CAST(day(o_orderdate) AS BIGINT) END AS aws, o_orderstatus = 'P' AS postponed FROM orders),
sides AS (SELECT game_id, game_date, season, home_id AS team_id, away_id AS other, hs AS gf, aws AS ga, postponed FROM g UNION ALL SELECT game_id, game_date, season, away_id, home_id, aws, hs, postponed FROM g)"""


def _people(spark, d):
    """Customers as people of nations; a few names and jerseys that are wrong."""
    return _t(spark, d, "customer", "CAST(c_custkey AS BIGINT) AS player_id", "CAST(c_nationkey AS BIGINT) AS team_id", "CASE WHEN c_mktsegment = 'BUILDING' THEN concat('Name ', floor(c_acctbal / 100)) ELSE c_name END AS name", "CAST(floor(c_acctbal / 90) AS BIGINT) AS jersey", "c_mktsegment")


PEOPLE = "p AS (SELECT CAST(c_custkey AS BIGINT) AS player_id, CAST(c_nationkey AS BIGINT) AS team_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Name ' || CAST(floor(c_acctbal / 100) AS BIGINT) ELSE c_name END AS name, CAST(floor(c_acctbal / 90) AS BIGINT) AS jersey FROM customer)"


def _teams(spark, d):
    """Nations, one for each supplier beyond, of which only those with an official row count."""
    return B.teams(spark, d).select("team_id", "name").unionByName(_t(spark, d, "supplier", "CAST(s_suppkey + 100 AS BIGINT) AS team_id", "s_name AS name"))


def _aliases(spark, d):
    return _t(spark, d, "supplier", "CAST(s_nationkey AS BIGINT) AS team_id", "concat('alias ', floor(s_acctbal / 1000)) AS alias")


def _official(spark, d):
    """By nation: a row under its name for two regions, rows under aliases; by supplier: under its name if its balance is negative."""
    a = _t(spark, d, "nation", "CAST(n_nationkey AS BIGINT) AS official_id", "lower(n_name) AS key", "CAST(n_nationkey AS BIGINT) AS wins", "CAST(n_regionkey AS BIGINT) AS losses", "CAST(0 AS BIGINT) AS ties", "CAST(n_nationkey AS DOUBLE) AS ranking", "n_regionkey").filter("n_regionkey < 2").drop("n_regionkey")
    b = _t(spark, d, "nation", "CAST(n_nationkey + 50 AS BIGINT) AS official_id", "concat('alias ', n_nationkey % 10) AS key", "CAST(4 AS BIGINT) AS wins", "CAST(3 AS BIGINT) AS losses", "CAST(2 AS BIGINT) AS ties", "CAST(30 + n_regionkey AS DOUBLE) AS ranking")
    c = _t(spark, d, "supplier", "CAST(s_suppkey + 1000 AS BIGINT) AS official_id", "lower(s_name) AS key", "CAST(0 AS BIGINT) AS wins", "CAST(0 AS BIGINT) AS losses", "CAST(0 AS BIGINT) AS ties", "CAST(NULL AS DOUBLE) AS ranking", "s_acctbal").filter("s_acctbal < 0").drop("s_acctbal")
    return a.unionByName(b).unionByName(c)


OFFICIAL = """t AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS name FROM nation UNION ALL SELECT CAST(s_suppkey + 100 AS BIGINT), s_name FROM supplier), al AS (SELECT s_nationkey AS team_id, 'alias ' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS alias FROM supplier),
o AS (SELECT n_nationkey AS official_id, lower(n_name) AS key, n_nationkey AS wins, n_regionkey AS losses, 0 AS ties, CAST(n_nationkey AS DOUBLE) AS ranking FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_nationkey + 50, 'alias ' || (n_nationkey % 10), 4, 3, 2, 30 + n_regionkey FROM nation
  UNION ALL SELECT s_suppkey + 1000, lower(s_name), 0, 0, 0, NULL FROM supplier WHERE s_acctbal < 0),
cand AS (SELECT t.team_id, o.* FROM t JOIN o ON o.key = lower(t.name) OR o.key IN (SELECT alias FROM al WHERE al.team_id = t.team_id))"""


def _anomalies(spark, d):
    return _t(
        spark, d, "events", "CAST(event_id AS BIGINT) AS id", "CASE event_type WHEN 'view' THEN 'quarter-line' WHEN 'click' THEN 'ranking-list' WHEN 'error' THEN 'aggregated-list' ELSE event_type END AS strategy",
        "CASE event_type WHEN 'view' THEN 'Period sum does not equal total' WHEN 'click' THEN concat('duplicate rank ', user_id % 3, ' in post') WHEN 'error' THEN concat('no goals header', CASE WHEN value < 10 THEN ' recognized' ELSE '' END) ELSE 'other' END AS reason", "props AS line", "CAST(user_id AS STRING) AS url")


ANOMALIES = """a AS (SELECT CAST(event_id AS BIGINT) AS id, CASE event_type WHEN 'view' THEN 'quarter-line' WHEN 'click' THEN 'ranking-list' WHEN 'error' THEN 'aggregated-list' ELSE event_type END AS strategy,
  CASE event_type WHEN 'view' THEN 'Period sum does not equal total' WHEN 'click' THEN 'duplicate rank ' || (user_id % 3) || ' in post' WHEN 'error' THEN 'no goals header' || CASE WHEN value < 10 THEN ' recognized' ELSE '' END ELSE 'other' END AS reason, props AS line, CAST(user_id AS VARCHAR) AS url FROM events)"""


def _summary(part, reason=None):
    return lambda s, d: desk.anomaly_summary(_anomalies(s, d), 25, reason)[part]


def _stats(spark, d):
    """Line items as stat rows; the customer of a part's number is the player, so some contests and players are unknown."""
    return _t(spark, d, "lineitem", "CAST(l_orderkey AS BIGINT) AS game_id", "CAST(l_partkey AS BIGINT) AS player_id", "CAST(l_quantity AS BIGINT) AS goals", "CAST(l_linenumber AS BIGINT) AS assists")


def _scouting(part):
    def run(s, d):
        rows = _stats(s, d).join(_people(s, d).select("player_id", F.col("name").alias("player_name"), "team_id"), "player_id").join(_games(s, d).select("game_id", "season"), "game_id")
        return desk.scouting_report(_games(s, d), rows, TEAM, OPPONENT, SEASON)[part]

    return run


RECENT = f"{GAMES}, last AS (SELECT game_id, game_date, other AS against, gf, ga FROM sides WHERE team_id = {OPPONENT} AND season = {SEASON} AND NOT postponed ORDER BY game_date DESC, game_id DESC LIMIT 5)"
CHECKS = f"""WITH {GAMES}, {PEOPLE}, tm AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id FROM nation), k AS (SELECT * FROM g WHERE home_id IN (SELECT team_id FROM tm) AND away_id IN (SELECT team_id FROM tm)), al AS (SELECT s_nationkey AS team_id, 'alias ' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS alias FROM supplier)
SELECT 'suspicious score' AS "check", 'warning' AS severity, count(*) AS found FROM k WHERE season = {YEAR} AND (hs > 30 OR aws > 30) UNION ALL SELECT 'negative score', 'error', count(*) FROM k WHERE season = {YEAR} AND (hs < 0 OR aws < 0)
UNION ALL SELECT 'duplicate game', 'warning', count(*) FROM (SELECT 1 FROM k WHERE season = {YEAR} GROUP BY game_date, home_id, away_id HAVING count(*) > 1) UNION ALL SELECT 'team without a game', 'warning', count(*) FROM tm WHERE team_id NOT IN (SELECT team_id FROM sides WHERE season = {YEAR} AND team_id IS NOT NULL)
UNION ALL SELECT 'stale season', 'warning', CAST(coalesce(DATE '{TODAY}' - max(game_date) > 7, TRUE) AS BIGINT) FROM g WHERE season = {YEAR} UNION ALL SELECT 'null required field', 'error', count(*) FROM g WHERE game_date IS NULL OR home_id IS NULL OR away_id IS NULL
UNION ALL SELECT 'duplicate player', 'warning', count(*) FROM (SELECT 1 FROM p GROUP BY lower(name), team_id HAVING count(*) > 1) UNION ALL SELECT 'duplicate alias', 'warning', count(*) FROM (SELECT 1 FROM al GROUP BY lower(alias) HAVING count(DISTINCT team_id) > 1)
UNION ALL SELECT 'orphaned stat', 'error', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'duplicate stat', 'error', count(*) FROM (SELECT 1 FROM lineitem WHERE l_partkey IN (SELECT c_custkey FROM customer) GROUP BY l_partkey, l_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'invalid jersey', 'warning', count(*) FROM p WHERE jersey < 0 OR jersey > 99"""

# ---- sheets (S16, S17): a file for each part, its columns in one of two orders

SHEET = '''CASE WHEN p_size % 2 = 0 THEN concat('"Date","Home Team","Home Score","Game Completed","Visitor Team","Visitor Score"\\n2026-04-01,"', p_name, ', North",', p_size, ',Yes,Elm,\\n\\n2026-4-1,a,1,No,b,2\\n2026-04-02,,1,No,b,2\\n')
 ELSE concat('Visitor Score,VISITOR TEAM,date,extra,home team\\r\\n', p_size, ',"say ""', p_name, '""",2026-05-01,x,Oak,beyond\\r\\nx,', p_type, ',2026-05-02,,Oak') END'''
UPLOAD = """CASE WHEN p_size % 2 = 0 THEN concat('Player,Game Date,Vs,G,GBs\\n', p_name, ',4/', 1 + p_size % 28, '/26,Oak,', p_size, ',\\n', p_name, ',later,Oak,1,1\\n,2026-04-01,Elm,1,1\\n')
 ELSE concat('name;,Date,fo won,SAVES\\n', p_name, ',2026-04-01,', p_size, ',x\\n,,,\\n', p_type, ',2026-04-02,,', p_size) END"""


def _texts(form):
    return lambda s, d: spread(B.table(s, d, "part"), "p_partkey").selectExpr("CAST(p_partkey AS STRING) AS path", f"{form} AS text")


def _ghosts(spark, d):
    """Suppliers as teams named by two letters, nations as the teams they stand for, customers as people of both."""
    ghosts = _t(spark, d, "supplier", "CAST(s_suppkey + 100 AS BIGINT) AS team_id", "CASE WHEN s_acctbal < 2000 THEN 'NT' WHEN s_acctbal < 4000 THEN 'QZ' ELSE s_name END AS name")
    teams = _t(spark, d, "nation", "CAST(n_nationkey AS BIGINT) AS team_id", "concat('Nation ', translate(CAST(n_nationkey AS STRING), '0123456789', 'tttttfghij')) AS name").unionByName(ghosts)
    games = _games(spark, d).select("game_id", "home_id", "away_id").unionByName(_t(spark, d, "supplier", "CAST(-s_suppkey - 1 AS BIGINT) AS game_id", "CASE WHEN s_acctbal > 1500 THEN CAST(s_suppkey + 100 AS BIGINT) END AS home_id", "CAST(1 AS BIGINT) AS away_id"))
    people = _t(spark, d, "part", "CAST(p_partkey AS BIGINT) AS id", "CAST(100 + p_size AS BIGINT) AS team_id")
    return R.ghost_repoints(teams, games, people, _stats(spark, d).select("game_id", F.col("player_id").alias("id")))


GHOSTS = f"""{GAMES}, gh AS (SELECT CAST(s_suppkey + 100 AS BIGINT) AS team_id, CASE WHEN s_acctbal < 2000 THEN 'NT' WHEN s_acctbal < 4000 THEN 'QZ' END AS name, s_acctbal FROM supplier WHERE s_acctbal < 4000), idle AS (SELECT * FROM gh WHERE s_acctbal <= 1500),
tn AS (SELECT n_nationkey AS t FROM nation WHERE CAST(n_nationkey AS VARCHAR)[1] < '5'), m AS (SELECT CAST(p_partkey AS BIGINT) AS id, team_id, name FROM part JOIN idle ON team_id = 100 + p_size),
met AS (SELECT m.id, m.team_id AS from_team, arg_min(sides.team_id, (game_id, CASE WHEN sides.team_id = g.home_id THEN 0 ELSE 1 END)) AS to_team FROM m JOIN lineitem ON l_partkey = m.id JOIN g ON game_id = l_orderkey JOIN sides USING (game_id) WHERE m.name = 'NT' AND sides.team_id IN (SELECT t FROM tn) GROUP BY 1, 2),
w AS (SELECT m.team_id, count(*) AS people, count(to_team) AS found FROM m LEFT JOIN met USING (id) GROUP BY 1), v AS (SELECT gh.team_id, gh.name, CASE WHEN s_acctbal > 1500 THEN 'skipped' WHEN people IS NULL THEN 'deletable' WHEN people = found THEN 'repointed' ELSE 'skipped' END AS verdict FROM gh LEFT JOIN w USING (team_id))"""

CORRECTION = (
    "CASE k % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'jersey_number' WHEN 2 THEN 'goals' ELSE 'height' END", "CASE k % 4 WHEN 2 THEN '2' ELSE 'x' END",
    "CASE k % 4 WHEN 0 THEN CASE WHEN c_acctbal < 1000 THEN ' ' WHEN c_acctbal > 9000 THEN repeat('n', 101) ELSE repeat('n', 100) END WHEN 1 THEN CASE WHEN c_acctbal < 0 THEN 'none' ELSE concat(floor(c_acctbal / 90), ' b') END ELSE CASE WHEN c_acctbal < 0 THEN 'many' ELSE CAST(floor(c_acctbal / 500) AS STRING) END END",
)

SUITE = {
    "s16_schedule_sheets": (
        lambda s, d: sheets.schedule_rows(_texts(SHEET)(s, d))[0],
        """SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(2 AS INTEGER) AS row, '2026-04-01' AS date, p_name || ', North' AS home, 'Elm' AS away, TRUE AS completed, CAST(p_size AS DOUBLE) AS home_score, CAST(NULL AS DOUBLE) AS away_score FROM part WHERE p_size % 2 = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2 + i, '2026-05-0' || (i + 1), 'Oak', CASE i WHEN 0 THEN 'say "' || p_name || '"' ELSE p_type END, FALSE, NULL, CASE i WHEN 0 THEN CAST(p_size AS DOUBLE) END FROM part, range(2) r(i) WHERE p_size % 2 = 1""",
    ),
    "s16_malformed_lines": (lambda s, d: sheets.schedule_rows(_texts(SHEET)(s, d))[1], "SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(3 + i AS INTEGER) AS row, CASE i WHEN 0 THEN '2026-4-1,a,1,No,b,2' ELSE '2026-04-02,,1,No,b,2' END AS line, CASE i WHEN 0 THEN 'bad date: \"2026-4-1\"' ELSE 'missing home/away team' END AS reason FROM part, range(2) r(i) WHERE p_size % 2 = 0"),
    "s17_uploaded_rows": (
        lambda s, d: sheets.upload_rows(_texts(UPLOAD)(s, d))[0].select("path", "row", "player_name", "game_date", "opponent", "goals", "ground_balls", "saves", "fo_won"),
        """SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(2 AS INTEGER) AS row, p_name AS player_name, DATE '2026-04-01' + CAST(p_size % 28 AS INTEGER) AS game_date, 'Oak' AS opponent, CAST(p_size AS DOUBLE) AS goals, 0::DOUBLE AS ground_balls, 0::DOUBLE AS saves, 0::DOUBLE AS fo_won FROM part WHERE p_size % 2 = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 4, p_type, DATE '2026-04-02', '', 0, 0, CAST(p_size AS DOUBLE), 0 FROM part WHERE p_size % 2 = 1""",
    ),
    "s17_upload_errors": (lambda s, d: sheets.upload_rows(_texts(UPLOAD)(s, d))[1], "SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(CASE WHEN p_size % 2 = 1 THEN 2 ELSE 3 + i END AS INTEGER) AS row, CASE WHEN p_size % 2 = 1 THEN 'Invalid saves' WHEN i = 0 THEN 'Invalid game_date' ELSE 'player_name is required' END AS message FROM part, range(2) r(i) WHERE p_size % 2 = 0 OR i = 0"),
    "d11_repointed_people": (lambda s, d: _ghosts(s, d)[0], f"WITH {GHOSTS} SELECT id, from_team, to_team FROM met WHERE from_team IN (SELECT team_id FROM v WHERE verdict = 'repointed')"),
    "d11_ghost_verdicts": (lambda s, d: _ghosts(s, d)[1], f"WITH {GHOSTS} SELECT * FROM v"),
    "j18_roster_differences": (
        lambda s, d: Z.roster_differences(_t(s, d, "customer", "c_mktsegment AS team", "concat(' Jo  ', c_custkey) AS name"), _t(s, d, "customer", "CASE WHEN c_acctbal < 0 THEN 'MACHINERY' ELSE c_mktsegment END AS team", "concat('JO ', c_custkey) AS name")),
        "WITH x AS (SELECT * FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'MACHINERY') SELECT c_mktsegment AS team, ' Jo  ' || c_custkey AS name, 'ours' AS side FROM x UNION ALL SELECT 'MACHINERY', 'JO ' || c_custkey, 'live' FROM x",
    ),
    "j18_score_drift": (
        lambda s, d: Z.score_drift(*(_t(s, d, "orders", "CAST(o_orderkey AS BIGINT) AS game_id", "to_date(o_orderdate) AS game_date", "CAST(o_orderkey AS STRING) AS home", "CAST(o_custkey AS STRING) AS away", "CAST(o_orderkey % 3 AS BIGINT) AS home_score", f"{away} AS away_score", "o_orderstatus").filter(keep).drop("o_orderstatus") for away, keep in (("CAST(o_custkey % 2 AS BIGINT)", "true"), ("CAST(o_custkey % 2 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT)", "o_orderstatus <> 'P'")))),
        "SELECT CAST(o_orderkey AS BIGINT) AS game_id, CAST(o_orderdate AS DATE) AS game_date, CAST(o_orderkey AS VARCHAR) AS home, CAST(o_custkey AS VARCHAR) AS away, CAST(o_orderkey % 3 AS BIGINT) AS home_score, CAST(o_custkey % 2 AS BIGINT) AS away_score, CASE o_orderstatus WHEN 'P' THEN 'missing' WHEN 'F' THEN 'drift' ELSE 'ok' END AS state FROM orders WHERE o_orderkey % 3 > 0 OR o_custkey % 2 > 0",
    ),
    "d22_corrected_texts": (
        lambda s, d: _t(s, d, "customer", "CAST(c_custkey AS BIGINT) AS k", "c_acctbal").select("k", Z.judge_correction(*(F.expr(e) for e in CORRECTION)).alias("status")),
        """SELECT CAST(c_custkey AS BIGINT) AS k, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_acctbal < 1000 OR c_acctbal > 9000 THEN 'outlier' ELSE 'pending' END WHEN 1 THEN CASE WHEN c_acctbal < 0 OR floor(c_acctbal / 90) > 99 THEN 'outlier' ELSE 'pending' END
        WHEN 2 THEN CASE WHEN c_acctbal < 0 OR floor(c_acctbal / 500) > 15 OR floor(c_acctbal / 500) > 10 THEN 'outlier' ELSE 'pending' END ELSE 'unknown' END AS status FROM customer""",
    ),
    "w16_day_signatures": (lambda s, d: Z.day_signatures(_games(s, d)), f"WITH {GAMES} SELECT game_date, string_agg(game_id || ':' || coalesce(CAST(aws AS VARCHAR), '') || ':' || hs || ':' || CAST(postponed AS INTEGER), '|' ORDER BY game_id) AS signature FROM g GROUP BY 1"),
    "j06_official_candidates": (lambda s, d: officials.official_candidates(_teams(s, d), _aliases(s, d), _official(s, d)).select("team_id", "official_id"), f"WITH {OFFICIAL} SELECT team_id, CAST(official_id AS BIGINT) AS official_id FROM cand"),
    "j07_official_by_ranking": (lambda s, d: officials.official_of(_teams(s, d), _aliases(s, d), _official(s, d), True).select("team_id", "official_id", "ranking"), f"WITH {OFFICIAL} SELECT team_id, CAST(official_id AS BIGINT) AS official_id, ranking FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY ranking DESC NULLS LAST, official_id) AS rn FROM cand) WHERE rn = 1"),
    "a05_listed_teams": (
        lambda s, d: officials.listed_teams(_teams(s, d), _games(s, d), _people(s, d), _aliases(s, d), _official(s, d)),
        f"""WITH {GAMES}, {PEOPLE}, {OFFICIAL}, d AS (SELECT team_id, count(*) AS games, count(*) FILTER (NOT postponed AND gf > ga) AS w, count(*) FILTER (NOT postponed AND gf < ga) AS l, count(*) FILTER (NOT postponed AND gf = ga) AS x FROM sides GROUP BY 1),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY official_id) AS rn FROM cand) WHERE rn = 1), r AS (SELECT t.*, coalesce(games, 0) AS games, coalesce(w, 0) AS w, coalesce(l, 0) AS l, coalesce(x, 0) AS x, official_id, wins, losses, ties FROM t LEFT JOIN d USING (team_id) LEFT JOIN one USING (team_id) WHERE d.team_id IS NOT NULL OR official_id IS NOT NULL OR team_id IN (SELECT team_id FROM p)),
        s AS (SELECT *, coalesce(wins, w) AS rw, coalesce(losses, l) AS rl, coalesce(ties, x) AS rt FROM r)
        SELECT team_id, name, games, w AS derived_wins, l AS derived_losses, x AS derived_ties, CAST(official_id AS BIGINT) AS official_id, rw || '-' || rl || CASE WHEN rt > 0 THEN '-' || rt ELSE '' END AS record, CASE WHEN official_id IS NULL THEN 'derived' ELSE 'official' END AS source, CASE WHEN wins + losses + ties > 0 THEN games::DOUBLE / (wins + losses + ties) END AS coverage FROM s""",
    ),
    "a17_anomaly_total": (_summary("total"), f"WITH {ANOMALIES} SELECT count(*) AS n FROM a"),
    "a17_anomalies_by_reason": (_summary("by_reason"), f"WITH {ANOMALIES} SELECT reason, count(*) AS n FROM a GROUP BY 1"),
    "a17_anomalies_of_a_reason": (_summary("top", " other "), f"WITH {ANOMALIES} SELECT reason, line, count(*) AS n, max(url) AS url FROM a WHERE reason = 'other' GROUP BY 1, 2 ORDER BY n DESC, line LIMIT 25"),
    "a18_triage_report": (
        lambda s, d: desk.triage_report(_anomalies(s, d), 6).withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x.id.cast("string"), x.line)), "|")),
        f"""WITH {ANOMALIES}, b AS (SELECT strategy, reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, strategy, reason) AS position FROM a GROUP BY 1, 2 QUALIFY position <= 6),
        x AS (SELECT a.*, n, position, row_number() OVER (PARTITION BY a.strategy, a.reason ORDER BY id) AS rn FROM a JOIN b USING (strategy, reason))
        SELECT strategy, reason, n, CAST(position AS INTEGER) AS position, string_agg(id || ':' || line, '|' ORDER BY id) AS samples, CASE WHEN strategy IN ('quarter-line', 'ranking-list') OR reason LIKE '%recognized' THEN 'S' ELSE 'M' END AS difficulty FROM x WHERE rn <= 5 GROUP BY strategy, reason, n, position""",
    ),
    "a23_last_games": (_scouting("last_games"), f"WITH {RECENT} SELECT *, CASE WHEN gf > ga THEN 'W' ELSE 'L' END AS result FROM last"),
    "a23_averages": (_scouting("averages"), f"WITH {RECENT} SELECT count(*) AS games, coalesce(avg(gf), 0) AS goals_for, coalesce(avg(ga), 0) AS goals_against FROM last"),
    "a23_scorers": (_scouting("scorers"), f"WITH {GAMES}, {PEOPLE} SELECT player_id, name AS player_name, CAST(sum(l_quantity) AS BIGINT) AS goals, CAST(sum(l_linenumber) AS BIGINT) AS assists FROM lineitem JOIN p ON player_id = l_partkey JOIN g ON game_id = l_orderkey WHERE team_id = {OPPONENT} AND season = {SEASON} AND NOT postponed GROUP BY 1, 2 ORDER BY sum(l_quantity) + sum(l_linenumber) DESC, sum(l_quantity) DESC, lower(name), player_id LIMIT 3"),
    "a23_head_to_head": (_scouting("head_to_head"), f"WITH {GAMES} SELECT game_id, game_date, gf, ga, CASE WHEN gf > ga THEN 'W' ELSE 'L' END AS result FROM sides WHERE team_id = {TEAM} AND other = {OPPONENT} AND NOT postponed"),
    "d26_quality_suite": (lambda s, d: desk.quality_suite(_games(s, d), B.teams(s, d), _people(s, d), _aliases(s, d), _stats(s, d), YEAR, TODAY), CHECKS),
}

QUERIES = {name: q for name, (q, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
