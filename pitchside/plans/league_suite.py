"""League tables, radar axes, reviews and changes over the bindings, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pitchside.operators import league as L
from pitchside.operators import period_flow
from pitchside.operators import reconciliation as R
from pitchside.plans import bindings as B
from pitchside.plans.reports import SCORES, _periods
from pitchside.plans.suite import TOTALS, WITH_GAMES

TODAY, KEPT_FILES, IDS = date(1998, 5, 20), 25, [7, 3, 11, 999_999_999, 1]
PLAYED = f"{WITH_GAMES}, played AS (SELECT *, sign(gf - ga) AS o FROM sides WHERE gf > 0 OR ga > 0)"
AXES = ["win_pct", "goals_for", "defense", "margin", "goals_for_total", "sos"]


def _snapshot(spark, d):
    """Customers as contests seen earlier, with the nation as the home side's goals."""
    k = F.col("c_custkey").cast("long")
    return B.table(spark, d, "customer").select(k.alias("game_num"), (k % 3).alias("home"), (k % 5).alias("away"), (F.col("c_nationkey").cast("long") % 3).alias("home_score"), (k % 2).alias("away_score"))


def _live(spark, d):
    k = F.col("s_suppkey").cast("long")
    home = F.when(k % 7 == 0, 9).otherwise(k % 3).cast("long")
    return B.table(spark, d, "supplier").select((k + 5).alias("game_num"), ((home + 5) % 3).alias("home"), ((k + 5) % 5).alias("away"), (F.col("s_nationkey").cast("long") % 3).alias("home_score"), ((k + 5) % 2).alias("away_score"))


def _reviews(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("current"), F.col("l_quantity").cast("long").alias("summed"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey").cast("long") % 60).alias("offered"))


def _corrections(spark, d):
    field = F.when(F.col("l_returnflag") == "R", "goals").when(F.col("l_returnflag") == "A", "saves").otherwise("name")
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", field.alias("field"), F.col("l_linenumber").cast("long").alias("old"), F.col("l_quantity").cast("long").alias("new"))


def _orders(spark, d):
    """Orders as contests with an id: the customer's nation against the clerk's number."""
    o, c = B.table(spark, d, "orders"), B.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"), F.col("c_nationkey").cast("long").alias("home_id"), (F.col("o_custkey").cast("long") % 25).alias("away_id"))


def _upload(spark, d):
    """All parts again, every second with a changed size, and as many that do not exist."""
    p = B.table(spark, d, "part")
    changed = p.select(F.col("p_partkey").cast("long").alias("k"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("long").alias("size"))
    return changed.unionByName(changed.select((-F.col("k") - 1).alias("k"), "size"))


def _parts(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("size"))


ORDERS = "WITH g AS (SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, CAST(c_nationkey AS BIGINT) AS home_id, CAST(o_custkey % 25 AS BIGINT) AS away_id FROM orders JOIN customer ON o_custkey = c_custkey)"
UPLOAD = """WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT) AS size FROM part),
b AS (SELECT * FROM c UNION ALL SELECT -k - 1, size FROM c), t AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS size FROM part)"""


def _plan(spark, d):
    return R.preview(_parts(spark, d), _upload(spark, d), ["k"], [F.col("size")])


def _aliases(spark, d):
    """Each supplier's name as an alias of its nation; the keys have a state in brackets."""
    return B.table(spark, d, "supplier").select(F.concat("s_name", F.lit(" (PA)")).alias("alias"), F.col("s_nationkey").cast("long").alias("team_id"))


def _raw_names(spark, d):
    n = B.table(spark, d, "nation").select(F.concat(F.initcap("n_name"), F.lit(" High School")).alias("raw"))
    return n.unionByName(B.table(spark, d, "customer").select(F.regexp_replace("c_name", "Customer", "Supplier").alias("raw")))


SUITE = {
    "a31_standings": (
        lambda s, d: L.standings(B.games(s, d)),
        f"{PLAYED} SELECT team_id, count(*) AS games, count(*) FILTER (o = 1) AS wins, count(*) FILTER (o = -1) AS losses, count(*) FILTER (o = 0) AS ties, CAST(sum(gf) AS BIGINT) AS pf, CAST(sum(ga) AS BIGINT) AS pa FROM played GROUP BY team_id",
    ),
    "w04_streak_texts": (
        lambda s, d: L.streak_texts(B.games(s, d), B.teams(s, d)),
        f"""{PLAYED}, r AS (SELECT team_id, o, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, o DESC) AS n FROM played), f AS (SELECT *, first_value(o) OVER (PARTITION BY team_id ORDER BY n) AS first FROM r),
        x AS (SELECT team_id, CASE first WHEN 1 THEN 'W' WHEN -1 THEN 'L' ELSE 'T' END || CAST(coalesce(min(n) FILTER (o <> first) - 1, max(n)) AS VARCHAR) AS streak FROM f GROUP BY team_id, first)
        SELECT team_id, coalesce(streak, 'W0') AS streak FROM teams LEFT JOIN x USING (team_id)""",
    ),
    "l06_podium": (
        lambda s, d: L.podium(B.games(s, d), B.teams(s, d)),
        f"{WITH_GAMES}, {TOTALS.format(where='WHERE NOT postponed')} SELECT team_id, name, wins, losses, wins::DOUBLE / (wins + losses) AS win_pct FROM totals JOIN teams USING (team_id) WHERE wins + losses > 0 ORDER BY wins DESC, win_pct DESC, name, team_id LIMIT 10",
    ),
    "w08_radar_axes": (
        lambda s, d: L.radar_axes(B.games(s, d)),
        f"""{WITH_GAMES}, {TOTALS.format(where='')}, b AS (SELECT *, wins + losses AS n, CASE WHEN wins + losses > 0 THEN wins::DOUBLE / (wins + losses) ELSE 0 END AS win_pct FROM totals),
        sched AS (SELECT s.team_id, avg(o.win_pct) AS sos FROM sides s JOIN b o ON s.opponent_id = o.team_id WHERE NOT postponed AND s.team_id <> s.opponent_id GROUP BY 1),
        wide AS (SELECT team_id, win_pct, CASE WHEN n > 0 THEN goals_for::DOUBLE / n ELSE 0 END AS goals_for, CASE WHEN n > 0 THEN goals_against::DOUBLE / n ELSE 0 END AS defense, CASE WHEN n > 0 THEN (goals_for - goals_against)::DOUBLE / n ELSE 0 END AS margin,
          goals_for::DOUBLE AS goals_for_total, coalesce(sos, 0.5) AS sos FROM b LEFT JOIN sched USING (team_id)),
        long AS ({' UNION ALL '.join(f"SELECT team_id, '{a}' AS axis, {a}::DOUBLE AS value, round({'-' if a == 'defense' else ''}{a}, 9) AS v FROM wide" for a in AXES)}),
        r AS (SELECT *, rank() OVER (PARTITION BY axis ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY axis, v) AS peers, count(*) OVER (PARTITION BY axis) AS n FROM long)
        SELECT team_id, axis, value, CASE WHEN n <= 1 THEN 0.5::DOUBLE ELSE (below + below + peers) / 2.0::DOUBLE / n END AS percentile FROM r""",
    ),
    "w15_closing_runs": (
        lambda s, d: L.closing_runs(period_flow.running_scores(_periods(s, d))),
        f"""{SCORES}, g AS (SELECT game_id, period, home - lag(home) OVER w AS home, away - lag(away) OVER w AS away, row_number() OVER (PARTITION BY game_id ORDER BY period DESC) AS rn FROM scores WINDOW w AS (PARTITION BY game_id ORDER BY period))
        SELECT game_id, period, home > 0 AS at_home, greatest(home, away) AS goals FROM g WHERE rn = 1 AND ((home >= 3 AND away = 0) OR (away >= 3 AND home = 0))""",
    ),
    "a33_suspect_scores": (
        lambda s, d: R.suspect_scores(B.player_stats(s, d), B.table(s, d, "orders").join(B.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("game_id"), F.col("c_nationkey").cast("long").alias("team_id"), (F.col("o_custkey").cast("long") % 6).alias("score"))),
        f"WITH {B.STATS_SQL} SELECT game_id, team_id, CAST(goals AS BIGINT) AS player_goals, CAST(player_id % 6 AS BIGINT) AS score FROM stats WHERE goals > player_id % 6",
    ),
    "d21_score_decisions": (
        lambda s, d: _reviews(s, d).select("l_orderkey", "l_linenumber", R.score_decision(F.col("current"), F.col("summed"), F.col("offered")).alias("decision")),
        """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'no_source' WHEN l_linenumber >= floor(l_quantity) THEN 'not_suspect' WHEN l_suppkey % 60 < floor(l_quantity) THEN 'below_sum' WHEN l_suppkey % 60 > floor(l_quantity) + 5 THEN 'above_ceiling' ELSE 'apply' END AS decision FROM lineitem""",
    ),
    "d22_correction_status": (
        lambda s, d: _corrections(s, d).select("l_orderkey", "l_linenumber", R.correction_status(F.col("field"), F.col("old"), F.col("new")).alias("status")),
        """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND (l_quantity > 15 OR floor(l_quantity) > 5 * l_linenumber) THEN 'outlier' WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'outlier' ELSE 'pending' END AS status FROM lineitem""",
    ),
    "d01_resolved_names": (
        lambda s, d: R.resolve_names(_raw_names(s, d), "raw", B.teams(s, d), _aliases(s, d)),
        """WITH raw AS (SELECT upper(n_name[1]) || lower(n_name[2:]) AS n, n_name AS key, n_nationkey AS id FROM nation)
        SELECT list_aggregate(list_transform(string_split(lower(key), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' High School' AS raw, CAST(id AS BIGINT) AS team_id FROM raw
        UNION ALL SELECT replace(c_name, 'Customer', 'Supplier'), CAST(s_nationkey AS BIGINT) FROM customer LEFT JOIN supplier ON replace(c_name, 'Customer', 'Supplier') = s_name""",
    ),
    "d27_stale_season": (
        lambda s, d: R.stale_season(B.games(s, d), TODAY),
        f"{WITH_GAMES} SELECT max(game_date) AS last_game, CAST(DATE '{TODAY}' - max(game_date) AS INTEGER) AS age, max(game_date) IS NULL OR DATE '{TODAY}' - max(game_date) > 7 AS stale FROM games WHERE season = {TODAY.year}",
    ),
    "j16_existing_games": (
        lambda s, d: R.existing_games(_orders(s, d).select("game_id", "game_date", F.col("away_id").alias("home_id"), F.col("home_id").alias("away_id")), _orders(s, d)).select("game_id", "found_id", "reversed"),
        f"""{ORDERS}, f AS (SELECT game_date, least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi, min(game_id) AS found_id, arg_min(home_id, game_id) AS found_home FROM g GROUP BY 1, 2, 3)
        SELECT game_id, found_id, found_home <> away_id AS reversed FROM g JOIN f ON g.game_date = f.game_date AND least(home_id, away_id) = lo AND greatest(home_id, away_id) = hi""",
    ),
    "j18_snapshot_diff": (
        lambda s, d: R.snapshot_diff(_snapshot(s, d), _live(s, d)),
        """WITH o AS (SELECT CAST(c_custkey AS BIGINT) AS game_num, c_custkey % 3 AS home, c_custkey % 5 AS away, CAST(c_nationkey % 3 AS BIGINT) AS hs, CAST(c_custkey % 2 AS BIGINT) AS aws FROM customer),
        n AS (SELECT CAST(s_suppkey AS BIGINT) + 5 AS game_num, ((CASE WHEN s_suppkey % 7 = 0 THEN 9 ELSE s_suppkey % 3 END) + 5) % 3 AS home, (s_suppkey + 5) % 5 AS away, CAST(s_nationkey % 3 AS BIGINT) AS hs, CAST((s_suppkey + 5) % 2 AS BIGINT) AS aws FROM supplier),
        x AS (SELECT coalesce(o.game_num, n.game_num) AS game_num, CASE WHEN o.game_num IS NULL THEN 'new_game' WHEN n.game_num IS NULL THEN 'removed' WHEN o.home <> n.home OR o.away <> n.away THEN 'teams_changed' WHEN o.hs + o.aws = 0 AND n.hs + n.aws > 0 THEN 'new_result'
          WHEN o.hs <> n.hs OR o.aws <> n.aws THEN 'score_changed' END AS change, o.hs AS old_home_score, o.aws AS old_away_score, n.hs AS new_home_score, n.aws AS new_away_score FROM o FULL JOIN n ON o.game_num = n.game_num)
        SELECT * FROM x WHERE change IS NOT NULL""",
    ),
    "l09_in_order_of": (
        lambda s, d: R.in_order_of(B.table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name"), "c_custkey", IDS).select("position", "c_custkey", "c_name"),
        f"SELECT CAST(list_position({IDS}, c_custkey) - 1 AS INTEGER) AS position, CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer WHERE c_custkey IN ({', '.join(map(str, IDS))})",
    ),
    "l11_latest_rows": (
        lambda s, d: R.latest_rows(B.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_orderkey"),
        "SELECT o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) USING (o_custkey, o_orderdate)",
    ),
    "m08_preview": (
        lambda s, d: _plan(s, d).select("k", "action", F.col("old.size").alias("old_size"), F.col("new.size").alias("new_size")),
        f"{UPLOAD} SELECT b.k, CASE WHEN t.k IS NULL THEN 'insert' WHEN t.size = b.size THEN 'same' ELSE 'update' END AS action, t.size AS old_size, b.size AS new_size FROM b LEFT JOIN t ON b.k = t.k",
    ),
    "m08_confirm": (lambda s, d: R.confirm(_parts(s, d), _plan(s, d), ["k"]), f"{UPLOAD} SELECT coalesce(b.k, t.k) AS k, coalesce(b.size, t.size) AS size FROM t FULL JOIN b ON b.k = t.k"),
    "m08_revert": (lambda s, d: R.revert(R.confirm(_parts(s, d), _plan(s, d), ["k"]), _plan(s, d), ["k"]), f"{UPLOAD} SELECT * FROM t"),
    "m09_latest_state": (
        lambda s, d: R.latest_state(B.table(s, d, "orders"), "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"]),
        "SELECT o_custkey, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderstatus, count(*) AS events FROM orders GROUP BY o_custkey",
    ),
    "s25_beyond_newest": (
        lambda s, d: R.beyond_newest(B.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modified")), KEPT_FILES).select("path"),
        f"SELECT path FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn FROM orders) WHERE rn > {KEPT_FILES}",
    ),
}

QUERIES = {name: fn for name, (fn, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
