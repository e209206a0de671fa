"""Staged matching and merges over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchside.operators import cascade, waterfall
from pitchside.plans import bindings as B

# ---- people of a sheet (D19): parts as roster, the same parts written in nine ways as sheet

FIRST = "CASE p_size % 8 WHEN 0 THEN 'Maria' WHEN 1 THEN 'Marla' WHEN 2 THEN 'Jon' WHEN 3 THEN 'John' WHEN 4 THEN 'Pierce' WHEN 5 THEN 'Peirce' WHEN 6 THEN 'Alan' ELSE 'Bobby' END"
LAST = "concat(replace(p_name, ' ', ''), translate(CAST(p_partkey % 7 AS {text}), '0123456', 'abcdefg'))"
WRITTEN = """CASE p_partkey % 10 WHEN 0 THEN concat(first, ' ', last) WHEN 1 THEN last WHEN 2 THEN concat(substr(last, 1, 2), substr(last, 4)) WHEN 3 THEN concat(substr(first, 1, 1), 'x ', last) WHEN 4 THEN concat(substr(first, 2), ' ', substr(last, 2))
 WHEN 5 THEN concat('Q', substr(first, 2), ' ', substr(last, 3), 'q') WHEN 6 THEN concat('Zed ', last, 'qqqq') WHEN 7 THEN ' - ' WHEN 8 THEN concat(substr(last, 1, 1), substr(last, 4)) ELSE concat('Newcomer', translate(CAST(p_size AS {text}), '0123456789', 'abcdefghij')) END"""


def _roster(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("stat_rows"))
    p = B.table(spark, d, "part").selectExpr("*", f"{FIRST} AS first", f"{LAST.format(text='STRING')} AS last").join(rows, "p_partkey", "left")
    return p.selectExpr("CAST(p_partkey AS BIGINT) AS player_id", "CAST(substr(p_brand, 7) AS BIGINT) AS team_id", "concat(first, ' ', last) AS name", "coalesce(stat_rows, 0) AS stat_rows", f"{WRITTEN.format(text='STRING')} AS written")


ROSTER = f"""p AS (SELECT *, {FIRST} AS first, {LAST.format(text='VARCHAR')} AS last FROM part), c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey AS player_id, CAST(substr(p_brand, 7) AS BIGINT) AS team_id, lower(first || ' ' || last) AS full_key, lower(last) AS last, lower(first[1]) AS initial, coalesce(n, 0) AS n, {WRITTEN.format(text='VARCHAR')} AS written FROM p LEFT JOIN c ON l_partkey = p_partkey),
k AS (SELECT DISTINCT team_id, written AS name, trim(lower(written), ' -') AS key FROM r)"""

PEOPLE_SQL = f"""WITH {ROSTER}, e AS (SELECT team_id, key, min(player_id) AS player_id FROM (SELECT DISTINCT team_id, key FROM k) JOIN r USING (team_id) WHERE full_key = key GROUP BY 1, 2 HAVING count(*) = 1),
rest AS (SELECT DISTINCT team_id, key FROM k WHERE key <> '' AND (team_id, key) NOT IN (SELECT team_id, key FROM e)), top AS (SELECT *, len(ids) > 0 AS met, len(ids) = 1 OR ns[1] > ns[2] AS sure FROM (
  SELECT team_id, key, contains(key, ' ') AS many, min(levenshtein(key, last)) AS near_last, min(levenshtein(key, full_key)) AS near_full, count(*) FILTER (levenshtein(key, full_key) <= 2) AS two, arg_min(player_id, (levenshtein(key, full_key), player_id)) AS best, count(*) FILTER (levenshtein(key, full_key) = 0) AS d0, count(*) FILTER (levenshtein(key, full_key) = 1) AS d1, count(*) FILTER (levenshtein(key, full_key) = 2) AS d2,
  coalesce(list(player_id ORDER BY n DESC, player_id) FILTER (hit), []) AS ids, coalesce(list(n ORDER BY n DESC, player_id) FILTER (hit), []) AS ns
  FROM (SELECT rest.*, r.*, CASE WHEN contains(key, ' ') THEN string_split(key, ' ')[-1] = last AND key[1] = initial ELSE levenshtein(key, last) <= 1 END AS hit FROM rest JOIN r USING (team_id)) GROUP BY 1, 2)),
v AS (SELECT team_id, key, CASE WHEN met THEN CASE WHEN sure THEN 'alias' ELSE 'skipped' END WHEN many THEN CASE WHEN two = 1 THEN 'alias' WHEN near_full <= 3 THEN 'skipped' ELSE 'created' END WHEN near_last <= 2 THEN 'skipped' ELSE 'created' END AS kind,
  CASE WHEN met AND sure THEN ids[1] WHEN NOT met AND many AND two = 1 THEN best END AS player_id, CASE WHEN met AND sure THEN CASE WHEN many THEN 0.94 ELSE 0.91 END WHEN NOT met AND many AND two = 1 THEN 0.9 END AS confidence,
  CASE WHEN met THEN CASE WHEN NOT sure THEN CASE WHEN many THEN 'several of this last name and initial' ELSE 'several last names' END END WHEN many THEN CASE WHEN two = 1 THEN NULL WHEN two > 1 AND (CASE near_full WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END) > 1 THEN 'several equally near' WHEN near_full <= 3 THEN 'close but not unique' END WHEN near_last <= 2 THEN 'close to a last name' END AS reason FROM top)
SELECT team_id, name, key, CASE WHEN key = '' THEN 'skipped' WHEN e.player_id IS NOT NULL THEN 'existing' ELSE v.kind END AS kind, CAST(coalesce(e.player_id, v.player_id) AS BIGINT) AS player_id, CAST(v.confidence AS DOUBLE) AS confidence, CASE WHEN key = '' THEN 'empty' ELSE v.reason END AS reason
FROM k LEFT JOIN e USING (team_id, key) LEFT JOIN v USING (team_id, key)"""

# ---- logos (D18): six kinds of parts, each with teams and schools of its own

TEAM_FORMS = {
    0: [("Oak{w}", "oak{w}")],
    1: [("Elm{w} High School", "elm{w}-hs")],
    2: [("Fir{w} Prep", "fir{w}-prep"), ("Fir{w} Academy", "fir{w}-academy")],
    3: [("Ash{w} (PA)", "ash{w}"), ("Ash{w} HS", "ash{w}-2")],
    4: [("WC Yew{w} High", "wc-yew{w}-high"), ("West Chester Yew{w} Prep", "west-chester-yew{w}-prep")],
    5: [("Lone{w}", "lone{w}")],
}
SCHOOL_FORMS = {0: ["Oak{w}", "OAK{w} Area"], 1: ["Elm{w} Area"], 2: ["Fir{w} College"], 3: ["Ash{w}"], 4: ["WC Yew{w} Area", "West Chester Yew{w} Township"], 5: ["Other{w} &amp; Co"]}


def _cases(forms: dict[int, list], part: int | None) -> str:
    """The forms of each kind as an array of strings, with {w} the part's word."""
    text = lambda f: f if part is None else f[part]
    one = lambda f: "concat('" + text(f).replace("{w}", "', w, '") + "')"
    return "CASE kind " + " ".join(f"WHEN {k} THEN array({', '.join(map(one, f))})" for k, f in forms.items()) + " END"


def _words(spark, d):
    return B.table(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS k", "p_partkey % 6 AS kind", "p_size", "translate(CAST(p_partkey AS STRING), '0123456789', 'bdgkmpqvxz') AS w")


def _logos(spark, d):
    p = _words(spark, d)
    teams = p.selectExpr("k", f"posexplode(arrays_zip({_cases(TEAM_FORMS, 0)} , {_cases(TEAM_FORMS, 1)})) AS (i, t)").selectExpr("k * 2 + i AS team_id", "t.`0` AS name", "t.`1` AS slug")
    schools = p.selectExpr("k", f"posexplode({_cases(SCHOOL_FORMS, None)}) AS (i, name)").selectExpr("concat('s', k, '-', i) AS school", "name", "concat(k, '.gif') AS logo", "k * 2 + i AS nth")
    return waterfall.match_logos(teams, schools, p.filter("kind = 5 AND p_size <= 25").selectExpr("concat('LONE', w) AS name", "concat('s', k, '-0') AS school"))


LOGOS_SQL = """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_partkey % 6 AS kind, p_size FROM part), x AS (
SELECT k, 0 AS t, 0 AS s, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS round FROM p WHERE kind < 5 OR p_size <= 25 UNION ALL SELECT k, 1, CASE kind WHEN 4 THEN 1 ELSE 0 END, CASE kind WHEN 4 THEN 2 ELSE 3 END FROM p WHERE kind IN (2, 3, 4))
SELECT k * 2 + t AS team_id, 's' || k || '-' || s AS school, k || '.gif' AS logo, CAST(round AS INTEGER) AS round FROM x"""

# ---- merges (D6, D8)


def _league(spark, d):
    t = lambda name, *columns: B.table(spark, d, name).selectExpr(*columns)
    return cascade.League(
        t("customer", "CAST(c_custkey AS BIGINT) AS team_id"),
        t("part", "CAST(p_partkey AS BIGINT) AS player_id", "CAST(p_size AS BIGINT) AS team_id", "p_name AS name_key"),
        t("orders", "CAST(o_orderkey AS BIGINT) AS game_id", "to_date(date_trunc('month', o_orderdate)) AS game_date", "CAST(o_custkey % 51 AS BIGINT) AS home_id", "CAST(o_orderkey % 51 AS BIGINT) AS away_id"),
        t("lineitem", "CAST(l_orderkey AS BIGINT) AS game_id", "CAST(l_suppkey % 51 AS BIGINT) AS team_id", "l_linenumber AS period", "l_quantity AS goals").groupBy("game_id", "team_id", "period").agg(F.min("goals").alias("goals")),
        t("lineitem", "CAST(l_orderkey AS BIGINT) AS game_id", "CAST(l_partkey AS BIGINT) AS player_id").distinct(),
        t("events", "to_date(ts) AS week", "event_type AS source", "CAST(user_id % 51 AS BIGINT) AS team_id").distinct(),
        t("supplier", "concat('a', s_nationkey) AS alias", "CAST(s_suppkey % 51 AS BIGINT) AS team_id").distinct(),
    )


def _team_merges(spark, d):
    """Customers of two segments go into the one with half their number, and so on in chains."""
    return B.table(spark, d, "customer").filter("c_custkey > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')").selectExpr("CAST(c_custkey AS BIGINT) AS old", "CAST(floor(c_custkey / 2) AS BIGINT) AS new")


def _merged(table):
    return lambda s, d: getattr(cascade.merge_teams(_league(s, d), _team_merges(s, d))[0], table)


CHAINS = """m AS (SELECT c_custkey AS old, c_custkey // 2 AS new FROM customer WHERE c_custkey > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')), ch AS (SELECT old, new FROM m UNION SELECT ch.old, m.new FROM ch JOIN m ON ch.new = m.old),
ends AS (SELECT CAST(old AS BIGINT) AS old, CAST(new AS BIGINT) AS new FROM ch WHERE new NOT IN (SELECT old FROM m))"""
MERGED = f"""WITH RECURSIVE {CHAINS}, p0 AS (SELECT CAST(p_partkey AS BIGINT) AS player_id, CAST(coalesce(new, p_size) AS BIGINT) AS team_id, p_name AS name_key, new IS NOT NULL AS moved FROM part LEFT JOIN ends ON old = p_size),
p1 AS (SELECT *, min(moved) OVER w AS all_moved, first_value(player_id) OVER (PARTITION BY team_id, name_key ORDER BY moved, player_id) AS stays FROM p0 WINDOW w AS (PARTITION BY team_id, name_key)), p2 AS (SELECT *, NOT moved OR (all_moved AND player_id = stays) AS kept FROM p1),
g0 AS (SELECT CAST(o_orderkey AS BIGINT) AS game_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS game_date, CAST(coalesce(h.new, o_custkey % 51) AS BIGINT) AS home_id, CAST(coalesce(a.new, o_orderkey % 51) AS BIGINT) AS away_id, h.new IS NOT NULL OR a.new IS NOT NULL AS moved FROM orders LEFT JOIN ends h ON h.old = o_custkey % 51 LEFT JOIN ends a ON a.old = o_orderkey % 51),
g1 AS (SELECT *, min(moved) OVER (PARTITION BY game_date, home_id, away_id) AS all_moved, row_number() OVER (PARTITION BY game_date, home_id, away_id ORDER BY moved, game_id) AS rn FROM g0), g2 AS (SELECT *, NOT moved OR (all_moved AND rn = 1) AS kept FROM g1),
s0 AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS game_id, CAST(l_partkey AS BIGINT) AS was FROM lineitem WHERE l_orderkey NOT IN (SELECT game_id FROM g2 WHERE NOT kept)),
s1 AS (SELECT game_id, was, coalesce(stays, was) AS player_id, stays IS NOT NULL AS moved FROM s0 LEFT JOIN (SELECT player_id, stays FROM p2 WHERE NOT kept) x ON was = x.player_id), s2 AS (SELECT *, min(moved) OVER (PARTITION BY game_id, player_id) AS all_moved, row_number() OVER (PARTITION BY game_id, player_id ORDER BY moved, was) AS rn FROM s1),
t0 AS (SELECT CAST(l_orderkey AS BIGINT) AS game_id, CAST(l_suppkey % 51 AS BIGINT) AS was, l_linenumber AS period, min(l_quantity) AS goals FROM lineitem GROUP BY ALL HAVING l_orderkey NOT IN (SELECT game_id FROM g2 WHERE NOT kept)),
t1 AS (SELECT t0.*, CAST(coalesce(new, was) AS BIGINT) AS team_id, new IS NOT NULL AS moved FROM t0 LEFT JOIN ends ON old = was), t2 AS (SELECT *, min(moved) OVER (PARTITION BY game_id, team_id, period) AS all_moved, row_number() OVER (PARTITION BY game_id, team_id, period ORDER BY moved, was) AS rn FROM t1),
r1 AS (SELECT DISTINCT CAST(ts AS DATE) AS week, event_type AS source, CAST(coalesce(new, user_id % 51) AS BIGINT) AS team_id FROM events LEFT JOIN ends ON old = user_id % 51), a1 AS (SELECT DISTINCT 'a' || s_nationkey AS alias, CAST(coalesce(new, s_suppkey % 51) AS BIGINT) AS team_id FROM supplier LEFT JOIN ends ON old = s_suppkey % 51)"""
REPORT = f"""{MERGED} SELECT 'people' AS "table", (SELECT count(*) FROM part) - (SELECT count(*) FROM p2 WHERE kept) AS gone UNION ALL SELECT 'teams', (SELECT count(*) FROM ends) UNION ALL SELECT 'games', (SELECT count(*) FROM g2 WHERE NOT kept)
UNION ALL SELECT 'periods', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey % 51, l_linenumber FROM lineitem)) - (SELECT count(*) FROM t2 WHERE NOT moved OR (all_moved AND rn = 1))
UNION ALL SELECT 'stats', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) - (SELECT count(*) FROM s2 WHERE NOT moved OR (all_moved AND rn = 1))
UNION ALL SELECT 'rankings', (SELECT count(*) FROM (SELECT DISTINCT CAST(ts AS DATE), event_type, user_id % 51 FROM events)) - (SELECT count(*) FROM r1) UNION ALL SELECT 'aliases', (SELECT count(*) FROM (SELECT DISTINCT s_nationkey, s_suppkey % 51 FROM supplier)) - (SELECT count(*) FROM a1)"""


def _merged_people(spark, d):
    people = B.table(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS player_id", "p_name AS name")
    stats = B.table(spark, d, "lineitem").selectExpr("CAST(l_orderkey AS BIGINT) AS game_id", "CAST(l_partkey AS BIGINT) AS player_id").distinct()
    aliases = B.table(spark, d, "supplier").selectExpr("concat('a', s_nationkey) AS alias", "CAST(s_suppkey AS BIGINT) AS player_id", "'seed' AS source", "0.5 AS confidence").withColumn("confidence", F.col("confidence").cast("double"))
    pairs = B.table(spark, d, "part").filter("p_type = 'PROMO'").selectExpr("CAST(p_partkey AS BIGINT) AS left_id", "explode(array(CAST(floor(p_partkey / 3) AS BIGINT), CAST(p_partkey + 1 AS BIGINT))) AS right_id")
    return cascade.merge_people(people, stats, aliases, cascade.keep_rule(pairs, stats))


PAIRS = """n AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), pairs AS (SELECT p_partkey AS l, unnest([p_partkey // 3, p_partkey + 1]) AS r FROM part WHERE p_type = 'PROMO'),
sized AS (SELECT l, r, coalesce(a.n, 0) AS ln, coalesce(b.n, 0) AS rn FROM pairs LEFT JOIN n a ON a.id = l LEFT JOIN n b ON b.id = r WHERE l <> r), sides AS (SELECT CASE WHEN ln > rn OR (ln = rn AND l < r) THEN r ELSE l END AS old, CASE WHEN ln > rn OR (ln = rn AND l < r) THEN l ELSE r END AS new, greatest(ln, rn) AS kn FROM sized),
m AS (SELECT old, arg_max(new, (kn, -new)) AS new FROM sides GROUP BY old HAVING old IN (SELECT p_partkey FROM part) AND arg_max(new, (kn, -new)) IN (SELECT p_partkey FROM part)), ch AS (SELECT old, new FROM m UNION SELECT ch.old, m.new FROM ch JOIN m ON ch.new = m.old), ends AS (SELECT CAST(old AS BIGINT) AS old, CAST(new AS BIGINT) AS new FROM ch WHERE new NOT IN (SELECT old FROM m))"""

SUITE = {
    "d19_workbook_people": (lambda s, d: waterfall.resolve_people(_roster(s, d).select("team_id", F.col("written").alias("name")), _roster(s, d)), PEOPLE_SQL),
    "d18_logos": (lambda s, d: _logos(s, d)[0], LOGOS_SQL),
    "d18_schools_without_team": (lambda s, d: _logos(s, d)[1], "SELECT 's' || p_partkey || '-' || i AS school FROM part, range(2) t(i) WHERE p_partkey % 6 = 5 AND i = 0 AND p_size > 25"),
    "d08_merge_chains": (lambda s, d: cascade.chains(_team_merges(s, d)), f"WITH RECURSIVE {CHAINS} SELECT old, new FROM ends"),
    "d08_merged_people": (_merged("people"), f"{MERGED} SELECT player_id, team_id, name_key FROM p2 WHERE kept"),
    "d08_merged_games": (_merged("games"), f"{MERGED} SELECT game_id, game_date, home_id, away_id FROM g2 WHERE kept"),
    "d08_merged_stats": (_merged("stats"), f"{MERGED} SELECT game_id, player_id FROM s2 WHERE NOT moved OR (all_moved AND rn = 1)"),
    "d08_merged_periods": (_merged("periods"), f"{MERGED} SELECT game_id, team_id, period, goals FROM t2 WHERE NOT moved OR (all_moved AND rn = 1)"),
    "d08_merge_report": (lambda s, d: cascade.merge_teams(_league(s, d), _team_merges(s, d))[1], REPORT),
    "d06_merged_stats": (
        lambda s, d: _merged_people(s, d).stats,
        f"WITH RECURSIVE {PAIRS} SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS game_id, CAST(coalesce(new, l_partkey) AS BIGINT) AS player_id FROM lineitem LEFT JOIN ends ON old = l_partkey",
    ),
    "d06_merged_aliases": (
        lambda s, d: _merged_people(s, d).aliases,
        f"""WITH RECURSIVE {PAIRS}, a AS (SELECT DISTINCT 'a' || s_nationkey AS alias, CAST(coalesce(new, s_suppkey) AS BIGINT) AS player_id FROM supplier LEFT JOIN ends ON old = s_suppkey)
        SELECT alias, player_id, 'seed' AS source, 0.5::DOUBLE AS confidence FROM a UNION ALL SELECT DISTINCT p_name, new, 'dedup', 1.0::DOUBLE FROM part JOIN ends ON old = p_partkey WHERE (p_name, new) NOT IN (SELECT alias, player_id FROM a)""",
    ),
}

QUERIES = {name: q for name, (q, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
