"""Names, lines and posts composed from the driver's tables; the SQL knows the answers from the parts they were composed of."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchside.functions import names as N
from pitchside.functions import parsers, posts, tables
from pitchside.functions import text as T
from pitchside.operators.core import spread
from pitchside.plans import bindings as B

#: The parts of a line, in both languages: two names, two scores, and which of eight forms the line has.
PART = {"k": "CAST(p_partkey AS BIGINT)", "v": "CAST(p_partkey % 8 AS INT)", "a": "concat('Old ', p_type)", "b": "concat('New ', p_type, 'shire')", "n": "CAST(p_size AS INT)", "m": "CAST(p_partkey % 20 AS INT)"}
PARTS = f"SELECT {', '.join(f'{e} AS {c}' for c, e in PART.items())}, p_name, p_type, p_brand FROM part"


def _parts(spark, d):
    return spread(B.table(spark, d, "part").selectExpr(*[f"{e} AS {c}" for c, e in PART.items()], "p_name", "p_type", "p_brand"), "k")


def _lines(spark, d, *forms: str):
    """Form v of each part: SQL expressions over the parts."""
    cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    return _parts(spark, d).withColumn("line", F.expr(f"CASE v % {len(forms)} {cases} END"))


def _parsed(*forms: str, parser, columns):
    return lambda s, d: _lines(s, d, *forms).withColumn("x", parser(F.col("line"))).selectExpr("k", *columns)


def _over(column, **columns):
    """k and expressions of a text over the parts."""
    return lambda s, d: _parts(s, d).withColumn("t", F.expr(column)).select("k", *[f(F.col("t")).alias(c) for c, f in columns.items()])


SCORES = ["concat(a, ' ', n, ', ', b, ' ', m)", "concat(a, ' ', n, ', ', b, ' ', m, ' (2OT)')", "concat(a, ' ', n, ', ', b, ' ', m, ', OT')", "concat(a, ' ', n, ', ', b, ' ', m, ' 3OT.')", "concat(a, ' ', n, ', ', b, ' ', m, ', ppd')", "concat(a, ' ', n, ' ', b, ' ', m)", "concat(a, ': ', n, ', ', m, ', 3 - ', n)", "concat(a, ' (NJ) ', n, ' ', b, ' ', m, ' (Senior Day)')"]
STATS = ["concat('Jo ', p_type, ' ', n, 'G, 2A')", "concat('Kropp: ', m, ' saves')", "concat('T.J. Bell FO ', m, '/', m + 3, ', 3 GBs')", "concat('Coach said ', p_name)", "concat(p_type, ' Roe (', m, ' goals) (200 career points)')"]
POST = "concat('<p>April 3</p><p>Girls</p><p>', a, ' 1, ', b, ' 2</p><h3>Boys</h3><p>', a, ' ', n, ', ', b, ' ', m, '<br>', a, ' at ', b, '</p><p>', a, ' 0, ', b, ' 0, ppd</p>')"
SUMMARY = "concat('<p>', a, ' ', n, ', ', b, ' ', m, '</p><p>', a, ' 1 2 3 4 - 10</p><p>', b, ' goals: 3 Al Bee, Cy Dee</p><p>', b, ' Scoring:</p><p>Eve Fox and Gil Hay 2G</p>')"


def _posts(spark, d, html):
    return posts.post_lines(_parts(spark, d).withColumn("html", F.expr(html)), "k", "html")


SUITE = {
    "x01_score_lines": (
        _parsed(*SCORES, parser=parsers.score_line, columns=["x.*"]),
        f"""WITH p AS ({PARTS}) SELECT k, CASE WHEN v <> 6 THEN a END AS team_a, CASE WHEN v <> 6 THEN n END AS score_a, CASE WHEN v <> 6 THEN b END AS team_b, CASE WHEN v <> 6 THEN m END AS score_b,
        CASE v WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 6 THEN NULL ELSE 0 END AS ot_periods, v = 4 AS postponed, CASE WHEN v = 6 THEN 'no score pattern' END AS reason FROM p""",
    ),
    "x02_period_lines": (
        _parsed("concat(a, ' 1 2 ', m, ' 4 - ', m + 7)", "concat('OE: ', n, ', ', m, ' = ', n)", parser=lambda c: parsers.quarter_line(c), columns=["x.team_hint", "array_join(transform(x.periods, i -> string(i)), '+') AS periods", "x.total", "x.validates", "x.warning"]),
        f"""WITH p AS ({PARTS}) SELECT k, CASE WHEN v % 2 = 0 THEN a ELSE 'OE' END AS team_hint, CASE WHEN v % 2 = 0 THEN '1+2+' || m || '+4' ELSE n || '+' || m END AS periods, CASE WHEN v % 2 = 0 THEN m + 7 ELSE n END AS total,
        v % 2 = 0 OR m = 0 AS validates, CASE WHEN v % 2 = 0 THEN NULL WHEN m = 0 THEN 'fewer than four periods' ELSE 'sum mismatch' END AS warning FROM p""",
    ),
    "x03_stat_lines": (
        _parsed(*STATS, parser=parsers.stat_line, columns=["x.name", "x.goals", "x.assists", "x.ground_balls", "x.saves", "x.fo_won", "x.fo_taken", "x.confidence", "array_join(x.capped, ',') AS capped", "x.reason"]),
        f"""WITH p AS (SELECT *, v % 5 AS f FROM ({PARTS})), x AS (SELECT *, CASE WHEN f = 3 OR (f = 4 AND m > 15) THEN 1 END AS bad FROM p)
        SELECT k, CASE WHEN bad IS NULL THEN CASE f WHEN 0 THEN 'Jo ' || p_type WHEN 1 THEN 'Kropp' WHEN 2 THEN 'T.J. Bell' ELSE p_type || ' Roe' END END AS name,
        CASE WHEN bad IS NULL THEN CASE WHEN f = 0 AND n <= 15 THEN n WHEN f = 4 THEN m ELSE 0 END END AS goals, CASE WHEN bad IS NULL THEN CASE WHEN f = 0 THEN 2 ELSE 0 END END AS assists, CASE WHEN bad IS NULL THEN CASE WHEN f = 2 THEN 3 ELSE 0 END END AS ground_balls,
        CASE WHEN bad IS NULL THEN CASE WHEN f = 1 THEN m ELSE 0 END END AS saves, CASE WHEN bad IS NULL THEN CASE WHEN f = 2 THEN m ELSE 0 END END AS fo_won, CASE WHEN bad IS NULL THEN CASE WHEN f = 2 THEN m + 3 ELSE 0 END END AS fo_taken,
        CASE WHEN bad IS NULL THEN CASE WHEN f = 1 THEN 0.6 ELSE 0.9 END END AS confidence, CASE WHEN (f = 0 AND n > 15) OR (f = 4 AND m > 15) THEN 'goals' ELSE '' END AS capped, CASE WHEN f = 3 THEN 'no stat' WHEN bad = 1 THEN 'over cap' END AS reason FROM x""",
    ),
    "x05_lists": (
        lambda s, d: _lines(s, d, "concat(p_type, ' goals: ', m, ' Al Bee, Cy Dee 2, Eff')", "concat(p_type, ' played')").select("k", F.inline(parsers.aggregated_list(F.col("line")))),
        f"""WITH p AS ({PARTS}) SELECT k, p_type AS team, 'goals' AS stat, unnest(['Al Bee', 'Cy Dee', 'Eff']) AS name, unnest([m, 2, 1]) AS count, NULL AS reason FROM p WHERE v % 2 = 0
        UNION ALL SELECT k, NULL, NULL, NULL, NULL, 'no list header' FROM p WHERE v % 2 = 1""",
    ),
    "x06_rankings": (
        _parsed("concat(m, '. ', a, ' 12-2')", "concat(m, ') ', a, ' (last week: 4)')", "concat(m, ' ', a, ' (ny) (3)')", "concat(100 + m, ' ', a)", parser=parsers.ranking_line, columns=["x.*"]),
        f"""WITH p AS (SELECT *, CASE WHEN v % 4 = 3 THEN 100 + m ELSE m END AS r FROM ({PARTS})) SELECT k, CASE WHEN r BETWEEN 1 AND 100 THEN r END AS rank, CASE WHEN r BETWEEN 1 AND 100 THEN a || CASE WHEN v % 4 = 2 THEN ' (NY)' ELSE '' END END AS team,
        CASE WHEN r NOT BETWEEN 1 AND 100 THEN 'no rank' END AS reason FROM p""",
    ),
    "x07_scoreboard_posts": (
        lambda s, d: posts.scoreboard(_posts(s, d, POST)),
        f"WITH p AS ({PARTS}) SELECT k AS post, 4 AS pos, 'April 3' AS date_label, 'Boys' AS section, a AS team_a, n AS score_a, b AS team_b, m AS score_b, 0 AS ot_periods, NULL AS reason FROM p",
    ),
    "x08_summary_posts": (
        lambda s, d: posts.summaries(_posts(s, d, SUMMARY)).select("post", "block", "pos", "kind", "team_a", "score_b", "hint", "name", "stat", "count", "confidence"),
        f"""WITH p AS ({PARTS}), r(pos, kind, hint, name, stat, count, confidence) AS (VALUES (0, 'score', NULL, NULL, NULL, NULL, NULL), (1, 'periods', 'A', NULL, '1 2 3 4', 10, NULL), (2, 'list', 'B', 'Al Bee', 'goals', 3, 0.7), (2, 'list', 'B', 'Cy Dee', 'goals', 1, 0.7),
        (4, 'stat', 'S', 'Eve Fox', 'goals', 2, 0.5), (4, 'stat', 'S', 'Gil Hay', 'goals', 2, 0.5))
        SELECT k AS post, 1 AS block, pos, kind, a AS team_a, m AS score_b, CASE hint WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'S' THEN b || ' Scoring:' END AS hint, name, stat, count, confidence FROM p, r""",
    ),
    "x09_categories": (
        lambda s, d: _parts(s, d).select("k", posts.category(F.expr("CASE v % 4 WHEN 0 THEN concat('monday-boys-', k) WHEN 1 THEN concat('girls-rankings-', k) WHEN 2 THEN concat('pa-state-rankings-', k) ELSE 'news' END"), F.expr("CASE WHEN n > 25 THEN '<a rel=\"category tag\">Scoreboard</a>' ELSE '' END")).alias("category")),
        f"""WITH p AS ({PARTS}) SELECT k, CASE WHEN v % 4 = 0 THEN 'hs-summaries' WHEN v % 4 = 1 AND n > 25 THEN 'rankings philly' WHEN v % 4 = 2 THEN 'rankings pa-state' WHEN v % 4 = 3 AND n > 25 THEN 'scoreboard' END AS category FROM p""",
    ),
    "x11_anomaly_tokens": (
        _over("CASE v % 3 WHEN 0 THEN concat('x [unresolved sub-header: \"', a, '\"]') WHEN 1 THEN concat('TEAMHINT=\"', b, '\"') ELSE p_name END", token=N.anomaly_token),
        f"WITH p AS ({PARTS}) SELECT k, CASE v % 3 WHEN 0 THEN a WHEN 1 THEN b END AS token FROM p",
    ),
    "s09_text_lines": (
        lambda s, d: _posts(s, d, "concat('<style>p</style><nav>x</nav><p>', a, ' &amp;  ', b, '</p><ul><li>', n, '<li></ul>“q”')"),
        f"WITH p AS ({PARTS}) SELECT k AS post, unnest([0, 1, 2]) AS pos, unnest([a || ' & ' || b, n || '', '\"q\"']) AS line FROM p",
    ),
    "f02_prose_brackets": (
        _over("CASE v % 3 WHEN 0 THEN concat(a, ' 1G (Set School record ', n, ' Goals)') WHEN 1 THEN concat(a, ' (', n, 'G, 3A)') ELSE concat(a, ' (captain)') END", line=N.strip_prose),
        f"WITH p AS ({PARTS}) SELECT k, CASE v % 3 WHEN 0 THEN a || ' 1G' WHEN 1 THEN a || ' (' || n || 'G, 3A)' ELSE a END AS line FROM p",
    ),
    "f03_team_names": (
        _over("concat('  ', a, CASE v % 4 WHEN 0 THEN ' (district 2)' WHEN 1 THEN ' (nj) (4)' WHEN 2 THEN ' (PA)(NY)' ELSE '' END)", name=N.team_name),
        f"WITH p AS ({PARTS}) SELECT k, a || CASE v % 4 WHEN 1 THEN ' (NJ)' WHEN 2 THEN ' (NY)' ELSE '' END AS name FROM p",
    ),
    "f05_team_tokens": (
        _over("CASE v % 4 WHEN 0 THEN concat(a, ' Scoring Stats') WHEN 1 THEN concat(a, ' Goalies:') WHEN 2 THEN 'Ground balls:' ELSE concat(a, ':') END", token=N.team_token),
        f"WITH p AS ({PARTS}) SELECT k, CASE WHEN v % 4 = 2 THEN '' ELSE a END AS token FROM p",
    ),
    "f08_official_keys": (
        _over("concat('St. ', p_name, CASE v % 3 WHEN 0 THEN '''s (NY)' WHEN 1 THEN '-x (PA)' ELSE '' END)", key=N.official_key),
        f"WITH p AS ({PARTS}) SELECT k, 'st ' || lower(p_name) || CASE v % 3 WHEN 0 THEN 's (ny)' WHEN 1 THEN 'x' ELSE '' END AS key FROM p",
    ),
    "f09_titles": (
        _over("concat(p_type, '-PARK Of the ', 'HS st. X-RAY')", title=N.title_case),
        f"WITH p AS ({PARTS}) SELECT k, p_type[1] || lower(p_type[2:]) || '-Park of the HS St. X-Ray' AS title FROM p",
    ),
    "f10_player_keys": (
        _over("concat('J. Núñez-', p_type, CASE v % 4 WHEN 0 THEN ', goalie' WHEN 1 THEN ' Jr.' WHEN 2 THEN ' – III' ELSE '' END)", key=N.player_key),
        f"WITH p AS ({PARTS}) SELECT k, 'j nunez-' || lower(p_type) AS key FROM p",
    ),
    "f11_fuzzy_keys": (
        _over("concat('#', n, ' José ', p_type, '-Roe (Sr.) goalie')", key=N.fuzzy_key),
        f"WITH p AS ({PARTS}) SELECT k, 'jose ' || lower(p_type) || ' roe' AS key FROM p",
    ),
    "f13_distances": (
        lambda s, d: _parts(s, d).select("k", N.osa_distance(F.col("p_name"), F.expr("CASE v % 4 WHEN 0 THEN concat(substr(p_name, 2, 1), left(p_name, 1), substr(p_name, 3)) WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN concat(p_name, 'xy') ELSE p_name END")).alias("steps")),
        f"WITH p AS ({PARTS}) SELECT k, CAST(CASE v % 4 WHEN 0 THEN CASE WHEN p_name[1] = p_name[2] THEN 0 ELSE 1 END WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS steps FROM p",
    ),
    "f14_similarities": (
        lambda s, d: _parts(s, d).select("p_name").distinct().select("p_name", F.explode(F.array(*map(F.lit, ("small ring", "ring", "red bolt box")))).alias("y")).select("p_name", "y", F.round(N.best_similarity(N.similarity_key(F.col("p_name")), N.similarity_key(F.col("y"))), 9).alias("score")),
        """WITH n AS (SELECT DISTINCT p_name FROM part), y(y) AS (VALUES ('small ring'), ('ring'), ('red bolt box')), w AS (SELECT *, string_split(p_name, ' ') AS u, string_split(y, ' ') AS v FROM n, y)
        SELECT p_name, y, round(greatest(1 - levenshtein(p_name, y)::DOUBLE / greatest(length(p_name), length(y)), len(list_intersect(u, v))::DOUBLE / greatest(len(u), len(v)), CASE WHEN contains(p_name, y) OR contains(y, p_name) THEN least(length(p_name), length(y))::DOUBLE / greatest(length(p_name), length(y)) ELSE 0 END), 9) AS score FROM w""",
    ),
    "f15_bonus_similarities": (
        lambda s, d: _parts(s, d).select("p_name").distinct().select("p_name", F.explode(F.array(*map(F.lit, ("small ring", "ring", "red bolt box", "")))).alias("y")).select("p_name", "y", F.round(N.bonus_similarity(N.bonus_key(F.col("p_name")), N.bonus_key(F.col("y"))), 9).alias("score")),
        """WITH n AS (SELECT DISTINCT p_name FROM part), y(y) AS (VALUES ('small ring'), ('ring'), ('red bolt box'), (''))
        SELECT p_name, y, CASE WHEN y = '' THEN 0 ELSE round(least(1, 1 - levenshtein(p_name, y)::DOUBLE / greatest(length(p_name), length(y)) + CASE WHEN p_name = y THEN 0.25 WHEN contains(p_name, y) OR contains(y, p_name) THEN 0.15 ELSE 0.05 * least(3, len(list_intersect(string_split(p_name, ' '), string_split(y, ' ')))) END), 9) END AS score FROM n, y""",
    ),
    "f16_partial_matches": (
        lambda s, d: _parts(s, d).select("k", N.partial_match(F.expr("CASE v WHEN 0 THEN substring_index(p_name, ' ', 1) WHEN 1 THEN concat('wc ', p_name) WHEN 2 THEN concat(left(p_name, 1), left(substring_index(p_name, ' ', -1), 1)) WHEN 3 THEN concat(left(p_name, 1), substring_index(p_name, ' ', -1)) WHEN 4 THEN concat(p_name, 'x') WHEN 5 THEN 'qq' WHEN 6 THEN concat(substring_index(p_name, ' ', -1), ' ', substring_index(p_name, ' ', 1)) ELSE concat('x', substring_index(p_name, ' ', 1)) END"), F.col("p_name")).alias("same"), "v"),
        f"WITH p AS ({PARTS}) SELECT k, v < 5 AS same, v FROM p",  # 5 to 7: letters that aren't initials, words out of order, a letter in front
    ),
    "f17_hints": (
        lambda s, d: _parts(s, d).select("k", N.resolve_hint(F.expr("CASE v % 4 WHEN 0 THEN lower(a) WHEN 1 THEN concat('N', upper(left(p_type, 1))) WHEN 2 THEN left(b, 6) ELSE 'Zzz' END"), F.array("a", "b")).alias("team")),
        f"WITH p AS ({PARTS}) SELECT k, CASE v % 4 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN b ELSE 'Zzz' END AS team FROM p",
    ),
    "f20_label_dates": (
        _over("CASE v % 4 WHEN 0 THEN 'Today' WHEN 1 THEN 'yesterday' WHEN 2 THEN concat('April ', 1 + m) ELSE concat('May ', 1 + m, ', 2024.') END", day=lambda c: posts.label_date(c, F.lit("2026-03-01"))),
        f"WITH p AS ({PARTS}) SELECT k, CASE v % 4 WHEN 0 THEN '2026-03-01' WHEN 1 THEN '2026-02-28' WHEN 2 THEN CAST(DATE '2026-04-01' + m AS VARCHAR) ELSE CAST(DATE '2024-05-01' + m AS VARCHAR) END AS day FROM p",
    ),
    "f22_publish_dates": (
        _over("CASE v % 4 WHEN 0 THEN concat('<meta property=\"article:published_time\" content=\"2026-04-', lpad(CAST(1 + m AS STRING), 2, '0'), 'T1\">') WHEN 1 THEN concat('<time class=\"entry-time\">May ', 1 + m, ', 2025</time>') WHEN 2 THEN concat('Posted 6/', 1 + m, '/25') ELSE a END", day=posts.publish_date),
        f"WITH p AS ({PARTS}) SELECT k, CASE v % 4 WHEN 0 THEN CAST(DATE '2026-04-01' + m AS VARCHAR) WHEN 1 THEN CAST(DATE '2025-05-01' + m AS VARCHAR) WHEN 2 THEN CAST(DATE '2025-06-01' + m AS VARCHAR) END AS day FROM p",
    ),
    "f24_compact_dates": (
        lambda s, d: B.table(s, d, "orders").select("o_orderkey", posts.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), F.explode(posts.days_between(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), F.col("o_orderkey").cast("int") % 4 - 1))).alias("at")).withColumn("at", F.col("at").cast("string")),
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_orderdate AS DATE) + CAST(unnest(range(o_orderkey % 4)) AS INTEGER) AS VARCHAR) AS at FROM orders",
    ),
    "f26_face_off_cells": (
        lambda s, d: _parts(s, d).withColumn("c", posts.face_off_cell(F.expr("CASE v % 3 WHEN 0 THEN concat(' ', m, ' / ', n, ' ') WHEN 1 THEN CAST(m AS STRING) ELSE 'x' END"))).select("k", "c.*"),
        f"WITH p AS ({PARTS}) SELECT k, CASE WHEN v % 3 = 2 THEN 0 ELSE m END AS won, CASE WHEN v % 3 = 0 THEN n ELSE 0 END AS taken FROM p",
    ),
    "s17_header_aliases": (
        lambda s, d: tables.known_columns(B.table(s, d, "part").selectExpr("p_name AS `Player`", "p_size AS ` GB `", "p_brand AS other", "p_partkey AS `FO  Won`", "p_type AS name")),
        "SELECT p_name AS player_name, p_size AS ground_balls, p_partkey AS fo_won FROM part",
    ),
    "s19_pasted_players": (
        lambda s, d: _lines(s, d, "concat_ws('\\t', '1', concat(n, ' - ', a), b, '5', m, '2', '9', '1', '4', '0')", "concat_ws('  ', m, concat(n, '-', a), b, '5', m, '2', '9', '1', '4', '0')", "concat_ws('  ', 'Rank', a, b, '5', m, '2', '9', '1', '4', '0')").select("k", F.inline(F.array_compact(F.array(tables.player_row(F.col("line")))))),
        f"WITH p AS ({PARTS}) SELECT k, n AS jersey, a AS name, b AS team, 5::DOUBLE AS games, CAST(m AS DOUBLE) AS goals, 2::DOUBLE AS assists, 9::DOUBLE AS points, 1::DOUBLE AS penalties, 4::DOUBLE AS minutes FROM p WHERE v % 3 < 2",
    ),
    "s19_pasted_goalies": (
        lambda s, d: _lines(s, d, "concat_ws('\\t', '1', concat(n, ' - ', a), b, '5', '60', m, '7.25')", "concat_ws('  ', m, a, b, '5', '60', m, '7.25')", "concat_ws('  ', '1', a)").select("k", F.inline(F.array_compact(F.array(tables.goalie_row(F.col("line")))))),
        f"WITH p AS ({PARTS}) SELECT k, CASE WHEN v % 3 = 0 THEN n ELSE 0 END AS jersey, a AS name, b AS team, 5::DOUBLE AS games, 60::DOUBLE AS minutes, CAST(m AS DOUBLE) AS goals_allowed, 7.25::DOUBLE AS average FROM p WHERE v % 3 < 2",
    ),
    "s22_feed_entries": (
        lambda s, d: _parts(s, d).select("k", F.inline(tables.feed_entries(F.expr("concat('<feed><title>x</title><entry><yt:videoId>v', k, '</yt:videoId><title>PBLA: June ', 1 + m, ', 2026 - ', a, '</title></entry><entry><yt:videoId>w</yt:videoId><title>PBLA: June 3, 2025</title></entry><entry><title>PBLA: May 3, 2026</title></entry></feed>')"), 2026))),
        f"WITH p AS ({PARTS}) SELECT k, CAST(DATE '2026-06-01' + m AS VARCHAR) AS day, 'v' || k AS video, 'PBLA: June ' || (1 + m) || ', 2026 - ' || a AS title FROM p",
    ),
    "f19_school_keys": (
        lambda s, d: _parts(s, d).select("k", F.explode(tables.school_keys(F.expr("CASE v % 3 WHEN 0 THEN concat('St. ', p_name, ' Senior High School (NJ)') WHEN 1 THEN concat('WC ', p_name, ' Prep Academy') ELSE p_name END"))).alias("key")),
        f"WITH p AS ({PARTS}) SELECT k, unnest(CASE v % 3 WHEN 0 THEN ['st ' || p_name || ' senior high school', 'st ' || p_name, 'saint ' || p_name] WHEN 1 THEN ['wc ' || p_name || ' prep academy', 'wc ' || p_name, 'west chester ' || p_name] ELSE [p_name] END) AS key FROM p",
    ),
    "f01_straight_text": (
        _over("concat(' “', a, '”  o’', b, ' ')", line=lambda c: T.squeeze(T.straight_quotes(c))),
        f"""WITH p AS ({PARTS}) SELECT k, '"' || a || '" o''' || b AS line FROM p""",
    ),
    "f06_states": (
        lambda s, d: _parts(s, d).withColumn("x", T.state_suffix(F.expr("concat(a, CASE v % 2 WHEN 0 THEN ' (nj)' ELSE '' END)"))).select("k", "x.*"),
        f"WITH p AS ({PARTS}) SELECT k, a AS name, CASE WHEN v % 2 = 0 THEN 'NJ' END AS state FROM p",
    ),
    "f23_days": (
        lambda s, d: B.table(s, d, "orders").select("o_orderkey", T.parse_day(F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 2 THEN CAST(datediff(o_orderdate, DATE'1899-12-30') AS STRING) ELSE 'soon' END")).alias("day")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    ),
    "f25_counts": (_over("CASE v % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat(m, ' ') ELSE 'x' END", n=T.count_or_zero), f"WITH p AS ({PARTS}) SELECT k, CASE v % 3 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(m AS DOUBLE) END AS n FROM p"),
    "x04_name_lists": (
        lambda s, d: _parts(s, d).select("k", F.posexplode(T.split_names(F.expr("CASE v % 3 WHEN 0 THEN 'A. Bee, C. Dee, and Eff' WHEN 1 THEN concat('Jo ', p_type, ' and Al Roe') ELSE concat('band and ', p_name) END"))).alias("nth", "name")),
        f"""WITH p AS ({PARTS}), x AS (SELECT k, CASE v % 3 WHEN 0 THEN ['A. Bee', 'C. Dee', 'Eff'] WHEN 1 THEN ['Jo ' || p_type, 'Al Roe'] ELSE ['band and ' || p_name] END AS l FROM p)
        SELECT k, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS nth, unnest(l) AS name FROM x""",
    ),
}

QUERIES = {name: q for name, (q, _) in SUITE.items()}
ORACLES = {name: sql for name, (_, sql) in SUITE.items()}
