"""What an editor looks at: anomalies, their triage, scouting of an opponent, and the checks of all tables (survey A17, A18, A23, D26)."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.core import ranked, two_sided

# How hard the anomalies of a strategy are to mend, by a pattern of their reason; the first that fits counts, M where none does.
DIFFICULTY = [
    ("quarter-line", "team hint did not resolve", "M"), ("quarter-line", "period sum does not equal total", "S"), ("player-stat-line", "no stat tokens recognized", "M"), ("score-line", "did not match Team A N, Team B N", "M"),
    ("ranking-list", r"duplicate rank \d+ in post", "S"), ("aggregated-list", "no .* header recognized", "S"),
]
HIGH, STALE_DAYS, SEASON_MONTHS, JERSEYS = 30, 7, (3, 6), (0, 99)


def anomaly_summary(rows: DataFrame, limit: int, reason: str | None = None) -> dict[str, DataFrame]:
    """total (n), by_reason (reason, n) and top (reason, line, n, url) of anomalies (reason, line, url), of one reason if that is given.

    The groups of lines are counted first; total and reasons are sums of them, so the rows are shuffled once.
    """
    wanted = (reason or "").strip()
    some = rows.filter(F.col("reason") == wanted) if wanted else rows
    groups = some.groupBy("reason", "line").agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("url"))
    return {
        "total": groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
        "by_reason": groups.groupBy("reason").agg(F.sum("n").alias("n")),
        "top": groups.orderBy(F.desc("n"), "line", "reason").limit(limit),
    }


def difficulty(strategy: Column, reason: Column) -> Column:
    """S, M or L-sized work, by the table above."""
    found = F.when(F.lit(False), "M")
    for of, pattern, size in DIFFICULTY:
        found = found.when((strategy == of) & reason.rlike(f"(?i){pattern}"), size)
    return found.otherwise("M")


def triage_report(rows: DataFrame, top: int = 10, samples: int = 5) -> DataFrame:
    """strategy, reason, n, position, difficulty and the first samples (id, line, url) of the largest groups of anomalies (id, strategy, reason, line, url).

    Only the rows of these groups are sorted, and of each only the few smallest ids are kept on the way.
    """
    groups = rows.groupBy("strategy", "reason").agg(F.count(F.lit(1)).alias("n"))
    best = groups.orderBy(F.desc("n"), "strategy", "reason").limit(top)
    place = ranked(best.withColumn("_all", F.lit(1)), ["_all"], [F.desc("n"), F.col("strategy"), F.col("reason")], "position").drop("_all")  # at most `top` rows
    here = rows.join(F.broadcast(place), ["strategy", "reason"])  # at most `top` rows
    few = ranked(here, ["strategy", "reason"], [F.col("id")]).filter(F.col("rn") <= samples)
    lines = F.sort_array(F.collect_list(F.struct("id", "line", "url")))
    return few.groupBy("strategy", "reason", "n", "position").agg(lines.alias("samples")).withColumn("difficulty", difficulty(F.col("strategy"), F.col("reason")))


def _result(gf: Column, ga: Column) -> Column:
    """W for more goals, L else, as the reports have it."""
    return F.when(gf > ga, "W").otherwise("L")


def scouting_report(games: DataFrame, stats: DataFrame, team: int, opponent: int, season: int | None = None, last: int = 5, scorers: int = 3) -> dict[str, DataFrame]:
    """last_games, averages, scorers and head_to_head about an opponent. Postponed contests count nowhere.

    games: game_id, game_date, season, home_id, away_id, scores, postponed. stats: game_id, player_id, player_name, team_id, season, goals, assists.
    Season bounds all but the meetings. Both teams' rows are filtered before anything is sorted.
    """
    played = games.filter(~F.coalesce("postponed", F.lit(False)))
    in_season = played if season is None else played.filter(F.col("season") == season)
    side = lambda me: (F.when(F.col("home_id") == me, F.col("home_score")).otherwise(F.col("away_score")), F.when(F.col("home_id") == me, F.col("away_score")).otherwise(F.col("home_score")))
    gf, ga = side(opponent)
    theirs = in_season.filter((F.col("home_id") == opponent) | (F.col("away_id") == opponent)).select("game_id", "game_date", F.when(F.col("home_id") == opponent, F.col("away_id")).otherwise(F.col("home_id")).alias("against"), gf.alias("gf"), ga.alias("ga"))
    recent = theirs.orderBy(F.desc("game_date"), F.desc("game_id")).limit(last)
    own, other = side(team)
    meetings = played.filter(((F.col("home_id") == team) & (F.col("away_id") == opponent)) | ((F.col("home_id") == opponent) & (F.col("away_id") == team)))
    rows = stats.filter(F.col("team_id") == opponent)
    rows = rows if season is None else rows.filter(F.col("season") == season)
    sums = rows.join(in_season.select("game_id"), "game_id", "left_semi").groupBy("player_id", "player_name").agg(F.coalesce(F.sum("goals"), F.lit(0)).alias("goals"), F.coalesce(F.sum("assists"), F.lit(0)).alias("assists"))
    return {
        "last_games": recent.withColumn("result", _result(F.col("gf"), F.col("ga"))),
        "averages": recent.agg(F.count(F.lit(1)).alias("games"), F.coalesce(F.avg("gf"), F.lit(0.0)).alias("goals_for"), F.coalesce(F.avg("ga"), F.lit(0.0)).alias("goals_against")),
        "scorers": sums.orderBy(F.desc(F.col("goals") + F.col("assists")), F.desc("goals"), F.lower("player_name"), "player_id").limit(scorers),
        "head_to_head": meetings.select("game_id", "game_date", own.alias("gf"), other.alias("ga")).withColumn("result", _result(F.col("gf"), F.col("ga"))),
    }


def quality_suite(games: DataFrame, teams: DataFrame, people: DataFrame, aliases: DataFrame, stats: DataFrame, year: int, today: date) -> DataFrame:
    """check, severity (warning or error) and found, a row for each check, also where it found nothing.

    games: game_id, game_date, home_id, away_id, scores; people: player_id, team_id, name, jersey; aliases: alias, team_id; stats:
    game_id, player_id. Checks of single contests are one pass over them. Staleness is only judged in the months of a season.
    """
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    now = F.year("game_date") == year
    known = games.join(teams.select(F.col("team_id").alias("home_id")), "home_id", "left_semi").join(teams.select(F.col("team_id").alias("away_id")), "away_id", "left_semi")
    single = known.agg(
        count(now & ((F.col("home_score") > HIGH) | (F.col("away_score") > HIGH))).alias("suspicious score"), count(now & ((F.col("home_score") < 0) | (F.col("away_score") < 0))).alias("negative score"),
    )
    missing = games.agg(count(F.col("game_date").isNull() | F.col("home_id").isNull() | F.col("away_id").isNull()).alias("n"))
    latest = F.max(F.when(now, F.col("game_date")))
    in_season = SEASON_MONTHS[0] <= today.month <= SEASON_MONTHS[1]
    stale = games.agg((F.lit(in_season) & F.coalesce(F.datediff(F.lit(today), latest) > STALE_DAYS, F.lit(True))).cast("long").alias("n"))
    repeated = lambda rows, keys, more=None: rows.groupBy(*keys).agg((more if more is not None else F.count(F.lit(1))).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("n"))
    playing = two_sided(games.withColumns({c: F.lit(None).cast("string") for c in ("season", "provenance", "postponed") if c not in games.columns}).filter(now)).select("team_id").distinct()
    total = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"))
    checks = [
        ("suspicious score", "warning", single.select(F.col("suspicious score").alias("n"))), ("negative score", "error", single.select(F.col("negative score").alias("n"))),
        ("duplicate game", "warning", repeated(known.filter(now), ["game_date", "home_id", "away_id"])), ("team without a game", "warning", total(teams.join(playing, "team_id", "left_anti"))), ("stale season", "warning", stale),
        ("null required field", "error", missing), ("duplicate player", "warning", repeated(people, [F.lower("name"), "team_id"])), ("duplicate alias", "warning", repeated(aliases, [F.lower("alias")], F.count_distinct("team_id"))),
        ("orphaned stat", "error", total(stats.join(games.select("game_id"), "game_id", "left_anti"))), ("duplicate stat", "error", repeated(stats.join(people.select("player_id"), "player_id", "left_semi"), ["player_id", "game_id"])),
        ("invalid jersey", "warning", total(people.filter(~F.col("jersey").between(*JERSEYS)))),
    ]
    return reduce(DataFrame.unionByName, [n.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col("n").alias("found")) for name, severity, n in checks])


def passes(findings: DataFrame) -> bool:
    """Whether no check with severity error found anything."""
    return findings.filter("severity = 'error' AND found > 0").isEmpty()
