"""Feeds, lists and small verdicts over contests and people (survey S8, P8-P13, J2, J13-J15, A32, A35, A36, A39, W10, W14, L5, L7, L10, L13, D30).

Lists with a limit are top-k sorts with a total order; everything else is one scan or an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.core import counted, first_per, ranked, two_sided
from pitchside.operators.team_analytics import record_text, team_totals

# Other names of ranking sources, and the known ones.
SOURCE_NAMES = {"phillylax": "philly"}
SOURCES = ["philly", "pa-state"]
#: How many aliases of a team go together where each is a row of each contest.
LIST = 1024


def watermark(rows: DataFrame, key: str, at: str, prefix: str) -> DataFrame:
    """One row: the newest time among keys with a prefix; null if there is none."""
    return rows.filter(F.col(key).startswith(prefix)).agg(F.max(at).alias("watermark"))


def limit_parameter(raw: Column, default: int, most: int) -> Column:
    """How many rows are asked for: the whole part of a positive number, at most so many; the default for anything else."""
    n = F.trim(raw).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (n >= 1), F.least(F.floor(n), F.lit(most).cast("long"))).otherwise(F.lit(default).cast("long"))


def season_parameter(raw: Column, newest: Column) -> Column:
    """(season, valid): a year from 2000 to 2100; null for `all`; the newest season where none is given; anything else is not valid."""
    n = raw.try_cast("double")
    year = (n == F.floor(n)) & n.between(2000, 2100)
    season = F.when(raw.isNull() | (raw == ""), newest).when(year, n.cast("long"))
    return F.struct(season.alias("season"), (F.coalesce(raw, F.lit("")).isin("", "all") | F.coalesce(year, F.lit(False))).alias("valid"))


def validation(won: Column, lost: Column, official_won: Column, official_lost: Column) -> Column:
    """match, close (off by at most two results) or divergent, with the differences; unmapped without an official record."""
    mapped = official_won.isNotNull() & official_lost.isNotNull()
    w, lo = official_won - won, official_lost - lost
    off = F.abs(w) + F.abs(lo)
    status = F.when(~mapped, "unmapped").when(off == 0, "match").when(off <= 2, "close").otherwise("divergent")
    return F.struct(status.alias("status"), F.when(mapped, w).alias("win_diff"), F.when(mapped, lo).alias("loss_diff"), F.when(mapped, off).alias("total_diff"))


def confidence_level(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), None).when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def source_name(s: Column) -> Column:
    """The source by its own name; null if it is not known."""
    own = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])[s], s)
    return F.when(own.isin(*SOURCES), own)


def containing(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by blanks, contain a text in any case; all rows for a blank text."""
    needle = text.strip().lower()
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle))) if needle else rows


def with_team_names(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Both teams' names; where a team is not known, the name as it was written (home_raw, away_raw)."""
    out = games
    for side in ("home", "away"):
        named = teams.select(F.col("team_id").alias(f"{side}_id"), F.col("name").alias(f"_{side}"))
        out = out.join(named, f"{side}_id", "left").withColumn(f"{side}_name", F.coalesce(f"_{side}", f"{side}_raw")).drop(f"_{side}")
    return out


def opponents_of(games: DataFrame, team: int, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """A team's contests with the other side's name, and a row for each of its aliases.

    Rows are contests times aliases, however they are made. Contests are dealt evenly by opponent, so that a task has the aliases of one or two teams. The join is with lists of
    at most LIST aliases, which is fewer rows by that factor, and the last step makes the rows of each list.
    """
    other = F.when(F.col("home_id") == team, F.col("away_id")).otherwise(F.col("home_id"))
    mine = games.filter((F.col("home_id") == team) | (F.col("away_id") == team)).select("game_id", "game_date", other.alias("team_id"))
    spark = games.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = mine.join(teams.select("team_id", F.col("name").alias("opponent")), "team_id").repartitionByRange(tasks, "team_id", "game_id")
    nth = F.row_number().over(Window.partitionBy("team_id").orderBy("alias")) - 1
    lists = aliases.select("team_id", "alias", F.floor(nth / LIST).alias("list")).groupBy("team_id", "list").agg(F.collect_list(F.struct("alias")).alias("aliases"))
    return named.join(lists.select("team_id", "aliases"), "team_id", "left").select("game_id", "game_date", "opponent", F.inline_outer("aliases"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's row with the smallest order value."""
    return first_per(rows, [key], [F.col(order)])


def pair_rows(pairs: DataFrame, people: DataFrame, teams: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs of people (a_id, b_id) with both names, teams and numbers of stat rows."""
    counts = stats.groupBy("id").agg(F.count(F.lit(1)).alias("stats"))
    full = people.join(teams.select("team_id", F.col("name").alias("team")), "team_id").join(counts, "id", "left").select("id", "name", "team", F.coalesce("stats", F.lit(0)).alias("stats"))
    out = pairs
    for s in ("a", "b"):
        out = out.join(full.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("name", "team", "stats")]), f"{s}_id")
    return out


def totals_mismatches(games: DataFrame, teams: DataFrame, official: DataFrame) -> DataFrame:
    """Teams whose wins, losses or goals differ from the official (team_id, wins, losses, points), worst first: by results, then goals, then id."""
    own = team_totals(games, "ignore").select("team_id", F.col("wins").alias("w"), F.col("losses").alias("l"), F.col("goals_for").alias("g"))
    both = official.join(teams.select("team_id", "name"), "team_id").join(own, "team_id", "left")
    deltas = both.select("team_id", "name", *[(F.coalesce(c, F.lit(0)) - F.col(o)).alias(f"delta_{o}") for c, o in (("w", "wins"), ("l", "losses"), ("g", "points"))])
    off = F.abs("delta_wins") + F.abs("delta_losses")
    return deltas.filter((off > 0) | (F.col("delta_points") != 0)).orderBy(off.desc(), F.abs("delta_points").desc(), "team_id")


def top_groups(rows: DataFrame, key: str, top: int = 8) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(top)


def season_summary(standings: DataFrame, players: DataFrame) -> DataFrame:
    """One row: goals of all teams, the most points and who has them (of equal ones the smallest id), zero and empty without players."""
    goals = standings.agg(F.coalesce(F.sum("pf"), F.lit(0)).alias("goals"))
    best = players.agg(F.greatest(F.coalesce(F.max("points"), F.lit(0)), F.lit(0)).alias("top_points"), F.coalesce(F.max_by("name", F.struct("points", -F.col("id"))), F.lit("")).alias("top_player"))
    return goals.join(best)  # one row each


def upcoming_records(schedule: DataFrame, games: DataFrame, team: int, since, limit: int = 5) -> DataFrame:
    """The next contests of a team with their opponent and the team's own overall record beside it."""
    other = F.when(F.col("home_id") == team, F.col("away_id")).otherwise(F.col("home_id"))
    mine = upcoming(schedule, team, since, limit).select("game_id", "game_date", other.alias("opponent_id"))
    own = team_totals(games, "ignore").filter(F.col("team_id") == team).select(record_text(F.col("wins"), F.col("losses"), F.col("ties")).alias("record"))
    return mine.join(own, how="left")  # one row at most on the right


def score_trend(games: DataFrame, team: int) -> DataFrame:
    """Goals for and against by contest of one team, in order of date and id; contests without scores or put off are left out."""
    played = games.filter(~F.col("postponed") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    mine = played.filter((F.col("home_id") == team) | (F.col("away_id") == team))
    home = F.col("home_id") == team
    return mine.select("game_id", "game_date", F.when(home, F.col("home_score")).otherwise(F.col("away_score")).alias("gf"), F.when(home, F.col("away_score")).otherwise(F.col("home_score")).alias("ga")).orderBy("game_date", "game_id")


def streak_chip(streak: Column) -> Column:
    """W3 or L2; null below two."""
    return F.when(streak >= 2, F.concat(F.lit("W"), streak.cast("string"))).when(streak <= -2, F.concat(F.lit("L"), F.abs(streak).cast("string")))


def day_text(iso: Column) -> Column:
    """M/D/YYYY of an ISO date; anything else as it is."""
    p = r"^(\d{4})-(\d{2})-(\d{2})"
    part = lambda i: F.regexp_extract(iso, p, i)
    return F.when(iso.rlike(p), F.concat_ws("/", part(2).cast("int"), part(3).cast("int"), part(1))).otherwise(iso)


def sorted_teams(teams: DataFrame, key: str, upward: bool = False) -> DataFrame:
    """Teams by name, wins (then share of wins) or gap (unknown ones last either way); ties by name without case."""
    way = (lambda c: c.asc()) if upward else (lambda c: c.desc())
    name = F.lower("name")
    if key == "name":
        order = [way(name)]
    elif key == "wins":
        wins, losses = (F.coalesce(c, F.lit(0)) for c in ("wins", "losses"))
        order = [way(wins), way(F.when(wins + losses > 0, wins / (wins + losses)).otherwise(0.0)), name]
    else:
        order = [F.col(key).asc_nulls_last() if upward else F.col(key).desc_nulls_last(), name]
    return ranked(teams, [], [*order, F.col("team_id")], "position")


def league_rank(standings: DataFrame) -> DataFrame:
    """Positions by points (two for a win, one for a tie), goal difference, goals for, goals against, name."""
    wide = standings.withColumns({"pts": 2 * F.col("wins") + F.col("ties"), "diff": F.col("pf") - F.col("pa")})
    return ranked(wide, [], [F.desc("pts"), F.desc("diff"), F.desc("pf"), F.col("pa"), F.col("name"), F.col("team_id")], "position")  # one row for each team of a league


def commitments(rows: DataFrame, people: DataFrame, teams: DataFrame, status: str | None = None, limit: int = 500) -> DataFrame:
    """The newest commitments by their date, or else by when they were entered; then by entry and name without case."""
    rows = rows if status is None else rows.filter(F.col("status") == status)
    named = rows.join(people.select(F.col("id").alias("player_id"), "name", "team_id"), "player_id").join(teams.select("team_id", F.col("name").alias("team")), "team_id", "left")
    return named.orderBy(F.coalesce("commit_date", "created_at").desc(), F.desc("created_at"), F.lower("name"), "commit_id").limit(limit)


def _of_team(schedule: DataFrame, team: int | None) -> DataFrame:
    return schedule if team is None else schedule.filter((F.col("home_id") == team) | (F.col("away_id") == team))


def schedule_list(schedule: DataFrame, since=None, until=None, team: int | None = None, limit: int = 500) -> DataFrame:
    rows = _of_team(schedule, team)
    rows = rows if since is None else rows.filter(F.col("game_date") >= F.lit(since))
    rows = rows if until is None else rows.filter(F.col("game_date") <= F.lit(until))
    return rows.orderBy("game_date", "game_id").limit(limit)


def upcoming(schedule: DataFrame, team: int, since, limit: int) -> DataFrame:
    return schedule_list(schedule, since=since, team=team, limit=limit)


def by_date(schedule: DataFrame) -> DataFrame:
    """One row for each date with its contests in order."""
    return schedule.groupBy("game_date").agg(F.sort_array(F.collect_list("game_id")).alias("games"))


def enough_games(rows: DataFrame, least: int) -> DataFrame:
    return rows.filter(F.col("games") >= least)


def win_counts(games: DataFrame) -> DataFrame:
    """Wins and losses of played contests by team."""
    played = two_sided(games).filter(~F.col("postponed"))
    return played.groupBy("team_id").agg(counted(F.col("gf") > F.col("ga")).alias("wins"), counted(F.col("gf") < F.col("ga")).alias("losses"))
