"""Tables of pages cell by cell, and box scores (survey S13)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions.names import without_marks

# What a page has that asks to sign in or says that there is no such page.
WALL = r"(?i)<form[^>]+id=[\"']login[\"']|<title>\s*404|Sign In to MaxPreps"

CELL = "table int, classes string, row int, cell int, column int, header string, text string"


class _Tables(HTMLParser):
    """Follows rows and cells of open tables; a cell's text is its own and that of what is in it, but not of inner tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[tuple] = []
        self.tables = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            classes = next((v or "" for k, v in attrs if k == "class"), "")
            self.open.append({"table": self.tables, "classes": " ".join(classes.split()), "row": -1, "cell": None, "cells": 0, "headers": {}, "spans": {}})
            self.tables += 1
        elif self.open and tag in ("tr", "td", "th"):
            t = self.open[-1]
            self._close(t)
            if tag == "tr" or t["row"] < 0:
                t["row"], t["cells"], t["column"] = t["row"] + 1, 0, 0
            if tag != "tr":
                while t["spans"].get(t["column"], 0) > t["row"]:  # a cell from above reaches down to here
                    t["column"] += 1
                span = {k: v for k, v in attrs if k in ("colspan", "rowspan")}
                wide, high = (min(1000, int(v)) if (v := (span.get(k) or "1")).isdigit() and int(v) else 1 for k in ("colspan", "rowspan"))
                t["cell"] = (t["cells"], t["column"], wide, high, [])
                t["cells"] += 1

    def _close(self, t):
        if t["cell"] is None:
            return
        nth, column, wide, high, parts = t["cell"]
        t["cell"], text = None, " ".join("".join(parts).split())
        for c in range(column, column + wide):
            t["spans"][c] = t["row"] + high
            if t["row"] == 0:
                t["headers"][c] = text
        self.done.append((t["table"], t["classes"], t["row"], nth, column, t["headers"].get(column, ""), text))
        t["column"] = column + wide

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close(self.open[-1])
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"][4].append(data)


def _cells(html: str | None) -> Iterator[tuple]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser._close(parser.open.pop())
    return sorted(parser.done)


@F.udtf(returnType=CELL)
class HtmlCells:
    """(table, classes, row, cell, column, header, text) of every cell of a page's tables, inner ones too.

    cell: its place in the row; column: its place in the grid, with cells that span rows and columns; header: the text of the
    table's first row at that column. White space is single blanks. Rows without a <tr> belong to the first row.
    """

    def eval(self, html: str):
        yield from _cells(html)


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A lateral join of pages with their cells."""
    return pages.select(key, html).lateralJoin(HtmlCells(F.col(html).outer())).drop(html)


def _loose(name: Column) -> Column:
    return F.regexp_replace(without_marks(F.lower(name)), "[^a-z0-9]+", "")


def box_scores(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, team_1, score_1, team_2, score_2): the first two teams of a page's first box score with a column Final and two whole scores.

    Pages that ask to sign in or say that there is none have none.
    """
    cells = html_cells(pages.filter(~F.coalesce(F.col(html).rlike(WALL), F.lit(True))), key, html).filter(F.array_contains(F.split("classes", " "), "boxscore"))
    final = cells.filter((F.col("row") == 0) & (F.lower("text") == "final")).groupBy(key, "table").agg(F.min("cell").alias("final"))
    rows = cells.filter("row > 0").join(final, [key, "table"]).groupBy(key, "table", "row")
    rows = rows.agg(F.max(F.when(F.col("cell") == 0, F.col("text"))).alias("team"), F.max(F.when(F.col("cell") == F.col("final"), F.col("text"))).alias("score"))
    whole = rows.filter(F.col("score").rlike(r"^(?:0|-?[1-9]\d*)$") & (F.col("team") != "")).select(key, "table", F.struct("row", "team", F.col("score").cast("long").alias("score")).alias("r"))
    tables = whole.groupBy(key, "table").agg(F.sort_array(F.collect_list("r")).alias("r")).filter(F.size("r") >= 2)
    first = tables.groupBy(key).agg(F.min_by("r", "table").alias("r"))
    return first.select(key, *[F.get("r", F.lit(i))[f].alias(f"{f}_{i + 1}") for i in (0, 1) for f in ("team", "score")])


def scores_of(home: Column, away: Column, teams: tuple[Column, Column], scores: tuple[Column, Column]) -> Column:
    """(home_score, away_score) of a box score for a contest whose names contain those of the box score or are contained in them; null where that doesn't tell."""
    alike = lambda a, b: F.contains(_loose(a), _loose(b)) | F.contains(_loose(b), _loose(a))
    pair = lambda i, j: F.struct(scores[i].alias("home_score"), scores[j].alias("away_score"))
    return F.when(alike(teams[0], home) & alike(teams[1], away), pair(0, 1)).when(alike(teams[0], away) & alike(teams[1], home), pair(1, 0))
