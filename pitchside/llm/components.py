"""Connected components of a distributed edge list, by alternating large-star and small-star.

Every round is two aggregations with joins and writes its edges to the shared folder, so no
lineage grows and a lost executor costs one round. A star's centre may have very many edges: the
minimum combines on the map side and the join back is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v, again with u > v and without repeats."""
    if large:  # each node links its larger neighbours to the smallest of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        linked = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # each node links itself and its smaller neighbours to the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return linked.filter("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b), longs.

    Links to oneself and repeated links are allowed; null ends are not. Nodes without a link to
    another are not returned.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        edges = written(_star(_star(edges, True), False), "edges")
        mark, before = _mark(edges), mark
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
