"""Data-quality findings, reconciliation and entity resolution (survey D3, D24-D26, A17, A19, A20, A30, J17, J18, W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.text import similarity
from pitchside.operators.near_names import candidates, within_share


def fuzzy_pairs(people: DataFrame, key: str, name: str, group: str, least: float = 0.85, block: int = 1) -> DataFrame:
    """Similar names in different groups that begin alike, found by shared pieces of names, then edit distance.

    People of one name are one row of the join until the last step. The smaller id comes first.
    """
    n = F.lower(F.trim(name))
    base = people.select(F.col(key).alias("id"), n.alias("name"), F.col(group).alias("grp")).filter((F.length("name") >= 4) & (F.col("name").contains(" ") | (F.length("name") >= 6)))
    names = base.select(F.col("name").alias("text")).distinct().withColumn("start", F.substring("text", 1, block))
    met = candidates(names, names, ["start"], *within_share(least)).filter((F.length("x") < F.length("y")) | (F.col("x") <= F.col("y")))
    similar = met.withColumn("sim", similarity(F.col("x"), F.col("y"))).filter(F.col("sim") >= least).select("x", "y", "sim")
    a, b = (base.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "name", "grp")]) for s in ("a", "b"))
    found = similar.join(a, F.col("x") == F.col("a_name")).join(b, F.col("y") == F.col("b_name")).filter((F.col("a_grp") != F.col("b_grp")) & ((F.col("x") != F.col("y")) | (F.col("a_id") < F.col("b_id"))))
    return found.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "sim")


def capped(stats: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Values over their cap become zero; rows that are all zero go."""
    out = stats.withColumns({c: F.when(F.col(c) > cap, 0).otherwise(F.col(c)) for c, cap in caps.items()})
    return out.filter(F.greatest(*[F.col(c) for c in caps]) > 0) if len(caps) > 1 else out.filter(F.col(next(iter(caps))) > 0)


def findings(**checks: tuple[str, DataFrame]) -> DataFrame:
    """One row per check: its severity and how many rows it found."""
    parts = [rows.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "found") for name, (severity, rows) in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_findings(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent insert: what is not recorded yet."""
    return found.dropDuplicates(keys).join(known, keys, "left_anti")


def grouped_anomalies(rows: DataFrame, reason: Column, line: Column, url: Column, top: int) -> DataFrame:
    """The most frequent (reason, line) groups with one address each."""
    g = rows.groupBy(reason.alias("reason"), line.alias("line")).agg(F.count(F.lit(1)).alias("n"), F.max(url).alias("url"))
    return g.orderBy(F.desc("n"), "reason", "line").limit(top)


def shares(rows: DataFrame, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def categorise(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """missing (only left), extra (only right), mismatched or equal, for each key."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(1).alias("_l"))
    b = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(1).alias("_r"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_left").eqNullSafe(F.col(f"{v}_right"))
    kind = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(same, "equal").otherwise("mismatched")
    return a.join(b, keys, "full_outer").withColumn("kind", kind).drop("_l", "_r")


def duplicated_names(people: DataFrame, name: str, group: str) -> DataFrame:
    """Names that occur in two groups or more."""
    return people.groupBy(F.lower(name).alias("name")).agg(F.countDistinct(group).alias("groups"), F.count(F.lit(1)).alias("n")).filter("groups >= 2")


def freshness(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(at).alias("latest"), F.count(F.lit(1)).alias("n"))
