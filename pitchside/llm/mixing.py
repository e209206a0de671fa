"""Mixing sources to target weights by the cube method.

A source's target over its size is how often each of its documents is repeated: the whole part
for all of them, the fractional part as the inclusion probability of a balanced sample. The sample
keeps two totals of each source, its words and its documents. The flight moves the probabilities of a
block of documents along vectors that change neither total, until few of the block are open. What the blocks leave open is blocked again and flies on, level by
level, until a source is one block. Its last documents (16 at most) are the landing
problem: of all their roundings, the one with the least error in words and documents is taken.

So a source of any size is spread over blocks of bounded size, and its words differ from the target
by what the best of up to 65,536 roundings leaves.

Sources are numbered by ranges of a distributed sort, and the level of the water (words for each
unit of weight, with sources stopping at `most` times their size) is found from sums that Spark adds up.

Random choices are seeded by source, block and level, so reruns agree. Rows with the same
source, id and size stand for each other: they are counted, numbered and sampled each.

Defined cases: a null or empty text has size 0; documents of size 0 fly like others and take 0. A null
source is a source of its own, the last. A null doc_id is an id like any other. A source without words has the target 0.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"
MOST, WEIGHTS = 3, (1, 2, 3)
BLOCK = 1000  # documents of a block, about
LAND = 16  # documents that a block leaves open
SMALL = 100_000  # sources that are broadcast (some 10 MB); more go through a salted join
SALTS = 64
RUN = 10_000  # equal rows that one array numbers
EDGE = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, n): how many rows have these values."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), size.alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))


def numbered(sources: DataFrame) -> DataFrame:
    """With `rank`, from 0 in the order of code points, null last. Only the partitions' row counts reach the driver."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts, first, at = dict(placed.groupBy("part").count().collect()), [], 0
    for part in sorted(counts):
        first.append((part, at))
        at += counts[part]
    before = sources.sparkSession.createDataFrame(first, "part int, first long")  # one row a partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return placed.withColumn("nth", nth).join(F.broadcast(before), "part").withColumn("rank", F.col("first") + F.col("nth") - 1).drop("part", "nth", "first")


def water_level(sources: DataFrame, total: int, most: int = MOST) -> Fraction:
    """Words for each unit of weight: sources whose share is above `most` times their size stop there, the excess is shared again."""
    level = Fraction(0)
    while True:
        stopped = F.lit(False) if level == 0 else F.col("weight").cast("decimal(38,0)") * level.numerator > F.col("source_size").cast("decimal(38,0)") * most * level.denominator
        full, weight = sources.agg(F.sum(F.when(stopped, F.col("source_size")).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))).first()
        risen = Fraction(total - most * int(full or 0), int(weight)) if weight else level
        if risen == level:
            return level
        level = risen


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, documents, target) of rows as sizes() makes them."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(numbered(found).withColumn("weight", weight), "source-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    if not total:
        return table.select("source", "source_size", "documents", F.lit(0.0).alias("target"))
    level = water_level(table, total, most)
    share = F.col("weight") * F.lit(float(level))
    stopped = F.col("weight").cast("decimal(38,0)") * level.numerator >= F.col("source_size").cast("decimal(38,0)") * most * level.denominator
    return table.select("source", "source_size", "documents", F.when(stopped, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def flight(size: Sequence[int], chance: Sequence[float], r: random.Random, leave: int = 2) -> np.ndarray:
    """Chances moved to 0 and 1 with the sums of chances and of size x chance unchanged; at most `leave` (2 or more) are left between.

    Each move follows the projection of the largest open document's axis on the null space of both totals, so that large
    documents are decided while many small ones can make up for them. One document at least is decided by a move.
    """
    size, chance = np.array(size, dtype=np.float64), np.array(chance, dtype=np.float64)
    chance = np.where((chance > EDGE) & (chance < 1 - EDGE), chance, np.rint(chance))
    open_ = np.argsort(-size, kind="stable")
    open_ = open_[(chance[open_] > 0) & (chance[open_] < 1)]
    while len(open_) > leave:
        p, d = chance[open_], size[open_] - size[open_].mean()
        spread = d @ d
        share = d * d / spread if spread else np.zeros(len(d))
        first = int(np.argmax(share < 1 - 1 / len(d) - 1e-9))  # an axis that isn't fixed by the totals; some is not
        step = np.full(len(d), -1 / len(d)) - (d * (d[first] / spread) if spread else 0)
        step[first] += 1
        step[np.abs(step) < 1e-12] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nanmin(np.where(step > 0, (1 - p) / step, np.where(step < 0, -p / step, np.inf)))
            down = np.nanmin(np.where(step > 0, p / step, np.where(step < 0, (p - 1) / step, np.inf)))
        p = p + (up if r.random() * (up + down) < down else -down) * step
        chance[open_] = np.where((p > EDGE) & (p < 1 - EDGE), p, np.rint(p))
        open_ = open_[(chance[open_] > 0) & (chance[open_] < 1)]
    return chance


def landing(size: Sequence[int], chance: np.ndarray) -> np.ndarray:
    """The rounding of the few open chances with the least error: in words, by the mean size, four times that in documents."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    sizes_ = np.array(size, dtype=np.float64)[open_]
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = ways - chance[open_]
    chance = chance.copy()
    if len(open_):
        chance[open_] = ways[np.argmin(4 * np.abs(off @ sizes_) / max(1.0, sizes_.mean()) + np.abs(off.sum(axis=1)))]
    return chance


def flying(level: int) -> Callable[[pa.Table], pa.Table]:
    """One block's flight, and its landing where the block is all that is left of its source."""

    def fly(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("doc_id", "ascending"), ("copy", "ascending")])
        source, part, parts = (table.column(x)[0].as_py() for x in ("source", "part", "parts"))
        r = random.Random(f"{source!r} {part} {level}")
        order = list(range(len(table)))
        r.shuffle(order)
        table = table.take(pa.array(order, pa.int64()))
        size = table.column("size").to_pylist()
        chance = flight(size, table.column("chance").to_pylist(), r, LAND)
        if parts == 1:
            chance = landing(size, chance)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance, pa.float64()))

    return fly


def balanced(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of (source, part, parts, doc_id, size, copy, chance and more) with `chance` moved to 0 or 1; parts: blocks of the source, part: the row's.

    Each level is one grouped pass. The next level's blocks hold what so many blocks leave open that they are
    about as large, LAND rows each at most.
    """
    merge, level, done, now = max(2, block // LAND), 0, [rows.filter("chance = 0")], rows.filter("chance > 0")
    while True:
        flown = written(now.groupBy("source", "part").applyInArrow(flying(level), now.schema), "flight")
        done.append(flown.filter("chance = 0 OR chance = 1"))
        rest = flown.filter("chance > 0 AND chance < 1")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        now = rest.withColumn("part", F.floor(F.col("part") / merge)).withColumn("parts", F.ceil(F.col("parts") / merge))
        level += 1


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document."""
    rows = written(sizes(docs), "sizes")
    goal = written(targets(rows, weights, most), "targets").withColumnRenamed("source", "s")
    if goal.count() <= small:
        planned = rows.join(F.broadcast(goal), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    else:  # a source with many rows meets copies of its target
        salted = goal.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")
        planned = rows.withColumn("salt", salt).join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("salt2"))).drop("s", "salt", "salt2")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    planned = planned.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio")).withColumn("chance", F.col("ratio") - F.col("whole"))
    # equal rows one by one, in two steps so that no array of copies is long
    planned = planned.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    planned = planned.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)))
    planned = planned.withColumn("parts", F.ceil(F.col("documents") / block)).withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.col("parts")))
    chosen = balanced(written(planned.drop("n", "ratio", "run", "documents"), "planned"), block)
    return chosen.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("chance")).cast("long").alias("copies"))
