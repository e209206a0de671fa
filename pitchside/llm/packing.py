"""Packing of documents into sequences of at most 4096 tokens by cutting-stock column generation.

A document's ids are cut into full sequences and a rest. The histogram of piece lengths, in classes
of ``unit`` tokens rounded up, goes to the driver (at most 4096 / unit counts); the patterns that
come back say how many pieces of each class share a sequence. The pieces of a class are ranked and
rank ranges are dealt to the uses of the patterns.

Ranks need no large sort: pieces of a class are split by a hash into groups of bounded size, group
counts are summed up, and rows are numbered within their group. The dealt ranges are broadcast;
they are bounded by the patterns (at most one for each class, and those of the rounding rest).

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each. A null
doc_id is packed like any other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.common import slices, written
from pitchside.llm.cuttingstock import solve
from pitchside.llm.tokens import END_ID, encoder

LENGTH, UNIT = 4096, 16
SLICE = 2_000_000  # bytes of text whose ids are in memory at once; a longer text is alone
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of the sequence length."""
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in (s for b in batches for s in slices(b, SLICE)):
            flat, at = enc.encode(batch.column(1))
            rows = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids = flat[at[i] : at[i + 1]].tobytes() + end
                n = len(ids) // 4
                rows += [(key, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def deal(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, pieces in one sequence, first slot) of each pattern and class."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        slot = 0
        for size, count in sorted(pattern.items(), reverse=True):
            at = used.get(size, 0)
            rows.append((size, at, at + times * count, sequence, count, slot))
            used[size] = at + times * count
            slot += count
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, unit: int = UNIT, group: int = 2000) -> DataFrame:
    """One row per piece: PIECES, sequence_id and offset.

    group: about how many pieces of a class are numbered in one place.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, length), "pieces")
    sized = cut.withColumn("cls", F.ceil(F.col("length") / unit).cast("long"))
    histogram = {r[0]: r[1] for r in sized.groupBy("cls").count().collect()}
    rows = deal(solve(histogram, length // unit))
    ranges = spark.createDataFrame(rows, "cls long, lo long, hi long, first long, per long, slot0 long")
    parts = max(1, sum(histogram.values()) // group)
    sized = sized.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n")).select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = sized.withColumn("_n", F.row_number().over(Window.partitionBy("cls", "part").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = numbered.join(counts, ["cls", "part"]).withColumn("rank", F.col("base") + F.col("_n"))
    placed = ranked.join(F.broadcast(ranges), (ranked.cls == ranges.cls) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    placed = placed.select(*[x.split()[0] for x in PIECES.split(", ")], (F.col("first") + F.floor(nth / F.col("per"))).alias("sequence_id"), (F.col("slot0") + nth % F.col("per")).alias("slot"))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
