"""Line dedup with DataFrame functions alone.

Normalised lines are exploded and hashed (128 bits: two XXH64 with different seeds), distinct
documents are counted per hash, and lines over the threshold are dropped in all documents but the
one with the largest id; what stays is reassembled by position.

Only hashes, ids and positions are shuffled for the counting and the join back; counts combine on
the map side, and the join is a plain equi-join whose hot keys adaptive execution can split.

Defined cases: a null or empty text is one empty line. Every row is a document, also where an id
repeats. A null id counts as smaller than any other. Lines that repeat within a document count it
once, and all of them go or stay together. An empty table gives an empty result. Other columns are
kept by `dedup_lines` and ignored for the decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import SPACE, ascii_lower, written

MIN_CHARS, MIN_DOCS = 40, 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def with_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with `_lines` (all lines) and `_drop` (positions to drop, null for none)."""
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text")).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    found = keyed.select("_k", "_id", F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line")).filter(F.char_length("_line") >= min_chars)
    found = found.select("_k", "_id", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.char_length("_key") >= min_chars)
    lines = found.select("_k", "_id", "_pos", *hashes(F.col("_key")))
    long_lines = F.filter(lines_of(F.col("text")), lambda x: F.char_length(x) >= min_chars)
    once = keyed.select("_id", F.explode(F.array_distinct(F.transform(long_lines, line_key))).alias("_key")).filter(F.char_length("_key") >= min_chars)
    common = once.select("_id", *hashes(F.col("_key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("_last")).filter(F.col("n") >= min_docs)
    common = written(common.drop("n"), "common-lines")  # a join of two plain shuffles, so that a very common line can be split
    drops = lines.join(common, ["h1", "h2"]).filter("_id <> _last").groupBy("_k", "_id").agg(F.collect_set("_pos").alias("_drop"))
    return keyed.join(drops, ["_k", "_id"], "left").drop("_k", "_id").withColumn("_lines", lines_of(F.col("text")))


def kept_text() -> Column:
    """Reassembles the kept lines in order; positions are removed by hash, not by search."""
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    return F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the common lines gone from `text`, and the columns n_lines and n_dropped."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    packed = docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))  # out of reach of name clashes
    out = with_drops(packed, min_chars, min_docs)
    dropped = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long")
    return out.select("doc_id", kept_text().alias("text"), *[F.col("_rest").getField(c).alias(c) for c in rest], F.size("_lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"))
