"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within 3 bits of each other are linked. Each distinct fingerprint emits the variants
of itself within half the radius (one bit or two), the variants are shuffled, and whoever meets at a
variant is linked: one that reaches it in at most one bit and any other are at most 3 apart.

Two rules keep the balls small without losing a link:

* Parity. Fingerprints 3 apart have different parity. The odd ones emit single-bit variants, the
  even ones two-bit variants; all fingerprints 2 apart meet by one bit or at one of the two.
* Halves. Of three differing bits two lie in the same half, so two-bit variants need only pairs
  within a half: 992 and not 2016. (Two even fingerprints that differ by one bit in each half meet
  at a single-bit variant.)

Before that, fingerprints without any possible partner are set aside: within 3 bits, one half
differs in at most one bit (half the radius, rounded down), so the two share a half with one bit
masked. Only fingerprints that share such a key with another emit their balls.

All fingerprints that meet at a variant are linked to its smallest one-bit member, so links grow
with the variants, not with pairs. A variant's members are distinct fingerprints within two bits,
at most 2081 of them, whatever the data. Exact copies are one fingerprint.

Defined cases: null and empty texts have fingerprint zero and link like any other. Repeated rows
and ties give equal fingerprints. A null doc_id never is a component's id unless all of its ids
are null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import per_document, spread, written
from pitchside.llm.components import components

SHINGLE, RADIUS, STEP = 3, 3, 1 << 18


def fingerprint(text: str) -> int:
    """64 bits as a signed long: a bit is set if over half of the shingles' hashes set it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):  # so that memory stays bounded for a very long text
        part = words[at : at + STEP + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= SHINGLE else [b" ".join(part)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    return per_document(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda key, text: (key, fingerprint(text)), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ONE_BIT = [_signed(1 << i) for i in range(64)]
TWO_BITS = [_signed(1 << i | 1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]


def crowded(fps: DataFrame) -> DataFrame:
    """Those of the distinct fingerprints (fp) that share a half, but for one bit, with another."""
    keys = spread(fps, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).selectExpr(
        "fp", "(CASE WHEN i < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END & ~shiftleft(1L, i % 32)) | shiftleft(CAST(i AS BIGINT), 32) AS key"
    )
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keys.join(shared, "key", "left_semi").select("fp").distinct()


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the radius."""
    even, odd = F.array(*map(F.lit, [0, *ONE_BIT, *TWO_BITS])), F.array(*map(F.lit, ONE_BIT))
    balls = spread(fps, "fp").select("fp", F.explode(F.when(F.expr("bit_count(fp) % 2 = 0"), even).otherwise(odd)).alias("mask")).selectExpr("fp", "fp ^ mask AS variant")
    met = balls.groupBy("variant").agg(
        F.min(F.when(F.expr("bit_count(fp ^ variant) <= 1"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("members")
    )
    met = met.filter("a IS NOT NULL AND size(members) > 1").select("a", F.explode("members").alias("b")).filter("a <> b").distinct()
    return met.filter(F.expr("bit_count(a ^ b)") <= RADIUS)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    members = components(ball_links(written(crowded(distinct.select("fp")), "crowded")))
    named = members.withColumnRenamed("node", "fp").join(distinct, "fp")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("low"))
    linked = named.select("fp", "component").join(lowest, "component").select("fp", "low")
    ids = distinct.join(linked, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id"))
    ids = written(ids, "component-ids")  # a join of two plain shuffles, so that a group of exact copies can be split
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs reduced to one document of each group: the one with the smallest id.

    Rows that repeat its id and text count as the same document. Groups in which no row has an id
    keep their different texts.
    """
    keep = near_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")), "left_semi").dropDuplicates(["doc_id", "text"])
