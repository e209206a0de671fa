"""Quality rules: countable faults of each document, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word and word-pair buckets are counted: one over a trusted target
(labelled documents of good quality that are not toxic), one over the whole raw corpus. A
document's score is the mean over its n-grams of log p_target - log p_raw; one threshold decides
for every document.

Bounds: the buckets are fixed in number, so the counts that reach the driver are too. The trusted
target and the documents that fit the threshold are bounded samples of labelled rows
(``max_labelled`` of each kind, the smallest by hash of the id); the raw counts cover all rows.

Defined cases: a null or empty text has no words and fails (fewer than 20). A null doc_id is kept
as it is and is never a labelled row. Repeated rows are judged each, and alike. Without labels of
either kind no threshold can be fitted and the ratio rejects nothing. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import SPACE, texts

TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Model:
    """ratio[bucket] = log p_target - log p_raw; documents below the threshold are rejected."""

    ratio: np.ndarray
    threshold: float


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the document, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    window = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    repeats = np.flatnonzero(counts[inverse] > 1)
    if not len(repeats):
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, repeats, 1)
    np.add.at(edge, repeats + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = repeated_words(words)
    return (n, len(text) - sum(text.count(c) for c in SPACE), sum(map(raw.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, n < 20 or 100 * repeats > 30 * n)


def buckets(text: str, bits: int) -> np.ndarray:
    """The bucket of every token and of every pair of neighbouring tokens."""
    tokens = TOKEN.findall(text.encode().lower())
    h = np.fromiter(map(crc32, tokens), dtype=np.uint64, count=len(tokens))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def llr(text: str, ratio: np.ndarray) -> float:
    """The length-normalised log-likelihood ratio; 0 for a text without tokens."""
    b = buckets(text, len(ratio).bit_length() - 1)
    return float(ratio[b].mean()) if len(b) else 0.0


def _labelled(labels: DataFrame, good: bool, most: int) -> DataFrame:
    """A bounded sample of label rows: the smallest by hash, so the same rows on every run."""
    trusted = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = labels.filter(trusted if good else F.col("quality") == 0).select("doc_id").dropna().distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, bits: int = 16, max_labelled: int = 20_000, lost: float = 50.0) -> Model:
    """Counts both multinomials and fits the threshold.

    lost: how many caught bad documents one lost good document weighs in the choice of threshold.
    """
    spark, size = docs.sparkSession, 1 << bits
    ordered = [r[0] for r in _labelled(labels, True, max_labelled).collect()]
    good, held_out = frozenset(ordered[::2]), frozenset(ordered[1::2])  # the threshold is fitted on rows the target has not seen
    bad = frozenset(r[0] for r in _labelled(labels, False, max_labelled).collect()) - good - held_out
    if not good or not held_out or not bad:
        return Model(np.zeros(size), -np.inf)
    trusted = spark.sparkContext.broadcast(good)  # at most max_labelled ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch)):
                got = np.bincount(buckets(text, bits), minlength=0)
                raw[: len(got)] += got
                if key in trusted.value:
                    target[: len(got)] += got
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    summed = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size), np.zeros(size)
    for r in summed.toLocalIterator():  # at most 2**bits rows
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.sum():
        return Model(np.zeros(size), -np.inf)
    ratio = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    shared, checked = spark.sparkContext.broadcast(ratio), spark.sparkContext.broadcast(held_out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(llr(t, shared.value), k in checked.value) for k, t in zip(batch.column(0).to_pylist(), texts(batch)) if not base_counts(t)[-1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.float64()), pa.array([x[1] for x in kept], pa.bool_())], names=["llr", "good"])

    ids = spark.createDataFrame([(x,) for x in sorted(held_out | bad)], "doc_id long")
    seen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(score, "llr double, good boolean").toPandas()
    return Model(ratio, _threshold(seen["llr"].to_numpy(), seen["good"].to_numpy().astype(bool), lost))


def _threshold(scores: np.ndarray, good: np.ndarray, lost: float) -> float:
    """The cut with the most caught bad rows less `lost` times the good rows below it; the middle of its gap."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    gain = np.concatenate([[0.0], np.cumsum(np.where(g, -lost, 1.0))])
    open_at = np.concatenate([[True], s[1:] > s[:-1], [True]])  # no cut between equal scores
    k = int(np.argmax(np.where(open_at, gain, -np.inf)))
    return -np.inf if k == 0 else float(np.nextafter(s[-1], np.inf) if k == len(s) else (s[k - 1] + s[k]) / 2)


def quality_rules(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: the counts, the ratio and the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in STATS.split(",")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [(*base_counts(t), llr(t, m.ratio)) for t in texts(batch)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            arrays = [pa.array(c, pa.bool_() if n == "base_failed" else pa.int64()) for n, c in zip(names[1:], columns)]
            verdict = pa.array([not r[5] and r[6] >= m.threshold for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays, verdict, pa.array(columns[6], pa.float64())], names=[*names, "kept", "llr"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, f"{STATS}, kept boolean, llr double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not base_counts(t)[-1] and llr(t, m.ratio) >= m.threshold for t in texts(batch)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
