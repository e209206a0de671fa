"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of 13 consecutive item words (an item with fewer is one window). For
each window length there is a shift table over blocks of two words, which says how far the search
may jump, buckets of windows by their last block, and a direct comparison of the whole window.

Bounds: the benchmark is cut into blocks of rows of at most ``block_chars`` characters by the
running sum of their lengths (an item longer than that is a block of its own). One block's tables at a
time are built and broadcast, some 115 bytes for each character, so about 230 MB for a full block; every document is
searched for each block, in a job of its own. With several blocks the documents are written once, each
block's hits are written by row, and the rows meet their hits in the end.

Defined cases: null and empty texts have no words, hence no windows and no hits. Repeated items
count as one id each time the id differs; equal windows of several items count for all of them. An
empty benchmark hits nothing, an empty table gives an empty result. A null doc_id is carried along;
items with a null id are ignored. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import texts, written

WIDTH = 13
#: A-Z to lower case, all ASCII that is no letter or digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class WuManber:
    """Finds all occurrences of word windows of one length."""

    def __init__(self, width: int, windows: dict[tuple[int, ...], set]):
        self.width, self.block = width, min(2, width)
        self.jump = width - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, width + 1):
                key = self.key(window, end)
                self.shift[key] = min(self.shift.get(key, self.jump), width - end)
            self.buckets[self.key(window, width)][window] = items

    def key(self, ids, end: int) -> int:
        """The block that ends before position end."""
        return ids[end - 1] if self.block == 1 else ids[end - 2] << 32 | ids[end - 1]

    def search(self, ids: list[int]) -> Iterator[tuple[int, set]]:
        """(start, items) of each occurrence. Id 0 stands for all words that no item has."""
        end, n, shift, jump, width, two = self.width, len(ids), self.shift.get, self.jump, self.width, self.block == 2
        while end <= n:
            key = ids[end - 2] << 32 | ids[end - 1] if two else ids[end - 1]
            by = shift(key, jump)
            if by:
                end += by
                continue
            items = self.buckets[key].get(tuple(ids[end - width : end]))
            if items is not None:
                yield end - width, items
            end += 1


class Searcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        groups: dict[int, dict] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            w = min(width, len(ids))
            for s in range(len(ids) - w + 1 if w else 0):
                groups[w][ids[s : s + w]].add(item)
        self.engines = [WuManber(w, g) for w, g in sorted(groups.items())]

    def hits(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged hit ranges (end exclusive), items found."""
        words = words_of(text)
        ids = [self.vocabulary.get(w, 0) for w in words]
        spans, found = [], set()
        for engine in self.engines:
            for start, items in engine.search(ids):
                spans.append((start, start + engine.width))
                found |= items
        return len(words), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size, each small enough for the driver and a broadcast."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").dropna().toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def summary(n: int, spans: list[tuple[int, int]], items: set) -> tuple:
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = sum(e - s for s, e in spans)
    return n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= n


FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = 2_000_000, only_clean: bool = False) -> DataFrame:
    """One row per row of docs with FIELDS; or, with only_clean, the rows of docs that are not contaminated."""
    blocks = _blocks(benchmark, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        return _in_blocks(docs, first, second, blocks, only_clean)
    shared = docs.sparkSession.sparkContext.broadcast(Searcher(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [summary(*shared.value.hits(t)) for t in texts(batch)]
            if only_clean:
                yield batch.filter(pa.array([not r[-1] for r in rows], pa.bool_()))
            else:
                yield _arrow([batch.column(0).cast(pa.int64())], ["doc_id"], rows)

    if only_clean:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {FIELDS}")


def _arrow(arrays: list, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*names, *(x.split()[0] for x in FIELDS.split(", "))])


def _in_blocks(docs: DataFrame, first, second, more, only_clean: bool) -> DataFrame:
    """Several blocks, one job for each: what it finds is written by row, and its tables are given up before the next ones are built."""
    spark = docs.sparkSession
    key, spans, items = (next(n for n in (f"_{name}{i}" for i in count()) if n not in docs.columns) for name in ("row", "spans", "items"))
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "documents")
    found, schema = [], f"{key} long, {spans} array<long>, {items} array<string>"
    for block in chain([first, second], more):
        shared = spark.sparkContext.broadcast(Searcher(block))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(k, *shared.value.hits(t)[1:]) for k, t in zip(batch.column(0).to_pylist(), texts(batch))]
                hits = [(k, [x for s in where for x in s], sorted(ids)) for k, where, ids in hits if where]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))], names=[key, spans, items])

        found.append(written(rows.select(key, "text").mapInArrow(search, schema), "hits"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_distinct(F.flatten(F.collect_list(items))).alias(items))
    joined = rows.join(every, key, "left").drop(key)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (spans, items)}
            out = [summary(len(words_of(t)), merged(list(zip((s or [])[::2], (s or [])[1::2]))), set(i or [])) for t, s, i in zip(texts(batch), at[spans], at[items])]
            if only_clean:
                yield batch.drop_columns([spans, items]).filter(pa.array([not r[-1] for r in out], pa.bool_()))
            else:
                yield _arrow([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())], ["doc_id"], out)

    return joined.mapInArrow(end, docs.schema if only_clean else f"doc_id long, {FIELDS}")
