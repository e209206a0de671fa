"""Substring dedup: word windows of 35 words that start at two places or more lose their words.

Every window is a suffix cut off at depth 35. Suffixes are split into groups by prefix, and a tree
over each group has a node of that depth with two leaves or more wherever a window repeats.

1. Segments. Each window picks the smallest of its six-word hashes as its anchor (the rightmost of
   equal ones), a choice that depends on its words alone, so equal windows pick equal anchors at
   equal distances. Neighbouring windows with one anchor form a segment of at most 30 windows.
2. Segments whose anchor occurs once in the corpus are done: nothing repeats there. Segments that
   equal another one word for word are done as well: all their windows repeat.
3. What is left are anchors with several different segments. One copy of each segment goes, with its
   words, to the group of its prefix: the anchor or, where an anchor has more segments than fit
   into memory, the full 35 words of each window (``group_segments``). Groups of the first kind are
   sorted into truncated suffix trees by prefix doubling; those of the second kind are single paths,
   whose leaves are counted with a map-side combine.
4. The windows found return to all copies of their segments, and from there to the documents.

Only hashes and positions are shuffled for all segments; words only for those of step 3.
Segments are compared by 128 bits of hash (anchor and content).

Defined cases: null and empty texts have no words. Each row is a document, also where ids or whole
rows repeat, so the windows of a repeated row repeat. A null doc_id is kept. A text of fewer than
35 words has no window. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import chunks, slices, written

WIDTH, GRAM = 35, 6
SPAN = WIDTH - GRAM + 1  # grams in a window; a segment has at most so many windows
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Hash of each word, where each text's words start, the distinct words, and each word's number."""
    index, words, starts = chunks(column)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    return h[index], starts, words, index


def rolling(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of `width` hashes."""
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for j in range(width):
        out = out * base + h[j : j + len(out)]
    return mix(out)


def segments(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and content hash of each segment of one document's word hashes."""
    n = len(h) - WIDTH + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    gram = rolling(h, GRAM, B1)
    at, reach = np.arange(len(gram)), 1
    while 2 * reach <= SPAN:  # at[i]: the smallest of `reach` grams from i, the rightmost of equal ones
        left, right = at[:-reach], at[reach:]
        at, reach = np.where(gram[right] <= gram[left], right, left), 2 * reach
    left, right = at[:n], at[SPAN - reach : SPAN - reach + n]
    at = np.where(gram[right] <= gram[left], right, left)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, n))
    # a hash of words first .. first+count+WIDTH-2, by prefix sums of a polynomial
    power = np.cumprod(np.full(len(h), B2, dtype=np.uint64))
    inverse = np.uint64(pow(int(B2), -1, 1 << 64))
    down = np.cumprod(np.full(len(h), inverse, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * power)])
    content = mix((total[first + count + WIDTH - 1] - total[first]) * down[first]) ^ mix(count.astype(np.uint64))
    return first, count, gram[at[first]].view(np.int64), content.view(np.int64)


KEYS = "k1 long, k2 long"
SEGMENT = f"{KEYS}, place long, anchor long, content long"  # place: first window * 32 + number of windows


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with what tells rows apart: 128 bits of hash of both (equal rows share a key and what is found for it)."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def all_segments(docs: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            h, starts, _, _ = word_hashes(batch.column(2))
            found = [segments(h[starts[i] : starts[i + 1]]) for i in range(len(batch))]
            each = np.array([len(f[0]) for f in found], dtype=np.int64)
            cat = [np.concatenate([f[k] for f in found]) for k in range(4)]
            rows = np.repeat(np.arange(len(batch)), each)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(cat[0] * 32 + cat[1]), pa.array(cat[2]), pa.array(cat[3])], names=names)

    return docs.select("k1", "k2", "text").mapInArrow(run, SEGMENT)


def segment_words(docs: DataFrame, chosen: DataFrame, deep: bool) -> DataFrame:
    """The words of chosen segments (k1, k2, place, anchor, content); with deep, a hash of each of their windows."""
    lists = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "anchor", "content")).alias("segments"))
    joined = docs.join(lists, ["k1", "k2"]).select("text", "segments")
    schema = "anchor long, content long, nth int, w1 long, w2 long" if deep else "anchor long, content long, n int, words string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            out = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().split()
                for x in found:
                    first, n = divmod(x["place"], 32)
                    part = words[first : first + n + WIDTH - 1]
                    if deep:
                        both = [xxhash.xxh3_128_intdigest(b" ".join(part[j : j + WIDTH])) for j in range(n)]
                        out += [(x["anchor"], x["content"], j, *np.array([v & (2**64 - 1), v >> 64], dtype=np.uint64).view(np.int64).tolist()) for j, v in enumerate(both)]
                    else:
                        out.append((x["anchor"], x["content"], n, b" ".join(part).decode()))
            types = [pa.int64(), pa.int64(), pa.int32(), *([pa.int64(), pa.int64()] if deep else [pa.string()])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=[x.split()[0] for x in schema.split(", ")])

    return joined.mapInArrow(run, schema)


def tree_masks(n: np.ndarray, words: pa.Array) -> np.ndarray:
    """For each segment of a group, a bit for each of its windows: set if the window starts elsewhere in the group too.

    Prefix doubling: the rank of a suffix cut at depth 2d is that of the pair of its ranks at depth
    d. Equal ranks at depth 35 are the leaves below one node of that depth.
    """
    index, _, starts = chunks(words)
    rank, depth = index.astype(np.int64), 1
    starts, size = starts[:-1], len(index)

    def deepen(rank: np.ndarray, by: int) -> np.ndarray:
        later = np.full(size, -1, dtype=np.int64)
        later[: size - by] = rank[by:]
        return np.unique(rank * (size + 1) + later + 1, return_inverse=True)[1].reshape(-1)

    while 2 * depth <= WIDTH:
        rank, depth = deepen(rank, depth), 2 * depth
    rank = deepen(rank, WIDTH - depth)
    owner = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    nodes = rank[starts[owner] + nth]  # suffixes that start a window; runs into the next segment are not among them
    _, inverse, leaves = np.unique(nodes, return_inverse=True, return_counts=True)
    masks = np.zeros(len(n), dtype=np.int64)
    np.bitwise_or.at(masks, owner, np.where(leaves[inverse.reshape(-1)] > 1, np.int64(1) << nth, 0))
    return masks


def tree_groups(found: DataFrame, batch_words: int = 2_000_000) -> DataFrame:
    """(anchor, content, mask) of segments with their words. Groups of an anchor are never split; small ones share a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def grown(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            column = rows.column("words").chunk(0) if len(rows) else pa.array([], pa.string())
            masks = tree_masks(rows.column("n").to_numpy().astype(np.int64), column) if len(rows) else np.zeros(0, np.int64)
            a, c = (rows.column(x).to_numpy() for x in ("anchor", "content"))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(masks)], names=["anchor", "content", "mask"])

        held_rows = 0
        for batch in batches:
            held.append(batch)
            held_rows += len(batch)
            if held_rows * WIDTH < batch_words:
                continue
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchors, anchors[-1]))  # sorted by anchor: the last group may go on
            if whole:
                yield grown(rows.slice(0, whole))
            rest = rows.slice(whole)
            held, held_rows = rest.to_batches(), len(rest)
        if held:
            yield grown(pa.Table.from_batches(held))

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, content long, mask long")


def window_masks(docs: DataFrame, group_segments: int = 20_000) -> DataFrame:
    """(k1, k2, found): the segments (place, mask) of each row key with repeated windows. docs: keyed."""
    rows = all_segments(docs)
    # what joins look up is written first: joins of two plain shuffles, so that a very common anchor can be split
    twice = written(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    shared = written(rows.join(twice, "anchor", "left_semi").select(*[x.split()[0] for x in SEGMENT.split(", ")]), "segments")
    kinds = written(shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "place")).alias("one")), "segment-kinds")
    groups = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "anchor-kinds")
    chosen = written(kinds.join(groups, "anchor").select("one.*", "anchor", "content", (F.col("kinds") > group_segments).alias("deep")), "branching")
    trees = tree_groups(segment_words(docs, chosen.filter("NOT deep"), deep=False))
    if chosen.filter("deep").isEmpty():
        masks = trees
    else:  # prefixes of full length: each group is one path
        leaves = written(segment_words(docs, chosen.filter("deep"), deep=True), "deep-suffixes")
        paths = leaves.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("leaves")).filter("leaves > 1").select("w1", "w2")
        masks = trees.union(leaves.join(paths, ["w1", "w2"]).groupBy("anchor", "content").agg(F.sum(F.expr("shiftleft(1L, nth)")).alias("mask")))
    seen = kinds.join(masks, ["anchor", "content"], "left")
    verdict = seen.select("anchor", "content", F.when(F.col("copies") > 1, -1).otherwise(F.coalesce("mask", F.lit(0))).cast("long").alias("mask")).filter("mask <> 0")
    hits = shared.join(written(verdict, "verdicts"), ["anchor", "content"])
    return hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "mask")).alias("found"))  # a set, as repeated rows share a key


def removed(n_words: int, found: list[tuple[int, int]]) -> np.ndarray:
    """Which words lie in a repeated window."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for place, mask in found:
        first, n = divmod(place, 32)
        at = first + np.array([j for j in range(n) if mask >> j & 1], dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WIDTH, -1)
    return np.cumsum(edge)[:-1] > 0


def drop_repeats(docs: DataFrame, group_segments: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_removed, text): what is left of each row, words joined by one space."""
    rows = keyed(docs)
    joined = rows.join(window_masks(rows, group_segments), ["k1", "k2"], "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            out = []
            for key, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = (text or "").encode().split()
                gone = removed(len(words), [(x["place"], x["mask"]) for x in found or []])
                kept = b" ".join([w for w, x in zip(words, gone) if not x] if found else words)
                out.append((key, len(words), int(gone.sum()), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int64()] * 3 + [pa.string()])], names=["doc_id", "n_words", "n_removed", "text"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")

