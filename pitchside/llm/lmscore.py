"""LM scoring: context-tree weighting of bytes, beside add-one word probabilities.

Documents with crc32(doc_id as text) mod 7 = 2 are held out; all others train.

1. Units (a word and the white space after it) are counted over all texts, combined on the map side; they give the
   words' counts, and the vocabulary grows with the corpus.
2. Texts are dealt to runs by hash (`run_bytes` each). Every byte of a text gives a cell (context, next byte), see `textcells`;
   a run's equal cells are summed up and go to the task of their bucket, which sums up those of all runs and writes them, with
   each run's as numbers among them. They are the leaves of the context tree, which grows with the corpus.
3. The tree stays on the executors. Subtrees below depth 4 are whole in one bucket each; the levels above
   are four small aggregations upward and four joins downward.
4. The bucket gives every cell its log probability, and each run gets those of its cells back, where a text's are summed up.
5. Within a run, buckets are taken in waves (`wave_bytes` of its bytes at once), which bounds memory. Step 4 is done for one half of
   the buckets after the other, so that half of the scores are on disk at once; each half reads the texts anew.
6. A text's base score is the sum over its units. At most ``hot_units`` of the most frequent units are
   broadcast for that, with their word counts; the others go through a join.

Nothing that grows is broadcast or sent to the driver, and no join key is frequent. A task of step 3 holds some buckets, each
with a few thousandths of the distinct cells at most.

The context of a byte is the eight bytes before it in its text, whatever words they are in. Units are looked up by 64 bits of
hash, texts are told apart by 128 bits.

Defined cases: a null or empty text is the end token alone (and the end byte). A null doc_id hashes
as an empty text. Repeated rows are scored each, and train each. Without training rows a word's
probability is 1/(0+1) and every bit's 1/2. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import textcells
from pitchside.llm.common import SPACE, slices, written
from pitchside.llm.contexttree import DEPTH, TOP, estimate, grown, log_probabilities

FOLDS, HELD = 7, 2
PASSES = 2  # a power of two: scores of one half of the buckets are on disk at once
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE.encode())] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def units(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased units of texts, where each text's units start (and the end), and each text's bytes with its end byte."""
    wide = pa.large_string()
    text = pc.binary_join_element_wise(pc.ascii_lower(column.fill_null("")).cast(wide), pa.scalar("\0", wide), pa.scalar("", wide))
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[: bounds[-1]] if len(text) else np.zeros(0, np.uint8)
    stop = IS_SPACE[data]
    stop[bounds[1:] - 1] = True
    offsets = np.concatenate([bounds[:1], np.flatnonzero(stop) + 1]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), text.buffers()[2]])
    return found.dictionary_encode(), np.searchsorted(offsets, bounds), np.diff(bounds)


def unit_ids(found: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found.to_pylist()), dtype=np.uint64, count=len(found)).view(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(unit, every, n): how often a unit is in all texts, and in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found, starts, _ = units(batch.column(1))
            at, size = found.indices.to_numpy(), len(found.dictionary)
            trains = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(starts))
            every, n = np.bincount(at, minlength=size), np.bincount(at[trains], minlength=size)
            yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.binary()), pa.array(every), pa.array(n)], names=["unit", "every", "n"])

    rows = docs.select((~held_out(F.col("doc_id"))).alias("trains"), "text").mapInArrow(run, "unit binary, every long, n long")
    return rows.groupBy("unit").agg(F.sum("every").alias("every"), F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(unit, every, n, is_word, count, first): units with their word's training count; first marks one of each word's at most seven forms."""
    size = F.octet_length("unit")
    forms = counted(docs).groupBy(F.expr("substring(unit, 1, octet_length(unit) - 1)").alias("word"))
    words = forms.agg(F.sum("n").alias("count"), F.collect_list(F.struct("unit", "every", "n")).alias("forms"))
    rows = words.select("count", F.posexplode("forms").alias("at", "form"))
    return rows.select("form.*", "count", (F.col("at") == 0).alias("first")).withColumn("is_word", size > 1)


#: The cells of a run in a bucket (cells, counts), or of all runs in it (run is null), or a run's numbers among those of all (steps).
PARTS = "bucket int, run int, size long, cells binary, counts binary, steps binary"
PART_TYPES = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()


def _rows(rows: list[tuple], types: Sequence[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in schema.split(", ")])


#: Shuffle files of a job go when it is done, not when the driver happens to collect its garbage.
CLEANING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Batches stay small whatever their rows are.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def in_runs(docs: DataFrame, runs: int) -> DataFrame:
    """Texts with the number of their run; a run is a partition."""
    return docs.withColumn("run", F.pmod("k1", F.lit(runs)).cast("int")).repartitionById(runs, F.col("run"))


def _taken(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The padded bytes of the batch's texts, and how many each has; nothing of the batch stays."""
    for s in slices(batch, 4_000_000):
        data, sizes = textcells.padded(s.column("text"))
        yield data.copy(), sizes


def parts(docs: DataFrame, runs: int, waves: int) -> DataFrame:
    """PARTS: the distinct cells of each run and bucket, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trains = [], []
        for batch in (b for b in batches if len(b)):
            number = batch.column("run")[0].as_py()
            trains.append(batch.column("trains").to_numpy(zero_copy_only=False))
            held.extend(_taken(batch))
        if not held:
            return
        trains = np.repeat(np.concatenate(trains), np.concatenate([sizes for _, sizes in held]))
        texts = textcells.Run([data for data, _ in held])
        del held
        for wave in range(waves):
            ctx, byte, n = textcells.counted(texts, trains, wave, waves)
            some = []
            for bucket, i, j in textcells.by_bucket(ctx):
                some.append((bucket, number, j - i, *textcells.packed(ctx[i:j], byte[i:j], n[i:j]), None))
                if len(some) == 500:
                    yield _rows(some, PART_TYPES, PARTS)
                    some = []
            yield _rows(some, PART_TYPES, PARTS)

    return in_runs(docs.select("k1", "trains", "text"), runs).mapInArrow(run, PARTS)


def batched(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """All rows of some buckets at once, with about so many cells (`size`). Rows are in order of bucket."""
    held, size = [], 0
    for batch in batches:
        while len(batch):
            bucket = batch.column("bucket").to_numpy()
            total = size + np.cumsum(batch.column("size").fill_null(0).to_numpy())
            last = held[-1].column("bucket")[-1].as_py() if held and size >= most else bucket[min(np.searchsorted(total, most), len(bucket) - 1)]
            cut = int(np.searchsorted(bucket, last, "right"))
            if cut == len(batch):
                held.append(batch)
                size = total[-1]
                break
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
    if held:
        yield pa.Table.from_batches(held)


def _by_size(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of rows with about so many cells together."""
    of = np.cumsum(batch.column("size").to_numpy()) // most
    yield from itertools.pairwise([*textcells.firsts(of).tolist(), len(of)])


def by_buckets(rows: DataFrame, some: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, batch_rows: int) -> DataFrame:
    """Applies a function to all rows of some buckets, several small ones at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batched(batches, batch_rows):
            yield from some(t)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _unpacked(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [textcells.unpacked(c, n) for c, n in zip(t.column("cells").to_pylist(), t.column("counts").to_pylist())]


def merged(rows: DataFrame, batch_rows: int) -> DataFrame:
    """PARTS: each bucket's distinct cells with their counts over all runs, and which of them each run has."""

    def some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ctx, byte, n, number = textcells.merged(_unpacked(t))
        own, start = [], {}
        for bucket, i, j in textcells.by_bucket(ctx):
            own.append((bucket, None, j - i, *textcells.packed(ctx[i:j], byte[i:j], n[i:j]), None))
            start[bucket] = i
        at = 0
        for bucket, run, size in zip(*(t.column(c).to_pylist() for c in ("bucket", "run", "size"))):
            own.append((bucket, run, size, None, None, textcells.packed_numbers(np.diff(number[at : at + size], prepend=start[bucket]))))
            at += size
        yield _rows(own, PART_TYPES, PARTS)

    return by_buckets(rows, some, PARTS, batch_rows)


NODES = "node long, heap long, zeros double, ones double, weighted double, own_share double, rest_share double"


def _weights(cells: DataFrame, batch_rows: int) -> DataFrame:
    """NODES for the bit nodes of depth TOP, from all runs' cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (b.slice(i, j - i) for b in batches for i, j in _by_size(b, batch_rows)):  # a row is a bucket; rows are in no order
            ctx, byte, n = (np.concatenate(x) for x in zip(*_unpacked(t)))
            levels, own_share, rest_share, weighted = grown(ctx, byte, n)
            top = levels[0]
            node = (ctx[top.first] >> np.uint64(8 * (DEPTH - TOP))).astype(np.int64)
            found = [node, top.heap(byte), top.zeros.astype(np.float64), top.ones.astype(np.float64), weighted, own_share[0], rest_share[0]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[x.split()[0] for x in NODES.split(", ")])

    return cells.filter("run IS NULL").select("bucket", "size", "cells", "counts").mapInArrow(run, NODES)


def _weighed(up: DataFrame) -> DataFrame:
    """NODES from (node, heap, zeros, ones, children): children is the sum of the log weighted probabilities below."""
    half = float(np.log(0.5))
    own = up.withColumn("own", estimate(F.col("zeros"), F.col("ones"), F.log))
    high, low = F.greatest("own", "children"), F.least("own", "children")
    out = own.withColumn("weighted", high + F.log1p(F.exp(low - high)) + half)
    shares = [F.exp(F.col(c) + half - F.col("weighted")).alias(name) for c, name in (("own", "own_share"), ("children", "rest_share"))]
    return out.select("node", "heap", "zeros", "ones", "weighted", *shares)


def _mixtures(top: DataFrame) -> DataFrame:
    """(node, heap, zero, one, rest) of the bit nodes of depth TOP: what depths 0 to TOP predict together, and what is left for the depths below."""
    levels = [top]
    for _ in range(TOP):
        below = levels[0].groupBy(F.shiftright("node", 8).alias("node"), "heap")
        levels.insert(0, written(_weighed(below.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))), "tree-level"))
    mixed = None
    for level in levels:
        own = [F.col("own_share") * (F.col(c) + 0.5) / (F.col("zeros") + F.col("ones") + 1) for c in ("zeros", "ones")]
        if mixed is None:
            mixed = level.select("node", "heap", own[0].alias("zero"), own[1].alias("one"), F.col("rest_share").alias("rest"))
            continue
        above = mixed.select(F.col("node").alias("parent"), "heap", "zero", "one", "rest")
        met = level.withColumn("parent", F.shiftright("node", 8)).join(above, ["parent", "heap"])
        zero, one = (F.col(c) + F.col("rest") * x for c, x in zip(("zero", "one"), own))
        mixed = met.select("node", "heap", zero.alias("zero"), one.alias("one"), (F.col("rest") * F.col("rest_share")).alias("rest"))
    return mixed


def _bucket(node: Column) -> Column:
    """textcells.bucket_of of a column, in steps that stay within 63 bits."""
    factor = F.lit(2654435761)
    low, high = node.bitwiseAND(F.lit(65535)) * factor, F.pmod(F.shiftright(node, 16) * factor, F.lit(65536))
    return F.shiftright(F.pmod(low + F.shiftleft(high, 16), F.lit(1 << 32)), 19).cast("int")


SCORES = "run int, bucket int, scores binary"
SCORE_TYPES = pa.int32(), pa.int32(), pa.binary()


def cell_scores(rows: DataFrame, nodes: DataFrame, batch_rows: int) -> DataFrame:
    """SCORES: for each run and bucket the log10 probability of each cell's byte in its context.

    rows: PARTS, as merged; nodes: bucket, node, heap, zero, one, rest.
    """
    of_node = ["node", "heap", "zero", "one", "rest"]

    def some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        above = t.filter(pc.is_valid(t.column("node")))
        own, of = t.filter(pc.is_valid(t.column("cells"))), t.filter(pc.is_valid(t.column("steps")))
        node, heap, *mixed = (above.column(c).to_numpy() for c in of_node)
        score = log_probabilities(*(np.concatenate(x) for x in zip(*_unpacked(own))), (node << 8 | heap, *mixed))
        sizes = own.column("size").to_pylist()
        start = dict(zip(own.column("bucket").to_pylist(), np.cumsum([0, *sizes]).tolist()))
        found = []
        for bucket, run, steps in zip(*(of.column(c).to_pylist() for c in ("bucket", "run", "steps"))):
            value = score[start[bucket] + np.cumsum(textcells.unpacked_numbers(steps))]
            found.append((run, bucket, textcells.packed_scores(value)))
            if len(found) == 500:
                yield _rows(found, SCORE_TYPES, SCORES)
                found = []
        yield _rows(found, SCORE_TYPES, SCORES)

    sized = F.when(F.col("run").isNull(), F.col("size")).alias("size")
    given = rows.select("bucket", "run", sized, "cells", "counts", "steps").unionByName(nodes, allowMissingColumns=True)
    return by_buckets(given, some, SCORES, batch_rows)


def text_scores(docs: DataFrame, scores: DataFrame, runs: int, waves: range) -> DataFrame:
    """(k1, k2, score): for each text the sum of its cells' scores in some waves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, of = [], [], {}
        for batch in batches:
            is_text = batch.column("bucket").is_null()
            if len(some := batch.filter(is_text)):
                keys.append(np.array([some.column(c).to_numpy() for c in ("k1", "k2")]))
                held.extend(_taken(some))
            some = batch.filter(pc.invert(is_text))
            of |= dict(zip(some.column("bucket").to_pylist(), some.column("scores").to_pylist()))
        if not held:
            return
        sizes = np.concatenate([sizes for _, sizes in held])
        texts = textcells.Run([data for data, _ in held])
        del held
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        score = np.zeros(len(sizes))
        for wave in waves:
            own = {b: textcells.unpacked_scores(x) for b, x in of.items() if b % waves.stop == wave}
            score += textcells.summed(texts, bounds, own, wave, waves.stop)
        yield pa.RecordBatch.from_arrays([*map(pa.array, np.concatenate(keys, axis=1)), pa.array(score)], names=["k1", "k2", "score"])

    rows = docs.select("k1", "k2", "text", F.pmod("k1", F.lit(runs)).cast("int").alias("run")).unionByName(scores, allowMissingColumns=True)
    return rows.repartitionById(runs, F.col("run")).mapInArrow(run, "k1 long, k2 long, score double")


def tree_scores(docs: DataFrame, n_bytes: int, run_bytes: int, wave_bytes: int, batch_rows: int) -> DataFrame:
    """(k1, k2, score): log10 probability of the bytes of all rows with these keys. docs: k1, k2, trains, text."""
    runs = max(1, -(-n_bytes // run_bytes))
    waves = max(PASSES, 1 << (-(-min(n_bytes, run_bytes) // wave_bytes) - 1).bit_length())
    cells = written(merged(parts(docs, runs, waves), batch_rows), "tree-cells")
    top = written(_weights(cells, batch_rows), "tree-level")
    nodes = written(_mixtures(top).withColumn("bucket", _bucket(F.col("node"))), "tree-nodes")
    found = []
    for p in range(PASSES):
        rows, own = (x.filter(F.col("bucket") % PASSES == p) for x in (cells, nodes))
        found.append(written(text_scores(docs, cell_scores(rows, own, batch_rows), runs, range(p, waves, PASSES)), "text-scores"))
    return reduce(DataFrame.unionByName, found).groupBy("k1", "k2").agg(F.sum("score").alias("score"))


def _frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most so many."""
    level = F.floor(F.log2(count) * 8)
    room, floor = most, None
    for r in rows.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 8 * 64 rows
        if r[1] > room:
            break
        room, floor = room - r[1], r[0]
    return rows.filter(level >= floor) if floor is not None else rows.limit(0)


def _columns(rows: DataFrame) -> dict[str, np.ndarray]:
    got = rows.toArrow()
    return {c: got.column(c).to_numpy() for c in got.column_names}


def unit_counts(words: DataFrame) -> DataFrame:
    """(id, every, known, base) of each unit: base is log10 of its word's count plus one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unit_ids(batch.column(0))), *batch.columns[1:]], names=["id", "every", "known", "base"])

    base = F.when(F.col("is_word"), F.log10(F.col("count") + 1.0)).otherwise(0.0)
    given = words.select("unit", "every", (F.col("is_word") & (F.col("count") > 0)).alias("known"), base.alias("base"))
    return given.mapInArrow(run, "id long, every long, known boolean, base double")


ROWS = "k1 long, k2 long, doc_id long, id long, times long, n_tokens long, n_known long, base double, n_bytes long"


def _lines(docs: DataFrame, hot: dict[str, np.ndarray]) -> DataFrame:
    """For each row its own line, and one for each of its units that is not hot. docs: k1, k2, doc_id, text."""
    order = np.argsort(hot["id"])
    shared = docs.sparkSession.sparkContext.broadcast({c: x[order] for c, x in hot.items()})
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in (s for b in batches for s in slices(b, 8_000_000)):
            found, starts, n_bytes = units(batch.column(3))
            at, ids, n = found.indices.to_numpy(), unit_ids(found.dictionary), len(batch)
            size = pc.binary_length(found.dictionary).to_numpy()
            if len(frequent["id"]):
                place = np.minimum(np.searchsorted(frequent["id"], ids), len(frequent["id"]) - 1)
                is_hot = frequent["id"][place] == ids
                known, base = (np.where(is_hot, frequent[c][place], 0) for c in ("known", "base"))
            else:
                is_hot, (known, base) = np.zeros(len(ids), dtype=bool), np.zeros((2, len(ids)))
            row = np.repeat(np.arange(n), np.diff(starts))
            total = lambda x: np.bincount(row, weights=x[at], minlength=n)
            cold = ~is_hot[at]
            pair, times = np.unique(row[cold] * len(ids) + at[cold], return_counts=True)
            m = len(pair)
            who = pa.array(np.concatenate([np.arange(n), pair // len(ids)]))
            own = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)])
            spread = batch.column(0).to_numpy()  # own lines join no unit; any number spreads them over the join's partitions
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(who) for c in (0, 1)),
                    pa.concat_arrays([batch.column(2), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([spread, ids[pair % len(ids)]])),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times.astype(np.int64))]),
                    own(total(size > 1).astype(np.int64) + 1, pa.int64()),
                    own(total(known).astype(np.int64), pa.int64()),
                    own(total(base), pa.float64()),
                    own(n_bytes, pa.int64()),
                ],
                names=names,
            )

    return docs.mapInArrow(run, ROWS)


def score_documents(docs: DataFrame, hot_units: int = 500_000, run_bytes: int = 32_000_000, wave_bytes: int = 4_000_000, batch_rows: int = 200_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    with settings(docs.sparkSession, CLEANING):
        return _scored(docs, hot_units, run_bytes, wave_bytes, batch_rows)


def _scored(docs: DataFrame, hot_units: int, run_bytes: int, wave_bytes: int, batch_rows: int) -> DataFrame:
    words = written(vocabulary(docs), "vocabulary")
    ends = F.col("n") * (F.expr("substring(unit, -1, 1)") == F.lit(b"\0")).cast("long")
    zero = F.lit(0)
    tokens, kinds, texts, n_bytes = words.agg(
        F.coalesce(F.sum(F.when(F.col("is_word"), F.col("n"))), zero),
        F.count(F.when(F.col("first") & F.col("is_word") & (F.col("count") > 0), 1)),
        F.coalesce(F.sum(ends), zero),
        F.coalesce(F.sum(F.col("every") * F.octet_length("unit")), zero),
    ).first()
    total, kinds = tokens + texts, kinds + (texts > 0)
    scored = written(unit_counts(words), "unit-counts")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with settings(docs.sparkSession, BATCHES):
        tree = tree_scores(keyed.withColumn("trains", ~held_out(F.col("doc_id"))), n_bytes, run_bytes, wave_bytes, batch_rows)
    lines = _lines(keyed, _columns(_frequent(scored, "every", hot_units).drop("every")))
    joined = lines.join(scored.select("id", F.col("known").alias("u_known"), F.col("base").alias("u_base")), "id", "left")
    own, times = F.col("times").isNull(), F.col("times")
    per = joined.groupBy("k1", "k2").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum(F.when(own, 1)).alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(own, F.col("n_known")).otherwise(times * F.col("u_known").cast("long"))).alias("n_known"),
        F.sum(F.when(own, F.col("base")).otherwise(times * F.col("u_base"))).alias("base"),
        F.max("n_bytes").alias("n_bytes"),
    )
    per = per.join(tree, ["k1", "k2"])
    # rows that repeat in id and text were summed up together
    out = per.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumns({c: F.col(c) / F.col("copies") for c in ("n_known", "base", "score")})
    end_known, end_base = int(texts > 0), float(np.log10(texts + 1.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.round("n_known").cast("long") + end_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - F.col("n_tokens") * float(np.log10(total + kinds + 1))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
