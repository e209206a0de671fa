"""Alignment of two tokenizers' tokens over the same bytes.

A task encodes texts with both tokenizers to ids and byte ends, and nothing else; groups, links and counts are
Spark's higher-order functions, joins and sums. Byte offsets at which tokens of both end
(array_intersect of the end arrays) cut the tokens into groups. Which token holds a byte is a look-up in an
array with an entry per byte (each token's number repeated over its bytes), so everything is linear in the text:
a group's tokens are those from one cut to the next, and a token of A is linked to the sequence of B's tokens
from that of its first byte to that of its last.

Neither tokenizer merges across the place between a character that is no white space and a blank. A blank and what
follows it up to the next such place is a unit: tokens of both end where it ends. So texts are encoded, and groups and links
built, once for each distinct unit of a run of texts, and a text has those of its units one after another.

Counts of id pairs are bounded by both vocabularies. Pairs that hold at least one in `most_broadcast` of
all links number at most that many; they are broadcast. All others are joined by a shuffle, in
which no pair can be common. Each row's sums of both meet again by row number.

Defined cases: null and empty texts, and those whose tokens of A or B don't give back the bytes of the
blank and the text (one that holds U+2581, say) have no tokens: all counts zero, no groups. Repeated
rows are counted each. A null doc_id is kept. Very long texts are encoded alone. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import shared_folder, slices, written
from pitchside.llm.tokens import ALPHABET

SLICE = 4_000_000  # bytes of text that are encoded at once; a longer text is alone
LONG = 1000  # characters without a blank that go to the tokenizer that takes no longer for long ones
MOST_BROADCAST = 400_000  # pairs, some 20 MB of a look-up table
#: The public pattern by which byte-level BPE cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AFTER_SIGN = re.compile(r"(?<=\S) ")


class Both:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.path_a, self.b = path_a, sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {chr(c): b for b, c in ALPHABET.items()} | {chr(b): b for b in range(256) if b not in ALPHABET}
        with open(path_a) as f:
            vocabulary = json.load(f)
        special = {t["content"] for t in vocabulary["added_tokens"]}
        ranks = {bytes(byte[c] for c in entry): i for entry, i in vocabulary["model"]["vocab"].items() if entry not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        of_a = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            of_a[i] = x
        self.bytes = of_a, of_b
        self.sizes = tuple(np.array([len(x) for x in of], dtype=np.int32) for of in self.bytes)

    @cached_property
    def slow_a(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path_a)
        found.encode_special_tokens = True
        return found

    def _a(self, unit: str) -> list[int]:
        return self.a.encode_ordinary(" " + unit) if len(unit) <= LONG else self.slow_a.encode(" " + unit, add_special_tokens=False).ids

    def _all_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all units, and where each unit's start. Units that end in a sign are encoded as one text, others one by one."""
        alone = [i for i, u in enumerate(units) if len(u) > LONG or not u or u[-1].isspace()]
        flat, counts, at = [], [], 0
        for i in [*alone, len(units)]:
            if i > at:
                joined = self.a.encode_ordinary(" " + " ".join(units[at:i]))
                bounds = np.cumsum(np.fromiter((1 + len(u.encode()) for u in units[at:i]), dtype=np.int64, count=i - at))
                total = np.cumsum(self.sizes[0][joined], dtype=np.int64)
                ends = np.searchsorted(total, bounds) + 1
                flat.append(joined)
                counts += np.diff(ends, prepend=0).tolist()
            if i < len(units):
                flat.append(self._a(units[i]))
                counts.append(len(flat[-1]))
            at = i + 1
        return np.concatenate([*(np.array(f, dtype=np.int32) for f in flat), np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)

    def _all_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lone = [self.b.piece_to_id("▁")]  # the blank alone, for which an empty text would get nothing
        ids = [x if u else lone for x, u in zip(self.b.encode(units, num_threads=1), units)]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))]).astype(np.int64)
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=starts[-1]), starts

    def encode(self, units: list[str], step: int = 20_000) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For A and B: flat ids, byte ends within the blank and each unit, and where each unit's start; and whether both give back its bytes."""
        parts, goods = ([], []), [np.zeros(0, dtype=bool)]
        for at in range(0, len(units), step):
            some = units[at : at + step]
            want = [b" " + u.encode() for u in some]
            length, whole, good = np.fromiter(map(len, want), dtype=np.int64, count=len(want)), b"".join(want), np.ones(len(some), dtype=bool)
            for side, (flat, starts), of, size in zip(parts, (self._all_a(some), self._all_b(some)), self.bytes, self.sizes):
                total = np.concatenate([[0], np.cumsum(size[flat], dtype=np.int64)])
                good &= np.diff(total[starts]) == length
                if b"".join(map(of.__getitem__, flat.tolist())) != whole:  # some unit of these isn't given back
                    good &= np.array([b"".join(map(of.__getitem__, flat[i:j].tolist())) == w for i, j, w in zip(starts, starts[1:], want)], dtype=bool)
                side.append((flat, (total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))).astype(np.int32), np.diff(starts)))
            goods.append(good)
        out = []
        for side in parts:
            flat, ends, counts = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in side)]) for k in range(3))
            out.append((flat.astype(np.int32), ends.astype(np.int32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)))
        return out, np.concatenate(goods)

    def units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of all texts, each text's units in order, and where each text's start. An empty text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        found = split.flatten().dictionary_encode()
        index, distinct = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        index, count = index[np.repeat(full, count)], np.where(full, count, 0)
        # a piece that is empty or ends in white space doesn't end where the next blank begins: such texts are cut by a pattern
        units = distinct.to_pylist()
        odd = np.array([p == "" or p[-1].isspace() for p in units], dtype=bool)
        cut = np.zeros(len(count), dtype=bool)
        cut[np.repeat(np.arange(len(count)), count)[odd[index]]] = True
        if cut.any():
            number = {p: i for i, p in enumerate(units)}
            own = np.split(index, np.cumsum(count)[:-1])
            for i in np.flatnonzero(cut):
                own[i] = np.array([number.setdefault(p, len(number)) for p in AFTER_SIGN.split(texts[int(i)].as_py())], dtype=np.int64)
            units, index, count = list(number), np.concatenate(own), np.array([len(x) for x in own], dtype=np.int64)
        return units, index, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


_BOTH: dict[tuple[str, str], Both] = {}


def both(path_a: str, path_b: str) -> Both:
    """One per Python worker."""
    if (path_a, path_b) not in _BOTH:
        _BOTH[path_a, path_b] = Both(path_a, path_b)
    return _BOTH[path_a, path_b]


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each run of texts (SLICE bytes): `units`, array of (a, a_ends, b, b_ends), ids and byte ends of each distinct unit, and `texts`, array of (doc_id, n_a, n_b, units)."""
    schema = "units array<struct<a: array<int>, a_ends: array<int>, b: array<int>, b_ends: array<int>>>, texts array<struct<doc_id: long, n_a: long, n_b: long, units: array<int>>>"

    def listed(starts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = both(path_a, path_b)
        for batch in (s for b in batches for s in slices(b, SLICE)):
            units, of_text, starts = enc.units(batch.column(1))
            sides, good = enc.encode(units)
            fine = np.add.reduceat(np.append(~good[of_text], False), np.minimum(starts[:-1], len(of_text))) == 0 if len(batch) else np.zeros(0, dtype=bool)
            fine |= np.diff(starts) == 0
            keep = np.repeat(fine, np.diff(starts))  # a text with a unit that isn't given back has no tokens
            starts = np.concatenate([[0], np.cumsum(np.where(fine, np.diff(starts), 0))])
            fields = [listed(at, pa.array(x, pa.int32())) for ids, ends, at in sides for x in (ids, ends)]
            unit = pa.StructArray.from_arrays(fields, ["a", "a_ends", "b", "b_ends"])
            own = of_text[keep]
            sizes = [np.diff(np.concatenate([[0], np.cumsum(np.diff(at)[own])])[starts]) for _, _, at in sides]  # tokens of each text
            text = pa.StructArray.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in sizes), listed(starts, pa.array(own, pa.int32()))], ["doc_id", "n_a", "n_b", "units"])
            yield pa.RecordBatch.from_arrays([listed([0, len(units)], unit), listed([0, len(batch)], text)], names=["units", "texts"])
            del units, of_text, sides, unit, text, fields, keep, own
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def holders(ends: Column) -> Column:
    """For each byte the number of the token that holds it."""
    return F.flatten(F.transform(ends, lambda e, i: F.array_repeat(i, e - _before(ends, i, 0))))


def _before(values: Column, i: Column, none: int) -> Column:
    return F.when(i == 0, none).otherwise(F.get(values, i - 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _known(u: Column) -> Column:
    """What groups and links of a unit (a, a_ends, b, b_ends) are read from."""
    return F.struct(F.array_intersect(u.a_ends, u.b_ends).alias("cuts"), holders(u.a_ends).alias("in_a"), holders(u.b_ends).alias("in_b"))


def _links(u: Column, in_b: Column) -> Column:
    def of_token(end: Column, i: Column) -> Column:
        high, low, last = F.shiftleft(F.get(u.a, i).cast("long"), 32), F.get(in_b, _before(u.a_ends, i, 0)), F.get(in_b, end - 1)
        return F.when(low == last, F.array(high + F.get(u.b, low))).otherwise(F.transform(F.sequence(low, last), lambda j: high + F.get(u.b, j)))

    return F.flatten(F.transform(u.a_ends, of_token))


def _per_group(k: Column, body: Callable[[Callable, Callable], Column]) -> Column:
    """body(first and last token of A, those of B) for each group: the holders of its first and last bytes."""

    def one(cut: Column, i: Column) -> Column:
        ends = lambda holder: (F.get(holder, _before(k.cuts, i, 0)), F.get(holder, cut - 1))
        return body(ends(k.in_a), ends(k.in_b))

    return F.transform(k.cuts, one)


def aligned(u: Column) -> Column:
    """(groups, links) of a unit (a, a_ends, b, b_ends): arrays of (a, b), arrays of ids, and of A's id x 2^32 + B's id."""
    run = lambda ids, ends: F.transform(F.sequence(*ends), lambda j: F.get(ids, j))
    groups = lambda k: _per_group(k, lambda a, b: F.struct(run(u.a, a).alias("a"), run(u.b, b).alias("b")))
    return _let(_known(u), lambda k: F.struct(groups(k).alias("groups"), _links(u, k.in_b).alias("links")))


def unit_row(u: Column) -> Column:
    """(n_groups, line, links) of a unit; line: its groups as text."""

    def run(ids: Column, ends: tuple[Column, Column]) -> Column:
        first, last = ends
        text = lambda j: F.get(ids, j).cast("string")
        return F.when(first == last, text(last)).otherwise(F.array_join(F.transform(F.sequence(first, last), text), ","))

    lines = lambda k: F.array_join(_per_group(k, lambda a, b: F.concat(run(u.a, a), F.lit("|"), run(u.b, b))), ";")
    row = lambda n, line, links: F.struct(n.alias("n_groups"), line.alias("line"), links.alias("links"))
    # most often both cut a unit alike
    pairs = F.zip_with(u.a, u.b, lambda a, b: F.concat(a.cast("string"), F.lit("|"), b.cast("string")))
    alike = row(F.size(u.a), F.array_join(pairs, ";"), F.zip_with(u.a, u.b, lambda a, b: F.shiftleft(a.cast("long"), 32) + b))
    return F.when(u.a_ends == u.b_ends, alike).otherwise(_let(_known(u), lambda k: row(F.size(k.cuts), lines(k), _links(u, k.in_b))))


def text_rows(found: DataFrame) -> DataFrame:
    """One row per text of tokens(): doc_id, n_a, n_b, n_groups, groups_text, links. A text's groups are those of its units one after another."""

    def of_text(units: Column) -> Callable[[Column], Column]:
        def one(t: Column) -> Column:
            groups = F.aggregate(t.units, F.lit(0).cast("long"), lambda n, i: n + F.get(units, i).n_groups)
            line = F.array_join(F.transform(t.units, lambda i: F.get(units, i).line), ";")
            links = F.flatten(F.transform(t.units, lambda i: F.get(units, i).links))
            return F.struct(t.doc_id.alias("doc_id"), t.n_a.alias("n_a"), t.n_b.alias("n_b"), groups.alias("n_groups"), line.alias("groups_text"), links.alias("links"))

        return one

    rows = _let(F.transform("units", unit_row), lambda units: F.transform(F.col("texts"), of_text(units)))
    return found.select(F.inline(rows))


def written_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with a number of its own: counts, the hash of its groups as text, and links."""
    spark = docs.sparkSession
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.encode("groups_text", "UTF-8"), 256)).otherwise("")
    out = text_rows(tokens(docs, path_a, path_b)).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links")
    path = f"{shared_folder(spark)}/links-{uuid4().hex}"
    out.write.option("compression", "zstd").parquet(path)  # with that, row numbers stay
    return spark.read.schema(out.schema).parquet(path)


def pair_counts(rows: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(pair, n, best, common): links of each id pair, whether that is its B id's most, and whether it is one of at most `most_broadcast` common ones."""
    counts = written(rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(low.alias("b_id")).agg(F.max("n").alias("most"))  # one row for each id of B's vocabulary
    total = counts.agg(F.sum("n")).first()[0] or 0
    flagged = counts.withColumn("b_id", low).join(F.broadcast(most), "b_id")
    return written(flagged.select("pair", "n", (F.col("n") == F.col("most")).alias("best"), (F.col("n").cast("decimal(38,0)") * most_broadcast >= total).alias("common")), "pair-counts")


def alignment(docs: DataFrame, path_a: str, path_b: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    rows = written_links(docs, path_a, path_b)
    pairs = pair_counts(rows, most_broadcast)
    each = rows.select("row", F.explode("links").alias("pair"))
    looked_up = each.join(F.broadcast(pairs.filter("common").drop("common")), "pair", "left")
    sums = lambda f, times: f.agg(F.sum(F.col("best").cast("long") * times).alias("n_best"), F.sum(F.col("n") * times).alias("count_sum"))
    common = sums(looked_up.filter("n IS NOT NULL").groupBy("row"), F.lit(1))
    rare = written(looked_up.filter("n IS NULL").groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times")), "rare-links")
    rare = sums(rare.join(pairs.filter("NOT common"), "pair").groupBy("row"), F.col("times"))
    base = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256")
    found = common.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
