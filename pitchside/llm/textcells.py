"""Cells (context, next byte) of whole texts, run by run.

A run is some texts, each behind eight padding bytes and with an end byte, so that the context of every byte is the eight
bytes before it in its text, across words and lines. A cell belongs to the bucket of the nearest TOP bytes of its context; buckets hold
whole subtrees below depth TOP. Within a run and a bucket, cells are in order of context (nearest byte first) and next byte;
both who counts a run's cells and who looks up their scores go by that order, so scores come back without their cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pitchside.llm.contexttree import DEPTH, PAD

BUCKETS = 8192
STEP = 1 << 20
ZSTD = pa.Codec("zstd", 1)


def bucket_of(node: np.ndarray) -> np.ndarray:
    """The bucket of the nearest four bytes, as a number of 32 bits."""
    return (node.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(19)).astype(np.uint16)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of texts, each behind its padding and with its end byte, and how many each text has."""
    wide = pa.large_binary()
    text = pc.ascii_lower(column.fill_null("")).cast(pa.large_string()).cast(wide)
    joined = pc.binary_join_element_wise(pa.scalar(bytes([PAD]) * DEPTH, wide), text, pa.scalar(b"\0", wide), pa.scalar(b"", wide))
    bounds = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds)


class Run:
    """The bytes of a run's texts, the pair of bytes before each (by number, where few pairs occur), and its bucket."""

    def __init__(self, data: np.ndarray | list[np.ndarray]):
        self.data = data = np.concatenate(data) if isinstance(data, list) else data
        self.pair = np.zeros(len(data), dtype=np.uint16)  # the byte before and the one before that
        self.bucket = np.zeros(len(data), dtype=np.uint16)
        steps = [slice(i, min(i + STEP, len(data))) for i in range(2, len(data), STEP)]
        seen = np.zeros(65536, dtype=bool)
        for s in steps:
            self.pair[s] = data[s.start - 1 : s.stop - 1].astype(np.uint16) << np.uint16(8) | data[s.start - 2 : s.stop - 2]
            seen[self.pair[s]] = True
            self.bucket[s] = bucket_of(self.pair[s].astype(np.uint32) << np.uint32(16) | self.pair[s.start - 2 : s.stop - 2])
            self.bucket[s][data[s] == PAD] = BUCKETS
        self.bucket[:2] = BUCKETS
        seen[0] = True
        self.known = np.flatnonzero(seen).astype(np.uint64)
        self.by_pairs = len(self.known) ** 4 < 1 << 55
        if self.by_pairs:
            rank = np.zeros(65536, dtype=np.uint16)
            rank[seen] = np.arange(len(self.known))
            for s in steps:
                self.pair[s] = rank[self.pair[s]]

    def at(self, wave: int, waves: int) -> np.ndarray:
        """Places of the wave."""
        own = self.bucket & np.uint16(waves - 1) if waves & waves - 1 == 0 else self.bucket % np.uint16(waves)
        return np.flatnonzero((own == wave) & (self.bucket != BUCKETS)).astype(np.int32)

    def keys(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """A number of at most 63 bits for the cell at each place, in the order of cells; what `contexts` reads contexts from."""
        if self.by_pairs:
            size = np.uint64(len(self.known))
            code = self.pair[place].astype(np.uint64)
            for d in (2, 4, 6):
                code *= size
                code += self.pair[place - d]
            read = self.known, True
        else:  # too many different pairs of bytes: contexts are numbered one by one
            ctx = np.zeros(len(place), dtype=np.uint64)
            for d in (0, 2, 4, 6):
                ctx = ctx << np.uint64(16) | self.pair[place - d]
            distinct, code = np.unique(ctx, return_inverse=True)
            code, read = code.astype(np.uint64), (distinct, False)
        code <<= np.uint64(8)
        code |= self.data[place]
        return code, read

    @staticmethod
    def contexts(keys: np.ndarray, read: tuple[np.ndarray, bool]) -> np.ndarray:
        code, (known, by_pairs) = keys >> np.uint64(8), read
        if not by_pairs:
            return known[code]
        ctx, size = np.zeros(len(keys), dtype=np.uint64), np.uint64(len(known))
        for shift in (0, 16, 32, 48):
            code, low = np.divmod(code, size)
            ctx |= known[low] << np.uint64(shift)
        return ctx


def firsts(values: np.ndarray) -> np.ndarray:
    """Where sorted values begin to differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def counted(run: Run, trains: np.ndarray, wave: int, waves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, next bytes and training counts of the distinct cells of a wave, bucket by bucket. trains: for each byte of the run."""
    place = run.at(wave, waves)
    key, read = run.keys(place)
    key <<= np.uint64(1)
    key |= ~trains[place]
    key.sort()
    start = firsts(key >> np.uint64(1))
    cell = key[start] >> np.uint64(1)
    n = np.add.reduceat(~key & np.uint64(1), start).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    del key
    ctx, byte = run.contexts(cell, read), (cell & np.uint64(255)).astype(np.uint8)
    order = np.argsort(bucket_of(ctx >> np.uint64(32)), kind="stable")
    return ctx[order], byte[order], n[order]


def _squeezed(planes: np.ndarray) -> bytes:
    """Bytes by plane, compressed, behind their number and that of the planes."""
    return np.array(planes.shape, dtype="<u4").tobytes() + ZSTD.compress(np.ascontiguousarray(planes), asbytes=True)


def _planes(data: bytes) -> np.ndarray:
    width, size = np.frombuffer(data, dtype="<u4", count=2).tolist()
    return np.frombuffer(ZSTD.decompress(memoryview(data)[8:], decompressed_size=width * size), dtype=np.uint8).reshape(width, size)


def packed_numbers(n: np.ndarray) -> bytes:
    """Numbers that are not negative, byte by byte: all lowest bytes, then all second ones, which compresses well."""
    width = max(1, (int(n.max()).bit_length() + 7) // 8)
    return _squeezed(n.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width])


def unpacked_numbers(data: bytes) -> np.ndarray:
    planes = _planes(data)
    n = planes[0].astype(np.int64)
    for i in range(1, len(planes)):
        n |= planes[i].astype(np.int64) << (8 * i)
    return n


def packed(ctx: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Cells and counts, byte by byte of their numbers."""
    planes = np.empty((9, len(ctx)), dtype=np.uint8)
    planes[:8], planes[8] = ctx.astype(">u8").view(np.uint8).reshape(-1, 8).T, byte
    return _squeezed(planes), packed_numbers(n)


def unpacked(cells: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = _planes(cells)
    return np.ascontiguousarray(planes[:8].T).view(">u8").ravel().astype(np.uint64), planes[8], unpacked_numbers(counts)


def packed_scores(x: np.ndarray) -> bytes:
    """Doubles rounded to 36 bits behind the binary point of their mantissa, byte by byte."""
    bits = np.ascontiguousarray(x, dtype="<f8").view("<u8") + np.uint64(1 << 15)
    return _squeezed(bits.view(np.uint8).reshape(-1, 8).T[2:])


def unpacked_scores(data: bytes) -> np.ndarray:
    planes = _planes(data)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, 2:] = planes.T
    return out.view("<f8").ravel()


def by_bucket(ctx: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, start and end of each bucket's cells."""
    bucket = bucket_of(ctx >> np.uint64(32))
    start = firsts(bucket)
    yield from zip(bucket[start].tolist(), start.tolist(), np.append(start[1:], len(bucket)).tolist())


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of several runs, bucket by bucket in order, their counts summed up, and the number of each part's cell among them."""
    ctx, byte, n = (np.concatenate(x) for x in zip(*parts))
    top = ctx >> np.uint64(32)
    start = firsts(top)
    node = top[start]
    _, rank = np.unique(bucket_of(node).astype(np.uint64) << np.uint64(32) | node, return_inverse=True)
    key = np.repeat(rank.astype(np.uint64), np.diff(np.append(start, len(top)))) << np.uint64(40) | (ctx & np.uint64(0xFFFFFFFF)) << np.uint64(8) | byte
    order = np.argsort(key)
    first = firsts(key[order])
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return ctx[order[first]], byte[order[first]], np.add.reduceat(n[order], first), number


def summed(run: Run, bounds: np.ndarray, scores: dict[int, np.ndarray], wave: int, waves: int) -> np.ndarray:
    """The sum of scores of each text's cells in a wave. bounds: where texts start, and the end; scores: of each bucket's cells in order."""
    place = run.at(wave, waves)
    key, _ = run.keys(place)
    bucket = run.bucket[place]
    order = np.argsort(bucket, kind="stable")
    key, bucket = key[order], bucket[order]
    start = firsts(bucket)
    value = np.empty(len(key))
    for b, i, j in zip(bucket[start].tolist(), start.tolist(), np.append(start[1:], len(bucket)).tolist()):
        at = np.argsort(key[i:j])
        own = key[i:j][at]
        number = np.zeros(j - i, dtype=np.int64)
        np.cumsum(own[1:] != own[:-1], out=number[1:])
        if number[-1] + 1 != len(scores[b]):
            raise RuntimeError("a run of texts had other cells when it was counted")
        value[order[i:j][at]] = scores[b][number]
    return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(place, bounds))), weights=value, minlength=len(bounds) - 1)
