"""Byte-level BPE encoding of whole columns (problem 8), without a call per word.

A batch of texts becomes one code-point array. Class changes between neighbouring code points give the pre-token bounds
of the public pattern; every distinct pre-token of a slice (by a 64-bit multilinear hash and its length) is encoded once
and remembered by the worker. New pre-tokens form padded matrices, one per length bucket: in each round every row merges
its leftmost pair of minimum rank, found in an open-addressing hash table of pairs; rows that are finished leave the
matrix (compaction). Token ids are then gathered back by array indexing.

The vocabulary is a parameter: a file of base64 token and rank per line. The driver reads it (a fixed vocabulary of under
65,536 entries, about 1 MB) and broadcasts it; executors need no file.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forms import code_points

OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4
# The characters of the Unicode property White_Space, and the contractions of the public pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")
NONE = np.int32(2**31 - 1)
SLICE = 1 << 20  # code points handled at once
LONG_ROW = 512  # bytes from which a pre-token is merged by itself
REMEMBER = 400_000  # pre-tokens a worker remembers before it starts afresh


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, from the interpreter's Unicode data."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        cat = unicodedata.category(chr(cp))[0]
        if cat == "L":
            out[cp] = LETTER
        elif cat == "N":
            out[cp] = NUMBER
    out[WHITE] = BLANK
    out[0x20] = SPACE
    return out


def token_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start, as indexes into `points`."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, dtype=bool)
    head[bounds] = True  # first of a row; the end counts as one
    white = kind >= BLANK
    before = np.concatenate([[np.uint8(255)], kind[:-1]])
    white_before = np.concatenate([[False], white[:-1]])
    word_after = np.concatenate([~white[1:], [False]]) & ~head[1:]
    start = np.where(white, ~white_before | word_after, np.where(white_before, before != SPACE, before != kind))
    start |= head[:n]
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~head[quote + 1]]
    one = points[quote + 1]
    short = quote[np.isin(one, [ord(c) for c in SHORT])]
    rest = quote[(quote + 2 < n)]
    rest = rest[~head[rest + 2]]
    two = np.zeros(len(rest), dtype=bool)
    for a, b in LONG:
        two |= (points[rest + 1] == ord(a)) & (points[rest + 2] == ord(b))
    for at, size in ((short, 2), (rest[two], 3)):
        start[at + 1] = False
        after = at + size
        after = after[after < n]
        start[after[(kind[after] == LETTER) & ~head[after]]] = True
    return np.flatnonzero(start)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Encoder:
    """Encodes batches with one vocabulary."""

    def __init__(self, vocabulary: bytes):
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.single = np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, ranks = [], []
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 16 | b)
                    ranks.append(rank)
        self.bits = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, 2**32 - 1, dtype=np.uint32)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        self._fill(np.array(keys, dtype=np.uint32), np.array(ranks, dtype=np.int32))
        self.position = _mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
        self.forget()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 2**32 - 1
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]], self.ranks[slot[take]] = keys[take], ranks[take]
            left = np.ones(len(keys), dtype=bool)
            left[take] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.code = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where the pair never merges or one side is padding (-1)."""
        shape = a.shape
        a, b = a.ravel(), b.ravel()
        out = np.full(len(a), NONE, dtype=np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[open_].astype(np.uint32) << np.uint32(16) | b[open_].astype(np.uint32)
        slot = self._slot(key)
        while len(open_):
            there = self.keys[slot]
            hit = there == key
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != 2**32 - 1)
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def merged(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges the rows of a padded id matrix to the end: ids in row order, and each row's first place and number."""
        n = len(matrix)
        count = np.zeros(n, dtype=np.int32)
        done_rows, done_ids = [], []
        live, rank = np.arange(n), self.pair_rank(matrix[:, :-1], matrix[:, 1:])
        while len(live):
            at = np.arange(len(live))
            if rank.shape[1]:
                place = rank.argmin(axis=1)
                best = rank[at, place]
                over = best == NONE
            else:
                over = np.ones(len(live), dtype=bool)
            if over.any():
                done_rows.append(live[over])
                rows = matrix[over]
                count[live[over]] = (rows >= 0).sum(axis=1)
                done_ids.append(rows[rows >= 0])
                if over.all():
                    break
                keep = ~over
                live, matrix, rank, place, best = live[keep], matrix[keep], rank[keep], place[keep], best[keep]
                at = np.arange(len(live))
            matrix[at, place] = best
            width = matrix.shape[1] - 1
            cols = np.arange(width)
            matrix = np.take_along_axis(matrix, cols + (cols > place[:, None]), axis=1)
            cols = cols[: width - 1]
            rank = np.take_along_axis(rank, cols + (cols >= place[:, None]), axis=1) if width > 1 else rank[:, :0]
            if width > 1:
                left = np.flatnonzero(place > 0)
                rank[left, place[left] - 1] = self.pair_rank(matrix[left, place[left] - 1], matrix[left, place[left]])
                right = np.flatnonzero(place < width - 1)
                rank[right, place[right]] = self.pair_rank(matrix[right, place[right]], matrix[right, place[right] + 1])
        order = np.concatenate(done_rows)
        ids = np.concatenate(done_ids)
        first = np.zeros(n, dtype=np.int64)
        sizes = count[order]
        first[order] = np.cumsum(sizes) - sizes
        return ids, first, count

    def _merged_long(self, ids: np.ndarray) -> np.ndarray:
        """Merges one long row. All places of the minimum rank merge at once where no pair that arises ranks lower
        (then the order among them is of no effect), else only the leftmost."""
        rank = self.pair_rank(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
            new = ids.copy()
            new[at] = best
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            made = new[keep]
            whole = self.pair_rank(made[:-1], made[1:])
            left, right = at[at > 0], at[at + 2 < len(ids)]
            arising = [self.pair_rank(ids[left - 1], new[left]), self.pair_rank(new[right], ids[right + 2])]
            place = np.cumsum(keep)[at] - 1
            arising += [whole[place[place > 0] - 1], whole[place[place < len(whole)]]]
            if len(at) > 1 and min((a.min() for a in arising if len(a)), default=NONE) < best:
                first = at[0]
                made = np.concatenate([ids[:first], [best], ids[first + 2 :]]).astype(np.int32)
                whole = self.pair_rank(made[:-1], made[1:])
            ids, rank = made, whole
        return ids

    def _learn(self, hashes: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Encodes pre-tokens that are new to this worker."""
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own = points[np.repeat(start, size) + within]
        raw = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        wide = 1 + (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF)
        length = np.add.reduceat(wide, np.cumsum(size) - size)
        begin = np.cumsum(length) - length
        count, first = np.zeros(len(size), dtype=np.int32), np.zeros(len(size), dtype=np.int64)
        bucket = np.ceil(np.log2(length)).astype(np.int64)
        flats, base = [self.flat], len(self.flat)
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            if 1 << b > LONG_ROW:
                for r in rows:
                    ids = self._merged_long(self.single[raw[begin[r] : begin[r] + length[r]]])
                    first[r], count[r] = base, len(ids)
                    flats.append(ids)
                    base += len(ids)
                continue
            width = int(length[rows].max())
            for part in np.array_split(rows, max(1, len(rows) * width >> 20)):
                if not len(part):
                    continue
                cols = np.arange(width)
                there = cols < length[part][:, None]
                matrix = np.where(there, self.single[raw[np.minimum(begin[part][:, None] + cols, len(raw) - 1)]], -1).astype(np.int32)
                ids, f, c = self.merged(matrix)
                first[part], count[part] = f + base, c
                flats.append(ids)
                base += len(ids)
        code = len(self.count) + np.arange(len(size))
        self.flat = np.concatenate(flats)
        self.count, self.first = np.concatenate([self.count, count]), np.concatenate([self.first, first])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.code = known[order], np.concatenate([self.code, code])[order]

    def _codes(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remembered code of each pre-token of a slice, and where the rows begin among them."""
        start = token_starts(points, bounds)
        row_first = np.searchsorted(start, bounds)
        if not len(start):
            return start, row_first
        size = np.diff(np.append(start, len(points)))
        top = int(size.max())
        if top > len(self.position):
            self.position = _mixed(np.arange(1, 2 * top + 1, dtype=np.uint64)) | np.uint64(1)
        within = np.arange(len(points)) - np.repeat(start, size)
        terms = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        terms ^= terms >> np.uint64(29)
        terms *= self.position[within]
        hashes = _mixed(np.add.reduceat(terms, start) + size.astype(np.uint64))
        uniq, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.count) > REMEMBER:
            self.forget()
        new = np.ones(len(uniq), dtype=bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, uniq), len(self.known) - 1)
            new = self.known[at] != uniq
        if new.any():
            self._learn(uniq[new], points, start[index[new]], size[index[new]])
        return self.code[np.searchsorted(self.known, uniq)][inverse.ravel()], row_first

    def _slices(self, array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points, bounds = code_points(array.fill_null("") if array.null_count else array)
        lo, n = 0, len(bounds) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, side="right")) - 1)
            yield points[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            lo = hi

    def counts(self, array: pa.Array) -> pa.Array:
        """The number of tokens of each text; 0 for null and empty."""
        out = []
        for points, bounds in self._slices(array):
            codes, first = self._codes(points, bounds)
            sums = np.concatenate([[0], np.cumsum(self.count[codes], dtype=np.int64)]) if len(codes) else np.zeros(1, dtype=np.int64)
            out.append(np.diff(sums[first]))
        return pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int64), type=pa.int64())

    def encode(self, array: pa.Array) -> pa.Array:
        """The token ids of each text; an empty list for null and empty."""
        values, sizes = [], []
        for points, bounds in self._slices(array):
            codes, first = self._codes(points, bounds)
            c = self.count[codes].astype(np.int64) if len(codes) else np.zeros(0, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(c)])
            within = np.arange(int(ends[-1])) - np.repeat(ends[:-1], c)
            values.append(self.flat[np.repeat(self.first[codes], c) + within] if len(codes) else np.zeros(0, dtype=np.int32))
            sizes.append(np.diff(ends[first]))
        flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int32)
        size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value[:4096]) ^ len(shared.value)
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _plain(array):
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def _shared(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def token_ids(spark: SparkSession, text: str, vocabulary: str) -> Column:
    """Column of token ids (array<int>) of a string column; [] for null and for "". Special tokens are plain text."""
    shared = _shared(spark, vocabulary)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(array: pa.Array) -> pa.Array:
        return _encoder(shared).encode(_plain(array))

    return ids(F.col(text))


def token_count(spark: SparkSession, text: str, vocabulary: str) -> Column:
    """Column of the number of tokens (bigint) of a string column; 0 for null and for ""."""
    shared = _shared(spark, vocabulary)

    @F.arrow_udf(T.LongType())
    def size(array: pa.Array) -> pa.Array:
        return _encoder(shared).counts(_plain(array))

    return size(F.col(text))
