"""Same or near-same records across splits (problem 1).

Two records are near-same if all words of the longer one but one in ONE_IN (rounded up) stand in both, counted as often as
they occur; the fold of `words` is applied, and order doesn't matter. The search is by hashes of word n-grams and loses no
near-same pair:

1. One scan of the texts gives each record its class (a 128-bit hash of its bag of words) and the hashes of its words. The
   distinct classes are written in blocks; everything later reads these, never the texts again.
2. Among as many of the rarest words of either record as may be missing, and k more, k at least are common (in any order of
   words that all records share). These words are dealt by hash into k - 1 buckets, so that two common words at least meet
   in one of them: the n-grams are the pairs of words of a bucket, in order of rarity (as the order of sentences must not
   matter, they are not neighbours in the text). k follows the length, so that the number of n-grams is in proportion to
   it; records near a step of k have the n-grams of both steps.
3. The n-gram hashes of the evaluation records are partitioned, as many partitions as their number needs. Each block of
   records asks each partition once for all its n-grams (four bytes each) and gets one bit for each: whether the other side
   has it. Nothing is broadcast, and no filter of a fixed size can fill up.
4. The n-grams that both sides have are joined. Each carries a parity sketch of its record's words, which differs in no more
   bits than the records in words: pairs too far apart end inside the join, before anything is shuffled. The join is
   free to be split by adaptive execution where an n-gram is frequent.
5. The words of the pairs left are joined by class, and the containment of each evaluation record per training record is
   computed on them.

Copies are one class throughout, so a text that fills a third of the table is compared once; pairs of ids are formed only
from the matched classes. Words are compared by hashes of 32 bits: a pair of n words is miscounted with a probability below
n * n / 2**32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged, unstage
from . import sketches
from .bpe import _mixed
from .words import unmarked, words

ONE_IN = 6  # words of which one, rounded up, may be missing; shorter records must have all words in common
SKETCH = 4  # 64-bit words of the parity sketch
BUCKET = 40  # words; above, a record's rarest words are dealt into 2, 4, 8 ... buckets
WORD_BITS = 20  # cells of the word counts; words that share a cell only share a place in the order of rarity
SLICE = 4096  # records handled at once, and to a block
ASKED = 1 << 21  # n-grams to a partition, about
TRAIN, HELD = 1, 2
ODD = np.uint64(0x9E3779B97F4A7C15)

_COLUMNS = [("a", "<i8"), ("b", "<i8"), ("n", "<i4"), ("side", "u1")]
BLOCK = "block bigint, " + ", ".join(f"{c} binary" for c, _ in _COLUMNS) + ", bag binary"


def _described(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of the rows that have words: their places, sizes, both halves of the class, and the flat hashes of their words, in which
    the occurrences of a word within a record are told apart."""
    w = words(batch.column(batch.schema.get_field_index("text")))
    kind = np.asarray(batch.column(batch.schema.get_field_index("kind"))).astype(np.uint64)
    size = np.diff(w.bounds)
    rows = np.flatnonzero(size)
    hashes = _mixed(w.hashes + np.repeat(kind * ODD, size))
    size = size[rows]
    if not len(rows):
        none = np.zeros(0, dtype=np.int64)
        return rows, size, none, none, np.zeros(0, dtype=np.uint32)
    first = np.cumsum(size) - size
    a = _mixed(np.add.reduceat(hashes, first) + size.astype(np.uint64)).view(np.int64)
    b = _mixed(np.add.reduceat(_mixed(hashes ^ np.uint64(0xD1B54A32D192ED03)), first)).view(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    hashes = hashes[np.lexsort((hashes, row))]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    new[first] = True
    start = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    told = _mixed(hashes + (np.arange(len(hashes)) - start).astype(np.uint64))
    return rows, size, a, b, (told >> np.uint64(32)).astype(np.uint32)


class Block:
    """Classes of records with their words; `take` gives those of one side."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, side: np.ndarray, bag: np.ndarray):
        self.a, self.b, self.n, self.side, self.bag = a, b, n.astype(np.int64), side, bag
        self.first = np.cumsum(self.n) - self.n

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Block:
        get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
        return cls(*[get(c, k) for c, k in _COLUMNS], get("bag", "<u4"))

    def row(self, number: int) -> pa.RecordBatch:
        cols = [getattr(self, c).astype(k).tobytes() for c, k in _COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([c], pa.binary()) for c in (*cols, self.bag.astype("<u4").tobytes())]], names=["block", *[c for c, _ in _COLUMNS], "bag"])

    def take(self, side: int) -> Block:
        keep = self.side & side > 0
        return self if keep.all() else Block(self.a[keep], self.b[keep], self.n[keep], self.side[keep], self.bag[np.repeat(keep, self.n)])

    def grams(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of each record's rarest words, and their records."""
        if not len(self.n):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(len(self.n)), self.n)
        weight = counts[self.bag >> np.uint32(32 - WORD_BITS)]
        order = np.lexsort((self.bag, weight, row))
        word = self.bag[order].astype(np.uint64)
        rank = np.arange(len(row)) - self.first[row]
        step = np.maximum(0, np.ceil(np.log2(self.n / BUCKET))).astype(np.int64)
        near_top = 1.25 * self.n + 2 >= BUCKET * 2.0**step
        missing = np.where(self.n >= ONE_IN, -(-self.n // ONE_IN), 0)
        grams, rows = [], []
        for up in (0, 1):
            deal = np.int64(1) << (step + up)
            use = np.flatnonzero((rank < (missing + deal + 1)[row]) & (near_top[row] if up else True))
            h, r = word[use], row[use]
            group = (r << np.int64(32)) | (h.astype(np.int64) & (deal[r] - 1))
            order = np.argsort(group, kind="stable")
            h, r, group = h[order], r[order], group[order]
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(h) else use
            size = np.diff(np.append(begin, len(h)))
            later = np.repeat(size, size) - 1 - (np.arange(len(h)) - np.repeat(begin, size))
            i = np.repeat(np.arange(len(h)), later)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
            salt = (deal.astype(np.uint64) * ODD)[r]
            alone = begin[self.n[r[begin]] == 1]
            grams += [_mixed(_mixed(h[i] + salt[i]) * np.uint64(3) + h[j]), _mixed(h[alone] + salt[alone])]
            rows += [r[i], r[alone]]
        return np.concatenate(grams), np.concatenate(rows)

    def sketches(self) -> list[np.ndarray]:
        """Parity sketches: each occurrence of a word flips one bit, so sketches differ in no more bits than the bags in words."""
        bit = np.uint64(1) << (self.bag & np.uint32(63)).astype(np.uint64)
        place = (self.bag >> np.uint32(6)) % np.uint32(SKETCH)
        return [np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), self.first).view(np.int64) if len(self.n) else np.zeros(0, np.int64) for k in range(SKETCH)]


def _routed(gram: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in order of partition and remainder: partition << 32 | remainder, the bounds of the partitions, and where
    each given n-gram stands."""
    key, at = np.unique(((gram >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (gram & np.uint64(0xFFFFFFFF)), return_inverse=True)
    return key, np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)), at


def near_same(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finds near-same records between the training split and the others.

    records: kind (int; only records of one kind are compared), id, train (boolean), text. Rows with a null in kind, id or
    train, and texts without words (null, blank, markup only), match nothing.

    Returns (matches, members). matches: ea, eb, ta, tb, n_shared, containment, similarity: the class of an evaluation
    record, that of a training record, the number of words in common, their share of the evaluation record's words, and
    of the longer record's words. members: a, b, kind, id, train: the classes of all records. Equal classes match with 1.
    """
    spark = records.sparkSession
    known = records.where("kind is not null and id is not null and train is not null and text is not null")
    rows = spread(known.select(F.col("kind").cast("int"), "id", "train", unmarked(F.col("text")).alias("text")))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes whose words this task has given out; forgotten when large, as repeats do no harm
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                at, size, a, b, bag = _described(batch)
                own = a.tolist()
                fresh = np.fromiter((c not in seen for c in own), dtype=bool, count=len(own))
                seen.update(own)
                if len(seen) > 200_000:
                    seen.clear()
                offsets = np.concatenate([[0], np.cumsum(np.where(fresh, size, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bag[np.repeat(fresh, size)].view(np.int32)), mask=pa.array(~fresh))
                take = batch.select(["kind", "id", "train"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *take.columns, pa.array(size.astype(np.int32)), lists], names=["a", "b", "kind", "id", "train", "n", "bag"])

    id_type = records.schema["id"].dataType.simpleString()
    described = staged(rows.mapInArrow(describe, f"a bigint, b bigint, kind int, id {id_type}, train boolean, n int, bag array<int>"), "described")
    members = described.select("a", "b", "kind", "id", "train")
    side = F.bit_or(F.when(F.col("train"), TRAIN).otherwise(HELD)).cast("tinyint").alias("side")
    classes = described.groupBy("a", "b").agg(F.first("n").alias("n"), side, F.first("bag", ignorenulls=True).alias("bag"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        counts = np.zeros(1 << WORD_BITS, dtype=np.int64)
        empty = pa.nulls(1, pa.binary())
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                block = Block(*[np.asarray(batch.column(c)) for c in range(4)], batch.column(4).flatten().to_numpy().view(np.uint32))
                counts += np.bincount(block.bag >> np.uint32(32 - WORD_BITS), minlength=len(counts))
                out = block.row(number)
                number += 1
                yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(1, pa.int32()), empty], names=[*out.schema.names, "segment", "body"])
        for part in sketches.parts(counts):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[empty] * 5, *part.columns], names=["block", *[c for c, _ in _COLUMNS], "bag", "segment", "body"])

    packed = staged(classes.mapInArrow(pack, f"{BLOCK}, segment int, body binary"), "classes")
    counts = spark.sparkContext.broadcast(sketches.merged(packed.where("body is not null").select("segment", "body"), 1 << WORD_BITS, "int64").astype(np.int32))
    blocks = packed.where("body is null").drop("segment", "body")
    # n-grams are fewer than words
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(described.agg(F.sum("n")).first()[0] or 0) // ASKED))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(batch, i)
                for s in (TRAIN, HELD):
                    key, bounds, _ = _routed(block.take(s).grams(counts.value)[0], parts)
                    part = np.flatnonzero(np.diff(bounds))
                    body = [key[bounds[p] : bounds[p + 1]].astype("<u4").tobytes() for p in part]
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), batch.column("block")[i].as_py())), pa.array(np.full(len(part), s, dtype=np.int32)), pa.array(body, pa.binary())], names=["part", "block", "side", "asked"])

    def answer(group: pa.Table) -> pa.Table:
        sides = np.asarray(group.column("side"))
        asked = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in group.column("asked")]
        of = {s: np.unique(np.concatenate([np.zeros(0, "<u4"), *[x for x, y in zip(asked, sides, strict=True) if y == s]])) for s in (TRAIN, HELD)}
        met = np.intersect1d(of[TRAIN], of[HELD], assume_unique=True)
        met = np.append(met, np.uint32(0))  # a last place for n-grams beyond all
        bits = [np.packbits((at < len(met) - 1) & (met[at] == x)).tobytes() for x in asked for at in [np.searchsorted(met[:-1], x)]]
        return pa.table([group.column("block"), group.column("side"), group.column("part"), pa.array(bits, pa.binary())], names=["block", "side", "part", "bits"])

    answers = blocks.mapInArrow(ask, "part int, block bigint, side int, asked binary").groupBy("part").applyInArrow(answer, "block bigint, side int, part int, bits binary")
    answers = staged(answers.groupBy("block", "side").agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("answers")), "answers")
    sketch = [f"s{k}" for k in range(SKETCH)]

    def hits_of(s: int, letter: str) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block.read(batch, i).take(s)
                    gram, row = block.grams(counts.value)
                    key, bounds, at = _routed(gram, parts)
                    met = np.zeros(len(key), dtype=bool)
                    for got in batch.column("answers")[i].as_py():
                        lo, hi = bounds[got["part"]], bounds[got["part"] + 1]
                        met[lo:hi] = np.unpackbits(np.frombuffer(got["bits"], dtype=np.uint8))[: hi - lo]
                    # an n-gram counts once for a record
                    r, at = np.divmod(np.unique((row * len(key) + at)[met[at]]), max(1, len(key)))
                    cols = [key[at].view(np.int64), block.a[r], block.n[r].astype(np.int32), *[x[r] for x in block.sketches()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["gram", *[f"{letter}{c}" for c in ("a", "n", *sketch)]])

        asked = blocks.join(answers.where(F.col("side") == s).select("block", "answers"), "block")
        return asked.mapInArrow(find, f"gram bigint, {letter}a bigint, {letter}n int" + "".join(f", {letter}{x} bigint" for x in sketch))

    met = hits_of(HELD, "e").join(hits_of(TRAIN, "t"), "gram")
    longer = F.greatest("en", "tn")
    least = longer - F.when(longer >= ONE_IN, F.ceil(longer / ONE_IN)).otherwise(0)
    differing = sum((F.bit_count(F.col(f"e{s}").bitwiseXOR(F.col(f"t{s}"))) for s in sketch), F.lit(0))
    could = (F.col("ea") != F.col("ta")) & (F.least("en", "tn") >= least) & (differing <= F.col("en") + F.col("tn") - 2 * least)
    near = staged(met.where(could).select("ea", "ta").distinct(), "met")
    unstage(answers)

    def bags_of(s: int, letter: str) -> DataFrame:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block.read(batch, i).take(s)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(block.first, block.n.sum()).astype(np.int32)), pa.array(block.bag.view(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(block.a), pa.array(block.b), pa.array(block.n.astype(np.int32)), lists], names=[f"{letter}{c}" for c in ("a", "b", "n", "bag")])

        return blocks.mapInArrow(unpack, f"{letter}a bigint, {letter}b bigint, {letter}n int, {letter}bag array<int>")

    # joined by the first half of the class, told apart by both
    scored = near.join(bags_of(HELD, "e"), "ea").join(bags_of(TRAIN, "t"), "ta").withColumn("n_shared", F.size(F.array_intersect("ebag", "tbag")))
    scored = scored.select("ea", "eb", "ta", "tb", "en", "tn", "n_shared")
    both = described.groupBy("a", "b", "n").agg(side).where(F.col("side") == TRAIN + HELD)
    equal = both.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("n").alias("en"), F.col("n").alias("tn"), F.col("n").alias("n_shared"))
    scored = scored.unionByName(equal)
    scored = scored.withColumn("containment", F.col("n_shared") / F.col("en")).withColumn("similarity", F.col("n_shared") / F.greatest("en", "tn"))
    matches = staged(scored.where(F.col("n_shared") >= least).select("ea", "eb", "ta", "tb", "n_shared", "containment", "similarity"), "matches")
    for done in (near, packed):
        unstage(done)
    return matches, members
