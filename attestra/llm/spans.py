"""Long spans that stand verbatim in more than one record (problem 10).

A span of `length` characters is a window. Every window is represented by its anchor, the smallest hash among the
`length // 2`-grams inside it, so equal windows have equal anchors and neighbouring windows mostly share theirs.

1. Every task sketches its own anchors, and the sketches are merged: a count-min sketch of one row whose width follows the
   number of anchors (CELLS cells to each), so that few cells are shared at any size of the corpus. The merged sketch is a
   table partitioned by cell. It is never broadcast, and it never counts too low.
2. A second pass hashes only the windows whose cell is estimated to occur in more than one text (the texts and their cells
   meet in a join; texts without such a cell aren't read again), and these windows are grouped exactly, by anchor and window
   hash (128 bits together). Groups of the same set of records count once before pairs are formed, so a long shared
   passage gives each pair of its records once.

Exact copies are found first, by digest; one of each is searched, and the others follow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import spread, staged, unstage
from .bpe import _mixed
from .forms import code_points

LENGTH = 200
CELLS = 1024  # cells of the sketch to an anchor: one unrepeated anchor in 1024 passes at most
MOST = 48  # bits of a cell, which leave 15 for the row within a batch
SLICE = 1 << 20  # code points hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (BASE, BACK):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def windows(points: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows given as code points: where windows start, their anchors, and their hashes (of the window)."""
    n, gram = len(points), length // 2
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][row] if n else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.arange(n) + length <= end)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    up, down = _power(n + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])
    low, span, want = grams, 1, length - gram + 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if want > span:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    return at, low[at], _mixed((sums[at + length] - sums[at]) * down[at] ^ BASE)


def _slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice: rows in the batch, starts within the text, anchors, hashes of all windows."""
    text = batch.column(batch.schema.get_field_index("text"))
    points, bounds = code_points(text.fill_null("") if text.null_count else text)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, side="right")) - 1)
        own = bounds[lo : hi + 1] - bounds[lo]
        at, anchor, whole = windows(points[bounds[lo] : bounds[hi]], own, length)
        row = np.searchsorted(own, at, side="right") - 1
        yield lo + row, at - own[row], anchor, whole
        lo = hi


def _sketched(texts: DataFrame, bits: int, length: int) -> DataFrame:
    """cell, key: the cells (of 2**bits) of the anchors of each text, each once for a text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(batch.schema.get_field_index("key")))
            for row, _, anchor, _ in _slices(batch, length):
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(row) else row
                own = np.unique((row[new] << MOST) | _cells(anchor[new], bits))
                yield pa.RecordBatch.from_arrays([pa.array(own & ((1 << MOST) - 1)), pa.array(keys[own >> MOST].astype(np.int64))], names=["cell", "key"])

    return texts.mapInArrow(build, "cell bigint, key bigint")


def _cells(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(anchor + BASE) >> np.uint64(64 - bits)).astype(np.int64)


def _suspect(texts: DataFrame, length: int) -> DataFrame:
    """key, anchor, whole, pos of the windows (of texts with `cells`) whose cell is one of those of their text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            keys, cells, bits = np.asarray(get("key")), get("cells"), get("bits")[0].as_py() if batch.num_rows else 1
            sizes = np.diff(np.asarray(cells.offsets))
            wanted = (np.repeat(np.arange(len(keys)), sizes) << MOST) | np.asarray(cells.flatten())
            for row, pos, anchor, whole in _slices(batch, length):
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
                run = np.flatnonzero(new)
                kept = np.isin((row[run] << MOST) | _cells(anchor[run], bits), wanted)
                keep = np.flatnonzero(kept[np.cumsum(new) - 1]) if len(run) else run
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(whole[keep].view(np.int64)), pa.array(keys[row[keep]].astype(np.int64)), pa.array(pos[keep].astype(np.int32))], names=["anchor", "whole", "key", "pos"])

    return texts.mapInArrow(find, "anchor bigint, whole bigint, key bigint, pos int")


class Shared:
    """Repeated windows and exact copies of the texts of a table.

    texts: `key` (bigint, unique) and `text`. Null texts and texts shorter than `length` have no windows. Everything is
    counted in code points.
    """

    def __init__(self, texts: DataFrame, key: str, text: str, length: int = LENGTH):
        self.length = length
        rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
        digest = F.unhex(F.sha2(F.col("text"), 256))
        self.sizes = staged(rows.select("key", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"), F.when(F.length("text") >= length, digest).alias("digest")), "digests")
        same = self.sizes.where("digest is not null").groupBy("digest").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        #: rep, key: every text that has an exact copy, with the smallest key among them
        self.copies = staged(self.sizes.join(same, "digest").select("rep", "key"), "copies")
        others = self.copies.where("key <> rep").select("key")
        # the planner knows the size of the staged list: it is broadcast if small, else joined by a shuffle
        single = rows.where(F.length("text") >= length).join(others, "key", "left_anti")
        # about four anchors to `length` characters
        anchors = (self.sizes.where("digest is not null").agg(F.sum("n")).first()[0] or 0) * 4 // length
        bits = min(MOST, max(16, (CELLS * anchors).bit_length()))
        sketch = staged(_sketched(single, bits, length), "sketch")
        twice = sketch.groupBy("cell").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("cell")
        suspect = staged(sketch.join(twice, "cell").groupBy("key").agg(F.collect_list("cell").alias("cells")), "suspect")
        found = staged(_suspect(single.join(suspect, "key").select("key", "text", "cells", F.lit(bits).alias("bits")), length), "windows")
        groups = found.groupBy("anchor", "whole").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("anchor", "whole")
        #: anchor, whole, key, pos: each window that stands in more than one text (of those searched)
        self.windows = staged(found.join(groups, ["anchor", "whole"]), "repeated")
        for done in (sketch, suspect, found):
            unstage(done)

    def pairs(self, first: str, second: str) -> DataFrame:
        """Each pair of keys, smaller first, whose texts share a window; copies included."""
        rows = self.windows.select("anchor", "whole", "key").distinct()
        mark = F.xxhash64("key")
        sets = rows.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(7))).alias("y"))
        chosen = sets.groupBy("n", "x", "y").agg(F.min(F.struct("anchor", "whole")).alias("g")).select("g.anchor", "g.whole")
        members = staged(rows.join(chosen, ["anchor", "whole"]), "members")
        left, right = members.withColumnRenamed("key", "a"), members.withColumnRenamed("key", "b")
        met = left.join(right, ["anchor", "whole"]).where("a < b").select("a", "b").distinct()
        for side in ("a", "b"):
            own = self.copies.select(F.col("rep").alias("_rep"), F.col("key").alias("_key"))
            met = met.join(own, F.col(side) == F.col("_rep"), "left").withColumn(side, F.coalesce("_key", side)).drop("_rep", "_key")
        same = self.copies.withColumnRenamed("key", "a").join(self.copies.withColumnRenamed("key", "b"), "rep").where("a < b").select("a", "b")
        met = met.unionByName(same).select(F.least("a", "b").alias(first), F.greatest("a", "b").alias(second))
        return met.distinct()

    def shares(self, key: str) -> DataFrame:
        """key, n_chars, n_shared, share: how many characters of each text stand in a span shared with another text.
        share is null for texts without characters."""
        after = F.lead("pos").over(W.partitionBy("key").orderBy("pos"))
        spans = self.windows.select("key", "pos").distinct().withColumn("span", F.least(F.lit(self.length), F.coalesce(after - F.col("pos"), F.lit(self.length))))
        shared = spans.groupBy("key").agg(F.sum("span").cast("bigint").alias("part"))
        copied = self.copies.select("key", F.lit(True).alias("copied"))
        out = self.sizes.select("key", "n").join(shared, "key", "left").join(copied, "key", "left")
        n_shared = F.when(F.col("copied"), F.col("n")).otherwise(F.coalesce("part", F.lit(0).cast("bigint")))
        out = out.select(F.col("key").alias(key), F.col("n").alias("n_chars"), n_shared.alias("n_shared"))
        return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)))
