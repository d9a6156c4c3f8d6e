"""Fixed-capacity containers filled with items of varying size (problem 9).

Shortest-pack-first over the size histogram: the histogram has at most `capacity` entries, so the driver plans on it at
any number of items. Sizes are placed longest first; a size goes to the open packs with the most room, whole groups of
equal packs at a time, and groups split only at a count. The resulting patterns are joined back to the items by each
item's rank among the items of its size. Ranks come from a range sort and per-partition counts, so that no task holds
all items of a frequent size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import staged

CAPACITY = 2048


class Slots(NamedTuple):
    """Rows of the plan: ranks from `lo` on of a size stand `each` to a container, from container `base` on."""

    size: np.ndarray
    lo: np.ndarray
    each: np.ndarray
    base: np.ndarray
    containers: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Slots:
    """Packs a histogram of sizes from 1 to capacity. Deterministic; each open group is a pattern and a number of packs."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r, groups in open_.items() if groups), default=0)
            if room < size:
                fit = capacity // size
                whole, rest = divmod(left, fit)
                if whole:
                    open_[capacity - fit * size].append(((size,) * fit, whole))
                if rest:
                    open_[capacity - rest * size].append(((size,) * rest, 1))
                left = 0
                continue
            pattern, count = open_[room].pop()
            used = min(left, count)
            if count > used:
                open_[room].append((pattern, count - used))
            open_[room - size].append(((*pattern, size), used))
            left -= used
    rows, base, placed = [], 0, Counter()
    for room in sorted(open_):
        for pattern, count in open_[room]:
            for size, each in Counter(pattern).items():
                rows.append((size, placed[size], each, base))
                placed[size] += each * count
            base += count
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return Slots(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], base)


def ranked(items: DataFrame, size: str, *order: str) -> DataFrame:
    """Adds `rank_in_size`, from 0, by `order` among the rows of equal size, without a window over a hot size."""
    laid = staged(items.repartitionByRange(size, *order).sortWithinPartitions(size, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    parts = laid.groupBy(F.col(size).alias("_size"), part.alias("_part")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    # one row per partition and size in it: at most partitions + sizes, as partitions are ranges of sizes
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_size").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).drop("_n")
    out = laid.join(parts, (F.col(size) == F.col("_size")) & (part == F.col("_part")))
    return out.withColumn("rank_in_size", F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_from", "_before", "_size", "_part")


def packed(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Assigns items to containers.

    items: `key` (unique) and `size`. Returns key, piece, piece_start, piece_size, container_id. Items of null size or
    size 0 take no place and have no row. An item above the capacity is cut into pieces of exactly the capacity, each a
    container by itself, and a remainder that is packed like any item; no other item is divided. Equal sizes are
    interchangeable; ties go by key.
    """
    spark = items.sparkSession
    sized = staged(items.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_n")).where(F.col("_n") > 0), "sizes")
    rest = sized.select("_key", (F.col("_n") - F.expr(f"_n div {capacity}") * capacity).alias("_rest"), F.expr(f"_n div {capacity}").alias("_full")).where(F.col("_rest") > 0)
    histogram = {r["_rest"]: r["n"] for r in rest.groupBy("_rest").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast((slots.size, slots.lo, slots.each, slots.base))

    @F.arrow_udf(T.LongType())
    def container(sizes: pa.Array, ranks: pa.Array) -> pa.Array:
        size_, lo, each, base = shared.value
        s, r = np.asarray(sizes, dtype=np.int64), np.asarray(ranks, dtype=np.int64)
        # ranks of one size are below 2**40, sizes at most the capacity
        at = np.searchsorted((size_ << 40) | lo, (s << 40) | r, side="right") - 1
        return pa.array(base[at] + (r - lo[at]) // each[at])

    small = ranked(rest, "_rest", "_key").select(
        F.col("_key").alias(key), F.col("_full").cast("int").alias("piece"), (F.col("_full") * capacity).alias("piece_start"),
        F.col("_rest").alias("piece_size"), container("_rest", "rank_in_size").alias("container_id"))
    whole = sized.where(F.col("_n") >= capacity).select("_key", F.expr(f"_n div {capacity}").alias("_full"))
    whole = whole.select("_key", F.posexplode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("piece", "_i"))
    whole = ranked(whole.withColumn("_one", F.lit(0)), "_one", "_key", "piece").select(
        F.col("_key").alias(key), "piece", (F.col("piece").cast("bigint") * capacity).alias("piece_start"),
        F.lit(capacity).cast("bigint").alias("piece_size"), (F.col("rank_in_size") + slots.containers).alias("container_id"))
    return small.unionByName(whole)
