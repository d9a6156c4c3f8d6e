"""Splits that keep related records together (problem 5).

Records that share a key are linked through the smallest record of the key, never pair by pair. Bundles are the
components of these links. How many bundles of each size go to each split is chosen on the histogram of bundle sizes,
whose number of entries is at most the square root of twice the number of records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .grouping import hook_and_shortcut
from .packing import ranked

# What stands for a missing id.
NO_ID = ["", "n/a", "unknown"]


def linking_id(column: Column | str) -> Column:
    """An id as it links: without case and outer blanks; null where it is missing."""
    c = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s ]+|[\s ]+$", ""))
    return F.when(~c.isin(NO_ID), c)


def bundles(records: DataFrame, record: str, keys: DataFrame, key_record: str, key: str) -> DataFrame:
    """record, bundle_id, bundle_size for each distinct non-null record; bundle_id is the smallest record of the bundle.

    keys: rows (key_record, key); null keys link nothing, repeated rows count once. A record without a shared key is a
    bundle of its own.
    """
    held = keys.where(F.col(key).isNotNull() & F.col(key_record).isNotNull()).select(F.col(key_record).alias("_r"), F.col(key).alias("_k")).distinct()
    least = held.groupBy("_k").agg(F.min("_r").alias("_least"))
    links = held.join(least, "_k").where(F.col("_r") != F.col("_least")).select("_r", "_least")
    groups = hook_and_shortcut(links, "_r", "_least").select(F.col("node").alias("_n"), "root")
    each = records.select(F.col(record).alias("record")).where(F.col(record).isNotNull()).distinct()
    out = staged(each.join(groups, F.col("record") == F.col("_n"), "left").select("record", F.coalesce("root", "record").alias("bundle_id")), "bundles")
    sizes = out.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("bundle_size"))
    return out.join(sizes, "bundle_id").select("record", "bundle_id", "bundle_size")


def _reach(items: list[tuple[int, int]], most: int) -> int:
    """Bitset of the totals up to `most` that subsets of items (size, how many) give; an item is taken whole or not."""
    reach, mask = 1, (1 << (most + 1)) - 1
    for s, n in items:
        reach |= (reach << (s * n)) & mask
    return reach


def _subset(items: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """Items that give exactly `total`, which must be reachable: the items are halved, and the total is divided between the
    halves by their bitsets, so that no more than two bitsets a level of halving are held."""
    if not total:
        return []
    if len(items) == 1:
        return items
    half = len(items) // 2
    left, right = items[:half], items[half:]
    a, b = _reach(left, total), _reach(right, total)
    turned = int(format(b, f"0{total + 1}b")[::-1], 2)  # bit t of it: the right half gives total - t
    both = a & turned
    part = both.bit_length() - 1
    del a, b, turned, both
    return _subset(left, part) + _subset(right, total - part)


def closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many of each size to take so that their total comes closest to target (the smaller of two equally close).

    A subset-sum problem on bitsets over the multiplicities (as powers of two). Each size starts from its proportional share,
    and only counts within 4 * w + 2 of it are tried, w being the greatest size: a nearest solution with the least
    difference from the shares differs by no more items, as otherwise some of the added and some of the removed ones would
    have equal totals (their sums can be ordered to stay within 2 * w of 0) and could be put back. So the bitsets don't grow
    with the number of bundles: they have at most min(target, sum of sizes * (4 * w + 2)) + w bits.
    """
    total = sum(s * m for s, m in sizes.items())
    if total == 0 or target <= 0:
        return dict.fromkeys(sizes, 0)
    if target >= total:
        return dict(sizes)
    top = max(s for s, m in sizes.items() if m)
    slack = 4 * top + 2
    taken = {s: m * target // total for s, m in sizes.items()}
    # the shares are rounded down; whole bundles bring them within one greatest size of the target
    rest = target - sum(s * n for s, n in taken.items())
    for s in sorted(sizes, reverse=True):
        more = min(sizes[s] - taken[s], rest // s)
        taken[s] += more
        rest -= s * more
    low = {s: max(0, n - slack) for s, n in taken.items()}
    want = target - sum(s * n for s, n in low.items())
    items = []
    for s in sorted(sizes, reverse=True):
        left, power = min(sizes[s], taken[s] + slack) - low[s], 1
        left = min(left, want // s + 1)  # more of a size than fills the rest can't be needed
        while left > 0:
            n = min(power, left)
            items.append((s, n))
            left, power = left - n, 2 * power
    reach = _reach(items, want + top)
    below = (reach & ((1 << (want + 1)) - 1)).bit_length() - 1
    above = reach >> want
    nearest = below
    if above:
        over = want + (above & -above).bit_length() - 1
        nearest = below if want - below <= over - want else over
    del reach, above
    out = dict(low)
    for s, n in _subset(items, nearest):
        out[s] += n
    return out


def shares(sizes: dict[int, int], fractions: dict[str, float]) -> dict[str, dict[int, int]]:
    """Numbers of bundles by split and size. The largest split takes what the others leave; the others are chosen in
    order of growing fraction, ties by name."""
    total = sum(s * m for s, m in sizes.items())
    order = sorted(fractions, key=lambda k: (fractions[k], k))
    whole = sum(max(0.0, f) for f in fractions.values()) or 1.0
    left, out = dict(sizes), {}
    for name in order[:-1]:
        out[name] = closest(left, round(total * max(0.0, fractions[name]) / whole))
        left = {s: m - out[name][s] for s, m in left.items()}
    out[order[-1]] = left
    return out


def assigned(bundled: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Adds split_target to rows of `bundles`: whole bundles, row shares as close to the fractions as sizes allow."""
    spark = bundled.sparkSession
    heads = staged(bundled.select("bundle_id", "bundle_size").distinct(), "heads")
    sizes = {r["bundle_size"]: r["n"] for r in heads.groupBy("bundle_size").agg(F.count(F.lit(1)).alias("n")).collect()}  # O(sqrt(records)) rows
    parts = shares(sizes, fractions)
    names = sorted(parts)
    rows = sorted(sizes)
    ends = np.cumsum(np.array([[parts[n][s] for n in names] for s in rows], dtype=np.int64).reshape(len(rows), len(names)), axis=1)
    shared = spark.sparkContext.broadcast((np.array(rows, dtype=np.int64), ends, names))

    @F.arrow_udf(T.StringType())
    def split(size: pa.Array, rank: pa.Array) -> pa.Array:
        known, bounds, labels = shared.value
        row = bounds[np.searchsorted(known, np.asarray(size, dtype=np.int64))]
        return pa.array(np.array(labels, dtype=object)[(row <= np.asarray(rank, dtype=np.int64)[:, None]).sum(axis=1)], type=pa.string())

    # order within a size by a hash, so that splits don't follow the order of ids
    order = heads.withColumn("_hash", F.xxhash64("bundle_id"))
    chosen = ranked(order, "bundle_size", "_hash", "bundle_id").select("bundle_id", split("bundle_size", "rank_in_size").alias("split_target"))
    return bundled.join(chosen, "bundle_id")
