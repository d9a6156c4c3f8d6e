"""Ordered operators without a window over a whole group: a range sort, running values within each range, and offsets.

A group may hold a third of all rows. Rows are laid out by range of (group, order), so no task holds a group; totals of the
ranges (one row for each range and group in it) give each range's offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged


def running(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds the running sums (this row included) within each group in the given order, which should be total.

    Rows of a null in `by` form a group of their own. Sums of nulls count as 0.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    named = rows.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()])
    laid = named.repartitionByRange(*by, *cols).sortWithinPartitions(*by, *cols).withColumn("_at", F.monotonically_increasing_id())
    laid = staged(laid, "ordered").withColumn("_part", F.shiftright("_at", 33))
    totals = laid.groupBy(*by, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # one row for each range and group in it
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = W.partitionBy(*by, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    own = laid.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums])
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)], F.col("_part") == F.col("_p"))
    out = own.join(offsets, same)
    return out.select(*rows.columns, *[(F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def ranked(rows: DataFrame, by: list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds the place of each row within its group, from 1."""
    return running(rows, by, list(order), {name: F.lit(1).cast("bigint")})


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and the exact quantiles of each group, with linear interpolation; nulls are left out."""
    held = rows.where(F.col(value).isNotNull()).select(*by, value)
    sizes = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked(held, by, value, name="_r").join(sizes, by)
    picks = []
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        low = F.max(F.when(F.col("_r") == F.floor(at) + 1, F.col(value)))
        high = F.max(F.when(F.col("_r") == F.ceil(at) + 1, F.col(value)))
        share = F.max(at - F.floor(at))
        picks.append((low + (high - low) * share).alias(name))
    return placed.groupBy(*by).agg(*picks)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n (0 for n = 0), exact below 16 and to 1e-10 above."""
    few = F.array(*[F.lit(sum(1 / k for k in range(1, m + 1))) for m in range(16)])
    x = n.cast("double")
    many = F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return F.when(n < 16, F.get(few, n.cast("int"))).otherwise(many)
