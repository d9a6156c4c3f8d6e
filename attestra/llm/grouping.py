"""Groups of directly or indirectly linked records (problems 5 and 7).

Both algorithms keep everything in tables: no links, components or labels reach the driver. Each round's tables are
written to the shared folder, which cuts the lineage and survives lost executors, and are deleted once read. A node with
very many links is no special case: minima are combined before each shuffle, links repeat at most once after
relabelling, and the remaining one-to-many joins have one row per key on one side, so adaptive execution may split the
other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged, unstage


def _compose(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Maps the roots of `lower` by `upper`; roots that `upper` does not hold stay."""
    up = upper.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return lower.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))


def boruvka(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by deterministic Borůvka hooking.

    Every component selects its smallest outgoing link (by its smaller, then its larger end); as the order is total, the
    selected links form trees but for pairs that select the same link, of which the smaller becomes the root. Trees
    collapse by pointer doubling, links are relabelled and deduplicated, until none remain. Components at least halve
    each round.

    Returns node, root: one row per node of a link between two different non-null ends; root is the smallest node of the
    group. Links with a null end and links of a node to itself give no rows; repeated links count once; no links give an
    empty result.
    """
    edges = staged(
        links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array("lo", "hi")).alias("node"), F.struct("lo", "hi").alias("edge"))
        best = ends.groupBy("node").agg(F.min("edge").alias("e")).select("node", F.when(F.col("node") == F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("to"))
        best = staged(best, "chosen")
        other = best.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        mutual = (F.col("_t") == F.col("node")) & (F.col("node") < F.col("to"))
        parents = staged(best.join(other, F.col("to") == F.col("_n")).select("node", F.when(mutual, F.col("node")).otherwise(F.col("to")).alias("root")), "parents")
        unstage(best)
        while True:
            up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            doubled = staged(parents.join(up, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), "doubled")
            unstage(parents)
            moved = not doubled.where("moved").isEmpty()
            parents = doubled.select("node", "root")
            parents._staged_at = doubled._staged_at
            if not moved:
                break
        levels.append(parents)
        lo = parents.select(F.col("node").alias("lo"), F.col("root").alias("a"))
        hi = parents.select(F.col("node").alias("hi"), F.col("root").alias("b"))
        fewer = edges.join(lo, "lo").join(hi, "hi").where(F.col("a") != F.col("b"))
        fewer = staged(fewer.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
        unstage(edges)
        edges = fewer
    if not levels:
        return edges.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    groups = levels[-1]
    for level in reversed(levels[:-1]):
        groups = _compose(level, groups)
    groups = staged(groups, "groups")
    for level in levels:
        unstage(level)
    smallest = groups.groupBy("root").agg(F.min("node").alias("least"))
    return groups.join(smallest, "root").select("node", F.col("least").alias("root"))


def hook_and_shortcut(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by parallel hooking and shortcutting over a table of parents.

    In every round each node and its parent hook onto the smallest grandparent among the node's neighbours, and every
    node is shortcut to its grandparent, until no parent changes. Parents only fall, so each root is the smallest node.
    Same result and conventions as `boruvka`.
    """
    edges = staged(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "links")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    start = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    parents = staged(start.select("node", F.least("node", "m").alias("f"), F.least("node", "m").alias("g")), "parents")
    while True:
        near = both.join(parents.select(F.col("node").alias("v"), F.col("g").alias("gv")), "v").groupBy(F.col("u").alias("node")).agg(F.min("gv").alias("m"))
        seen = parents.join(near, "node")
        offers = seen.select("node", F.least("g", "m").alias("f")).unionByName(seen.select(F.col("f").alias("node"), F.col("m").alias("f")))
        hooked = staged(offers.groupBy("node").agg(F.min("f").alias("f")), "hooked")
        up = hooked.select(F.col("node").alias("_n"), F.col("f").alias("_g"))
        before = parents.select(F.col("node").alias("_m"), F.col("f").alias("_f"), F.col("g").alias("_h"))
        after = hooked.join(up, F.col("f") == F.col("_n")).join(before, F.col("node") == F.col("_m"))
        after = staged(after.select("node", "f", F.col("_g").alias("g"), ((F.col("f") != F.col("_f")) | (F.col("_g") != F.col("_h"))).alias("moved")), "parents")
        unstage(hooked)
        unstage(parents)
        parents = after
        if parents.where("moved").isEmpty():
            unstage(edges)
            return parents.select("node", F.col("f").alias("root"))
