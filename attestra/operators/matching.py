"""Matchings, colourings and chains over tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged, unstage
from .graph import components


def disjoint(rows: DataFrame, key: str, rank: str, items: str) -> DataFrame:
    """Rows of the greedy choice in order of rank (ties by key) that share no item with an earlier chosen one.

    In each round the rows that come first among all open rows of each of their items are chosen, and rows that share an item
    with them are dropped; that gives what the sequential walk gives. rows: key, rank, items (array). Rows without items are
    all chosen.
    """
    every = staged(rows.select(key, rank, F.array_distinct(F.array_compact(items)).alias("_items")), "rows")
    chosen = [every.where("size(_items) = 0").select(key)]
    open_ = staged(every.where("size(_items) > 0").select(key, F.struct(rank, key).alias("_r"), F.explode("_items").alias("_i")), "open")
    while not open_.isEmpty():
        first = open_.groupBy("_i").agg(F.min("_r").alias("_first"))
        best = open_.join(first, "_i").groupBy(key).agg(F.bool_and(F.col("_r") == F.col("_first")).alias("_best")).where("_best").select(key)
        best = staged(best, "chosen")
        chosen.append(best)
        used = open_.join(best, key).select("_i").distinct()
        gone = open_.join(used, "_i").select(key).distinct()
        left = staged(open_.join(gone, key, "left_anti"), "open")
        unstage(open_)
        open_ = left
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def coloring(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root, color of every node of a graph: 0 or 1, the smallest node of a component having 0; null where the component has
    an odd cycle.

    Components of the double cover: each node twice, each edge between different copies. A component is two-colourable if its
    root's two copies are not connected.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")).distinct()
    cover = e.select(F.concat("u", F.lit("#0")).alias("x"), F.concat("v", F.lit("#1")).alias("y")).unionByName(e.select(F.concat("u", F.lit("#1")).alias("x"), F.concat("v", F.lit("#0")).alias("y")))
    both = staged(components(cover, "x", "y"), "cover")
    copy = lambda i: both.where(F.col("node").endswith(f"#{i}")).select(F.expr("substring(node, 1, length(node) - 2)").alias("node"), F.col("root").alias(f"r{i}"))
    sides = copy(0).join(copy(1), "node")
    plain = lambda c: F.expr(f"substring({c}, 1, length({c}) - 2)")
    smallest = F.least(plain("r0"), plain("r1"))
    color = F.when(F.col("r0") == F.col("r1"), F.lit(None)).when((plain("r0") == smallest) & F.col("r0").endswith("#0"), 0).otherwise(1)
    return sides.select("node", smallest.alias("root"), color.cast("int").alias("color"))


def hash_chain(rows: DataFrame, journal: str, order: list[str], body: str) -> DataFrame:
    """Adds version (from 1) and link: the SHA-256 of the former link and the row's body. Each link binds all rows before it.

    A chain is sequential, so each journal is laid out in order and streamed; a task holds one batch and one link.
    """
    laid = rows.repartition(journal).sortWithinPartitions(journal, *order)
    names = [*rows.columns, "version", "link"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, version, link = object(), 0, ""
        for batch in batches:
            versions, links = [], []
            for j, own in zip(batch[journal], batch[body], strict=True):
                if j != now:
                    now, version, link = j, 0, ""
                version += 1
                link = hashlib.sha256(f"{link}|{own}".encode()).hexdigest()
                versions.append(version)
                links.append(link)
            yield batch.assign(version=versions, link=links)[names]

    return laid.mapInPandas(walk, T.StructType([*rows.schema.fields, T.StructField("version", T.LongType()), T.StructField("link", T.StringType())]))


def chain_breaks(rows: DataFrame, journal: str, body: str) -> DataFrame:
    """journal, version of the rows whose link is not that of the former link and their body, or whose former version is missing."""
    former = rows.select(F.col(journal).alias("_j"), (F.col("version") + 1).alias("_v"), F.col("link").alias("_link"))
    both = rows.join(former, (F.col(journal) == F.col("_j")) & (F.col("version") == F.col("_v")), "left")
    want = F.sha2(F.concat(F.coalesce("_link", F.lit("")), F.lit("|"), body), 256)
    return both.where((F.col("link") != want) | (F.col("_link").isNull() & (F.col("version") > 1))).select(journal, "version")
