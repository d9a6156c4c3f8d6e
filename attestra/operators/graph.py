"""Graph fixpoints over tables: components, cascades, closures, constraints. Nothing is collected; rounds are staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sorted_join, staged, unstage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node of each component, by minimum labels with shortcutting. Null ends are dropped."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = staged(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root")), "labels")
    while True:
        seen = both.join(sorted_join(labels.select(F.col("node").alias("v"), F.col("root").alias("r"))), "v").select(F.col("u").alias("node"), "r")
        own = labels.select("node", F.col("root").alias("r"))
        # a node's offer also reaches its former root, so that trees hook as a whole
        offers = seen.join(sorted_join(labels), "node").select(F.col("root").alias("node"), "r")
        low = seen.unionByName(own).unionByName(offers).groupBy("node").agg(F.min("r").alias("low"))
        jump = low.select(F.col("node").alias("_n"), F.col("low").alias("_j"))
        new = low.join(sorted_join(jump), F.col("low") == F.col("_n")).select("node", F.col("_j").alias("root"))
        old = labels.select("node", F.col("root").alias("_old"))
        new = staged(new.join(sorted_join(old), "node").select("node", "root", (F.col("root") != F.col("_old")).alias("moved")), "labels")
        unstage(labels)
        labels = new
        if labels.where("moved").isEmpty():
            unstage(both)
            return labels.select("node", "root")


def reachable(start: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """All nodes reached from `start` along edges source to target, itself included: the retraction cascade."""
    found = staged(start.select(F.col(node).alias("node")).where("node is not null").distinct(), "found")
    links = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    frontier = found
    while not frontier.isEmpty():
        fresh = staged(frontier.join(links, F.col("node") == F.col("s")).select(F.col("t").alias("node")).distinct().join(found, "node", "left_anti"), "frontier")
        both = staged(found.unionByName(fresh), "found")
        unstage(found)
        found, frontier = both, fresh
    return found.select(F.col("node").alias(node))


def horn_closure(rules: DataFrame, base: DataFrame) -> DataFrame:
    """Least fixpoint of Horn rules (rule, head, body array) over base facts (fact): a head holds once its whole body holds.

    Unfounded cycles derive nothing; a rule with an empty body holds from the start.
    """
    flat = rules.select("rule", "head", F.array_distinct("body").alias("body"))
    needs = staged(flat.select("rule", "head", F.size("body").alias("need"), F.explode("body").alias("fact")), "rules")
    known = staged(base.select("fact").unionByName(flat.where(F.size("body") == 0).select(F.col("head").alias("fact"))).distinct(), "facts")
    while True:
        met = needs.join(known, "fact").groupBy("rule", "head", "need").agg(F.count(F.lit(1)).alias("have")).where("have = need")
        fresh = staged(met.select(F.col("head").alias("fact")).distinct().join(known, "fact", "left_anti"), "fresh")
        if fresh.isEmpty():
            return known
        both = staged(known.unionByName(fresh), "facts")
        unstage(known)
        known = both


def peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: topological levels by peeling nodes without open prerequisites; nodes on or behind a cycle have no row.

    edges: node, needs.
    """
    left, done, level = staged(nodes.select("node").distinct(), "left"), None, 0
    links = edges.select("node", "needs").distinct()
    while True:
        blocked = links.join(left.select(F.col("node").alias("needs")), "needs").select("node").distinct()
        ready = staged(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            return ready if done is None else done
        done = ready if done is None else staged(done.unionByName(ready), "levels")
        left = staged(left.join(ready.select("node"), "node", "left_anti"), "left")
        level += 1


def violations(nodes: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """rule, subject: what breaks the relation schema.

    nodes: id, type. edges: id, subject, predicate, object. relations: predicate, domain, range ("*" is any), allow_self,
    unique (an object at most once for each subject and predicate). Rules: duplicate_node, referential, unknown_predicate,
    domain, range, self_loop, duplicate_triple, cardinality.
    """
    types = nodes.select("id", "type").distinct()
    twice = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_node").alias("rule"), F.col("id").cast("string").alias("subject"))
    e = edges.join(relations, "predicate", "left")
    e = e.join(types.toDF("subject", "stype"), "subject", "left").join(types.toDF("object", "otype"), "object", "left")
    rules = {
        "referential": F.col("stype").isNull() | F.col("otype").isNull(),
        "unknown_predicate": F.col("domain").isNull(),
        "domain": (F.col("domain") != "*") & (F.col("domain") != F.col("stype")),
        "range": (F.col("range") != "*") & (F.col("range") != F.col("otype")),
        "self_loop": (F.col("subject") == F.col("object")) & ~F.col("allow_self"),
    }
    broken = e.select(F.col("id").cast("string").alias("subject"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    triples = edges.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").cast("string")).alias("i")).where("n > 1").select(F.lit("duplicate_triple").alias("rule"), F.col("i").alias("subject"))
    many = e.where("unique").groupBy("subject", "predicate").agg(F.count_distinct("object").alias("n")).where("n > 1").select(F.lit("cardinality").alias("rule"), F.col("subject").cast("string").alias("subject"))
    return broken.select("rule", "subject").unionByName(twice).unionByName(triples).unionByName(many)
