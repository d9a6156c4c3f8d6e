"""Further scorers, routers and reports over decision rows and the prepared data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import prob
from ..operators.decisions import POSITIVE, decision_rows
from ..session import table
from .metrics import correct, count, n, sql
from .registry import query


@query(sql("""
SELECT arm, id, place FROM (SELECT arm, id, CAST(row_number() OVER (PARTITION BY arm ORDER BY CASE WHEN label = gold THEN 1 ELSE 0 END, coalesce(dist[gold], 0), id) AS INTEGER) AS place FROM d WHERE gold IS NOT NULL AND split = 'development') WHERE place <= 20"""))
def f14_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 most instructive development rows of each arm: wrong ones first, then by the gold label's probability (a report)."""
    rows = decision_rows(spark, sf).where("gold is not null and split = 'development'")
    order = W.partitionBy("arm").orderBy(F.when(correct(), 1).otherwise(0), F.coalesce(F.try_element_at("dist", "gold"), F.lit(0.0)), "id")
    return rows.select("arm", "id", F.row_number().over(order).alias("place")).where("place <= 20")


@query(sql("""
, c AS (SELECT r.pair[1] AS a, r.pair[2] AS b, avg(p) AS q FROM d JOIN evaluation_results r ON d.id = r.result_id WHERE NOT error AND r.pair[1] IS NOT NULL AND r.pair[2] IS NOT NULL GROUP BY ALL),
e AS (SELECT a AS x, b AS y, q FROM c UNION ALL SELECT b, a, q FROM c), k AS (SELECT x, y, max(q) AS q FROM e GROUP BY ALL),
t AS (SELECT x, y, q, lead(q) OVER (PARTITION BY x ORDER BY q DESC, y) AS next, row_number() OVER (PARTITION BY x ORDER BY q DESC, y) AS r FROM k)
SELECT x AS entity, CASE WHEN q >= 0.8 AND (next IS NULL OR q - next >= 0.05) THEN y ELSE 'defer' END AS choice FROM t WHERE r = 1"""))
def c12_select_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The identity of an entity: its best candidate at 0.8 or more and 0.05 ahead of the next, else deferred."""
    ends = table(spark, sf, "evaluation_results").select(F.col("result_id").alias("id"), F.get("pair", F.lit(0)).alias("a"), F.get("pair", F.lit(1)).alias("b"))
    c = decision_rows(spark, sf).where("not error").join(ends, "id").where("a is not null and b is not null").groupBy("a", "b").agg(F.avg("p").alias("q"))
    k = c.select(F.col("a").alias("x"), F.col("b").alias("y"), "q").unionByName(c.select(F.col("b").alias("x"), F.col("a").alias("y"), "q")).groupBy("x", "y").agg(F.max("q").alias("q"))
    # the two best of a minimum on (-q, y): no window over a hot entity
    first = k.groupBy("x").agg(F.min(F.struct(-F.col("q"), "y")).alias("m")).select("x", F.col("m.y").alias("y"), (-F.col("m.col1")).alias("q"))
    second = k.join(first.select("x", "y"), ["x", "y"], "left_anti").groupBy("x").agg(F.max("q").alias("next"))
    sure = (F.col("q") >= 0.8) & (F.col("next").isNull() | (F.col("q") - F.col("next") >= 0.05))
    return first.join(second, "x", "left").select(F.col("x").alias("entity"), F.when(sure, F.col("y")).otherwise("defer").alias("choice"))


@query(sql("""
, g AS (SELECT arm, grp, count(*) AS n, count(*) FILTER (WHERE label <> gold) AS w FROM d WHERE gold IS NOT NULL AND split = 'calibration' GROUP BY ALL),
t AS (SELECT arm, sum(n) AS n, sum(w) AS w FROM g GROUP BY arm)
SELECT g.arm, grp, round((t.w - g.w + 1) / CAST(t.n - g.n + 2 AS DOUBLE), 6) AS risk FROM g JOIN t ON g.arm = t.arm"""))
def j7_leave_group_out(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's risk from all other groups of its arm: totals less the group's own."""
    g = decision_rows(spark, sf).where("gold is not null and split = 'calibration'").groupBy("arm", "grp").agg(n().alias("n"), count(~correct()).alias("w"))
    t = g.groupBy("arm").agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    return g.join(F.broadcast(t), "arm").select("arm", "grp", F.round((F.col("tw") - F.col("w") + 1) / (F.col("tn") - F.col("n") + 2), 6).alias("risk"))  # a row for each arm


@query(sql("""
, w AS (SELECT arm, label = gold AS ok, 1 + id % 3 AS weight, power(p - CASE WHEN gold = 'same' THEN 1 ELSE 0 END, 2) AS b FROM d WHERE gold IS NOT NULL AND NOT error)
SELECT arm, round(sum(CASE WHEN ok THEN weight ELSE 0 END) / CAST(sum(weight) AS DOUBLE), 6) AS accuracy, round(sum(weight * b) / sum(weight), 6) AS brier FROM w GROUP BY arm"""))
def j12_weighted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and Brier score under row weights."""
    w = 1 + F.col("id") % 3
    b = F.pow(F.col("p") - F.when(F.col("gold") == POSITIVE, 1.0).otherwise(0.0), 2)
    rows = decision_rows(spark, sf).where("gold is not null and not error")
    return rows.groupBy("arm").agg(F.round(F.sum(F.when(correct(), w).otherwise(0)) / F.sum(w), 6).alias("accuracy"), F.round(F.sum(w * b) / F.sum(w), 6).alias("brier"))


@query(sql("""
, r AS (SELECT arm, count(*) FILTER (WHERE gold='same' AND label='same') / CAST(nullif(count(*) FILTER (WHERE gold='same'), 0) AS DOUBLE) AS tpr, count(*) FILTER (WHERE gold='different' AND label='same') / CAST(nullif(count(*) FILTER (WHERE gold='different'), 0) AS DOUBLE) AS fpr FROM d GROUP BY arm)
SELECT arm, q AS prevalence, CASE WHEN q * tpr + (1 - q) * fpr > 0 THEN round(q * tpr / (q * tpr + (1 - q) * fpr), 6) END AS prec FROM r, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE)) AS v(q)"""))
def b18_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """Precision projected to other prevalences at fixed true and false positive rates; null where undefined."""
    rate = lambda g: count((F.col("gold") == g) & (F.col("label") == POSITIVE)) / F.nullif(count(F.col("gold") == g), F.lit(0))
    r = decision_rows(spark, sf).groupBy("arm").agg(rate("same").alias("tpr"), rate("different").alias("fpr")).withColumn("prevalence", F.explode(F.array(F.lit(0.01), F.lit(0.1), F.lit(0.5))))
    q = F.col("prevalence")
    total = q * F.col("tpr") + (1 - q) * F.col("fpr")
    return r.select("arm", "prevalence", F.when(total > 0, F.round(q * F.col("tpr") / total, 6)).alias("prec"))


@query(sql("""
, s AS (SELECT arm, count(*) AS m FROM d WHERE label = 'same' GROUP BY arm), t AS (SELECT sum(m) AS t FROM s),
q AS (SELECT arm, floor(m * 50.0 / t) AS base, m * 50.0 / t - floor(m * 50.0 / t) AS rest FROM s, t), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, arm) AS k, 50 - sum(base) OVER () AS more FROM q)
SELECT arm, CAST(base + CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r"""))
def f17_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """50 reviews shared among the arms by largest remainder."""
    s = decision_rows(spark, sf).where(F.col("label") == POSITIVE).groupBy("arm").agg(n().alias("m"))
    whole = W.partitionBy()  # a row for each arm
    share = F.col("m") * F.lit(50.0) / F.sum("m").over(whole)
    q = s.select("arm", F.floor(share).alias("base"), (share - F.floor(share)).alias("rest"))
    r = q.select("arm", "base", F.row_number().over(W.orderBy(F.desc("rest"), "arm")).alias("k"), (50 - F.sum("base").over(whole)).alias("more"))
    return r.select("arm", (F.col("base") + F.when(F.col("k") <= F.col("more"), 1).otherwise(0)).cast("bigint").alias("quota"))


@query("""
WITH r AS (SELECT DISTINCT lower(trim(claim_id)) AS claim, lower(trim(document_id)) AS doc, lower(trim(gold_label)) AS label, rationale_sentence_ids FROM relation_examples WHERE claim_id IS NOT NULL AND document_id IS NOT NULL)
SELECT claim, doc, CASE WHEN count(DISTINCT label) > 1 THEN 'CONFLICT' ELSE coalesce(max(label), 'not_enough_info') END AS label, count(*) AS n,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(rationale_sentence_ids) FILTER (WHERE rationale_sentence_ids IS NOT NULL)))), ','), '') AS rationale FROM r GROUP BY ALL""")
def a20_claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each claim and cited document: its label or CONFLICT, and the sorted distinct rationale sentences."""
    key = lambda c: F.lower(F.trim(c))
    r = table(spark, sf, "relation_examples").where("claim_id is not null and document_id is not null").select(key("claim_id").alias("claim"), key("document_id").alias("doc"), key("gold_label").alias("label"), "rationale_sentence_ids").distinct()
    labels = F.count_distinct("label")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("rationale_sentence_ids"))))
    return r.groupBy("claim", "doc").agg(F.when(labels > 1, "CONFLICT").otherwise(F.coalesce(F.max("label"), F.lit("not_enough_info"))).alias("label"), n().alias("n"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("rationale"))


@query(sql("""
, m AS (SELECT arm, split, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE label = gold) AS DOUBLE) AS correct, CAST(count(*) FILTER (WHERE error) AS DOUBLE) AS errors FROM d GROUP BY ALL)
SELECT arm, split, metric, value FROM m UNPIVOT (value FOR metric IN (n, correct, errors))"""))
def a19_report_long(spark: SparkSession, sf: str) -> DataFrame:
    """The report table in long form."""
    m = decision_rows(spark, sf).groupBy("arm", "split").agg(n().cast("double").alias("n"), count(correct()).cast("double").alias("correct"), count(F.col("error")).cast("double").alias("errors"))
    return m.unpivot(["arm", "split"], ["n", "correct", "errors"], "metric", "value")
