"""Decision rows: the central fact table that every metric, policy and fit reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prob import hash_bucket
from ..session import table

LABELS = ["same", "different"]
POSITIVE = "same"


def decision_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per verdict: id, task, arm, item, grp, split, gold, label, p, dist, score, error, tokens, latency.

    gold is null unless one of the two labels (such rows stay, but are no subject of correctness). label is ERROR for failed
    calls and unreadable answers, ABSTAIN for abstentions. split is a 60/20/20 hash partition by group.
    """
    gold, said = F.lower(F.trim("gold_label")), F.lower(F.trim("predicted_label"))
    label = F.when(F.col("raw_error").isNotNull(), "ERROR").when(said == "abstain", "ABSTAIN").when(said.isin(LABELS), said).otherwise("ERROR")
    rows = table(spark, sf, "evaluation_results").select(
        F.col("result_id").alias("id"), F.col("decision_primitive").alias("task"), F.col("backend_name").alias("arm"), F.col("example_id").alias("item"),
        F.coalesce(F.get("pair", F.lit(0)), F.lit("")).alias("grp"), F.when(gold.isin(LABELS), gold).alias("gold"), label.alias("label"),
        F.try_element_at("distribution", F.lit(POSITIVE)).alias("p"), F.col("distribution").alias("dist"), F.col("confidence").alias("score"),
        F.col("raw_error").isNotNull().alias("error"), F.col("tokens_used.input").alias("tokens_in"), F.col("tokens_used.output").alias("tokens_out"),
        F.col("latency_ms").alias("latency"), "execution_mode", "backend_version", "recorded_at")
    bucket = hash_bucket(F.col("grp"), 10)
    return rows.withColumn("split", F.when(bucket < 6, "development").when(bucket < 8, "calibration").otherwise("evaluation"))


#: The same rows in DuckDB.
DECISIONS = """d AS (
  SELECT *, CASE WHEN b < 6 THEN 'development' WHEN b < 8 THEN 'calibration' ELSE 'evaluation' END AS split FROM (
  SELECT result_id AS id, decision_primitive AS task, backend_name AS arm, example_id AS item, coalesce(pair[1], '') AS grp,
    CASE WHEN lower(trim(gold_label)) IN ('same', 'different') THEN lower(trim(gold_label)) END AS gold,
    CASE WHEN raw_error IS NOT NULL THEN 'ERROR' WHEN lower(trim(predicted_label)) = 'abstain' THEN 'ABSTAIN'
         WHEN lower(trim(predicted_label)) IN ('same', 'different') THEN lower(trim(predicted_label)) ELSE 'ERROR' END AS label,
    distribution['same'] AS p, distribution AS dist, confidence AS score, raw_error IS NOT NULL AS error, tokens_used.input AS tokens_in, tokens_used.output AS tokens_out,
    latency_ms AS latency, execution_mode, backend_version, recorded_at,
    CAST(('0x' || substr(sha256(coalesce(pair[1], '')), 1, 8)) AS BIGINT) % 10 AS b FROM evaluation_results))"""
