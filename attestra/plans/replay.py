"""Loaders, replays, caches, backends and plans over the tables: the parts of A, B, G, M and N that read recorded results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prob
from ..operators import graph, policies
from ..operators.decisions import decision_rows
from ..operators.planner import staged_sample
from ..session import table
from ..sources.files import cached
from .metrics import count, n, sql
from .registry import query


@query(sql("""
, r AS (SELECT sha256(item || '|' || arm || '|' || backend_version) AS request, min_by(ROW(label, error), id) AS x, count(*) AS calls FROM d WHERE item IS NOT NULL AND arm IS NOT NULL AND backend_version IS NOT NULL GROUP BY 1),
q AS (SELECT DISTINCT item, arm, sha256(item || '|' || arm || '|1.4') AS request FROM d WHERE item IS NOT NULL AND arm IS NOT NULL)
SELECT q.arm, count(*) AS asked, count(r.request) AS replayed, count(*) FILTER (WHERE r.x[2]) AS failed, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls FROM q LEFT JOIN r ON q.request = r.request GROUP BY q.arm"""))
def a9_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed replay: a recorded answer serves a request only if input, formulation and version are the same; nothing else is reused."""
    d = decision_rows(spark, sf).where("item is not null and arm is not null")
    key = lambda version: F.sha2(F.concat("item", F.lit("|"), "arm", F.lit("|"), version), 256)
    r = d.where("backend_version is not null").groupBy(key(F.col("backend_version")).alias("request")).agg(F.min_by("error", "id").alias("failed"), n().alias("calls"))
    q = d.select("item", "arm").distinct().withColumn("request", key(F.lit("1.4")))
    both = q.join(r.withColumn("found", F.lit(True)), "request", "left")
    return both.groupBy("arm").agg(n().alias("asked"), count(F.col("found")).alias("replayed"), count(F.col("failed")).alias("failed"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))


@query("""
WITH c AS (SELECT example_id AS key, predicted_label AS response, recorded_at AS r_at, result_id, CASE WHEN result_id % 10 = 0 THEN '' ELSE sha256(predicted_label) END AS digest FROM evaluation_results WHERE predicted_label IS NOT NULL),
g AS (SELECT key, arg_min(response, ROW(-epoch_us(r_at), digest)) AS response FROM c WHERE sha256(response) = digest AND r_at IS NOT NULL GROUP BY key), q AS (SELECT DISTINCT example_id AS key FROM evaluation_results WHERE example_id IS NOT NULL)
SELECT CASE WHEN g.key IS NULL THEN 'miss' ELSE lower(trim(g.response)) END AS state, count(*) AS n FROM q LEFT JOIN g ON q.key = g.key GROUP BY 1""")
def a14_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A response cache by content: the latest entry whose digest is that of its response (every tenth entry is spoilt here), else a miss."""
    e = table(spark, sf, "evaluation_results")
    digest = F.when(F.col("result_id") % 10 == 0, "").otherwise(F.sha2("predicted_label", 256))
    cache = e.where("predicted_label is not null and recorded_at is not null").select(F.col("example_id").alias("key"), F.col("predicted_label").alias("response"), digest.alias("sha256"), F.col("recorded_at").alias("at"))
    asked = e.where("example_id is not null").select(F.col("example_id").alias("key")).distinct()
    got = cached(asked, cache)
    return got.groupBy(F.when(F.col("response").isNull(), "miss").otherwise(F.lower(F.trim("response"))).alias("state")).agg(n().alias("n"))


@query("""
WITH r AS (SELECT DISTINCT id, claim, lower(trim(gold_label)) AS label, group_id FROM relation_examples), c AS (SELECT id, count(*) AS k FROM r GROUP BY id), s AS (SELECT claim, count(DISTINCT id) AS k FROM r WHERE trim(claim) <> '' GROUP BY claim)
SELECT problem, count(*) AS n FROM (
  SELECT 'state empty' AS problem FROM r WHERE claim IS NULL OR trim(claim) = '' UNION ALL SELECT 'label unknown' FROM r WHERE label IS NULL OR label NOT IN ('supports', 'refutes', 'not_enough_info')
  UNION ALL SELECT 'group missing' FROM r WHERE group_id IS NULL UNION ALL SELECT 'id repeated' FROM c WHERE k > 1 UNION ALL SELECT 'state repeated' FROM s WHERE k > 1) GROUP BY problem""")
def a15_example_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What a loader of labelled examples must reject, by kind: empty states, unknown labels, missing groups, repeated ids and states."""
    r = table(spark, sf, "relation_examples").select("id", "claim", F.lower(F.trim("gold_label")).alias("label"), "group_id").distinct()
    bad = F.array_compact(F.array(
        F.when(F.col("claim").isNull() | (F.trim("claim") == ""), "state empty"), F.when(F.col("group_id").isNull(), "group missing"),
        F.when(F.col("label").isNull() | ~F.col("label").isin("supports", "refutes", "not_enough_info"), "label unknown")))
    rows = r.select(F.explode(bad).alias("problem"))
    ids = r.groupBy("id").agg(n().alias("k")).where("k > 1").select(F.lit("id repeated").alias("problem"))
    states = r.where("trim(claim) <> ''").groupBy("claim").agg(F.count_distinct("id").alias("k")).where("k > 1").select(F.lit("state repeated").alias("problem"))
    return rows.unionByName(ids).unionByName(states).groupBy("problem").agg(n().alias("n"))


def json_safe(value: Column) -> Column:
    """A number as JSON text; NaN and infinities, which JSON does not have, as a marked string; null stays null."""
    text = F.when(F.isnan(value), "NaN").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.when(text.isNotNull(), F.concat(F.lit('"<nonfinite:'), text, F.lit('>"'))).otherwise(F.round(value, 4).cast("decimal(20,4)").cast("string"))


@query(sql("""
SELECT id, CASE WHEN x = 0 THEN '"<nonfinite:NaN>"' WHEN x = 1 THEN '"<nonfinite:inf>"' ELSE CAST(CAST(round(score, 4) AS DECIMAL(20,4)) AS VARCHAR) END AS score FROM (SELECT id, score, id % 50 AS x FROM d WHERE score IS NOT NULL)"""))
def a17_json_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as JSON-safe text, with some made not a number and infinite."""
    value = F.when(F.col("id") % 50 == 0, float("nan")).when(F.col("id") % 50 == 1, float("inf")).otherwise(F.col("score"))
    return decision_rows(spark, sf).where("score is not null").select("id", json_safe(value).alias("score"))


@query("""SELECT DISTINCT id, '{"claim":' || to_json(claim) || ',"source":' || to_json(source_code) || '}' AS ir FROM relation_examples WHERE claim IS NOT NULL AND source_code IS NOT NULL AND NOT regexp_matches(claim, '[\\x00-\\x1f\\x7f]')""")
def a22_serialized(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON objects of fixed field order (claims with control characters are left to the canonical form)."""
    r = table(spark, sf, "relation_examples").where("claim is not null and source_code is not null").where(~F.col("claim").rlike(r"[\x00-\x1f\x7f]"))
    return r.select("id", F.to_json(F.struct("claim", F.col("source_code").alias("source"))).alias("ir")).distinct()


@query("""
WITH s AS (SELECT result_id, CAST(('0x' || substr(sha256(CAST(result_id AS VARCHAR)), 1, 8)) AS BIGINT) % 4 AS shard FROM evaluation_results), c AS (SELECT result_id, shard FROM s WHERE NOT (shard = 2 AND result_id % 100 = 0) UNION ALL SELECT result_id, (shard + 1) % 4 FROM s WHERE result_id % 500 = 1),
k AS (SELECT result_id, count(*) AS n FROM c GROUP BY result_id)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN k.n IS NULL THEN 'missing' WHEN k.n > 1 THEN 'twice' ELSE 'once' END AS state FROM s LEFT JOIN k USING (result_id)) GROUP BY state""")
def a23_shards(spark: SparkSession, sf: str) -> DataFrame:
    """A capture in four shards against its plan: rows that no shard has and rows that two have (some are spoilt here)."""
    s = table(spark, sf, "evaluation_results").select("result_id", prob.hash_bucket(F.col("result_id"), 4).alias("shard"))
    c = s.where(~((F.col("shard") == 2) & (F.col("result_id") % 100 == 0))).unionByName(s.where(F.col("result_id") % 500 == 1).select("result_id", ((F.col("shard") + 1) % 4).alias("shard")))
    k = c.groupBy("result_id").agg(n().alias("k"))
    state = F.when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "twice").otherwise("once")
    return s.join(k, "result_id", "left").groupBy(state.alias("state")).agg(n().alias("n"))


@query("""SELECT r AS risk, a AS alpha, CAST(ceil(ln(a) / ln(1 - r)) AS BIGINT) AS rows FROM (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) AS x(r), (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) AS y(a)""")
def b19_sample_size(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without an error that show a rate below the risk, on a grid of risks and levels."""
    grid = [(r, a, policies.zero_error_sample_size(r, a)) for r in (0.001, 0.01, 0.05, 0.1) for a in (0.01, 0.05)]
    return spark.createDataFrame(grid, "risk double, alpha double, rows bigint")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), c AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o FROM orders)
SELECT 'p' || p AS node, 0 AS level FROM (SELECT DISTINCT p FROM o) UNION ALL SELECT 'o' || o, 1 FROM (SELECT DISTINCT o FROM o) UNION ALL SELECT 'o' || o, 0 FROM (SELECT DISTINCT o FROM c WHERE o NOT IN (SELECT o FROM o))
UNION ALL SELECT 'c' || c, max(CASE WHEN o.o IS NULL THEN 1 ELSE 2 END) FROM c LEFT JOIN (SELECT DISTINCT o FROM o) o ON c.o = o.o GROUP BY c""")
def g6_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Topological levels of the dependencies part, order, customer, by peeling; what lies on or behind a cycle would have no row."""
    name = lambda k, c: F.concat(F.lit(k), c)
    lines = table(spark, sf, "lineitem").select(name("o", "l_orderkey").alias("node"), name("p", "l_partkey").alias("needs"))
    orders = table(spark, sf, "orders").select(name("c", "o_custkey").alias("node"), name("o", "o_orderkey").alias("needs"))
    edges = lines.unionByName(orders).distinct()
    nodes = edges.select(F.explode(F.array("node", "needs")).alias("node"))
    return graph.peeled(nodes, edges).select("node", "level")


@query("""
WITH r AS (SELECT DISTINCT id FROM relation_examples WHERE id IS NOT NULL), u AS (SELECT id, CAST(('0x' || substr(sha256('mock:' || id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM r)
SELECT id, round(0.02 + 0.96 * u, 9) AS p, CASE WHEN 0.02 + 0.96 * u >= 0.5 THEN 'same' ELSE 'different' END AS label FROM u""")
def m4_mock(spark: SparkSession, sf: str) -> DataFrame:
    """A mock backend: distributions from a digest of the input, the same in every run and partitioning."""
    r = table(spark, sf, "relation_examples").where("id is not null").select("id").distinct()
    p = 0.02 + 0.96 * prob.hash_bucket(F.concat(F.lit("mock:"), "id"), 2**32) / F.lit(4294967296.0)
    return r.select("id", F.round(p, 9).alias("p"), F.when(p >= 0.5, "same").otherwise("different").alias("label"))


@query("""
WITH r AS (SELECT DISTINCT id, length(claim) AS n FROM relation_examples WHERE id IS NOT NULL)
SELECT CASE WHEN n IS NULL THEN 'ERROR' WHEN n % 2 = 0 THEN 'same' ELSE 'different' END AS label, count(*) AS n FROM r GROUP BY 1""")
def m6_evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Requests through a backend in Arrow batches: a row it can't answer is an ERROR row, and never a fallback answer."""

    def parity(rows: pd.DataFrame) -> pd.DataFrame:
        label = rows["n"].map(lambda x: "same" if x % 2 == 0 else "different", na_action="ignore")
        return rows.assign(label=label.where(rows["n"].notna(), "ERROR"), error=rows["n"].isna().map({True: "no claim", False: None}))

    requests = table(spark, sf, "relation_examples").where("id is not null").select("id", F.length("claim").alias("n")).distinct()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "label", "error")])
    return policies.decide(requests, parity, schema).groupBy("label").agg(n().alias("n"))


@query("""
WITH r AS (SELECT DISTINCT id, group_id, source_code FROM relation_examples WHERE id IS NOT NULL AND source_code IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY sha256('3:' || id), id) AS r, (SELECT count(DISTINCT source_code) FROM r) AS d FROM r),
t AS (SELECT group_id, min(CASE WHEN r <= ceil(40.0 / d) THEN 0 WHEN r <= ceil(200.0 / d) THEN 1 END) AS stage FROM k GROUP BY group_id)
SELECT stage, count(*) AS rows, count(DISTINCT r.group_id) AS groups FROM r JOIN t ON r.group_id = t.group_id WHERE stage IS NOT NULL GROUP BY stage""")
def n1_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Nested stages of a planned sample (a sampling operator): shares of 40 and 200 rows over the sources in digest order, with whole groups."""
    r = table(spark, sf, "relation_examples").where("id is not null and source_code is not null").select("id", "group_id", "source_code").distinct()
    s = staged_sample(r, "id", "group_id", "source_code", [40, 200], 3)
    return s.where("stage is not null").groupBy("stage").agg(n().alias("rows"), F.count_distinct("group_id").alias("groups"))
