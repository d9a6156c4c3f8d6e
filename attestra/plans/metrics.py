"""Operational and probabilistic metrics of decision rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prob
from ..operators.decisions import DECISIONS, LABELS, POSITIVE, decision_rows
from ..operators.ordering import harmonic, quantiles, ranked, running
from ..session import staged, table
from .registry import query

def n() -> F.Column:
    return F.count(F.lit(1))


def count(condition) -> F.Column:
    return F.count(F.when(condition, 1))


def correct() -> F.Column:
    return F.col("label") == F.col("gold")


def sql(body: str) -> str:
    return f"WITH {DECISIONS} {body}"


@query(sql("""SELECT arm, coalesce(gold, 'NONE') AS gold, label, count(*) AS n FROM d GROUP BY ALL"""))
def e1_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts with ERROR and ABSTAIN as predicted classes."""
    return decision_rows(spark, sf).groupBy("arm", F.coalesce("gold", F.lit("NONE")).alias("gold"), "label").agg(n().alias("n"))


@query(sql("""
, k AS (SELECT arm, c, count(*) FILTER (WHERE gold = c AND label = c) AS tp, count(*) FILTER (WHERE gold <> c AND label = c) AS fp, count(*) FILTER (WHERE gold = c AND label <> c) AS fn
        FROM d, (VALUES ('same'), ('different')) AS v(c) WHERE gold IS NOT NULL GROUP BY ALL)
SELECT arm, c AS class, CAST(tp + fn AS BIGINT) AS support, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 6) END AS prec,
  CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 6) END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) END::DOUBLE AS f1 FROM k"""))  # fmt: skip
def e1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 by class; failed and abstained rows count as wrong, F1 of nothing right is 0."""
    rows = decision_rows(spark, sf).where("gold is not null").select("arm", "gold", "label", F.explode(F.array(*map(F.lit, LABELS))).alias("class"))
    g, p = F.col("gold") == F.col("class"), F.col("label") == F.col("class")
    k = rows.groupBy("arm", "class").agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(tp == 0, F.lit(0.0)).otherwise(prob.ratio(2 * tp, 2 * tp + fp + fn))
    return k.select("arm", "class", (tp + fn).alias("support"), prob.ratio(tp, tp + fp).alias("prec"), prob.ratio(tp, tp + fn).alias("recall"), f1.alias("f1"))


@query(sql("""
SELECT arm, count(*) AS n, count(*) FILTER (WHERE gold IS NOT NULL) AS eligible, count(*) FILTER (WHERE error) AS errors, count(*) FILTER (WHERE label = 'ABSTAIN') AS abstained,
  count(*) FILTER (WHERE label = gold) AS correct, round(count(*) FILTER (WHERE label = gold) / CAST(count(*) FILTER (WHERE gold IS NOT NULL) AS DOUBLE), 6) AS accuracy,
  round(count(*) FILTER (WHERE label IN ('same', 'different')) / CAST(count(*) AS DOUBLE), 6) AS coverage,
  round(count(*) FILTER (WHERE label = gold) / CAST(count(*) FILTER (WHERE gold IS NOT NULL AND label IN ('same', 'different')) AS DOUBLE), 6) AS selective_accuracy,
  round(avg(CASE WHEN gold IS NOT NULL AND NOT error THEN power(p - CASE WHEN gold = 'same' THEN 1 ELSE 0 END, 2) * 2 END), 6) AS brier,
  round(avg(CASE WHEN gold IS NOT NULL AND NOT error THEN -ln(greatest(dist[gold], 1e-15)) END), 6) AS log_loss FROM d GROUP BY arm"""))  # fmt: skip
def e2_backend_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of each backend: failures stay in the denominators, probability scores use valid rows only."""
    rows = decision_rows(spark, sf)
    ok, gold, answered = ~F.col("error") & F.col("gold").isNotNull(), F.col("gold").isNotNull(), F.col("label").isin(LABELS)
    return rows.groupBy("arm").agg(
        n().alias("n"), count(gold).alias("eligible"), count(F.col("error")).alias("errors"), count(F.col("label") == "ABSTAIN").alias("abstained"), count(correct()).alias("correct"),
        prob.ratio(count(correct()), count(gold)).alias("accuracy"), prob.ratio(count(answered), n()).alias("coverage"), prob.ratio(count(correct()), count(gold & answered)).alias("selective_accuracy"),
        F.round(F.avg(F.when(ok, prob.brier(F.col("dist"), F.col("gold"), LABELS))), 6).alias("brier"), F.round(F.avg(F.when(ok, prob.log_loss(F.col("dist"), F.col("gold")))), 6).alias("log_loss"))


@query(sql("""
, b AS (SELECT arm, least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, score, label = gold AS ok FROM d WHERE gold IS NOT NULL AND NOT error AND score IS NOT NULL)
SELECT arm, bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b GROUP BY arm, bin"""))
def e8_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability curve: ten equal bins of the score, the last one closed."""
    return _bins(spark, sf).groupBy("arm", "bin").agg(n().alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("ok"), 6).alias("accuracy"))


def _bins(spark: SparkSession, sf: str, bins: int = 10) -> DataFrame:
    rows = decision_rows(spark, sf).where("gold is not null and not error and score is not null")
    return rows.select("arm", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("bigint").alias("bin"), "score", F.when(correct(), 1.0).otherwise(0.0).alias("ok"))


@query(sql("""
, b AS (SELECT arm, least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n, abs(sum(score) - sum(CASE WHEN label = gold THEN 1.0 ELSE 0.0 END)) AS gap
        FROM d WHERE gold IS NOT NULL AND NOT error AND score IS NOT NULL GROUP BY ALL)
SELECT arm, round(sum(gap) / sum(n), 6) AS ece FROM b GROUP BY arm"""))
def e5_ece(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error over ten bins."""
    b = _bins(spark, sf).groupBy("arm", "bin").agg(n().alias("n"), F.abs(F.sum("score") - F.sum("ok")).alias("gap"))
    return b.groupBy("arm").agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"))


@query(sql("""
, k AS (SELECT arm, CAST(count(*) FILTER (WHERE gold='same' AND label='same') AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE gold='different' AND label='different') AS DOUBLE) AS tn,
   CAST(count(*) FILTER (WHERE gold='different' AND label='same') AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE gold='same' AND label='different') AS DOUBLE) AS fn FROM d GROUP BY arm)
SELECT arm, CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 6) END AS mcc,
  CASE WHEN tn + fp > 0 THEN round(fp / (tn + fp), 6) END AS false_merge_rate FROM k"""))
def e4_mcc(spark: SparkSession, sf: str) -> DataFrame:
    """Matthews correlation of answered rows, and the false merges among the different pairs."""
    c = lambda g, p: count((F.col("gold") == g) & (F.col("label") == p)).cast("double")
    k = decision_rows(spark, sf).groupBy("arm").agg(c("same", "same").alias("tp"), c("different", "different").alias("tn"), c("different", "same").alias("fp"), c("same", "different").alias("fn"))
    prod = F.expr("(tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)")
    return k.select("arm", F.when(prod > 0, F.round(F.expr("tp*tn-fp*fn") / F.sqrt(prod), 6)).alias("mcc"), prob.ratio(F.col("fp"), F.expr("tn+fp")).alias("false_merge_rate"))


@query(sql("""
, r AS (SELECT arm, id, avg(CASE WHEN label = gold THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY arm ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS risk
        FROM d WHERE gold IS NOT NULL AND NOT error AND score IS NOT NULL)
SELECT arm, round(avg(risk), 6) AS aurc FROM r GROUP BY arm"""))
def e5_aurc(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the risk-coverage curve: the mean error of all prefixes in order of score, then id.

    A wrong row of rank r adds 1/k to every prefix k from r to n, that is the difference of two harmonic numbers.
    """
    rows = decision_rows(spark, sf).where("gold is not null and not error and score is not null").select("arm", "id", "score", correct().alias("ok"))
    sizes = rows.groupBy("arm").agg(n().alias("n"))
    placed = ranked(rows, ["arm"], F.desc("score"), "id").join(F.broadcast(sizes), "arm")  # a row for each arm
    area = F.when(F.col("ok"), 0.0).otherwise(harmonic(F.col("n")) - harmonic(F.col("rank") - 1))
    return placed.groupBy("arm").agg(F.round(F.sum(area) / F.max("n"), 6).alias("aurc"))


@query(sql("""
, s AS (SELECT arm, score, count(*) AS n, count(*) FILTER (WHERE label = gold) AS ok FROM d WHERE gold IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
t AS (SELECT arm, count(*) AS total FROM d WHERE gold IS NOT NULL GROUP BY arm),
c AS (SELECT arm, score, sum(n) OVER w AS accepted, sum(ok) OVER w AS right_ FROM s WINDOW w AS (PARTITION BY arm ORDER BY score DESC))
SELECT c.arm, score, CAST(accepted AS BIGINT) AS accepted, round(accepted / CAST(total AS DOUBLE), 6) AS coverage, round(1 - right_ / CAST(accepted AS DOUBLE), 6) AS risk FROM c JOIN t USING (arm)"""))
def f1_risk_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Risk and coverage at each score: ties are admitted as a block, coverage is of all eligible rows."""
    rows = decision_rows(spark, sf).where("gold is not null")
    s = rows.where("score is not null").groupBy("arm", "score").agg(n().alias("n"), count(correct()).alias("ok"))
    c = running(s, ["arm"], [F.desc("score")], {"accepted": F.col("n"), "right_": F.col("ok")})
    total = rows.groupBy("arm").agg(n().alias("total"))
    return c.join(total, "arm").select("arm", "score", "accepted", prob.ratio(F.col("accepted"), F.col("total")).alias("coverage"), F.round(1 - F.col("right_") / F.col("accepted"), 6).alias("risk"))


@query(sql("""
, r AS (SELECT arm, id, score, CASE WHEN label = gold THEN 0.0 ELSE 1.0 END AS wrong FROM d WHERE gold IS NOT NULL AND NOT error AND score IS NOT NULL),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY arm ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tie FROM (
  SELECT *, CASE WHEN lag(score) OVER (PARTITION BY arm ORDER BY score DESC, id) - score <= 1e-14 THEN 0 ELSE 1 END AS fresh FROM r)),
c AS (SELECT arm, avg(wrong) OVER (PARTITION BY arm ORDER BY tie, wrong, id ROWS UNBOUNDED PRECEDING) AS best, avg(wrong) OVER (PARTITION BY arm ORDER BY tie, wrong DESC, id ROWS UNBOUNDED PRECEDING) AS worst FROM t)
SELECT arm, round(avg(best), 6) AS lower, round(avg(worst), 6) AS upper FROM c GROUP BY arm"""))
def f2_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the AURC over all orders within ties: scores no further than 1e-14 apart in sequence are one tie, its wrong
    rows stand last for the lower bound and first for the upper one.

    Only counts of each tie are needed: with a rows before it, of n in all, k wrong ones of m stand at ranks a + m - k + 1 to
    a + m, or a + 1 to a + k, and each adds a difference of harmonic numbers. Sums of harmonic numbers are
    H(1) + ... + H(x) = (x + 1) H(x) - x.
    """
    rows = decision_rows(spark, sf).where("gold is not null and not error and score is not null")
    s = rows.groupBy("arm", "score").agg(n().alias("n"), count(~correct()).alias("bad"))
    # the next greater distinct score stands one rank before
    placed = staged(ranked(s, ["arm"], F.desc("score")), "scores")
    former = placed.select("arm", (F.col("rank") + 1).alias("rank"), F.col("score").alias("former"))
    marked = placed.join(former, ["arm", "rank"], "left")
    fresh = F.when(F.col("former") - F.col("score") <= 1e-14, 0).otherwise(1)
    ties = running(marked.withColumn("fresh", fresh), ["arm"], [F.desc("score")], {"tie": F.col("fresh")}).groupBy("arm", "tie").agg(F.sum("n").alias("m"), F.sum("bad").alias("k"))
    r = running(ties, ["arm"], ["tie"], {"upto": F.col("m")})
    total = ties.groupBy("arm").agg(F.sum("m").alias("n"))
    sums = lambda x: (x + 1) * harmonic(x) - x
    last, first = F.col("upto"), F.col("upto") - F.col("m")
    area = lambda lo, hi: F.col("k") * harmonic(F.col("n")) - (sums(hi) - sums(lo))
    r = r.join(F.broadcast(total), "arm")  # a row for each arm
    lower, upper = area(last - F.col("k") - 1, last - 1), area(first - 1, first + F.col("k") - 1)
    some = lambda c: F.sum(F.when(F.col("k") > 0, c).otherwise(0.0)) / F.max("n")
    return r.groupBy("arm").agg(F.round(some(lower), 6).alias("lower"), F.round(some(upper), 6).alias("upper"))


@query(sql("""
SELECT arm, split, count(*) AS n, count(*) FILTER (WHERE label = 'same') AS edges, count(*) FILTER (WHERE label = 'same' AND gold = 'same') AS correct_edges,
  count(*) FILTER (WHERE label = 'same' AND gold = 'different') AS wrong_edges, count(*) FILTER (WHERE gold = 'same' AND label <> 'same') AS missed_edges FROM d GROUP BY ALL"""))
def e6_edge_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Edges (accepted positive verdicts) by arm and split: right, wrong and missed."""
    edge = F.col("label") == POSITIVE
    return decision_rows(spark, sf).groupBy("arm", "split").agg(n().alias("n"), count(edge).alias("edges"), count(edge & (F.col("gold") == POSITIVE)).alias("correct_edges"), count(edge & (F.col("gold") == "different")).alias("wrong_edges"), count((F.col("gold") == POSITIVE) & ~edge).alias("missed_edges"))


@query(sql("""
, g AS (SELECT arm, grp, count(*) AS n, count(*) FILTER (WHERE label = 'same' AND gold = 'different') AS wrong, bool_and(label = gold) AS clean FROM d WHERE gold IS NOT NULL GROUP BY ALL)
SELECT arm, count(*) AS groups, CAST(max(n) AS BIGINT) AS largest, count(*) FILTER (WHERE wrong > 0) AS contaminated, count(*) FILTER (WHERE clean) AS complete_and_clean FROM g GROUP BY arm"""))
def e7_component_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels: groups with a wrong edge, and groups all of whose rows are right."""
    wrong = (F.col("label") == POSITIVE) & (F.col("gold") == "different")
    g = decision_rows(spark, sf).where("gold is not null").groupBy("arm", "grp").agg(n().alias("n"), count(wrong).alias("wrong"), F.bool_and(correct()).alias("clean"))
    return g.groupBy("arm").agg(n().alias("groups"), F.max("n").alias("largest"), count(F.col("wrong") > 0).alias("contaminated"), count(F.col("clean")).alias("complete_and_clean"))


@query(sql("""
SELECT arm, execution_mode, count(*) AS calls, count(*) FILTER (WHERE error) AS failed, count(*) FILTER (WHERE tokens_in IS NULL) AS unknown_usage, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
  round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95, round(quantile_cont(latency, 0.99), 4) AS p99, round(avg(latency), 4) AS mean_latency FROM d GROUP BY ALL"""))
def e10_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, failures, tokens and exact latency quantiles (linear interpolation)."""
    rows = decision_rows(spark, sf)
    by = ["arm", "execution_mode"]
    sums = rows.groupBy(*by).agg(n().alias("calls"), count(F.col("error")).alias("failed"), count(F.col("tokens_in").isNull()).alias("unknown_usage"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.avg("latency"), 4).alias("mean_latency"))
    q = quantiles(rows, by, "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    q = q.select(F.col("arm").alias("_a"), F.col("execution_mode").alias("_m"), *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])
    return sums.join(q, F.col("arm").eqNullSafe(F.col("_a")) & F.col("execution_mode").eqNullSafe(F.col("_m")), "left").drop("_a", "_m")


@query(sql("""
, v AS (SELECT item, id, arm, label, p FROM d WHERE NOT error),
r AS (SELECT a.arm, abs(a.p - b.p) AS tv, a.label <> b.label AS flip FROM v a JOIN v b ON a.item = b.item AND a.arm = b.arm AND a.id < b.id)
SELECT arm, count(*) AS pairs, count(*) FILTER (WHERE flip) AS flips, round(avg(tv), 6) AS mean_tv, count(*) FILTER (WHERE tv = 0) AS exact FROM r GROUP BY arm"""))
def e11_repeatability(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated verdicts of a backend on one example: total variation distance and flips over the pairs of repeats."""
    # no pairs are formed: of m sorted probabilities the one of rank r is added 2 r - m - 1 times in all differences
    v = decision_rows(spark, sf).where("not error and item is not null").select("item", "arm", "id", "label", "p")
    two = lambda c: c * (c - 1) / 2
    sizes = v.groupBy("arm", "item").agg(n().alias("m"), F.count("p").alias("mp")).where("m > 1")
    placed = ranked(v.where("p is not null"), ["arm", "item"], "p", "id").join(sizes.select("arm", "item", "mp"), ["arm", "item"])
    apart = placed.groupBy("arm").agg(F.sum(F.col("p") * (2 * F.col("rank") - F.col("mp") - 1)).alias("tv"))
    alike = lambda c: v.where(F.col(c).isNotNull()).groupBy("arm", "item", c).agg(n().alias("c")).groupBy("arm").agg(F.sum(two(F.col("c"))).alias(f"same_{c}"))
    pairs = sizes.groupBy("arm").agg(F.sum(two(F.col("m"))).alias("pairs"), F.sum(two(F.col("mp"))).alias("with_p"))
    r = pairs.join(apart, "arm", "left").join(alike("label"), "arm").join(alike("p"), "arm", "left")
    return r.select("arm", F.col("pairs").cast("bigint").alias("pairs"), (F.col("pairs") - F.col("same_label")).cast("bigint").alias("flips"), F.round(F.col("tv") / F.col("with_p"), 6).alias("mean_tv"), F.coalesce("same_p", F.lit(0)).cast("bigint").alias("exact"))


@query(sql("""
SELECT arm, CASE WHEN dist IS NULL THEN 'missing' WHEN list_sort(map_keys(dist)) <> ['different', 'same'] THEN 'keys' WHEN abs(list_sum(map_values(dist)) - 1) > 1e-6 THEN 'sum' ELSE 'valid' END AS state, count(*) AS n FROM d GROUP BY ALL"""))
def b2_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Distributions by what is wrong with them."""
    return decision_rows(spark, sf).groupBy("arm", F.coalesce(prob.distribution_error(F.col("dist"), LABELS), F.lit("valid")).alias("state")).agg(n().alias("n"))


@query(sql("""SELECT id, label, CASE WHEN dist IS NULL THEN NULL WHEN dist['same'] >= dist['different'] THEN 'same' ELSE 'different' END AS top FROM d WHERE NOT error
  AND (CASE WHEN dist['same'] >= dist['different'] THEN 'same' ELSE 'different' END) IS DISTINCT FROM label"""))
def b8_argmax_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts whose label is not the most probable one (ties by label order)."""
    rows = decision_rows(spark, sf).where("not error").select("id", "label", prob.argmax_label(F.col("dist"), LABELS).alias("top"))
    return rows.where(~F.col("top").eqNullSafe(F.col("label")))


@query(sql("""SELECT t.temperature, arm, round(avg(-ln(greatest(CASE WHEN gold = 'same' THEN q ELSE 1 - q END, 1e-15))), 6) AS nll FROM (
  SELECT temperature, arm, gold, 1 / (1 + exp((ln(greatest(1 - p, 1e-15)) - ln(greatest(p, 1e-15))) / temperature)) AS q FROM d, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) AS v(temperature)
  WHERE split = 'calibration' AND gold IS NOT NULL AND NOT error) AS t GROUP BY ALL"""))
def j1_temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Negative log-likelihood of the calibration split on a grid of temperatures."""
    rows = decision_rows(spark, sf).where("split = 'calibration' and gold is not null and not error")
    grid = rows.select("arm", "gold", "p", F.explode(F.array(*[F.lit(t) for t in (0.5, 1.0, 2.0, 4.0)])).alias("temperature"))
    q = prob.tempered(F.col("p"), F.col("temperature"))
    return grid.groupBy("temperature", "arm").agg(F.round(F.avg(-F.log(F.greatest(F.when(F.col("gold") == POSITIVE, q).otherwise(1 - q), F.lit(prob.CLIP)))), 6).alias("nll"))


@query("""SELECT kind, coalesce(lang, 'none') AS lang, count(*) AS n, count(text) AS with_text, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT sha256(text)) AS distinct_texts FROM documents GROUP BY GROUPING SETS ((kind, lang)) """)
def e23_corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by kind and language: rows, texts, characters and distinct texts."""
    return table(spark, sf, "documents").groupBy("kind", F.coalesce("lang", F.lit("none")).alias("lang")).agg(n().alias("n"), F.count("text").alias("with_text"), F.sum("n_chars").alias("chars"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"))


@query("""SELECT coalesce(split, 'all') AS split, coalesce(gold, 'all') AS gold, count(*) AS n, count(DISTINCT id) AS distinct_ids FROM (SELECT id, split, coalesce(lower(trim(gold_label)), 'none') AS gold FROM relation_examples) GROUP BY GROUPING SETS ((split, gold), (split), ())""")
def e20_label_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Overall, by split, and by split and label in one pass."""
    rows = table(spark, sf, "relation_examples").select("id", "split", F.coalesce(F.lower(F.trim("gold_label")), F.lit("none")).alias("gold"))
    out = rows.rollup("split", "gold").agg(n().alias("n"), F.count_distinct("id").alias("distinct_ids"))
    return out.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("gold", F.lit("all")).alias("gold"), "n", "distinct_ids")
