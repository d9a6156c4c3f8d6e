"""Gates, pairings, ordered selections, splits and fits over decision rows and the prepared data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import prob
from ..operators import graph, policies
from ..operators.decisions import DECISIONS, LABELS, POSITIVE, decision_rows
from ..operators.ordering import ranked
from ..session import table
from .metrics import correct, count, n, sql
from .registry import query

# gates


@query(sql("""SELECT id, arm, score FROM d WHERE label = 'same' AND score >= 0.9"""))
def c1_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted edges: the positive label at a score of 0.9 or more."""
    return decision_rows(spark, sf).where((F.col("label") == POSITIVE) & (F.col("score") >= 0.9)).select("id", "arm", "score")


@query(sql("""
, v AS (SELECT item, arm, id, label FROM d WHERE NOT error)
SELECT DISTINCT a.item FROM v a JOIN v b ON a.item = b.item AND a.id < b.id WHERE a.label = 'same' AND b.label = 'same'"""))
def c2_stable(spark: SparkSession, sf: str) -> DataFrame:
    """Examples that two valid runs both call the same."""
    runs = decision_rows(spark, sf).where((~F.col("error")) & (F.col("label") == POSITIVE)).groupBy("item").agg(n().alias("n"))
    return runs.where("n > 1").select("item")


@query(sql("""SELECT arm, CASE WHEN error THEN 'ERROR' WHEN label = 'ABSTAIN' OR score < 0.75 THEN 'ABSTAIN' ELSE label END AS gated, count(*) AS n, count(*) FILTER (WHERE gold IS NOT NULL AND label = gold) AS correct FROM d GROUP BY ALL"""))
def c3_threshold_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Labels after the gate: below the threshold an answer becomes an abstention, errors stay errors."""
    gated = F.when(F.col("error"), "ERROR").when((F.col("label") == "ABSTAIN") | (F.col("score") < 0.75), "ABSTAIN").otherwise(F.col("label"))
    return decision_rows(spark, sf).groupBy("arm", gated.alias("gated")).agg(n().alias("n"), count(correct()).alias("correct"))


@query(sql("""SELECT id, grp, split FROM d WHERE split = 'calibration' AND grp NOT IN (SELECT grp FROM d WHERE split = 'evaluation' UNION SELECT grp FROM d WHERE error)"""))
def c5_purge_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration rows of groups that touch neither the evaluation split nor a failed call."""
    rows = decision_rows(spark, sf)
    bad = rows.where("split = 'evaluation' or error").select("grp").distinct()
    return rows.where("split = 'calibration'").join(bad, "grp", "left_anti").select("id", "grp", "split")


@query("""
WITH RECURSIVE """ + DECISIONS + """
, e AS (SELECT d.id, d.split, d.error, grp AS a, coalesce(r.pair[2], grp) AS b FROM d JOIN evaluation_results r ON d.id = r.result_id WHERE d.split <> 'development'),
l AS (SELECT DISTINCT a, b FROM e UNION SELECT b, a FROM e),
bad(x) AS (SELECT a FROM e WHERE split = 'evaluation' OR error UNION SELECT l.b FROM bad JOIN l ON bad.x = l.a)
SELECT id, a AS grp, split FROM e WHERE split = 'calibration' AND a NOT IN (SELECT x FROM bad)""")
def c5_purge_components(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration rows of connected components (over both ends of the pairs of both splits) without an evaluation row or a failed call."""
    ends = table(spark, sf, "evaluation_results").select(F.col("result_id").alias("id"), F.get("pair", F.lit(1)).alias("other"))
    rows = decision_rows(spark, sf).where("split <> 'development'").join(ends, "id").select("id", "grp", "split", "error", F.coalesce("other", "grp").alias("other"))
    roots = graph.components(rows, "grp", "other")
    bad = rows.where("split = 'evaluation' or error").select(F.col("grp").alias("node")).distinct().join(roots, "node").select("root").distinct()
    clean = roots.join(bad, "root", "left_anti").select(F.col("node").alias("grp"))
    return rows.where("split = 'calibration'").join(clean, "grp", "left_semi").select("id", "grp", "split")


@query("""
WITH r AS (SELECT DISTINCT id, split, lower(trim(claim_id)) AS c, lower(trim(document_id)) AS doc FROM relation_examples),
bad AS (SELECT DISTINCT a.c FROM r a JOIN r b ON a.doc = b.doc WHERE a.split = 'train' AND b.split <> 'train' AND a.doc NOT IN ('', 'n/a', 'unknown'))
SELECT DISTINCT id FROM r WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.c = r.c)""")
def c6_overlap_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows left when every claim with a document that also serves a held-out row is dropped whole."""
    key = lambda c: F.lower(F.trim(c))
    r = table(spark, sf, "relation_examples").select("id", "split", key("claim_id").alias("c"), key("document_id").alias("doc")).distinct()
    train, held = r.where("split = 'train'"), r.where("split <> 'train'").select("doc").distinct()
    bad = train.where(~F.col("doc").isin("", "n/a", "unknown")).join(held, "doc", "left_semi").select("c").distinct()
    return train.join(bad, "c", "left_anti").select("id").distinct()


@query("""
WITH p AS (SELECT DISTINCT id, least(entity_1, entity_2) AS a, greatest(entity_1, entity_2) AS b, gold_label FROM identity_pairs WHERE entity_1 IS NOT NULL AND entity_2 IS NOT NULL),
k AS (SELECT a, b, count(*) AS n, count(DISTINCT gold_label) AS labels FROM p GROUP BY ALL)
SELECT a, b, n, labels > 1 AS conflicting FROM k WHERE n > 1""")
def c7_conflicting_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs judged by several rows, and whether their labels conflict."""
    p = table(spark, sf, "identity_pairs").where("entity_1 is not null and entity_2 is not null").select("id", F.least("entity_1", "entity_2").alias("a"), F.greatest("entity_1", "entity_2").alias("b"), "gold_label").distinct()
    return p.groupBy("a", "b").agg(n().alias("n"), F.count_distinct("gold_label").alias("labels")).where("n > 1").select("a", "b", "n", (F.col("labels") > 1).alias("conflicting"))


@query("""
WITH s AS (SELECT source_code, row_number() OVER (ORDER BY sha256('7:' || source_code), source_code) AS r, count(*) OVER () AS n FROM sources)
SELECT source_code FROM s WHERE r > floor(n * 0.25)""")
def c9_surviving_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources left after a quarter is lost, in the order of a seeded digest."""
    return policies.survivors(table(spark, sf, "sources").select("source_code"), "source_code", loss=0.25, seed=7)


@query(sql("""
, r AS (SELECT arm, id, score, label = gold AS ok, row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS k FROM d WHERE label = 'same' AND score IS NOT NULL AND gold IS NOT NULL),
m AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM r GROUP BY arm))
SELECT arm, count(*) AS accepted, count(*) FILTER (WHERE ok) AS correct, round(min(score), 6) AS cut FROM r, m WHERE r.k <= m.k GROUP BY arm"""))
def f3_matched_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """All arms at equal volume: the k best edges of each, k being the least number that an arm accepts."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").isNotNull() & F.col("gold").isNotNull())
    placed = ranked(rows.select("arm", "id", "score", correct().alias("ok")), ["arm"], F.desc("score"), "id", name="k")
    least = rows.groupBy("arm").agg(n().alias("c")).agg(F.min("c").alias("most"))
    return placed.join(F.broadcast(least), F.col("k") <= F.col("most")).groupBy("arm").agg(n().alias("accepted"), count(F.col("ok")).alias("correct"), F.round(F.min("score"), 6).alias("cut"))  # one row is broadcast


@query(sql("""
, e AS (SELECT id, arm, score, pair_ AS x FROM (SELECT d.id, arm, score, unnest(pair) AS pair_ FROM d JOIN evaluation_results e ON d.id = e.result_id WHERE label = 'same' AND score IS NOT NULL)),
g AS (SELECT x, count(DISTINCT id) AS deg FROM e WHERE x IS NOT NULL GROUP BY x),
i AS (SELECT e.id, arm, score, sum(deg - 1) AS impact FROM e JOIN g USING (x) GROUP BY ALL)
SELECT id, arm, round((1 - score) * impact, 6) AS priority FROM i QUALIFY row_number() OVER (ORDER BY (1 - score) * impact DESC, id) <= 100"""))
def f5_review_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 edges most worth a review: uncertainty times the number of incident edges (a top-k report)."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").isNotNull()).select("id", "arm", "score")
    ends = table(spark, sf, "evaluation_results").select(F.col("result_id").alias("id"), F.explode("pair").alias("x")).where("x is not null")
    e = rows.join(ends, "id")
    degree = e.groupBy("x").agg(F.count_distinct("id").alias("deg"))
    i = e.join(degree, "x").groupBy("id", "arm", "score").agg(F.sum(F.col("deg") - 1).alias("impact"))
    value = (1 - F.col("score")) * F.col("impact")
    return i.select("id", "arm", F.round(value, 6).alias("priority"), value.alias("v")).orderBy(F.desc("v"), "id").limit(100).drop("v")


@query(sql("""
, g AS (SELECT arm, grp, max(CASE WHEN gold = 'same' THEN 1 - p ELSE p END) AS worst FROM d WHERE split = 'calibration' AND gold IS NOT NULL AND NOT error GROUP BY ALL),
r AS (SELECT arm, worst, row_number() OVER (PARTITION BY arm ORDER BY worst, grp) AS k, count(*) OVER (PARTITION BY arm) AS n FROM g)
SELECT arm, round(worst, 6) AS threshold FROM r WHERE k = CAST(ceil((n + 1) * 0.9) AS BIGINT)"""))
def f9_conformal_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Conformal threshold: of the groups' greatest nonconformities, the one of rank ceil(0.9 (n + 1)); none beyond n."""
    rows = decision_rows(spark, sf).where("split = 'calibration' and gold is not null and not error")
    g = rows.groupBy("arm", "grp").agg(F.max(F.when(F.col("gold") == POSITIVE, 1 - F.col("p")).otherwise(F.col("p"))).alias("worst"))
    sizes = g.groupBy("arm").agg(n().alias("n"))
    r = ranked(g, ["arm"], "worst", "grp", name="k").join(F.broadcast(sizes), "arm")  # a row for each arm
    return r.where(F.col("k") == F.ceil((F.col("n") + 1) * 0.9)).select("arm", F.round("worst", 6).alias("threshold"))


@query("""
WITH t AS (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY sha256('plan' || id), id) AS k FROM (SELECT DISTINCT id, split FROM relation_examples))
SELECT split, id FROM t WHERE k <= 60""")
def f12_ranked_quota(spark: SparkSession, sf: str) -> DataFrame:
    """A quota of 60 ids of each split in digest order (a sampling operator); the planner limits each partition to 60 first."""
    rows = table(spark, sf, "relation_examples").select("id", "split").distinct()
    k = F.row_number().over(W.partitionBy("split").orderBy(F.sha2(F.concat(F.lit("plan"), "id"), 256), "id"))
    return rows.withColumn("k", k).where("k <= 60").select("split", "id")


@query(sql("""
, v AS (SELECT item, max(label) FILTER (WHERE arm = 'contract_a') AS a, max(label) FILTER (WHERE arm = 'contract_b') AS b, max(label) FILTER (WHERE arm = 'noul_plain') AS c FROM d GROUP BY item)
SELECT item, CASE WHEN a = 'ERROR' OR b = 'ERROR' OR c = 'ERROR' THEN 'ERROR'
  WHEN (coalesce(a,'') = 'same')::INT + (coalesce(b,'') = 'same')::INT + (coalesce(c,'') = 'same')::INT >= 2 THEN 'same'
  WHEN (coalesce(a,'') = 'different')::INT + (coalesce(b,'') = 'different')::INT + (coalesce(c,'') = 'different')::INT >= 2 THEN 'different' ELSE 'ABSTAIN' END AS vote FROM v"""))
def f18_majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three views decide; any error is an error, no majority an abstention."""
    arms = ["contract_a", "contract_b", "noul_plain"]
    v = decision_rows(spark, sf).groupBy("item").agg(*[F.max(F.when(F.col("arm") == a, F.col("label"))).alias(a) for a in arms])
    votes = F.array_compact(F.array(*arms))
    tally = lambda label: F.size(F.filter(votes, lambda x: x == label))
    return v.select("item", F.when(F.array_contains(votes, "ERROR"), "ERROR").when(tally("same") >= 2, "same").when(tally("different") >= 2, "different").otherwise("ABSTAIN").alias("vote"))


# joins and pairings


@query(sql("""
, u AS (SELECT arm, item, min(id) AS id FROM d WHERE NOT error AND gold IS NOT NULL GROUP BY ALL), r AS (SELECT d.arm, d.item, label <> gold AS wrong, label FROM u JOIN d USING (id)),
p AS (SELECT a.arm AS arm_1, b.arm AS arm_2, a.wrong AS w1, b.wrong AS w2, a.label = b.label AS agree FROM r a JOIN r b ON a.item = b.item AND a.arm < b.arm)
SELECT arm_1, arm_2, count(*) AS n, count(*) FILTER (WHERE w1 AND w2) AS both_wrong, count(*) FILTER (WHERE w1 AND w2 AND agree) AS agree_wrong, count(*) FILTER (WHERE w1) AS wrong_1, count(*) FILTER (WHERE w2) AS wrong_2,
  round(count(*) FILTER (WHERE w1) * CAST(count(*) FILTER (WHERE w2) AS DOUBLE) / count(*), 6) AS expected FROM p GROUP BY ALL"""))
def d2_joint_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of arms on the examples both judged: joint errors against what independence would give."""
    ok = decision_rows(spark, sf).where("not error and gold is not null")
    first = ok.groupBy("arm", "item").agg(F.min_by(F.struct("label", "gold"), "id").alias("x")).select("arm", "item", (F.col("x.label") != F.col("x.gold")).alias("w"), F.col("x.label").alias("label"))
    b = first.toDF("arm_2", "item", "w2", "label2")
    p = first.toDF("arm_1", "item", "w1", "label1").join(b, "item").where("arm_1 < arm_2")
    w1, w2 = F.col("w1"), F.col("w2")
    return p.groupBy("arm_1", "arm_2").agg(n().alias("n"), count(w1 & w2).alias("both_wrong"), count(w1 & w2 & (F.col("label1") == F.col("label2"))).alias("agree_wrong"), count(w1).alias("wrong_1"), count(w2).alias("wrong_2"), F.round(count(w1) * count(w2).cast("double") / n(), 6).alias("expected"))


@query(sql("""SELECT grp, count(DISTINCT split) AS splits FROM (SELECT DISTINCT grp, split FROM d UNION SELECT group_id, split FROM relation_examples WHERE group_id IS NOT NULL) GROUP BY grp HAVING count(DISTINCT split) > 1"""))
def d6_split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that stand in more than one split."""
    rows = decision_rows(spark, sf).select("grp", "split").unionByName(table(spark, sf, "relation_examples").select(F.col("group_id").alias("grp"), "split").where("grp is not null"))
    return rows.groupBy("grp").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


@query(sql("""
, plan AS (SELECT DISTINCT a.arm, i.item FROM (SELECT DISTINCT arm FROM d) a, (SELECT DISTINCT item FROM d) i), seen AS (SELECT arm, item, count(*) AS n FROM d GROUP BY ALL)
SELECT plan.arm, count(*) AS planned, count(seen.n) AS observed, count(*) - count(seen.n) AS missing FROM plan LEFT JOIN seen ON plan.arm = seen.arm AND plan.item = seen.item GROUP BY plan.arm"""))
def d7_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Planned against observed verdicts of every arm; the plan holds each example once for each arm."""
    rows = decision_rows(spark, sf)
    items, seen = rows.agg(F.count_distinct("item").alias("planned")), rows.groupBy("arm").agg(F.count_distinct("item").alias("observed"))
    return seen.join(F.broadcast(items)).select("arm", "planned", "observed", (F.col("planned") - F.col("observed")).alias("missing"))  # one row is broadcast


@query(sql("""
, e AS (SELECT d.id, gold, unnest(r.pair) AS x FROM d JOIN evaluation_results r ON d.id = r.result_id WHERE label = 'same' AND gold IS NOT NULL),
bad AS (SELECT DISTINCT x FROM e WHERE gold = 'different' AND x IS NOT NULL)
SELECT count(DISTINCT id) AS edges, count(DISTINCT CASE WHEN gold = 'same' THEN id END) AS correct,
  (SELECT count(DISTINCT id) FROM e WHERE gold = 'same' AND id NOT IN (SELECT id FROM e JOIN bad USING (x))) AS clean FROM e"""))
def d12_taint(spark: SparkSession, sf: str) -> DataFrame:
    """A wrong edge taints both its ends; clean edges are right and touch no tainted end."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("gold").isNotNull()).select("id", "gold")
    e = rows.join(table(spark, sf, "evaluation_results").select(F.col("result_id").alias("id"), F.explode("pair").alias("x")), "id")
    bad = e.where("gold = 'different' and x is not null").select("x").distinct().withColumn("bad", F.lit(True))
    flat = e.join(bad, "x", "left").groupBy("id", "gold").agg(F.max(F.coalesce("bad", F.lit(False))).alias("tainted"))
    return flat.agg(n().alias("edges"), count(F.col("gold") == POSITIVE).alias("correct"), count((F.col("gold") == POSITIVE) & ~F.col("tainted")).alias("clean"))


# evidence, shrinkage, fits



@query(sql("""
, g AS (SELECT arm, grp, sum(ln(1 - least((1 - score), 0.999999))) AS s, max(1 - score) AS lo, sum(1 - score) AS up FROM d WHERE label = 'same' AND score IS NOT NULL GROUP BY ALL)
SELECT arm, count(*) AS groups, round(avg(1 - exp(s)), 6) AS independent, round(avg(lo), 6) AS lower, round(avg(least(1, up)), 6) AS upper FROM g GROUP BY arm"""))
def e15_group_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk that a group holds a wrong edge: if errors are independent, and the bounds whatever they are."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").isNotNull()).withColumn("r", 1 - F.col("score"))
    g = rows.groupBy("arm", "grp").agg(F.sum(F.log(1 - F.least("r", F.lit(0.999999)))).alias("s"), F.max("r").alias("lo"), F.sum("r").alias("up"))
    return g.groupBy("arm").agg(n().alias("groups"), F.round(F.avg(1 - F.exp("s")), 6).alias("independent"), F.round(F.avg("lo"), 6).alias("lower"), F.round(F.avg(F.least(F.lit(1.0), "up")), 6).alias("upper"))


@query(sql("""
, f AS (SELECT arm, label, least(CAST(floor(score * 4) AS BIGINT), 3) AS bin, label <> gold AS wrong FROM d WHERE split = 'calibration' AND gold IS NOT NULL AND NOT error AND label <> 'ABSTAIN'),
prior AS (SELECT (1 + count(*) FILTER (WHERE wrong)) / CAST(count(*) + 2 AS DOUBLE) AS q FROM f)
SELECT arm, label, bin, count(*) AS n, round((count(*) FILTER (WHERE wrong) + 10 * any_value(q)) / (count(*) + 10), 6) AS risk FROM f, prior GROUP BY ALL"""))
def e16_shrunken_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Error rate by label and score bin, shrunk towards the overall rate with the weight of ten rows."""
    rows = decision_rows(spark, sf).where("split = 'calibration' and gold is not null and not error and label <> 'ABSTAIN'")
    f = rows.select("arm", "label", F.least(F.floor(F.col("score") * 4), F.lit(3)).cast("bigint").alias("bin"), (~correct()).alias("wrong"))
    return policies.shrunken(f, ["arm", "label", "bin"], "wrong", weight=10.0)



@query(sql("""
, g AS (SELECT arm, t, count(*) FILTER (WHERE score >= t AND label = 'same') AS n, count(*) FILTER (WHERE score >= t AND label = 'same' AND gold <> label) AS k
  FROM d, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) AS v(t) WHERE split = 'calibration' AND gold IS NOT NULL GROUP BY ALL)
SELECT arm, t AS threshold, n, k AS wrong, CASE WHEN n > 0 THEN round(k / CAST(n AS DOUBLE), 6) END AS error_rate FROM g"""))
def j4_threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted edges and wrong ones of the calibration split on a grid of thresholds."""
    rows = decision_rows(spark, sf).where("split = 'calibration' and gold is not null").select("arm", "label", "gold", "score", F.explode(F.array(*[F.lit(t) for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)])).alias("threshold"))
    edge = (F.col("score") >= F.col("threshold")) & (F.col("label") == POSITIVE)
    g = rows.groupBy("arm", "threshold").agg(count(edge).alias("n"), count(edge & (F.col("gold") != F.col("label"))).alias("wrong"))
    return g.withColumn("error_rate", prob.ratio(F.col("wrong"), F.col("n")))


# the greatest p with P(X <= k) > alpha by halving, for thresholds on the grid whose bound is at most 0.2
CERTIFIED = """
WITH RECURSIVE """ + DECISIONS + """
, g AS (SELECT arm, t, count(*) FILTER (WHERE score >= t AND label = 'same') AS n, count(*) FILTER (WHERE score >= t AND label = 'same' AND gold <> label) AS k
  FROM d, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) AS v(t) WHERE split = 'calibration' AND gold IS NOT NULL GROUP BY ALL),
h(arm, t, n, k, lo, hi, i) AS (SELECT arm, t, n, k, k / CAST(n AS DOUBLE), 1.0::DOUBLE, 0 FROM g WHERE n > 0 AND k < n
  UNION ALL SELECT arm, t, n, k, CASE WHEN tail > 0.05 / 6 THEN mid ELSE lo END, CASE WHEN tail > 0.05 / 6 THEN hi ELSE mid END, i + 1 FROM (
    SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) AS tail FROM h WHERE i < 60))
, b AS (SELECT arm, t, n, hi AS bound FROM h WHERE i = 60), m AS (SELECT arm, min(t) AS t FROM b WHERE bound <= 0.2 GROUP BY arm)
SELECT x.arm, m.t AS threshold, coalesce(b.n, 0) AS accepted, round(b.bound, 6) AS bound FROM (SELECT DISTINCT arm FROM g) x LEFT JOIN m ON x.arm = m.arm LEFT JOIN b ON b.arm = m.arm AND b.t = m.t"""


@query(CERTIFIED)
def c11_certified_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The least threshold of the grid whose one-sided binomial bound (corrected for the grid) allows at most 20 % wrong."""
    return policies.certified_threshold(j4_threshold_grid(spark, sf), "arm", "threshold", "n", "wrong", risk=0.2, alpha=0.05)


@query("""
WITH RECURSIVE """ + DECISIONS + """
, r AS (SELECT arm, grp, id, score, row_number() OVER (PARTITION BY arm, grp ORDER BY score DESC, id) AS k FROM d WHERE label = 'same' AND score IS NOT NULL),
w(arm, grp, k, spent, id, score, ok) AS (SELECT DISTINCT arm, grp, CAST(0 AS BIGINT), 0.0::DOUBLE, NULL::BIGINT, NULL::DOUBLE, false FROM r
  UNION ALL SELECT r.arm, r.grp, r.k, w.spent + CASE WHEN w.spent + (1 - r.score) <= 0.5 + 1e-12 THEN 1 - r.score ELSE 0 END, r.id, r.score, w.spent + (1 - r.score) <= 0.5 + 1e-12 FROM w JOIN r ON w.arm = r.arm AND w.grp = r.grp AND r.k = w.k + 1)
SELECT arm, grp, id, score FROM w WHERE ok""")
def c10_admit_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Edges admitted in order of score while each group's summed risk stays within its budget; what doesn't fit is skipped."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").isNotNull()).select("arm", "grp", "id", "score")
    return policies.admit_budget(rows, ["arm", "grp"], "id", "score", budget=0.5)


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS df, round(ln((n + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1, 6) AS idf FROM w, n GROUP BY word, n""")
def j9_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse document frequency of all words of all texts."""
    docs = table(spark, sf, "documents").where("text is not null")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    total = docs.agg(n().alias("total"))
    return words.groupBy("word").agg(n().alias("df")).join(F.broadcast(total)).select("word", "df", F.round(F.log((F.col("total") + 1) / (F.col("df") + 1).cast("double")) + 1, 6).alias("idf"))  # one row is broadcast


@query("""
WITH r AS (SELECT DISTINCT id, claim, evidence FROM relation_examples WHERE claim IS NOT NULL), w AS (
  SELECT id, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')) AS c, list_distinct(regexp_extract_all(lower(array_to_string(evidence, ' ')), '[a-z0-9]+')) AS e FROM r)
SELECT id, CAST(len(c) AS INTEGER) AS n_words, CAST(len(list_intersect(c, e)) AS INTEGER) AS n_common, CASE WHEN len(c) > 0 THEN round(len(list_intersect(c, e)) / CAST(len(c) AS DOUBLE), 6) END AS coverage FROM w WHERE e IS NOT NULL""")
def b10_lexical_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a claim's distinct words that stand in its evidence."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    r = table(spark, sf, "relation_examples").where("claim is not null and evidence is not null").select("id", "claim", "evidence").distinct()
    w = r.select("id", words(F.col("claim")).alias("c"), words(F.concat_ws(" ", "evidence")).alias("e"))
    common = F.size(F.array_intersect("c", "e"))
    return w.select("id", F.size("c").alias("n_words"), common.alias("n_common"), prob.ratio(common, F.size("c")).alias("coverage"))


@query("""SELECT id, CAST(i AS INTEGER) AS pos, CAST(s AS BIGINT) AS start, CAST(s + length(e) AS BIGINT) AS "end" FROM (
  SELECT id, i, evidence[i + 1] AS e, coalesce(list_sum(list_transform(evidence[1:i], lambda x: coalesce(length(x), 0) + 1)), 0) AS s
  FROM (SELECT DISTINCT id, evidence, unnest(range(0, len(evidence))) AS i FROM relation_examples WHERE evidence IS NOT NULL)) WHERE e IS NOT NULL""")
def b27_span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of each evidence item in the text that joins the items by line ends."""
    rows = table(spark, sf, "relation_examples").select("id", "evidence").distinct().select("id", "evidence", F.posexplode("evidence").alias("pos", "e")).where("e is not null")
    start = F.aggregate(F.slice("evidence", 1, F.col("pos")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)) + 1)
    return rows.select("id", "pos", start.alias("start"), (start + F.length("e")).alias("end"))


@query("""SELECT source_code, kind, trust FROM sources WHERE curator IS NULL OR trust IS NULL OR isnan(trust) OR kind IS NULL""")
def e35_source_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with a missing attribute."""
    return table(spark, sf, "sources").where("curator is null or trust is null or isnan(trust) or kind is null").select("source_code", "kind", "trust")
