"""Fits of inventory part J: grids, guards, cascades, label shift, shrinkage and the paired cluster bootstrap, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prob
from ..operators import fitting, policies
from ..operators.decisions import LABELS, POSITIVE, decision_rows
from ..operators.ordering import ranked
from ..session import staged, table
from .metrics import correct, count, n, sql
from .registry import query
from .scalars import paired_probabilities

TEMPERATURES = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
_rows = lambda values: ", ".join(f"({v}::DOUBLE)" for v in values)
_array = lambda values: F.array(*map(F.lit, values))


@query(sql(f"""
, c AS (SELECT arm, p, gold, CAST(('0x' || substr(sha256(grp), 64, 1)) AS INTEGER) % 2 AS half FROM d WHERE split = 'calibration' AND gold IS NOT NULL AND NOT error AND p IS NOT NULL),
f AS (SELECT arm, t, avg(-ln(greatest(CASE WHEN gold = 'same' THEN q ELSE 1 - q END, 1e-15))) AS nll FROM (SELECT arm, gold, t, 1 / (1 + exp((ln(greatest(1 - p, 1e-15)) - ln(greatest(p, 1e-15))) / t)) AS q FROM c, (VALUES {_rows(TEMPERATURES)}) AS v(t) WHERE half = 0) GROUP BY ALL),
b AS (SELECT arm, t FROM f QUALIFY row_number() OVER (PARTITION BY arm ORDER BY round(nll, 9), abs(t - 1), t) = 1),
g AS (SELECT arm, t, w, avg(-ln(greatest(CASE WHEN gold = 'same' THEN m ELSE 1 - m END, 1e-15))) AS nll, avg(2 * power(m - CASE WHEN gold = 'same' THEN 1 ELSE 0 END, 2)) AS brier FROM (
  SELECT c.arm, gold, b.t, w, (1 - w) * p + w / (1 + exp((ln(greatest(1 - p, 1e-15)) - ln(greatest(p, 1e-15))) / b.t)) AS m FROM c JOIN b ON c.arm = b.arm, (VALUES {_rows(WEIGHTS)}) AS v(w) WHERE half = 1) GROUP BY ALL),
r AS (SELECT arm, brier AS raw FROM g WHERE w = 0)
SELECT g.arm, t AS temperature, w AS weight FROM g JOIN r USING (arm) WHERE brier <= raw + 1e-12 QUALIFY row_number() OVER (PARTITION BY g.arm ORDER BY round(nll, 9), w) = 1"""))
def j2_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Temperature by the log loss of one half of the calibration groups; its weight by the other half, where it must not raise the
    Brier score; weight 0 changes nothing. An arm without rows in both halves has no row."""
    half = F.conv(F.substring(F.sha2("grp", 256), 64, 1), 16, 10).cast("int") % 2
    c = staged(decision_rows(spark, sf).where("split = 'calibration' and gold is not null and not error and p is not null").select("arm", "p", "gold", half.alias("half")), "calibration")
    truth = F.when(F.col("gold") == POSITIVE, 1.0).otherwise(0.0)
    nll = lambda q: F.round(F.avg(-F.log(F.greatest(F.when(F.col("gold") == POSITIVE, q).otherwise(1 - q), F.lit(prob.CLIP)))), 9)
    f = c.where("half = 0").withColumn("t", F.explode(_array(TEMPERATURES)))
    f = f.groupBy("arm", "t").agg(nll(prob.tempered(F.col("p"), F.col("t"))).alias("nll"))
    b = f.groupBy("arm").agg(F.min(F.struct("nll", F.abs(F.col("t") - 1).alias("far"), "t")).alias("m")).select("arm", F.col("m.t").alias("t"))
    # a row for each arm
    g = c.where("half = 1").join(F.broadcast(b), "arm").withColumn("w", F.explode(_array(WEIGHTS)))
    g = g.withColumn("q", (1 - F.col("w")) * F.col("p") + F.col("w") * prob.tempered(F.col("p"), F.col("t")))
    g = g.groupBy("arm", "t", "w").agg(nll(F.col("q")).alias("nll"), F.avg(2 * F.pow(F.col("q") - truth, 2)).alias("brier"))
    raw = g.where("w = 0").select("arm", F.col("brier").alias("raw"))
    best = g.join(F.broadcast(raw), "arm").where("brier <= raw + 1e-12").groupBy("arm", "t").agg(F.min(F.struct("nll", "w")).alias("m"))
    return best.select("arm", F.col("t").alias("temperature"), F.col("m.w").alias("weight"))


CASCADE = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
PAIRED = """, x AS (SELECT item, arg_min(ROW(label, score, error, coalesce(tokens_in, 0), gold, split), id) FILTER (WHERE arm = 'noul_plain') AS a, arg_min(ROW(label, score, error, coalesce(tokens_in, 0), gold, split), id) FILTER (WHERE arm = 'contract_b') AS b FROM d WHERE gold IS NOT NULL GROUP BY item),
y AS (SELECT item, a[1] AS al, a[2] AS score, a[3] AS failed, a[4] AS ta, a[5] AS gold, b[1] AS bl, b[4] AS tb FROM x WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    """item, gold, and of a cheap and a dear arm their first label and tokens; score and failure of the cheap one."""
    rows = decision_rows(spark, sf).where("gold is not null")
    pick = lambda arm: F.min_by(F.when(F.col("arm") == arm, F.struct("label", "score", "error", F.coalesce("tokens_in", F.lit(0)).alias("t"), "gold")), F.when(F.col("arm") == arm, F.col("id")))
    x = rows.groupBy("item").agg(pick("noul_plain").alias("a"), pick("contract_b").alias("b")).where("a is not null and b is not null")
    return x.select("item", F.col("a.label").alias("al"), F.col("a.score").alias("score"), F.col("a.error").alias("failed"), F.col("a.t").alias("at"), F.col("a.gold").alias("gold"), F.col("b.label").alias("bl"), F.col("b.t").alias("bt"))


def _f1(label: str, by: str = "label"):
    tp, fp, fn = count((F.col("gold") == label) & (F.col(by) == label)), count((F.col("gold") != label) & (F.col(by) == label)), count((F.col("gold") == label) & (F.col(by) != label))
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


_SQL_F1 = lambda by: "(" + " + ".join(f"coalesce(2.0 * count(*) FILTER (WHERE gold = '{c}' AND {by} = '{c}') / nullif(count(*) FILTER (WHERE gold = '{c}') + count(*) FILTER (WHERE {by} = '{c}'), 0), 0)" for c in LABELS) + ") / 2"


@query(sql(PAIRED + f""", g AS (SELECT t, gold, CASE WHEN failed OR score IS NULL OR score < t THEN bl ELSE al END AS label, ta + CASE WHEN failed OR score IS NULL OR score < t THEN tb ELSE 0 END AS tokens, CASE WHEN failed OR score IS NULL OR score < t THEN 1 ELSE 0 END AS up FROM y, (VALUES {_rows(CASCADE)}) AS v(t)),
s AS (SELECT t, {_SQL_F1("label")} AS f1, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(up) AS BIGINT) AS escalations FROM g GROUP BY t), r AS (SELECT {_SQL_F1("bl")} - 0.01 AS target FROM y)
SELECT t AS threshold, round(f1, 6) AS macro_f1, tokens, escalations, f1 >= target - 1e-12 AS eligible, f1 >= target - 1e-12 AND row_number() OVER (ORDER BY CASE WHEN f1 >= target - 1e-12 THEN 0 ELSE 1 END, tokens, t) = 1 AS chosen FROM s, r"""))
def j4_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """A cascade from a cheap arm to a dear one by threshold: the cheapest whose macro-F1 is at most 0.01 below the dear arm's."""
    y = staged(_paired(spark, sf), "paired")
    up = F.col("failed") | F.col("score").isNull() | (F.col("score") < F.col("t"))
    g = y.withColumn("t", F.explode(_array(CASCADE))).select("t", "gold", F.when(up, F.col("bl")).otherwise(F.col("al")).alias("label"), (F.col("at") + F.when(up, F.col("bt")).otherwise(0)).alias("tokens"), F.when(up, 1).otherwise(0).alias("up"))
    s = g.groupBy("t").agg(((_f1("same") + _f1("different")) / 2).alias("f1"), F.sum("tokens").alias("tokens"), F.sum("up").alias("escalations"))
    r = y.agg(((_f1("same", "bl") + _f1("different", "bl")) / 2 - 0.01).alias("target"))
    s = s.join(F.broadcast(r)).withColumn("eligible", F.col("f1") >= F.col("target") - 1e-12)  # one row
    best = s.where("eligible").agg(F.min(F.struct("tokens", "t")).alias("m")).select(F.col("m.t").alias("best"))
    return s.join(F.broadcast(best)).select(F.col("t").alias("threshold"), F.round("f1", 6).alias("macro_f1"), "tokens", "escalations", "eligible", (F.col("eligible") & (F.col("t") == F.col("best"))).alias("chosen"))


ROUTE = [0.5, 0.7, 0.9]


@query(sql(PAIRED + f""", v AS (SELECT false AS direct, p.t AS pt, q.t AS nt FROM (VALUES {_rows(ROUTE)}) AS p(t), (VALUES {_rows(ROUTE)}) AS q(t) UNION ALL SELECT true, 0.0, 0.0),
g AS (SELECT direct, pt, nt, gold, direct OR failed OR score IS NULL OR score < CASE WHEN al = 'same' THEN pt ELSE nt END AS up, al, bl, ta, tb FROM y, v),
h AS (SELECT *, CASE WHEN up THEN bl ELSE al END AS label, CASE WHEN direct THEN 0 ELSE ta END + CASE WHEN up THEN tb ELSE 0 END AS tokens FROM g),
s AS (SELECT direct, pt, nt, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE up AND NOT direct) AS escalations, count(*) FILTER (WHERE label = 'same' AND gold = 'same') AS correct, count(*) FILTER (WHERE label = 'same' AND gold <> 'same') AS wrong FROM h GROUP BY ALL),
r AS (SELECT count(*) FILTER (WHERE bl = 'same' AND gold = 'same') AS rc, count(*) FILTER (WHERE bl = 'same' AND gold <> 'same') AS rw FROM y)
SELECT direct, pt AS positive_threshold, nt AS negative_threshold, tokens, escalations, correct, wrong, wrong <= rw AND correct >= 0.98 * rc AND (rc + rw = 0 OR (correct + wrong > 0 AND correct / CAST(correct + wrong AS DOUBLE) >= rc / CAST(rc + rw AS DOUBLE) - 1e-12)) AS eligible FROM s, r"""))
def j4_edge_route(spark: SparkSession, sf: str) -> DataFrame:
    """Routes with a threshold for edges and one for the rest, and the direct route: tokens, escalations, edges, and whether a route
    is no worse than the dear arm (as few wrong edges, 98 % of the right ones, as precise)."""
    y = staged(_paired(spark, sf), "paired")
    policies_ = [(True, 0.0, 0.0), *[(False, a, b) for a in ROUTE for b in ROUTE]]
    v = spark.createDataFrame(policies_, "direct boolean, pt double, nt double")
    g = y.join(F.broadcast(v))  # ten policies
    low = F.col("score") < F.when(F.col("al") == POSITIVE, F.col("pt")).otherwise(F.col("nt"))
    g = g.withColumn("up", F.col("direct") | F.col("failed") | F.col("score").isNull() | low)
    label = F.when(F.col("up"), F.col("bl")).otherwise(F.col("al"))
    tokens = F.when(F.col("direct"), 0).otherwise(F.col("at")) + F.when(F.col("up"), F.col("bt")).otherwise(0)
    edge, right = label == POSITIVE, F.col("gold") == POSITIVE
    s = g.groupBy("direct", "pt", "nt").agg(F.sum(tokens).alias("tokens"), count(F.col("up") & ~F.col("direct")).alias("escalations"), count(edge & right).alias("correct"), count(edge & ~right).alias("wrong"))
    r = y.agg(count((F.col("bl") == POSITIVE) & right).alias("rc"), count((F.col("bl") == POSITIVE) & ~right).alias("rw"))
    precise = (F.col("rc") + F.col("rw") == 0) | ((F.col("correct") + F.col("wrong") > 0) & (F.try_divide("correct", F.col("correct") + F.col("wrong")) >= F.try_divide("rc", F.col("rc") + F.col("rw")) - 1e-12))
    eligible = (F.col("wrong") <= F.col("rw")) & (F.col("correct") >= 0.98 * F.col("rc")) & precise
    return s.join(F.broadcast(r)).select("direct", F.col("pt").alias("positive_threshold"), F.col("nt").alias("negative_threshold"), "tokens", "escalations", "correct", "wrong", F.coalesce(eligible, F.lit(False)).alias("eligible"))


@query()
def j5_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic fusion of two arms' log probabilities (no SQL: gradient descent; the tests compare with a direct fit): five folds by
    group, each predicted by a fit on the other four, whose gradient is summed in Spark, so that no rows reach the driver."""
    x = paired_probabilities(spark, sf, ["gold", "grp"]).where("gold is not null")
    logs = {f"f{i}": F.log(F.greatest(c, F.lit(1e-6))) for i, c in enumerate((F.col("a"), 1 - F.col("a"), F.col("b"), 1 - F.col("b")), 1)}
    rows = x.select("item", "grp", F.when(F.col("gold") == POSITIVE, 1.0).otherwise(0.0).alias("y"), *[c.alias(k) for k, c in logs.items()])
    return fitting.crossfit(rows, "item", "grp", "y", list(logs), folds=5)


@query(sql("""
, c AS (SELECT arm, gold, CASE WHEN p >= 0.5 THEN 'same' ELSE 'different' END AS said FROM d WHERE split = 'calibration' AND gold IS NOT NULL AND NOT error AND p IS NOT NULL),
r AS (SELECT arm, count(*) FILTER (WHERE gold = 'same' AND said = 'same') / CAST(nullif(count(*) FILTER (WHERE gold = 'same'), 0) AS DOUBLE) AS tpr, count(*) FILTER (WHERE gold = 'different' AND said = 'same') / CAST(nullif(count(*) FILTER (WHERE gold = 'different'), 0) AS DOUBLE) AS fpr, avg(CASE WHEN gold = 'same' THEN 1.0 ELSE 0.0 END) AS prior FROM c GROUP BY arm),
t AS (SELECT arm, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS mu FROM d WHERE split = 'evaluation' AND NOT error AND p IS NOT NULL GROUP BY arm),
q AS (SELECT arm, prior, abs(tpr - fpr) < 1e-6 AS flat, least(1.0, greatest(0.0, ((tpr - fpr) * (mu - fpr) + 0.001 * prior) / (power(tpr - fpr, 2) + 0.001))) AS shifted FROM r JOIN t USING (arm))
SELECT arm, round(prior, 6) AS prior, round(CASE WHEN flat OR shifted IS NULL THEN prior ELSE shifted END, 6) AS shifted FROM q"""))
def j6_label_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The share of positives in the evaluation split from its verdicts alone: least squares on the calibration confusion with a ridge
    of 0.001 towards the prior, on the simplex; unchanged where the confusion can't tell the labels apart."""
    rows = decision_rows(spark, sf).where("not error and p is not null").withColumn("said", F.col("p") >= 0.5)
    g = F.col("gold") == POSITIVE
    c = rows.where("split = 'calibration' and gold is not null")
    r = c.groupBy("arm").agg((count(g & F.col("said")) / F.nullif(count(g), F.lit(0))).alias("tpr"), (count(~g & F.col("said")) / F.nullif(count(~g), F.lit(0))).alias("fpr"), F.avg(F.when(g, 1.0).otherwise(0.0)).alias("prior"))
    t = rows.where("split = 'evaluation'").groupBy("arm").agg(F.avg(F.when(F.col("said"), 1.0).otherwise(0.0)).alias("mu"))
    gap = F.col("tpr") - F.col("fpr")
    least = (gap * (F.col("mu") - F.col("fpr")) + 0.001 * F.col("prior")) / (gap * gap + 0.001)
    least = F.when(least.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), least)))
    shifted = F.when((F.abs(gap) < 1e-6) | least.isNull(), F.col("prior")).otherwise(least)
    return r.join(t, "arm").select("arm", F.round("prior", 6).alias("prior"), F.round(shifted, 6).alias("shifted"))


RHO = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5]


@query(sql(f"""
, g AS (SELECT arm, grp, count(*) AS n, count(*) FILTER (WHERE gold = 'different') AS k FROM d WHERE label = 'same' AND gold IS NOT NULL AND split = 'development' GROUP BY ALL),
m AS (SELECT arm, (sum(k) + 0.5) / (sum(n) + 1.0) AS mu FROM g GROUP BY arm), h AS (SELECT arm, n, k, count(*) AS c FROM g GROUP BY ALL),
x AS (SELECT h.arm, mu, rho, n, k, c, CASE WHEN rho > 0 THEN mu * (1 / rho - 1) END AS a, CASE WHEN rho > 0 THEN (1 - mu) * (1 / rho - 1) END AS b FROM h JOIN m ON h.arm = m.arm, (VALUES {_rows(RHO)}) AS v(rho)),
l AS (SELECT arm, any_value(mu) AS mu, rho, sum(c * CASE WHEN rho = 0 THEN k * ln(mu) + (n - k) * ln(1 - mu) ELSE lgamma(a + k) + lgamma(b + n - k) + lgamma(a + b) - lgamma(a + b + n) - lgamma(a) - lgamma(b) END) AS ll FROM x GROUP BY arm, rho)
SELECT arm, round(mu, 6) AS mu, rho FROM l QUALIFY row_number() OVER (PARTITION BY arm ORDER BY round(ll, 6) DESC, rho) = 1"""))
def j7_beta_binomial(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and correlation of the wrong edges of groups: rho of the greatest beta-binomial likelihood on a grid. Groups of equal counts
    are one row; the ratios of gamma functions are products over the edges of a group."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("gold").isNotNull() & (F.col("split") == "development"))
    g = staged(rows.groupBy("arm", "grp").agg(n().alias("n"), count(F.col("gold") == "different").alias("k")), "groups")
    m = g.groupBy("arm").agg(((F.sum("k") + 0.5) / (F.sum("n") + 1.0)).alias("mu"))
    x = g.groupBy("arm", "n", "k").agg(n().alias("c")).join(F.broadcast(m), "arm").withColumn("rho", F.explode(_array(RHO)))  # a row for each arm
    x = x.withColumns({"a": F.when(F.col("rho") > 0, F.col("mu") * (1 / F.nullif("rho", F.lit(0.0)) - 1)), "b": F.when(F.col("rho") > 0, (1 - F.col("mu")) * (1 / F.nullif("rho", F.lit(0.0)) - 1))})
    rise = lambda base, times: F.expr(f"CASE WHEN {times} > 0 THEN aggregate(sequence(0, cast({times} as int) - 1), 0.0D, (s, i) -> s + ln({base} + i)) ELSE 0.0D END")
    free = rise("a", "k") + rise("b", "(n - k)") - rise("(a + b)", "n")
    plain = F.col("k") * F.log("mu") + (F.col("n") - F.col("k")) * F.log(1 - F.col("mu"))
    best = x.groupBy("arm", "rho").agg(F.first("mu").alias("mu"), F.round(F.sum(F.col("c") * F.when(F.col("rho") == 0, plain).otherwise(free)), 6).alias("ll"))
    best = best.groupBy("arm").agg(F.min(F.struct(-F.col("ll"), "rho", "mu")).alias("m"))
    return best.select("arm", F.round("m.mu", 6).alias("mu"), F.col("m.rho").alias("rho"))


@query(sql(PAIRED + """, o AS (SELECT CASE WHEN score < 0.6 THEN 0 WHEN score < 0.75 THEN 1 WHEN score < 0.9 THEN 2 ELSE 3 END AS bin, al AS kind, (bl = gold)::INT - (al = gold)::INT AS delta FROM y WHERE score IS NOT NULL), p AS (SELECT avg(delta) AS pooled FROM o)
SELECT kind, bin, count(*) AS n, round((sum(delta) + 20 * any_value(pooled)) / (count(*) + 20), 6) AS rate FROM o, p GROUP BY kind, bin"""))
def j8_voi_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Expected improvement by a further query, by kind and confidence bin, shrunk towards the pooled rate with the weight of 20 rows."""
    y = _paired(spark, sf).where("score is not null")
    bin_ = F.when(F.col("score") < 0.6, 0).when(F.col("score") < 0.75, 1).when(F.col("score") < 0.9, 2).otherwise(3)
    delta = (F.col("bl") == F.col("gold")).cast("int") - (F.col("al") == F.col("gold")).cast("int")
    o = y.select(F.col("al").alias("kind"), bin_.alias("bin"), delta.alias("delta"))
    return o.join(F.broadcast(o.agg(F.avg("delta").alias("pooled")))).groupBy("kind", "bin").agg(n().alias("n"), F.round((F.sum("delta") + 20 * F.first("pooled")) / (n() + 20), 6).alias("rate"))  # one row


DRAWS = 2000


@query(sql(f"""
, s AS (SELECT grp, count(*) FILTER (WHERE arm = 'contract_a') AS na, count(*) FILTER (WHERE arm = 'contract_a' AND label = gold) AS oa, count(*) FILTER (WHERE arm = 'contract_a' AND label = 'same') AS ea, count(*) FILTER (WHERE arm = 'contract_a' AND label = 'same' AND gold = 'same') AS ca,
  count(*) FILTER (WHERE arm = 'contract_b') AS nb, count(*) FILTER (WHERE arm = 'contract_b' AND label = gold) AS ob, count(*) FILTER (WHERE arm = 'contract_b' AND label = 'same') AS eb, count(*) FILTER (WHERE arm = 'contract_b' AND label = 'same' AND gold = 'same') AS cb
  FROM d WHERE gold IS NOT NULL AND arm IN ('contract_a', 'contract_b') GROUP BY grp),
h AS (SELECT s.*, block, sha256(grp || ':' || block) AS x FROM s, range(0, {DRAWS // 16}) AS r(block)),
u AS (SELECT h.*, block * 16 + i AS draw, CAST(('0x' || substr(x, CAST(4 * i + 1 AS BIGINT), 4)) AS INTEGER) / 65536.0::DOUBLE AS v FROM h, range(0, 16) AS r(i)),
k AS (SELECT *, (v >= 0.36787944117144233)::INT + (v >= 0.7357588823428847)::INT + (v >= 0.9196986029286058)::INT + (v >= 0.9810118431238462)::INT + (v >= 0.9963401531726563)::INT + (v >= 0.9994058151824183)::INT + (v >= 0.9999167588507119)::INT AS k FROM u),
t AS (SELECT draw, CAST(sum(k * na) AS DOUBLE) AS na, CAST(sum(k * oa) AS DOUBLE) AS oa, CAST(sum(k * ea) AS DOUBLE) AS ea, CAST(sum(k * ca) AS DOUBLE) AS ca, CAST(sum(k * nb) AS DOUBLE) AS nb, CAST(sum(k * ob) AS DOUBLE) AS ob, CAST(sum(k * eb) AS DOUBLE) AS eb, CAST(sum(k * cb) AS DOUBLE) AS cb FROM k GROUP BY draw),
m AS (SELECT 'accuracy' AS metric, ob / nullif(nb, 0) - oa / nullif(na, 0) AS v FROM t UNION ALL SELECT 'precision', cb / nullif(eb, 0) - ca / nullif(ea, 0) FROM t)
SELECT metric, count(v) AS draws, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m GROUP BY metric"""))
def j10_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Paired cluster bootstrap of two arms: both get the same Poisson weights of the groups in each of 2,000 draws; the intervals are of
    the differences in accuracy and in edge precision, without the draws in which one is undefined."""
    rows = decision_rows(spark, sf).where("gold is not null and arm in ('contract_a', 'contract_b')")
    sums = {}
    for t, arm in (("a", "contract_a"), ("b", "contract_b")):
        own, edge = F.col("arm") == arm, F.col("label") == POSITIVE
        sums |= {f"n{t}": count(own), f"o{t}": count(own & correct()), f"e{t}": count(own & edge), f"c{t}": count(own & edge & (F.col("gold") == POSITIVE))}
    stats = rows.groupBy("grp").agg(*[c.alias(k) for k, c in sums.items()])
    t = policies.drawn_sums(stats, "grp", list(sums), DRAWS)
    ratio = lambda x, y: F.try_divide(F.col(x), F.nullif(F.col(y), F.lit(0.0)))
    m = t.select(F.explode(F.array(F.struct(F.lit("accuracy").alias("metric"), (ratio("ob", "nb") - ratio("oa", "na")).alias("v")), F.struct(F.lit("precision").alias("metric"), (ratio("cb", "eb") - ratio("ca", "ea")).alias("v")))).alias("x")).select("x.*")
    return m.groupBy("metric").agg(F.count("v").alias("draws"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("v", F.lit(0.975)), 6).alias("hi"))  # 2,000 values


@query("""
WITH g AS (SELECT group_id, row_number() OVER (ORDER BY sha256('11:' || group_id), group_id) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT group_id FROM relation_examples WHERE group_id IS NOT NULL))
SELECT group_id, CASE WHEN r <= floor(0.7 * m) THEN 'train' WHEN r <= floor(0.85 * m) THEN 'calibration' ELSE 'evaluation' END AS part FROM g""")
def j11_group_split(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded split by whole groups in digest order: 70, 15 and 15 % of the groups."""
    g = table(spark, sf, "relation_examples").where("group_id is not null").select("group_id").distinct()
    r = ranked(g.select("group_id", F.lit(0).alias("all"), F.sha2(F.concat(F.lit("11:"), "group_id"), 256).alias("h")), ["all"], "h", "group_id", name="r").join(F.broadcast(g.agg(n().alias("m"))))  # one row
    part = F.when(F.col("r") <= F.floor(0.7 * F.col("m")), "train").when(F.col("r") <= F.floor(0.85 * F.col("m")), "calibration").otherwise("evaluation")
    return r.select("group_id", part.alias("part"))


@query(sql("""
, x AS (SELECT item, min_by(CASE WHEN error THEN NULL ELSE p END, id) FILTER (WHERE arm = 'contract_a') AS a, min_by(CASE WHEN error THEN NULL ELSE p END, id) FILTER (WHERE arm = 'contract_b') AS b, count(*) FILTER (WHERE arm = 'contract_a') AS na, count(*) FILTER (WHERE arm = 'contract_b') AS nb FROM d GROUP BY item)
SELECT item, round(a, 6) AS a, round(b, 6) AS b, na > 1 OR nb > 1 AS repeated FROM x WHERE na > 0 AND nb > 0"""))
def j13_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations for fusion: both arms' probabilities of an example (the first call without a probability falls through to the next), null
    where every call failed, and whether one of them was called twice."""
    rows = decision_rows(spark, sf).withColumn("q", F.when(~F.col("error"), F.col("p")))
    side = lambda arm: F.min_by(F.when(F.col("arm") == arm, F.col("q")), F.when((F.col("arm") == arm) & F.col("q").isNotNull(), F.col("id")))
    x = rows.groupBy("item").agg(side("contract_a").alias("a"), side("contract_b").alias("b"), count(F.col("arm") == "contract_a").alias("na"), count(F.col("arm") == "contract_b").alias("nb")).where("na > 0 and nb > 0")
    return x.select("item", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), ((F.col("na") > 1) | (F.col("nb") > 1)).alias("repeated"))


@query(sql("""
, m AS (SELECT arm, """ + _SQL_F1("label") + """ AS f1, avg(power(p - CASE WHEN gold = 'same' THEN 1 ELSE 0 END, 2)) AS b FROM d WHERE split = 'development' AND gold IS NOT NULL GROUP BY arm)
SELECT arm, CAST(row_number() OVER (ORDER BY round(f1, 9) DESC, round(b, 9), arm) AS INTEGER) AS place FROM m"""))
def j3_select_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Order of the arms on the development split: macro-F1, then Brier score, then name."""
    from pyspark.sql.window import Window as W

    rows = decision_rows(spark, sf).where("split = 'development' and gold is not null")
    truth = F.when(F.col("gold") == POSITIVE, 1.0).otherwise(0.0)
    m = rows.groupBy("arm").agg(F.round((_f1("same") + _f1("different")) / 2, 9).alias("f1"), F.round(F.avg(F.pow(F.col("p") - truth, 2)), 9).alias("b"))
    return m.select("arm", F.row_number().over(W.orderBy(F.desc("f1"), "b", "arm")).alias("place"))  # a row for each arm


@query()
def j1_temperature(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted temperature of each arm by golden section (no SQL: an iteration; the grid of j1_temperature_grid brackets it)."""
    rows = decision_rows(spark, sf).where("split = 'calibration' and gold is not null and not error and p is not null")
    return policies.fit_temperature(staged(rows.select("arm", "p", (F.col("gold") == POSITIVE).alias("positive")), "calibration"), "arm", "p", "positive")


