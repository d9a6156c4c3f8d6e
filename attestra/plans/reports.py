"""Aggregations of inventory part E: summaries, clustering scores, evidence, audits and outcomes of reviews."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prob
from ..operators import graph
from ..operators.decisions import LABELS, POSITIVE, decision_rows
from ..operators.ordering import ranked
from ..session import staged, table

from .metrics import correct, count, n, sql
from .registry import query


def _wrong() -> Column:
    """An accepted edge that is none."""
    return (F.col("label") == POSITIVE) & (F.col("gold") == "different")


@query(sql("""
SELECT task, arm, count(*) AS n, count(*) FILTER (WHERE label = gold) AS correct, count(*) FILTER (WHERE gold = 'different') AS negatives, count(*) FILTER (WHERE gold = 'different' AND label = 'same') AS false_merges,
  round(count(*) FILTER (WHERE gold = 'different' AND label = 'same') / CAST(nullif(count(*) FILTER (WHERE gold = 'different'), 0) AS DOUBLE), 6) AS false_merge_rate FROM d WHERE gold IS NOT NULL GROUP BY ALL"""))
def e3_false_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Summary by task and arm, with the false merges among the negatives."""
    rows = decision_rows(spark, sf).where("gold is not null")
    negative = F.col("gold") == "different"
    return rows.groupBy("task", "arm").agg(n().alias("n"), count(correct()).alias("correct"), count(negative).alias("negatives"), count(_wrong()).alias("false_merges"), prob.ratio(count(_wrong()), count(negative)).alias("false_merge_rate"))


def _confusion(rows: DataFrame) -> DataFrame:
    """By arm: the four cells of answered rows, and the sums that scores of them need."""
    c = lambda g, p: count((F.col("gold") == g) & (F.col("label") == p)).cast("double")
    return rows.groupBy("arm").agg(c("same", "same").alias("ss"), c("same", "different").alias("sd"), c("different", "same").alias("ds"), c("different", "different").alias("dd"), F.avg(prob.brier(F.col("dist"), F.col("gold"), LABELS)).alias("brier"))


@query(sql("""
, k AS (SELECT arm, CAST(count(*) FILTER (WHERE gold='same' AND label='same') AS DOUBLE) AS ss, CAST(count(*) FILTER (WHERE gold='same' AND label='different') AS DOUBLE) AS sd,
  CAST(count(*) FILTER (WHERE gold='different' AND label='same') AS DOUBLE) AS ds, CAST(count(*) FILTER (WHERE gold='different' AND label='different') AS DOUBLE) AS dd,
  avg(2 * power(p - CASE WHEN gold = 'same' THEN 1 ELSE 0 END, 2)) AS brier FROM d WHERE gold IS NOT NULL AND NOT error AND label IN ('same', 'different') AND p IS NOT NULL GROUP BY arm),
m AS (SELECT *, ss + sd + ds + dd AS n, (2 * ss / nullif(2 * ss + sd + ds, 0) + 2 * dd / nullif(2 * dd + sd + ds, 0)) / 2 AS f1,
  ((ss + dd) * (ss + sd + ds + dd) - (ss + sd) * (ss + ds) - (ds + dd) * (sd + dd)) / sqrt((power(ss + sd + ds + dd, 2) - power(ss + sd, 2) - power(ds + dd, 2)) * (power(ss + sd + ds + dd, 2) - power(ss + ds, 2) - power(sd + dd, 2))) AS mcc FROM k)
SELECT arm, round(f1, 6) AS macro_f1, round((ss + dd) / n, 6) AS accuracy, round(mcc, 6) AS mcc, round(0.55 * f1 + 0.20 * (ss + dd) / n + 0.15 * (1 - brier / 2) + 0.10 * (mcc + 1) / 2, 6) AS composite FROM m"""))
def e4_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Macro-F1, accuracy, multiclass MCC from the marginals, and the composite .55 F1 + .20 accuracy + .15 (1 - Brier / 2) + .10 (MCC + 1) / 2."""
    rows = decision_rows(spark, sf).where(F.col("gold").isNotNull() & ~F.col("error") & F.col("label").isin(LABELS) & F.col("p").isNotNull())
    k = _confusion(rows).withColumn("n", F.expr("ss + sd + ds + dd"))
    k = k.withColumns({"f1": F.expr("(2 * ss / nullif(2 * ss + sd + ds, 0) + 2 * dd / nullif(2 * dd + sd + ds, 0)) / 2"), "acc": F.expr("(ss + dd) / n")})
    root = F.sqrt(F.expr("(n * n - power(ss + sd, 2) - power(ds + dd, 2)) * (n * n - power(ss + ds, 2) - power(sd + dd, 2))"))
    k = k.withColumn("mcc", F.expr("(ss + dd) * n - (ss + sd) * (ss + ds) - (ds + dd) * (sd + dd)") / root)
    composite = 0.55 * F.col("f1") + 0.20 * F.col("acc") + 0.15 * (1 - F.col("brier") / 2) + 0.10 * (F.col("mcc") + 1) / 2
    return k.select("arm", F.round("f1", 6).alias("macro_f1"), F.round("acc", 6).alias("accuracy"), F.round("mcc", 6).alias("mcc"), F.round(composite, 6).alias("composite"))


@query(sql("""
, b AS (SELECT arm, bins, least(CAST(floor(score * bins) AS BIGINT), bins - 1) AS bin, count(*) AS n, abs(sum(score) - sum(CASE WHEN label = gold THEN 1.0 ELSE 0.0 END)) AS gap
  FROM d, (VALUES (5), (10), (15), (20)) AS v(bins) WHERE gold IS NOT NULL AND NOT error AND score IS NOT NULL GROUP BY ALL)
SELECT arm, bins, round(sum(gap) / sum(n), 6) AS ece FROM b GROUP BY arm, bins"""))
def e5_ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error with 5, 10, 15 and 20 bins."""
    rows = decision_rows(spark, sf).where("gold is not null and not error and score is not null").select("arm", "score", F.when(correct(), 1.0).otherwise(0.0).alias("ok"), F.explode(F.array(*map(F.lit, (5, 10, 15, 20)))).alias("bins"))
    bin_ = F.least(F.floor(F.col("score") * F.col("bins")), F.col("bins") - 1)
    b = rows.groupBy("arm", "bins", bin_.alias("bin")).agg(n().alias("n"), F.abs(F.sum("score") - F.sum("ok")).alias("gap"))
    return b.groupBy("arm", "bins").agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"))


@query(sql("""
, k AS (SELECT arm, c, count(*) FILTER (WHERE gold = c AND label = c) AS tp, count(*) FILTER (WHERE gold <> c AND label = c) AS fp, count(*) FILTER (WHERE gold = c AND label <> c) AS fn
        FROM d, (VALUES ('same'), ('different')) AS v(c) WHERE gold IS NOT NULL GROUP BY ALL),
a AS (SELECT arm, count(*) FILTER (WHERE label = 'ABSTAIN') AS abstained, count(*) AS n FROM d WHERE gold IS NOT NULL GROUP BY arm)
SELECT k.arm, round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1, any_value(a.abstained) AS abstained, round(any_value(a.abstained / CAST(a.n AS DOUBLE)), 6) AS abstained_share FROM k JOIN a USING (arm) GROUP BY k.arm"""))
def e9_policy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Macro-F1 with abstentions as a predicted class of their own, that is wrong for every label."""
    rows = decision_rows(spark, sf).where("gold is not null")
    sums = []
    for c in LABELS:
        g, p = F.col("gold") == c, F.col("label") == c
        sums += [count(g & p).alias(f"tp_{c}"), count(~g & p).alias(f"fp_{c}"), count(g & ~p).alias(f"fn_{c}")]
    k = rows.groupBy("arm").agg(*sums, count(F.col("label") == "ABSTAIN").alias("abstained"), n().alias("n"))
    f1 = lambda c: F.when(F.col(f"tp_{c}") == 0, 0.0).otherwise(2 * F.col(f"tp_{c}") / (2 * F.col(f"tp_{c}") + F.col(f"fp_{c}") + F.col(f"fn_{c}")))
    return k.select("arm", F.round((f1(LABELS[0]) + f1(LABELS[1])) / 2, 6).alias("macro_f1"), "abstained", prob.ratio(F.col("abstained"), F.col("n")).alias("abstained_share"))


LLR = "(({0} % 401) - 200) / 100.0"


@query(f"""
WITH RECURSIVE i AS (SELECT doc_id, kind || ':' || coalesce(lang, '-') AS prior_key, source AS grp, sha256(text) AS h, CAST({LLR.format("length(text)")} AS DOUBLE) AS llr FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
u AS (SELECT prior_key, h, min(grp) AS grp, any_value(llr) AS llr, count(*) AS copies FROM i GROUP BY ALL),
l AS (SELECT DISTINCT a.prior_key, a.grp AS x, b.grp AS y FROM i a JOIN i b ON a.prior_key = b.prior_key AND a.h = b.h),
r(prior_key, x, y) AS (SELECT prior_key, x, y FROM l UNION SELECT r.prior_key, r.x, l.y FROM r JOIN l ON r.prior_key = l.prior_key AND r.y = l.x),
c AS (SELECT prior_key, x AS grp, min(y) AS root FROM r GROUP BY ALL),
g AS (SELECT u.prior_key, root, avg(llr) AS m FROM u JOIN c ON u.prior_key = c.prior_key AND u.grp = c.grp GROUP BY ALL),
s AS (SELECT u.prior_key, count(*) AS unique_items, CAST(sum(copies) AS BIGINT) AS items, sum(llr * copies) AS naive, sum(llr) AS dedup FROM u GROUP BY ALL),
t AS (SELECT prior_key, count(*) AS source_groups, sum(m) AS grouped FROM g GROUP BY ALL)
SELECT s.prior_key AS claim, items, unique_items, source_groups, round(naive, 4) AS naive, round(dedup, 4) AS exact_dedup, round(grouped, 4) AS grouped FROM s JOIN t USING (prior_key)""")
def e14_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Log odds from evidence in three modes: every item; each text once; the mean of each group of sources, where sources that
    hold one text are one group (so that copying under another name adds nothing). Score and claim of a text are derived
    from its length, kind and language."""
    d = table(spark, sf, "documents").where("text is not null and source is not null")
    claim = F.concat("kind", F.lit(":"), F.coalesce("lang", F.lit("-")))
    i = d.select(claim.alias("claim"), F.col("source").alias("grp"), F.sha2("text", 256).alias("h"), F.expr(LLR.format("length(text)")).cast("double").alias("llr"))
    held = staged(i.groupBy("claim", "h", "grp").agg(n().alias("n"), F.first("llr").alias("llr")), "evidence")
    u = held.groupBy("claim", "h").agg(F.min("grp").alias("grp"), F.first("llr").alias("llr"), F.sum("n").alias("copies"))
    key = lambda g: F.concat("claim", F.lit("|"), g)
    links = held.join(u.select("claim", "h", F.col("grp").alias("least")), ["claim", "h"]).select(key("grp").alias("a"), key("least").alias("b"))
    roots = graph.components(links, "a", "b")
    g = u.withColumn("node", key("grp")).join(roots, "node").groupBy("claim", "root").agg(F.avg("llr").alias("m"))
    s = u.groupBy("claim").agg(F.sum("copies").alias("items"), n().alias("unique_items"), F.sum(F.col("llr") * F.col("copies")).alias("naive"), F.sum("llr").alias("dedup"))
    t = g.groupBy("claim").agg(n().alias("source_groups"), F.sum("m").alias("grouped"))
    return s.join(t, "claim").select("claim", "items", "unique_items", "source_groups", F.round("naive", 4).alias("naive"), F.round("dedup", 4).alias("exact_dedup"), F.round("grouped", 4).alias("grouped"))


@query(sql("""
, g AS (SELECT arm, grp, avg(score) AS q, avg(CASE WHEN gold = 'different' THEN 0.0 ELSE 1.0 END) AS y FROM d WHERE label = 'same' AND gold IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
w AS (SELECT arm, q, CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END AS t FROM g)
SELECT arm, count(*) AS groups, round(avg(power(q - t, 2)), 6) AS brier, round(avg(-ln(greatest(CASE WHEN t = 1 THEN q ELSE 1 - q END, 1e-15))), 6) AS log_loss, round(avg(q - t), 6) AS bias FROM w GROUP BY arm"""))
def e17_proper_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Group Brier score, clipped log loss and bias of the claim that all accepted edges of a group are right; one denominator."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("gold").isNotNull() & F.col("score").isNotNull())
    g = rows.groupBy("arm", "grp").agg(F.avg("score").alias("q"), F.when(F.bool_and(F.col("gold") == POSITIVE), 1.0).otherwise(0.0).alias("t"))
    q, t = F.col("q"), F.col("t")
    return g.groupBy("arm").agg(n().alias("groups"), F.round(F.avg(F.pow(q - t, 2)), 6).alias("brier"), F.round(F.avg(-F.log(F.greatest(F.when(t == 1, q).otherwise(1 - q), F.lit(prob.CLIP)))), 6).alias("log_loss"), F.round(F.avg(q - t), 6).alias("bias"))


def pairwise_scores(predicted: DataFrame, truth: DataFrame, forbidden: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of pairwise clustering scores. predicted, truth, forbidden: distinct pairs a < b; entities: distinct nodes.

    Precision and recall are 1 where their set is empty, and F1 where both are. Open triangles (two of three pairs) are
    counted by degrees: paths of length two, less three for each closed triangle, so that no pairs of neighbours of a hub
    are listed but for the closed ones, which are found from the end of smaller degree.
    """
    tp = predicted.join(truth, ["a", "b"])
    both = predicted.unionByName(predicted.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = staged(both.groupBy("a").agg(n().alias("deg")), "degrees")
    paths = degree.agg(F.sum(F.col("deg") * (F.col("deg") - 1) / 2).alias("paths"))
    # each edge from its end of smaller degree; a triangle has one end with both edges leaving it
    x, y = degree.toDF("a", "da"), degree.toDF("b", "db")
    way = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = predicted.join(x, "a").join(y, "b")
    directed = staged(e.select(F.when(way, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(way, F.col("b")).otherwise(F.col("a")).alias("v")), "directed")
    wedges = directed.join(directed.select("u", F.col("v").alias("w")), "u").where("v < w").select(F.col("v").alias("a"), F.col("w").alias("b"))
    closed = wedges.join(predicted, ["a", "b"]).agg(n().alias("closed"))
    parts = [tp.agg(n().alias("tp")), predicted.agg(n().alias("p")), truth.agg(n().alias("t")), entities.agg(n().alias("nodes")), paths, closed, predicted.join(forbidden, ["a", "b"]).agg(n().alias("hard"))]
    one = parts[0]
    for part in parts[1:]:
        one = one.join(F.broadcast(part))  # one row each
    universe = F.expr("nodes * (nodes - 1) / 2 - t")
    return one.select(
        F.coalesce(prob.ratio(F.col("tp"), F.col("p")), F.lit(1.0)).alias("prec"), F.coalesce(prob.ratio(F.col("tp"), F.col("t")), F.lit(1.0)).alias("recall"),
        F.coalesce(prob.ratio(2 * F.col("tp"), F.col("p") + F.col("t")), F.lit(1.0)).alias("f1"), F.round((F.col("p") - F.col("tp")) / F.greatest(universe, F.lit(1.0)), 9).alias("false_merge_rate"),
        F.col("p").alias("pairs"), (F.coalesce("paths", F.lit(0.0)) - 3 * F.col("closed")).cast("bigint").alias("open_triangles"), "hard")


@query("""
WITH m AS (SELECT least(pair[1], pair[2]) AS a, greatest(pair[1], pair[2]) AS b, count(*) FILTER (WHERE lower(trim(predicted_label)) = 'same') AS yes, count(*) AS n, max(lower(trim(gold_label))) AS gold
  FROM evaluation_results WHERE raw_error IS NULL AND pair[1] IS NOT NULL AND pair[2] IS NOT NULL AND pair[1] <> pair[2] GROUP BY ALL),
p AS (SELECT a, b FROM m WHERE yes * 2 > n), t AS (SELECT a, b FROM m WHERE gold = 'same'), f AS (SELECT a, b FROM m WHERE gold = 'different'), v AS (SELECT a AS x FROM m UNION SELECT b FROM m),
s AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
o AS (SELECT count(*) AS k FROM s u JOIN s w ON u.x = w.x AND u.y < w.y WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = u.y AND p.b = w.y))
SELECT round(tp / CAST(np AS DOUBLE), 6) AS prec, round(tp / CAST(nt AS DOUBLE), 6) AS recall, round(2.0 * tp / (np + nt), 6) AS f1, round((np - tp) / greatest(nv * (nv - 1) / 2.0 - nt, 1), 9) AS false_merge_rate, np AS pairs, k AS open_triangles,
  (SELECT count(*) FROM p JOIN f USING (a, b)) AS hard
FROM (SELECT (SELECT count(*) FROM p JOIN t USING (a, b)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM v) AS nv), o""")
def e18_pairwise_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Pairwise precision, recall, F1, false-merge rate, open triangles and forbidden pairs of the majority verdicts on each pair."""
    lower = lambda c: F.lower(F.trim(c))
    rows = table(spark, sf, "evaluation_results").where("raw_error is null").select(F.get("pair", F.lit(0)).alias("x"), F.get("pair", F.lit(1)).alias("y"), lower("predicted_label").alias("said"), lower("gold_label").alias("gold")).where("x <> y")
    m = rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(count(F.col("said") == "same").alias("yes"), n().alias("n"), F.max("gold").alias("gold"))
    m = staged(m, "verdicts")
    nodes = m.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return pairwise_scores(m.where("yes * 2 > n").select("a", "b"), m.where("gold = 'same'").select("a", "b"), m.where("gold = 'different'").select("a", "b"), nodes)


@query(sql("""
, r AS (SELECT arm, backend_version, execution_mode, avg(CASE WHEN label = gold THEN 1.0 ELSE 0.0 END) AS acc FROM d WHERE gold IS NOT NULL GROUP BY ALL)
SELECT arm, count(*) AS runs, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd FROM r GROUP BY arm"""))
def e19_over_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and sample deviation of the accuracy over runs (version and mode); the deviation of one run is null."""
    runs = decision_rows(spark, sf).where("gold is not null").groupBy("arm", "backend_version", "execution_mode").agg(F.avg(F.when(correct(), 1.0).otherwise(0.0)).alias("acc"))
    return runs.groupBy("arm").agg(n().alias("runs"), F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_samp("acc"), 6).alias("sd"))


@query("""
WITH r AS (SELECT DISTINCT id, split, gold_label, len(evidence) AS n, list_filter(list_distinct(rationale_sentence_ids), lambda i: i >= 0 AND i < len(evidence)) AS gold, len(list_distinct(rationale_sentence_ids)) AS wanted FROM relation_examples WHERE evidence IS NOT NULL AND rationale_sentence_ids IS NOT NULL),
k AS (SELECT split, wanted, len(list_filter(gold, lambda i: i < 3)) AS kept FROM r)
SELECT split, count(*) AS rows, CAST(sum(wanted) AS BIGINT) AS gold_sentences, CAST(sum(kept) AS BIGINT) AS retained, CASE WHEN sum(wanted) > 0 THEN round(sum(kept) / CAST(sum(wanted) AS DOUBLE), 6) END AS recall, count(*) FILTER (WHERE kept = wanted) AS complete FROM k GROUP BY split""")
def e21_rationale_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the gold sentences the first three sentences retain, by split."""
    r = table(spark, sf, "relation_examples").where("evidence is not null and rationale_sentence_ids is not null").select("id", "split", "gold_label", F.size("evidence").alias("n"), F.array_distinct("rationale_sentence_ids").alias("ids")).distinct()
    kept = F.size(F.filter("ids", lambda i: (i >= 0) & (i < F.least(F.col("n"), F.lit(3)))))
    k = r.select("split", F.size("ids").cast("bigint").alias("wanted"), kept.cast("bigint").alias("kept"))
    return k.groupBy("split").agg(n().alias("rows"), F.sum("wanted").alias("gold_sentences"), F.sum("kept").alias("retained"), prob.ratio(F.sum("kept"), F.sum("wanted")).alias("recall"), count(F.col("kept") == F.col("wanted")).alias("complete"))


@query(sql("""
, a AS (SELECT d.*, e.correct AS told FROM d JOIN evaluation_results e ON d.id = e.result_id),
c AS (SELECT arm, count(*) FILTER (WHERE told IS NOT NULL AND gold IS NOT NULL AND NOT error AND told <> (label = gold)) AS contradicted, count(*) FILTER (WHERE p IS NOT NULL AND abs(list_sum(map_values(dist)) - 1) > 1e-6) AS mass_defects FROM a GROUP BY arm),
s AS (SELECT arm, item, max(p) - min(p) AS spread FROM d WHERE NOT error AND p IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT c.arm, contradicted, mass_defects, (SELECT count(*) FROM s WHERE s.arm = c.arm) AS repeated, (SELECT round(max(spread), 6) FROM s WHERE s.arm = c.arm) AS widest FROM c"""))
def e22_saved_results(spark: SparkSession, sf: str) -> DataFrame:
    """Audit of saved results: flags that contradict the labels, distributions that don't sum to 1, spread of repeated calls."""
    told = table(spark, sf, "evaluation_results").select(F.col("result_id").alias("id"), F.col("correct").alias("told"))
    rows = decision_rows(spark, sf)
    a = rows.join(told, "id")
    wrong = F.col("told").isNotNull() & F.col("gold").isNotNull() & ~F.col("error") & (F.col("told") != correct())
    mass = F.aggregate(F.map_values("dist"), F.lit(0.0), lambda s, p: s + p)
    c = a.groupBy("arm").agg(count(wrong).alias("contradicted"), count(F.col("p").isNotNull() & (F.abs(mass - 1) > 1e-6)).alias("mass_defects"))
    s = rows.where("not error and p is not null").groupBy("arm", "item").agg((F.max("p") - F.min("p")).alias("spread"), n().alias("m")).where("m > 1")
    return c.join(s.groupBy("arm").agg(n().alias("repeated"), F.round(F.max("spread"), 6).alias("widest")), "arm", "left").select("arm", "contradicted", "mass_defects", F.coalesce("repeated", F.lit(0).cast("bigint")).alias("repeated"), "widest")


@query("""
WITH v AS (SELECT DISTINCT id, entity_1 AS s, gold_label AS p, entity_2 AS o FROM identity_pairs), nodes AS (SELECT DISTINCT entity_1 AS id FROM identity_pairs WHERE entity_1 IS NOT NULL)
SELECT problem, count(*) AS n FROM (
  SELECT 'id is node and edge' AS problem FROM v JOIN nodes ON v.id = nodes.id
  UNION ALL SELECT 'subject missing' FROM v WHERE s IS NULL
  UNION ALL SELECT 'object missing' FROM v WHERE o IS NULL
  UNION ALL SELECT 'triple repeated' FROM v WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY s, p, o HAVING count(*) > 1) GROUP BY problem""")
def e25_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Structure of the pair graph: ids shared by nodes and edges, missing ends, repeated triples."""
    t = table(spark, sf, "identity_pairs")
    v = t.select("id", F.col("entity_1").alias("s"), F.col("gold_label").alias("p"), F.col("entity_2").alias("o")).distinct()
    nodes = t.where("entity_1 is not null").select(F.col("entity_1").alias("id")).distinct()
    say = lambda df, text: df.select(F.lit(text).alias("problem"))
    out = say(v.join(nodes, "id"), "id is node and edge").unionByName(say(v.where("s is null"), "subject missing")).unionByName(say(v.where("o is null"), "object missing"))
    out = out.unionByName(say(v.where("s is not null and o is not null").groupBy("s", "p", "o").agg(n().alias("m")).where("m > 1"), "triple repeated"))
    return out.groupBy("problem").agg(n().alias("n"))


LOSSES = [0.0, 0.1, 0.25, 0.5]


@query(sql(f"""
, x AS (SELECT seed, grp, row_number() OVER (PARTITION BY seed ORDER BY sha256('[' || seed || ',"' || grp || '"]'), grp) AS r, count(*) OVER (PARTITION BY seed) AS m FROM (SELECT DISTINCT grp FROM d WHERE gold IS NOT NULL), range(0, 100) AS s(seed)),
g AS (SELECT arm, grp, count(*) AS n, count(*) FILTER (WHERE gold = 'same') AS pos, count(*) FILTER (WHERE gold = 'same' AND label = 'same') AS hit FROM d WHERE gold IS NOT NULL GROUP BY ALL),
k AS (SELECT loss, seed, arm, CAST(sum(n) AS DOUBLE) AS retained, CAST(sum(pos) AS DOUBLE) AS pos, CAST(sum(hit) AS DOUBLE) AS hit FROM g JOIN x USING (grp), (VALUES {", ".join(f"({v}::DOUBLE)" for v in LOSSES)}) AS v(loss) WHERE r > floor(m * loss) GROUP BY ALL),
t AS (SELECT arm, sum(pos) AS total FROM g GROUP BY arm)
SELECT loss, arm, round(avg(hit / total), 6) AS recall, round(quantile_cont(hit / total, 0.05), 6) AS p05, round(quantile_cont(hit / total, 0.95), 6) AS p95, round(avg(pos / total), 6) AS ceiling, round(avg(retained), 3) AS retained FROM k JOIN t USING (arm) GROUP BY loss, arm"""))
def e26_loss_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Recall left when exactly floor(n * loss) groups are lost, in the order of a seeded digest: 100 seeds at each loss, with the
    ceiling (the share of positives that survive) and the rows retained. Sums by group come first; the seeds rank groups only."""
    rows = decision_rows(spark, sf).where("gold is not null")
    positive = F.col("gold") == POSITIVE
    g = staged(rows.groupBy("arm", "grp").agg(n().alias("n"), count(positive).alias("pos"), count(positive & (F.col("label") == POSITIVE)).alias("hit")), "groups")
    groups = g.select("grp").distinct()
    x = groups.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(99))))
    x = x.withColumn("key", F.sha2(F.concat(F.lit("["), F.col("seed").cast("string"), F.lit(',"'), "grp", F.lit('"]')), 256))
    x = ranked(x, ["seed"], "key", "grp", name="r").join(F.broadcast(groups.agg(n().alias("m"))))  # one row
    # one row for each seed and group: the losses it survives
    kept = x.select("seed", "grp", F.filter(F.array(*map(F.lit, LOSSES)), lambda v: F.col("r") > F.floor(F.col("m") * v)).alias("losses"))
    k = kept.join(g, "grp").select("seed", "arm", "n", "pos", "hit", F.explode("losses").alias("loss")).groupBy("loss", "seed", "arm").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "pos", "hit")])
    t = g.groupBy("arm").agg(F.sum("pos").alias("total"))
    k = k.join(F.broadcast(t), "arm").withColumn("v", F.col("hit") / F.col("total"))  # a row for each arm
    # 100 values to a percentile
    return k.groupBy("loss", "arm").agg(F.round(F.avg("v"), 6).alias("recall"), F.round(F.percentile("v", F.lit(0.05)), 6).alias("p05"), F.round(F.percentile("v", F.lit(0.95)), 6).alias("p95"), F.round(F.avg(F.col("pos") / F.col("total")), 6).alias("ceiling"), F.round(F.avg("n"), 3).alias("retained"))


@query("""
WITH r AS (SELECT DISTINCT id, split, kind FROM relation_examples JOIN sources USING (source_code)), c AS (SELECT split, coalesce(kind, 'none') AS domain, count(*) AS candidates FROM r GROUP BY ALL)
SELECT split, domain, candidates, candidates * 4 * 2 * 3 AS decisions, round(candidates * 24 * 0.0001::DOUBLE, 4) AS cost, CASE WHEN candidates * 24 * 0.0001 > 5 THEN 'budget' ELSE '' END AS blockers FROM c""")
def e27_stage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counted work by split and domain: decisions of 4 arms, 2 repeats and 3 attempts, their cost, and what blocks a run."""
    sources = table(spark, sf, "sources").select("source_code", "kind")  # a fixed table of forty rows
    r = table(spark, sf, "relation_examples").select("id", "split", "source_code").join(F.broadcast(sources), "source_code").select("id", "split", "kind").distinct()
    c = r.groupBy("split", F.coalesce("kind", F.lit("none")).alias("domain")).agg(n().alias("candidates"))
    cost = F.col("candidates") * 24 * 0.0001
    return c.select("split", "domain", "candidates", (F.col("candidates") * 24).alias("decisions"), F.round(cost, 4).alias("cost"), F.when(cost > 5, "budget").otherwise("").alias("blockers"))


@query(sql("""
, e AS (SELECT id, arm, grp, 1 - score AS risk, gold = 'different' AS wrong, row_number() OVER (PARTITION BY arm ORDER BY score, id) AS r, count(*) OVER (PARTITION BY arm) AS m FROM d WHERE label = 'same' AND score IS NOT NULL AND gold IS NOT NULL),
s AS (SELECT *, r <= floor(m * 0.2) AS seen FROM e),
g AS (SELECT arm, grp, bool_or(wrong AND NOT seen) AS left_wrong, count(*) FILTER (WHERE wrong AND seen) AS caught FROM s GROUP BY ALL),
x AS (SELECT arm, sum(CASE WHEN seen THEN 0 ELSE risk END) AS expected, count(*) FILTER (WHERE wrong AND NOT seen) AS wrong, count(*) FILTER (WHERE seen) AS reviewed FROM s GROUP BY arm)
SELECT x.arm, reviewed, round(expected, 4) AS expected_wrong, wrong, CAST(sum(caught) AS BIGINT) AS caught, count(*) FILTER (WHERE left_wrong) AS contaminated FROM x JOIN g USING (arm) GROUP BY ALL"""))
def e28_review_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of reviewing the least certain fifth of each arm's edges: expected and true errors left, errors caught, groups still contaminated."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").isNotNull() & F.col("gold").isNotNull())
    e = rows.select("id", "arm", "grp", "score", (1 - F.col("score")).alias("risk"), (F.col("gold") == "different").alias("wrong"))
    sizes = e.groupBy("arm").agg(n().alias("m"))
    s = ranked(e, ["arm"], "score", "id", name="r").join(F.broadcast(sizes), "arm").withColumn("seen", F.col("r") <= F.floor(F.col("m") * 0.2))  # a row for each arm
    open_ = F.col("wrong") & ~F.col("seen")
    g = s.groupBy("arm", "grp").agg(F.bool_or(open_).alias("left_wrong"), count(F.col("wrong") & F.col("seen")).alias("caught"), count(open_).alias("wrong"), count(F.col("seen")).alias("reviewed"), F.sum(F.when(F.col("seen"), 0.0).otherwise(F.col("risk"))).alias("expected"))
    return g.groupBy("arm").agg(F.sum("reviewed").alias("reviewed"), F.round(F.sum("expected"), 4).alias("expected_wrong"), F.sum("wrong").alias("wrong"), F.sum("caught").alias("caught"), count(F.col("left_wrong")).alias("contaminated"))


@query(sql("""
, g AS (SELECT arm, grp, count(*) AS n, count(*) FILTER (WHERE gold = 'different') AS k FROM d WHERE label = 'same' AND gold IS NOT NULL GROUP BY ALL)
SELECT arm, n AS exposure, count(*) AS groups, CAST(sum(k) AS BIGINT) AS wrong, count(*) FILTER (WHERE k > 0) AS contaminated, CAST(sum(n - k) - 5 * sum(k) AS BIGINT) AS utility FROM g GROUP BY arm, n"""))
def e31_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by exposure (accepted edges): wrong edges, contaminated groups, and utility (+1 for a right edge, -5 for a wrong one)."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("gold").isNotNull())
    g = rows.groupBy("arm", "grp").agg(n().alias("n"), count(F.col("gold") == "different").alias("k"))
    return g.groupBy("arm", F.col("n").alias("exposure")).agg(n().alias("groups"), F.sum("k").alias("wrong"), count(F.col("k") > 0).alias("contaminated"), (F.sum(F.col("n") - F.col("k")) - 5 * F.sum("k")).alias("utility"))


@query(sql("""
SELECT id, CASE WHEN error THEN 'failed' WHEN gold IS NULL THEN 'ineligible' WHEN label = gold THEN 'right' ELSE 'wrong' END AS state,
  CASE WHEN NOT error AND gold IS NOT NULL THEN round(2 * power(p - CASE WHEN gold = 'same' THEN 1 ELSE 0 END, 2), 9) END AS brier,
  CASE WHEN NOT error AND gold IS NOT NULL THEN round(-ln(greatest(dist[gold], 1e-15)), 6) + 0.0 END AS log_loss FROM d"""))
def e32_row_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each row: Brier score and log loss are null unless the row is eligible and the call succeeded."""
    rows = decision_rows(spark, sf)
    ok = ~F.col("error") & F.col("gold").isNotNull()
    state = F.when(F.col("error"), "failed").when(F.col("gold").isNull(), "ineligible").when(correct(), "right").otherwise("wrong")
    return rows.select("id", state.alias("state"), F.round(F.when(ok, 2 * F.pow(F.col("p") - F.when(F.col("gold") == POSITIVE, 1.0).otherwise(0.0), 2)), 9).alias("brier"), F.round(F.when(ok, prob.log_loss(F.col("dist"), F.col("gold"))), 6).alias("log_loss"))


@query(sql("""
, e AS (SELECT * FROM d WHERE gold IS NOT NULL AND NOT error AND p IS NOT NULL AND abs(list_sum(map_values(dist)) - 1) <= 1e-6),
v AS (SELECT variant, arm, gold, CASE variant WHEN 'raw' THEN p WHEN 'sharp' THEN p * p / (p * p + (1 - p) * (1 - p)) ELSE 0.5 + (p - 0.5) / 2 END AS q FROM e, (VALUES ('raw'), ('sharp'), ('flat')) AS t(variant))
SELECT variant, arm, count(*) AS n, round(avg(2 * power(q - CASE WHEN gold = 'same' THEN 1 ELSE 0 END, 2)), 6) AS brier, round(avg(CASE WHEN (q >= 0.5) = (gold = 'same') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v GROUP BY variant, arm"""))
def e33_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of the probabilities scored on identical rows: those with a binary gold label and without a mass defect."""
    mass = F.aggregate(F.map_values("dist"), F.lit(0.0), lambda s, x: s + x)
    e = decision_rows(spark, sf).where("gold is not null and not error and p is not null").where(F.abs(mass - 1) <= 1e-6)
    p = F.col("p")
    forms = {"raw": p, "sharp": p * p / (p * p + (1 - p) * (1 - p)), "flat": 0.5 + (p - 0.5) / 2}
    v = e.select("arm", "gold", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("q")) for k, c in forms.items()])).alias("x")).select("arm", "gold", "x.*")
    truth = F.when(F.col("gold") == POSITIVE, 1.0).otherwise(0.0)
    return v.groupBy("variant", "arm").agg(n().alias("n"), F.round(F.avg(2 * F.pow(F.col("q") - truth, 2)), 6).alias("brier"), F.round(F.avg(F.when((F.col("q") >= 0.5) == (F.col("gold") == POSITIVE), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(sql("""
, t AS (SELECT id, p, 1 / (1 + exp((ln(greatest(1 - p, 1e-15)) - ln(greatest(p, 1e-15))) / 3.0)) AS q FROM d WHERE NOT error AND p IS NOT NULL)
SELECT id, CASE WHEN abs(2 * p - 1) <= 1e-14 THEN 'tie' WHEN (p >= 0.5) <> (q >= 0.5) THEN 'changed' END AS state FROM t WHERE abs(2 * p - 1) <= 1e-14 OR (p >= 0.5) <> (q >= 0.5)"""))
def e34_numerical_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose two classes are no further apart than 1e-14 (a temperature may turn these), and rows that it turned without need."""
    p = F.col("p")
    q = prob.tempered(p, 3.0)
    state = F.when(F.abs(2 * p - 1) <= 1e-14, "tie").when((p >= 0.5) != (q >= 0.5), "changed")
    return decision_rows(spark, sf).where("not error and p is not null").select("id", state.alias("state")).where("state is not null")


@query(sql("""
, c AS (SELECT arm, label, score, gold, label IN ('same', 'different') AND score >= 0.8 AS commit FROM d WHERE gold IS NOT NULL)
SELECT arm, count(*) AS n, round(avg(CASE WHEN commit THEN 1.0 ELSE 0.0 END), 6) AS committed, round(avg(CASE WHEN commit THEN CASE WHEN label = gold THEN 1.0 ELSE 0.0 END END), 6) AS right_if_committed, round(avg(CASE WHEN commit THEN CASE WHEN label = gold THEN 1 ELSE -5 END ELSE 0 END), 6) AS utility FROM c GROUP BY arm"""))
def e30_policy_table(spark: SparkSession, sf: str) -> DataFrame:
    """Policies side by side: share committed, accuracy given a commitment (null without any), mean utility."""
    rows = decision_rows(spark, sf).where("gold is not null").withColumn("commit", F.coalesce(F.col("label").isin(LABELS) & (F.col("score") >= 0.8), F.lit(False)))
    right = F.when(correct(), 1.0).otherwise(0.0)
    return rows.groupBy("arm").agg(n().alias("n"), F.round(F.avg(F.when(F.col("commit"), 1.0).otherwise(0.0)), 6).alias("committed"), F.round(F.avg(F.when(F.col("commit"), right)), 6).alias("right_if_committed"), F.round(F.avg(F.when(F.col("commit"), F.when(correct(), 1).otherwise(-5)).otherwise(0)), 6).alias("utility"))
