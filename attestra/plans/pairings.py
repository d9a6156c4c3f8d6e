"""Pairings (part D), matchings, ordered selections (part F) and graph operators (part G) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prob
from ..operators import graph, lineage, matching
from ..operators.decisions import LABELS, POSITIVE, decision_rows
from ..operators.ordering import ranked, running
from ..session import staged, table
from .graphs import SAME, P, _lineage, _same
from .metrics import correct, count, n, sql
from .registry import query

KEY = "lower(trim({}))"


@query("""
WITH RECURSIVE r AS (SELECT split, id, list_distinct(list_filter(identity_groups, lambda x: x IS NOT NULL)) AS g, row_number() OVER (PARTITION BY split ORDER BY sha256('"' || id || '"'), id) AS k
  FROM (SELECT DISTINCT split, id, identity_groups FROM identity_pairs WHERE split IN ('calibration', 'evaluation'))),
w(split, k, used, id, took) AS (SELECT DISTINCT split, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), NULL::VARCHAR, false FROM r
  UNION ALL SELECT w.split, r.k, CASE WHEN list_has_any(w.used, r.g) THEN w.used ELSE list_concat(w.used, r.g) END, r.id, NOT list_has_any(w.used, r.g) FROM w JOIN r ON w.split = r.split AND r.k = w.k + 1)
SELECT split, id FROM w WHERE took""")
def c8_disjoint_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each held-out split chosen in digest order so that no two share an identity group."""
    r = table(spark, sf, "identity_pairs").where("split in ('calibration', 'evaluation')").select("split", "id", "identity_groups").distinct()
    # groups of one split don't meet those of the other
    named = F.transform("identity_groups", lambda g: F.concat("split", F.lit("|"), g))
    rows = r.select(F.concat("split", F.lit("|"), "id").alias("key"), F.sha2(F.concat(F.lit('"'), "id", F.lit('"')), 256).alias("rank"), named.alias("items"))
    chosen = matching.disjoint(rows, "key", "rank", "items")
    return chosen.select(F.substring_index("key", "|", 1).alias("split"), F.expr("substring(key, instr(key, '|') + 1)").alias("id"))


def _arm(spark: SparkSession, sf: str, arm: str) -> DataFrame:
    return decision_rows(spark, sf).where(F.col("arm") == arm)


@query(sql("""
, a AS (SELECT item, count(*) AS n, max(gold) AS gold FROM d WHERE arm = 'contract_a' GROUP BY item), b AS (SELECT item, count(*) AS n, max(gold) AS gold FROM d WHERE arm = 'contract_b' GROUP BY item)
SELECT CASE WHEN a.item IS NULL OR b.item IS NULL THEN 'unpaired' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' WHEN a.gold IS DISTINCT FROM b.gold THEN 'other label' ELSE 'paired' END AS state, count(*) AS n
FROM a FULL JOIN b ON a.item = b.item GROUP BY 1"""))
def d1_validate_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two arms judged the same examples: unpaired, repeated or differently labelled ones by their number."""
    side = lambda arm, t: _arm(spark, sf, arm).groupBy(F.col("item").alias(f"item{t}")).agg(n().alias(f"n{t}"), F.max("gold").alias(f"gold{t}"))
    both = side("contract_a", 1).join(side("contract_b", 2), F.col("item1") == F.col("item2"), "full_outer")
    state = F.when(F.col("item1").isNull() | F.col("item2").isNull(), "unpaired").when((F.col("n1") > 1) | (F.col("n2") > 1), "repeated").when(~F.col("gold1").eqNullSafe(F.col("gold2")), "other label").otherwise("paired")
    return both.groupBy(state.alias("state")).agg(n().alias("n"))


@query(sql("""
, p AS (SELECT grp, list_distinct(list(id)) AS calls FROM d GROUP BY grp), x AS (SELECT grp, unnest(calls) AS id FROM p)
SELECT x.grp, count(*) AS calls, count(*) FILTER (WHERE d.arm = 'contract_a') AS contract_a, count(*) FILTER (WHERE d.arm = 'contract_b') AS contract_b, count(*) FILTER (WHERE d.arm = 'noul_plain') AS noul_plain,
  CAST(sum(d.tokens_in) AS BIGINT) AS tokens, count(*) FILTER (WHERE d.id IS NULL) AS unresolved FROM x LEFT JOIN d ON x.id = d.id GROUP BY x.grp"""))
def d3_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions rebuilt from their call ids: every id must resolve, each call's usage counts once, sites are pivoted."""
    d = decision_rows(spark, sf)
    x = d.select("grp", "id").distinct()  # the calls of each prediction
    both = x.join(d.select(F.col("id").alias("call"), "arm", "tokens_in"), F.col("id") == F.col("call"), "left")
    arms = [count(F.col("arm") == a).alias(a) for a in ("contract_a", "contract_b", "noul_plain")]
    return both.groupBy("grp").agg(n().alias("calls"), *arms, F.sum("tokens_in").alias("tokens"), count(F.col("call").isNull()).alias("unresolved"))


@query(sql("""
, q AS (SELECT DISTINCT item FROM d WHERE arm = 'contract_a'), r AS (SELECT item, count(*) AS n FROM d WHERE arm = 'rule_overlap' GROUP BY item)
SELECT CASE WHEN q.item IS NULL THEN 'unknown' WHEN r.item IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'bound' END AS state, count(*) AS n FROM q FULL JOIN r ON q.item = r.item GROUP BY 1"""))
def d4_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Requests against responses: unknown, missing and duplicate response ids are told apart."""
    q = _arm(spark, sf, "contract_a").select(F.col("item").alias("asked")).distinct()
    r = _arm(spark, sf, "rule_overlap").groupBy(F.col("item").alias("answered")).agg(n().alias("m"))
    state = F.when(F.col("asked").isNull(), "unknown").when(F.col("answered").isNull(), "missing").when(F.col("m") > 1, "duplicate").otherwise("bound")
    return q.join(r, F.col("asked") == F.col("answered"), "full_outer").groupBy(state.alias("state")).agg(n().alias("n"))


@query("""
WITH r AS (SELECT DISTINCT id, lower(trim(document_id)) AS doc, lower(trim(title)) AS title FROM relation_examples),
known AS (SELECT DISTINCT doc FROM r WHERE doc IS NOT NULL AND doc NOT IN ('', 'n/a', 'unknown')),
t AS (SELECT title, min(doc) AS doc FROM r JOIN known USING (doc) WHERE title IS NOT NULL GROUP BY title HAVING count(DISTINCT doc) = 1)
SELECT id, CASE WHEN k.doc IS NOT NULL THEN 'id' WHEN t.doc IS NOT NULL THEN 'title' ELSE 'none' END AS by, coalesce(k.doc, t.doc) AS endpoint FROM r LEFT JOIN known k ON r.doc = k.doc LEFT JOIN t ON r.title = t.title""")
def d5_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoint resolution: the explicit id if it is known, else the document of that title if only one has it, else null."""
    r = table(spark, sf, "relation_examples").select("id", F.expr(KEY.format("document_id")).alias("doc"), F.expr(KEY.format("title")).alias("title")).distinct()
    known = r.where("doc is not null and doc not in ('', 'n/a', 'unknown')").select("doc").distinct()
    t = r.where("title is not null").join(known, "doc").groupBy("title").agg(F.min("doc").alias("by_title"), F.count_distinct("doc").alias("m")).where("m = 1").drop("m")
    out = r.join(known.select("doc", F.col("doc").alias("by_id")), "doc", "left").join(t, "title", "left")
    return out.select("id", F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_title").isNotNull(), "title").otherwise("none").alias("by"), F.coalesce("by_id", "by_title").alias("endpoint"))


@query(sql("""
, e AS (SELECT arm, item, max(label) AS label FROM d WHERE split = 'development' AND gold IS NOT NULL AND label <> gold GROUP BY ALL),
k AS (SELECT arm, count(*) AS n FROM e GROUP BY arm), s AS (SELECT a.arm AS arm_1, b.arm AS arm_2, count(*) FILTER (WHERE a.label = b.label) AS same, count(*) AS common FROM e a JOIN e b ON a.item = b.item AND a.arm < b.arm GROUP BY ALL)
SELECT x.arm AS arm_1, y.arm AS arm_2, coalesce(same, 0) AS same_wrong, x.n + y.n - coalesce(common, 0) AS error_union, round(coalesce(same, 0) / CAST(x.n + y.n - coalesce(common, 0) AS DOUBLE), 6) AS similarity
FROM k x JOIN k y ON x.arm < y.arm LEFT JOIN s ON s.arm_1 = x.arm AND s.arm_2 = y.arm"""))
def d9_view_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """How alike two arms err on the development split: equal wrong answers over all examples that either got wrong."""
    rows = decision_rows(spark, sf).where("split = 'development' and gold is not null").where(~correct())
    e = staged(rows.groupBy("arm", "item").agg(F.max("label").alias("label")), "errors")
    k = e.groupBy("arm").agg(n().alias("n"))
    s = e.toDF("arm_1", "item", "l1").join(e.toDF("arm_2", "item", "l2"), "item").where("arm_1 < arm_2").groupBy("arm_1", "arm_2").agg(count(F.col("l1") == F.col("l2")).alias("same"), n().alias("common"))
    pairs = k.toDF("arm_1", "n1").join(F.broadcast(k.toDF("arm_2", "n2")), F.col("arm_1") < F.col("arm_2"))  # a row for each arm
    out = pairs.join(s, ["arm_1", "arm_2"], "left").withColumn("same_wrong", F.coalesce("same", F.lit(0)).cast("bigint")).withColumn("error_union", F.col("n1") + F.col("n2") - F.coalesce("common", F.lit(0)))
    return out.select("arm_1", "arm_2", "same_wrong", "error_union", prob.ratio(F.col("same_wrong"), F.col("error_union")).alias("similarity"))


@query(sql("""
, k AS (SELECT arm, count(*) FILTER (WHERE label = 'same' AND gold = 'same') AS ok, count(*) FILTER (WHERE label = 'same' AND gold = 'different') AS bad FROM d GROUP BY arm)
SELECT arm, s AS sensitivity, f AS false_removal, round(ok * (1 - f), 4) AS kept_right, round(bad * (1 - s), 4) AS left_wrong, CASE WHEN ok * (1 - f) + bad * (1 - s) > 0 THEN round(ok * (1 - f) / (ok * (1 - f) + bad * (1 - s)), 6) END AS prec
FROM k, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) AS a(s), (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) AS b(f)"""))
def d11_review_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of a reviewer's sensitivity and false removals: edges kept, errors left, precision."""
    rows = decision_rows(spark, sf).where(F.col("label") == POSITIVE)
    k = rows.groupBy("arm").agg(count(F.col("gold") == POSITIVE).alias("ok"), count(F.col("gold") == "different").alias("bad"))
    grid = k.withColumn("sensitivity", F.explode(F.array(*map(F.lit, (0.5, 0.8, 1.0))))).withColumn("false_removal", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.2)))))
    kept, left = F.col("ok") * (1 - F.col("false_removal")), F.col("bad") * (1 - F.col("sensitivity"))
    return grid.select("arm", "sensitivity", "false_removal", F.round(kept, 4).alias("kept_right"), F.round(left, 4).alias("left_wrong"), prob.ratio(kept, kept + left).alias("prec"))


@query(f"""
WITH RECURSIVE e AS ({SAME} AND split = 'train'), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS root FROM r GROUP BY node), q AS (SELECT DISTINCT entity_1 AS a, entity_2 AS b FROM identity_pairs WHERE split <> 'train' AND entity_1 IS NOT NULL AND entity_2 IS NOT NULL),
v AS (SELECT DISTINCT least(coalesce(x.root, e.a), coalesce(y.root, e.b)) AS a, greatest(coalesce(x.root, e.a), coalesce(y.root, e.b)) AS b FROM (SELECT DISTINCT entity_1 AS a, entity_2 AS b FROM identity_pairs WHERE gold_label = 'different' AND split = 'train' AND entity_1 IS NOT NULL AND entity_2 IS NOT NULL) e LEFT JOIN c x ON e.a = x.node LEFT JOIN c y ON e.b = y.node)
SELECT q.a, q.b, EXISTS (SELECT 1 FROM v WHERE v.a = least(coalesce(x.root, q.a), coalesce(y.root, q.b)) AND v.b = greatest(coalesce(x.root, q.a), coalesce(y.root, q.b))) AS answer
FROM q LEFT JOIN c x ON q.a = x.node LEFT JOIN c y ON q.b = y.node""")
def d13_query_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the training graph holds a `different` edge between two entities: ends are mapped to their identity, the symmetric
    edge is put in order, and looked up."""
    t = table(spark, sf, "identity_pairs").where("entity_1 is not null and entity_2 is not null").select(F.col("entity_1").alias("a"), F.col("entity_2").alias("b"), "gold_label", "split")
    c = staged(graph.components(t.where("split = 'train' and gold_label = 'same'"), "a", "b"), "identities")

    def mapped(pairs: DataFrame) -> DataFrame:
        out = pairs.join(c.toDF("a", "ra"), "a", "left").join(c.toDF("b", "rb"), "b", "left")
        x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        return out.select("a", "b", F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))

    held = mapped(t.where("split = 'train' and gold_label = 'different'").select("a", "b").distinct()).select("x", "y").distinct().withColumn("held", F.lit(True))
    asked = mapped(t.where("split <> 'train'").select("a", "b").distinct())
    return asked.join(held, ["x", "y"], "left").select("a", "b", F.coalesce("held", F.lit(False)).alias("answer"))


@query("""
WITH RECURSIVE r AS (SELECT DISTINCT id, 'document:' || lower(trim(document_id)) AS a, 'claim:' || lower(trim(claim_id)) AS b FROM relation_examples WHERE document_id IS NOT NULL AND claim_id IS NOT NULL),
l AS (SELECT a, b FROM r UNION SELECT b, a FROM r), x(node, other) AS (SELECT a, a FROM l UNION SELECT x.node, l.b FROM x JOIN l ON x.other = l.a), c AS (SELECT node, min(other) AS root FROM x GROUP BY node)
SELECT id, root AS component FROM r JOIN c ON r.a = c.node""")
def g3_candidate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The component of each candidate over its typed ends, whatever its label or score."""
    t = table(spark, sf, "relation_examples").where("document_id is not null and claim_id is not null")
    r = t.select("id", F.concat(F.lit("document:"), F.expr(KEY.format("document_id"))).alias("a"), F.concat(F.lit("claim:"), F.expr(KEY.format("claim_id"))).alias("b")).distinct()
    roots = graph.components(r, "a", "b")
    return r.join(roots, F.col("a") == F.col("node")).select("id", F.col("root").alias("component"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT entity_1 AS u, entity_2 AS v FROM identity_pairs WHERE entity_1 IS NOT NULL AND entity_2 IS NOT NULL),
l AS (SELECT u || '#0' AS x, v || '#1' AS y FROM e UNION SELECT u || '#1', v || '#0' FROM e), b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x), nodes AS (SELECT DISTINCT u AS node FROM e UNION SELECT v FROM e),
s AS (SELECT n.node, min(left(r.y, length(r.y) - 2)) AS root FROM nodes n JOIN r ON r.x IN (n.node || '#0') GROUP BY n.node)
SELECT s.node, s.root, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.x = s.node || '#0' AND r.y = s.node || '#1') THEN NULL WHEN EXISTS (SELECT 1 FROM r WHERE r.x = s.node || '#0' AND r.y = s.root || '#0') THEN 0 ELSE 1 END AS color FROM s""")
def g11_coloring(spark: SparkSession, sf: str) -> DataFrame:
    """Two-colouring of the graph of judged pairs; null in components with an odd cycle."""
    return matching.coloring(table(spark, sf, "identity_pairs"), "entity_1", "entity_2")


PROOFS = f"l AS (SELECT DISTINCT l_orderkey AS f, 's' || l_suppkey AS s, 'p' || l_partkey AS p, CAST({P.format('l_suppkey')} AS DOUBLE) AS ps, CAST({P.format('l_partkey')} AS DOUBLE) AS pp FROM lineitem)"


@query(f"""
WITH RECURSIVE {PROOFS}, e AS (SELECT f, s AS a, p AS b FROM l UNION SELECT f, p, s FROM l), r(f, a, b) AS (SELECT f, a, a FROM e UNION SELECT r.f, r.a, e.b FROM r JOIN e ON r.f = e.f AND r.b = e.a),
c AS (SELECT f, a, min(b) AS root FROM r GROUP BY ALL), g AS (SELECT l.f, root, max(ps * pp) AS lo, least(1.0, sum(ps * pp)) AS up FROM l JOIN c ON l.f = c.f AND l.s = c.a GROUP BY ALL)
SELECT f AS formula_id, count(*) AS parts, round(1 - exp(sum(ln(1 - lo))), 9) AS lower, round(CASE WHEN max(up) >= 1 THEN 1.0 ELSE 1 - exp(sum(ln(1 - least(up, 0.999999999999)))) END, 9) AS upper FROM g GROUP BY f""")
def h1_proof_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of each order's lineage with independent atoms: parts of proofs that share atoms are independent of each other."""
    return lineage.proof_bounds(*_lineage(spark, sf))


ANSWER = f"""
WITH RECURSIVE {PROOFS}, k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s, p) AS i, count(*) OVER (PARTITION BY f) AS m FROM l),
w(f, i, atoms, sign) AS (SELECT DISTINCT f, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), -1 FROM k
  UNION ALL SELECT w.f, k.i, CASE WHEN t.take THEN list_distinct(list_concat(w.atoms, [k.s, k.p])) ELSE w.atoms END, CASE WHEN t.take THEN -w.sign ELSE w.sign END FROM w JOIN k ON w.f = k.f AND k.i = w.i + 1, (VALUES (true), (false)) AS t(take)),
x AS (SELECT w.f, sign * CASE WHEN len(atoms) = 0 THEN 0.0 ELSE list_product(list_transform(atoms, lambda a: CAST((CAST(substr(a, 2) AS BIGINT) % 90 + 5) / 100.0 AS DOUBLE))) END AS v FROM w JOIN (SELECT DISTINCT f, m FROM k) z ON w.f = z.f AND w.i = z.m)"""


@query(ANSWER + " SELECT f AS formula_id, round(sum(v), 12) AS p, 'exact' AS state FROM x GROUP BY f")
def h3_worlds(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of every order's lineage by summing all worlds of each independent part (the SQL sums by inclusion and exclusion)."""
    return lineage.worlds(*_lineage(spark, sf))


@query(ANSWER + " SELECT f AS formula_id, round(sum(v), 12) AS lower, round(sum(v), 12) AS upper, 'exact' AS state FROM x GROUP BY f")
def h4_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of every order's lineage by memoized expansion (the SQL sums by inclusion and exclusion)."""
    return lineage.exact(*_lineage(spark, sf))


# ordered selections


@query(sql("""
, r AS (SELECT arm, id, score, label = gold AS ok, row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS k FROM d WHERE label = 'same' AND score IS NOT NULL AND gold IS NOT NULL),
c AS (SELECT arm, count(*) AS accepted, count(*) FILTER (WHERE ok) AS correct, min(score) AS last FROM r WHERE k <= 100 GROUP BY arm)
SELECT c.arm, accepted, correct, accepted - correct AS incorrect, round(correct / CAST(accepted AS DOUBLE), 6) AS prec, count(*) AS boundary_ties FROM c JOIN r ON c.arm = r.arm AND r.score = c.last GROUP BY ALL"""))
def f4_budget_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 best edges of each arm: right and wrong ones, and how many edges have the score of the last one taken."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").isNotNull() & F.col("gold").isNotNull()).select("arm", "id", "score", correct().alias("ok"))
    taken = ranked(rows, ["arm"], F.desc("score"), "id", name="k").where("k <= 100")
    c = taken.groupBy("arm").agg(n().alias("accepted"), count(F.col("ok")).alias("correct"), F.min("score").alias("last"))
    ties = rows.join(F.broadcast(c.select("arm", "last")), "arm").where("score = last").groupBy("arm").agg(n().alias("boundary_ties"))  # a row for each arm
    return c.join(ties, "arm").select("arm", "accepted", "correct", (F.col("accepted") - F.col("correct")).alias("incorrect"), prob.ratio(F.col("correct"), F.col("accepted")).alias("prec"), "boundary_ties")


@query(sql("""
, c AS (SELECT id, grp, 1 - score AS risk FROM d WHERE arm = 'contract_a' AND label = 'same' AND score IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY risk DESC, id) AS k, coalesce(sum(ln(greatest(1 - risk, 1e-300))) OVER (PARTITION BY grp ORDER BY risk DESC, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM c),
g AS (SELECT *, risk * exp(rest) AS gain FROM p), m AS (SELECT *, min(gain) OVER (PARTITION BY grp ORDER BY k ROWS UNBOUNDED PRECEDING) AS least FROM g)
SELECT id, grp, k AS place_in_group, round(least, 6) AS gain FROM m"""))
def f6_review_order(spark: SparkSession, sf: str) -> DataFrame:
    """Group-aware review order without a loop: within a group items go by falling risk, an item's gain is its risk times the
    probability that all later ones are right, and the order of all is by the running least gain of the group (then by place)."""
    c = _arm(spark, sf, "contract_a").where((F.col("label") == POSITIVE) & F.col("score").isNotNull()).select("id", "grp", (1 - F.col("score")).alias("risk"))
    logs = F.log(F.greatest(1 - F.col("risk"), F.lit(1e-300)))
    placed = running(c, ["grp"], [F.desc("risk"), "id"], {"k": F.lit(1).cast("bigint"), "upto": logs})
    total = c.groupBy("grp").agg(F.sum(logs).alias("total"))
    g = placed.join(total, "grp").withColumn("gain", F.col("risk") * F.exp(F.col("total") - F.col("upto")))
    # the running least: few items of a group lower it; those are found by a window over the group's places
    from pyspark.sql.window import Window as W

    least = F.min("gain").over(W.partitionBy("grp").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return g.select("id", "grp", F.col("k").alias("place_in_group"), F.round(least, 6).alias("gain"))


@query(sql("""
, v AS (SELECT least(CAST(floor(score * 4) AS BIGINT), 3) AS bin, arm, avg(CASE WHEN label = gold THEN 0.0 ELSE 1.0 END) AS rate FROM d WHERE split = 'development' AND gold IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
s AS (SELECT d.arm, d.id, rate * (1 + d.id % 5) - 0.1 AS voi, (1 - score) AS unsure FROM d JOIN v ON d.arm = v.arm AND least(CAST(floor(score * 4) AS BIGINT), 3) = v.bin WHERE split = 'evaluation' AND score IS NOT NULL),
r AS (SELECT policy, arm, id, row_number() OVER (PARTITION BY policy, arm ORDER BY CASE policy WHEN 'confidence' THEN unsure WHEN 'impact' THEN unsure * (1 + id % 5) ELSE voi END DESC, id) AS k FROM s, (VALUES ('confidence'), ('impact'), ('voi')) AS t(policy))
SELECT policy, arm, id FROM r WHERE k <= 25"""))
def f8_select_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 examples of each arm most worth a query (a top-k report) by uncertainty, by uncertainty times impact, and by the value
    of information: the error rate of the score bin on the development split, times impact, less the cost."""
    rows = decision_rows(spark, sf).where("score is not null")
    bin_ = F.least(F.floor(F.col("score") * 4), F.lit(3)).cast("bigint")
    v = rows.where("split = 'development' and gold is not null").groupBy("arm", bin_.alias("bin")).agg(F.avg(F.when(correct(), 0.0).otherwise(1.0)).alias("rate"))
    s = rows.where("split = 'evaluation'").withColumn("bin", bin_).join(F.broadcast(v), ["arm", "bin"])  # four rows for each arm
    impact, unsure = 1 + F.col("id") % 5, 1 - F.col("score")
    values = F.array(*[F.struct(F.lit(k).alias("policy"), c.alias("v")) for k, c in (("confidence", unsure), ("impact", unsure * impact), ("voi", F.col("rate") * impact - 0.1))])
    x = s.select("arm", "id", F.explode(values).alias("x")).select("x.policy", "arm", "id", "x.v")
    return ranked(x, ["policy", "arm"], F.desc("v"), "id", name="k").where("k <= 25").select("policy", "arm", "id")


CHAIN = """
WITH RECURSIVE j AS (SELECT user_id, event_id, concat_ws('|', event_id, event_type, props) AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events),
c(user_id, event_id, version, link) AS (SELECT user_id, event_id, version, sha256('|' || body) FROM j WHERE version = 1 UNION ALL SELECT j.user_id, j.event_id, j.version, sha256(c.link || '|' || j.body) FROM c JOIN j ON c.user_id = j.user_id AND j.version = c.version + 1)
"""


@query(CHAIN + "SELECT user_id, event_id, version, link FROM c")
def f10_hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Journal links: each is the digest of the former link and the event, so that a change shows in every later one."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.concat_ws("|", "event_id", "event_type", "props").alias("body"))
    return matching.hash_chain(e, "user_id", ["ts", "event_id"], "body").select("user_id", "event_id", "version", "link")


@query(CHAIN + "SELECT user_id, version FROM c WHERE version % 50 = 7 OR version % 50 = 8 AND user_id IN (SELECT user_id FROM c d WHERE d.user_id = c.user_id AND d.version = c.version - 1)")
def f10_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit of a journal in which every fiftieth link (from the 7th) was overwritten: that link and the next one are broken."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.concat_ws("|", "event_id", "event_type", "props").alias("body"))
    chain = matching.hash_chain(e, "user_id", ["ts", "event_id"], "body")
    spoilt = staged(chain.withColumn("link", F.when(F.col("version") % 50 == 7, F.lit("0" * 64)).otherwise(F.col("link"))), "journal")
    return matching.chain_breaks(spoilt, "user_id", "body")


@query("""
WITH RECURSIVE r AS (SELECT DISTINCT id, lower(trim(gold_label)) AS label, group_id FROM relation_examples WHERE split = 'train' AND gold_label IS NOT NULL AND group_id IS NOT NULL),
k AS (SELECT label, id, [group_id] AS g, row_number() OVER (PARTITION BY label ORDER BY sha256(id), id) AS k FROM r),
w(label, k, used, id, took) AS (SELECT DISTINCT label, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), NULL::VARCHAR, false FROM k
  UNION ALL SELECT w.label, k.k, CASE WHEN list_has_any(w.used, k.g) THEN w.used ELSE list_concat(w.used, k.g) END, k.id, NOT list_has_any(w.used, k.g) FROM w JOIN k ON w.label = k.label AND k.k = w.k + 1)
SELECT label, id, CASE WHEN p <= 6 THEN 'demonstration' ELSE 'development' END AS role FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY sha256(id), id) AS p FROM w WHERE took) WHERE p <= 26""")
def f11_development(spark: SparkSession, sf: str) -> DataFrame:
    """Demonstrations (6) and development rows (20) of each label in digest order, no two of a label from one group (a sampling operator)."""
    r = table(spark, sf, "relation_examples").where("split = 'train' and gold_label is not null and group_id is not null").select("id", F.expr(KEY.format("gold_label")).alias("label"), "group_id").distinct()
    rows = r.select(F.concat("label", F.lit("|"), "id").alias("key"), F.sha2("id", 256).alias("rank"), F.array(F.concat("label", F.lit("|"), "group_id")).alias("items"))
    took = matching.disjoint(rows, "key", "rank", "items").select(F.substring_index("key", "|", 1).alias("label"), F.expr("substring(key, instr(key, '|') + 1)").alias("id"))
    p = ranked(took.withColumn("h", F.sha2("id", 256)), ["label"], "h", "id", name="p").where("p <= 26")
    return p.select("label", "id", F.when(F.col("p") <= 6, "demonstration").otherwise("development").alias("role"))


@query(f"""
WITH RECURSIVE e AS ({SAME}), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a), c AS (SELECT node, min(other) AS root FROM r GROUP BY node),
x AS (SELECT root, count(DISTINCT p.id) FILTER (WHERE gold_label = 'different') AS changed FROM c JOIN identity_pairs p ON p.entity_1 = c.node GROUP BY root), s AS (SELECT root, count(*) AS size FROM c GROUP BY root)
SELECT root, size, changed FROM s JOIN x USING (root) ORDER BY changed DESC, size DESC, root LIMIT 20""")
def f15_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 components most worth showing (a top-k report): most contested, then largest, then by name."""
    c = staged(graph.components(_same(spark, sf), "a", "b"), "clusters")
    pairs = table(spark, sf, "identity_pairs").select("id", F.col("entity_1").alias("node"), "gold_label")
    x = c.join(pairs, "node").groupBy("root").agg(F.count_distinct(F.when(F.col("gold_label") == "different", F.col("id"))).alias("changed"))
    s = c.groupBy("root").agg(n().alias("size"))
    return s.join(x, "root").orderBy(F.desc("changed"), F.desc("size"), "root").limit(20)


@query(sql("""
, s AS (SELECT arm, least(CAST(floor(score * 5) AS BIGINT), 4) AS bin, id, 1 - score AS risk FROM d WHERE label = 'same' AND score IS NOT NULL),
c AS (SELECT arm, bin, count(*) AS m FROM s GROUP BY ALL), m AS (SELECT *, sum(m) OVER (PARTITION BY arm) AS t FROM c), q AS (SELECT *, floor(m * 40.0 / t) AS base, m * 40.0 / t - floor(m * 40.0 / t) AS rest FROM m),
a AS (SELECT arm, bin, base + CASE WHEN row_number() OVER (PARTITION BY arm ORDER BY rest DESC, bin) <= 40 - sum(base) OVER (PARTITION BY arm) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT s.*, row_number() OVER (PARTITION BY arm, bin ORDER BY risk DESC, id) AS k FROM s)
SELECT r.arm, r.bin, r.id FROM r JOIN a ON r.arm = a.arm AND r.bin = a.bin WHERE k <= quota"""))
def f17_risk_selection(spark: SparkSession, sf: str) -> DataFrame:
    """40 reviews of each arm shared among its score bins by largest remainder, and within a bin the riskiest first."""
    from pyspark.sql.window import Window as W

    s = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").isNotNull()).select("arm", "id", "score", (1 - F.col("score")).alias("risk"))
    s = s.withColumn("bin", F.least(F.floor(F.col("score") * 5), F.lit(4)).cast("bigint"))
    m = s.groupBy("arm", "bin").agg(n().alias("m"))
    arm = W.partitionBy("arm")  # five rows for each arm
    share = F.col("m") * F.lit(40.0) / F.sum("m").over(arm)
    q = m.select("arm", "bin", F.floor(share).alias("base"), (share - F.floor(share)).alias("rest"))
    quota = F.col("base") + F.when(F.row_number().over(arm.orderBy(F.desc("rest"), "bin")) <= 40 - F.sum("base").over(arm), 1).otherwise(0)
    r = ranked(s, ["arm", "bin"], F.desc("risk"), "id", name="k")
    return r.join(F.broadcast(q.select("arm", "bin", quota.alias("quota"))), ["arm", "bin"]).where("k <= quota").select("arm", "bin", "id")


def prediction_set(p, threshold):
    """Labels whose nonconformity is within the threshold; all of them where there is none."""
    inside = F.array_compact(F.array(*[F.when(1 - (p if x == POSITIVE else 1 - p) <= threshold + 1e-12, F.lit(x)) for x in LABELS]))
    return F.when(threshold.isNull(), F.array(*map(F.lit, LABELS))).otherwise(inside)


@query(sql("""
, g AS (SELECT arm, grp, max(CASE WHEN gold = 'same' THEN 1 - p ELSE p END) AS worst FROM d WHERE split = 'calibration' AND gold IS NOT NULL AND NOT error GROUP BY ALL),
r AS (SELECT arm, worst, row_number() OVER (PARTITION BY arm ORDER BY worst, grp) AS k, count(*) OVER (PARTITION BY arm) AS n FROM g), t AS (SELECT arm, worst AS threshold FROM r WHERE k = CAST(ceil((n + 1) * 0.9) AS BIGINT)),
s AS (SELECT d.arm, gold, CASE WHEN error OR t.threshold IS NULL THEN 'same,different' ELSE concat_ws(',', CASE WHEN 1 - p <= threshold + 1e-12 THEN 'same' END, CASE WHEN p <= threshold + 1e-12 THEN 'different' END) END AS labels FROM d LEFT JOIN t ON d.arm = t.arm WHERE split = 'evaluation' AND gold IS NOT NULL)
SELECT arm, labels, count(*) AS n, count(*) FILTER (WHERE list_contains(string_split(labels, ','), gold)) AS covered FROM s GROUP BY ALL"""))
def f9_prediction_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Conformal prediction sets of the evaluation split and how often they hold the label; failed calls get every label."""
    from .selection import f9_conformal_fit

    # the threshold is a row for each arm, to six digits; nonconformities have four
    t = f9_conformal_fit(spark, sf)
    rows = decision_rows(spark, sf).where("split = 'evaluation' and gold is not null").join(F.broadcast(t), "arm", "left")
    sets = F.when(F.col("error"), F.array(*map(F.lit, LABELS))).otherwise(prediction_set(F.col("p"), F.col("threshold")))
    s = rows.select("arm", "gold", sets.alias("s"))
    return s.groupBy("arm", F.array_join("s", ",").alias("labels")).agg(n().alias("n"), count(F.array_contains("s", F.col("gold"))).alias("covered"))
