"""Graph, lineage and conflict queries over the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import conflicts, graph, lineage
from ..session import sorted_join, staged, table
from .metrics import count, n
from .registry import query

SAME = "SELECT DISTINCT entity_1 AS a, entity_2 AS b FROM identity_pairs WHERE gold_label = 'same' AND entity_1 IS NOT NULL AND entity_2 IS NOT NULL"


def _same(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "identity_pairs").where("gold_label = 'same' and entity_1 is not null and entity_2 is not null").select(F.col("entity_1").alias("a"), F.col("entity_2").alias("b")).distinct()


@query(f"""
WITH RECURSIVE e AS ({SAME}), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT node, min(other) AS root FROM r GROUP BY node""")
def g2_components(spark: SparkSession, sf: str) -> DataFrame:
    """Identity clusters of the pairs that are labelled the same."""
    return graph.components(_same(spark, sf), "a", "b")


@query(f"""
WITH RECURSIVE e AS ({SAME}), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS root FROM r GROUP BY node), d AS (SELECT DISTINCT entity_1 AS a, entity_2 AS b FROM identity_pairs WHERE gold_label = 'different')
SELECT d.a, d.b, x.root AS cluster FROM d JOIN c x ON d.a = x.node JOIN c y ON d.b = y.node WHERE x.root = y.root""")
def g4_cannot_link(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs labelled different inside one identity cluster."""
    c = staged(graph.components(_same(spark, sf), "a", "b"), "clusters")
    d = table(spark, sf, "identity_pairs").where("gold_label = 'different'").select(F.col("entity_1").alias("a"), F.col("entity_2").alias("b")).distinct()
    x, y = c.toDF("a", "cluster"), c.toDF("b", "cluster")
    return d.join(x, "a").join(y, ["b", "cluster"]).select("a", "b", "cluster")


CLAIMS = "SELECT DISTINCT lower(trim(document_id)) AS doc, lower(trim(claim_id)) AS claim, source_code FROM relation_examples WHERE document_id IS NOT NULL AND claim_id IS NOT NULL"


@query(f"""
WITH RECURSIVE c AS ({CLAIMS}), start AS (SELECT DISTINCT 'd:' || doc AS node FROM c WHERE source_code LIKE 'labnote%'),
e AS (SELECT 'd:' || doc AS s, 'c:' || claim AS t FROM c UNION SELECT 'c:' || claim, 'd:' || doc FROM c), r(node) AS (SELECT node FROM start UNION SELECT t FROM r JOIN e ON r.node = e.s) SELECT node FROM r""")
def g7_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What a withdrawal of one kind of source reaches: documents, the claims they serve, those claims' documents, and so on."""
    r = table(spark, sf, "relation_examples").where("document_id is not null and claim_id is not null")
    c = r.select(F.concat(F.lit("d:"), F.lower(F.trim("document_id"))).alias("d"), F.concat(F.lit("c:"), F.lower(F.trim("claim_id"))).alias("c"), "source_code").distinct()
    edges = c.select(F.col("d").alias("s"), F.col("c").alias("t")).unionByName(c.select(F.col("c").alias("s"), F.col("d").alias("t")))
    return graph.reachable(c.where("source_code like 'labnote%'").select(F.col("d").alias("node")), edges, "node", "s", "t")


@query("""
WITH base AS (SELECT p_partkey FROM part WHERE p_size <= 45), o AS (SELECT l_orderkey AS k, bool_and(l_partkey IN (SELECT p_partkey FROM base)) AS ok FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_custkey AS k, bool_and(coalesce(o.ok, false)) AS ok FROM orders LEFT JOIN o ON o_orderkey = o.k GROUP BY o_custkey)
SELECT 'p' || p_partkey AS fact FROM base UNION ALL SELECT 'o' || k FROM o WHERE ok UNION ALL SELECT 'c' || k FROM c WHERE ok""")
def g8_horn(spark: SparkSession, sf: str) -> DataFrame:
    """Closure of Horn rules: an order follows from all its parts, a customer from all their orders."""
    base = table(spark, sf, "part").where("p_size <= 45").select(F.concat(F.lit("p"), "p_partkey").alias("fact"))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("body")).select(F.concat(F.lit("o"), "l_orderkey").alias("head"), "body")
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.concat(F.lit("o"), "o_orderkey")).alias("body")).select(F.concat(F.lit("c"), "o_custkey").alias("head"), "body")
    rules = o.unionByName(c).select(F.col("head").alias("rule"), "head", "body")
    return graph.horn_closure(rules, base)


@query("""
WITH e AS (SELECT entity_1 AS a, entity_2 AS b, gold_label AS t FROM (SELECT DISTINCT id, entity_1, entity_2, gold_label FROM identity_pairs) WHERE entity_1 IS NOT NULL AND entity_2 IS NOT NULL),
u AS (SELECT DISTINCT a, b, t FROM e), d AS (SELECT x, count(*) AS deg FROM (SELECT a AS x FROM u UNION ALL SELECT b FROM u) GROUP BY x)
SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM u) AS typed, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM u)) AS pairs, (SELECT count(*) FROM u WHERE a = b) AS loops,
  (SELECT count(*) FROM u x JOIN u y ON x.a = y.b AND x.b = y.a AND x.t = y.t WHERE x.a < x.b) AS reciprocal, (SELECT count(*) FROM d) AS nodes, (SELECT max(deg) FROM d) AS max_degree""")
def e12_graph_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Edges, typed edges, pairs, loops, reciprocal edges, nodes and the largest degree of the judged pairs."""
    e = table(spark, sf, "identity_pairs").where("entity_1 is not null and entity_2 is not null").select("id", F.col("entity_1").alias("a"), F.col("entity_2").alias("b"), F.col("gold_label").alias("t")).distinct()
    u = e.select("a", "b", "t").distinct()
    deg = u.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(n().alias("deg"))
    back = u.where("a < b").join(u.toDF("b", "a", "t"), ["a", "b", "t"])
    parts = [e.agg(n().alias("edges")), u.agg(n().alias("typed"), F.count_distinct("a", "b").alias("pairs"), count(F.col("a") == F.col("b")).alias("loops")), back.agg(n().alias("reciprocal")), deg.agg(n().alias("nodes"), F.max("deg").alias("max_degree"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@query("""
SELECT lower(trim(claim_id)) AS claim, lower(trim(gold_label)) AS label, array_to_string(list_sort(list(DISTINCT id)), ',') AS assertions, count(DISTINCT id) AS n
FROM relation_examples WHERE claim_id IS NOT NULL AND gold_label IS NOT NULL GROUP BY ALL""")
def e13_view(spark: SparkSession, sf: str) -> DataFrame:
    """The identity view: assertions of one normalized subject and label, in order (a claim cites few documents)."""
    r = table(spark, sf, "relation_examples").where("claim_id is not null and gold_label is not null")
    ids = F.array_sort(F.collect_set("id"))
    return r.groupBy(F.lower(F.trim("claim_id")).alias("claim"), F.lower(F.trim("gold_label")).alias("label")).agg(F.array_join(ids, ",").alias("assertions"), F.count_distinct("id").alias("n"))


@query("""
WITH nodes AS (SELECT DISTINCT entity_1 AS id FROM identity_pairs WHERE entity_1 IS NOT NULL), e AS (SELECT DISTINCT id, entity_1 AS s, gold_label AS p, entity_2 AS o FROM identity_pairs WHERE entity_1 IS NOT NULL AND entity_2 IS NOT NULL)
SELECT rule, subject FROM (
  SELECT 'referential' AS rule, id AS subject FROM e WHERE s NOT IN (SELECT id FROM nodes) OR o NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'unknown_predicate', id FROM e WHERE p IS NULL OR p NOT IN ('same', 'different')
  UNION ALL SELECT 'self_loop', id FROM e WHERE s = o AND p IN ('same', 'different')
  UNION ALL SELECT 'duplicate_triple', min(id) FROM e GROUP BY s, p, o HAVING count(*) > 1
  UNION ALL SELECT 'cardinality', s FROM e WHERE p = 'same' GROUP BY s HAVING count(DISTINCT o) > 1)""")
def e24_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The pair graph against its schema: endpoints known as first entities, no loops, no repeats, one `same` each."""
    rows = table(spark, sf, "identity_pairs").where("entity_1 is not null")
    nodes = rows.select(F.col("entity_1").alias("id"), F.lit("work").alias("type")).distinct()
    edges = rows.where("entity_2 is not null").select("id", F.col("entity_1").alias("subject"), F.col("gold_label").alias("predicate"), F.col("entity_2").alias("object")).distinct()
    schema = spark.createDataFrame([("same", "work", "*", False, True), ("different", "work", "*", False, False)], "predicate string, domain string, range string, allow_self boolean, unique boolean")
    return graph.violations(nodes, edges, F.broadcast(schema))  # two rows



# lineage

P = "({0} % 90 + 5) / 100.0"


def _lineage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An order as an OR over its lines of (supplier AND part); atoms have fixed probabilities by key."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
    f = lines.groupBy(F.col("l_orderkey").alias("formula_id")).agg(F.collect_list(F.array(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"))).alias("proofs"))
    atoms = [lines.select(F.col("l_orderkey").alias("formula_id"), F.concat(F.lit(k), c).alias("atom"), F.expr(P.format(c)).cast("double").alias("p")) for k, c in (("s", "l_suppkey"), ("p", "l_partkey"))]
    return f, atoms[0].unionByName(atoms[1]).distinct()


@query(f"""
WITH l AS (SELECT DISTINCT l_orderkey AS formula_id, l_suppkey, l_partkey, CAST({P.format("l_suppkey")} AS DOUBLE) AS a, CAST({P.format("l_partkey")} AS DOUBLE) AS b FROM lineitem)
SELECT formula_id, round(max(greatest(0, a + b - 1)), 9) AS lower, round(least(1.0, sum(least(a, b))), 9) AS upper FROM l GROUP BY formula_id""")
def h2_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Frechet bounds of every order's lineage."""
    return lineage.bounds(*_lineage(spark, sf))



@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS formula_id, l_suppkey AS s FROM lineitem)
SELECT formula_id, count(*) AS proofs, round(1 - exp(sum(ln(1 - CAST((s % 90 + 5) / 100.0 AS DOUBLE)))) + 1e-9, 6) AS p FROM l GROUP BY formula_id""")
def h1_independent(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy OR of an order's distinct suppliers."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("formula_id"), "l_suppkey").distinct()
    return lines.groupBy("formula_id").agg(n().alias("proofs"), F.round(1 - F.exp(F.sum(F.log(1 - F.expr(P.format("l_suppkey")).cast("double")))) + 1e-9, 6).alias("p"))  # no ties of rounding


@query("""
WITH l AS (SELECT l_orderkey AS formula_id, list_sort(list(DISTINCT 's' || l_suppkey)) AS proof FROM lineitem GROUP BY l_orderkey, l_linestatus), k AS (SELECT DISTINCT formula_id, proof FROM l)
SELECT formula_id, count(*) AS minimal FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS o WHERE o.formula_id = k.formula_id AND o.proof <> k.proof AND list_has_all(k.proof, o.proof)) GROUP BY formula_id""")
def g1_absorbed(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs left after duplicates and supersets are absorbed; a proof is the suppliers of an order's lines of one status."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("formula_id"), "l_linestatus").agg(F.collect_set(F.concat(F.lit("s"), "l_suppkey")).alias("proof"))  # noqa: E741
    f = l.groupBy("formula_id").agg(F.collect_list("proof").alias("proofs"))
    return f.select("formula_id", F.size(lineage.canonical(F.col("proofs"))).cast("bigint").alias("minimal"))


# conflicts

ASSERTIONS = """a AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, regexp_extract(props, '[0-9]+') AS object, CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS polarity,
  CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s, CAST(floor(epoch(ts) / 3600) AS BIGINT) + 1 + event_id % 12 AS e FROM events)"""


def _assertions(spark: SparkSession, sf: str) -> DataFrame:
    start = F.floor(F.unix_timestamp("ts") / 3600).cast("bigint")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.lit("all").alias("scope"), F.regexp_extract("props", "[0-9]+", 0).alias("object"),
        F.when(F.col("event_id") % 7 == 0, -1).otherwise(1).alias("polarity"), start.alias("start"), (start + 1 + F.col("event_id") % 12).alias("end"), (1 + F.col("event_id") % 9).alias("weight"))


@query(f"""WITH {ASSERTIONS} SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON x.subject = y.subject AND x.predicate = y.predicate AND x.id < y.id AND x.s < y.e AND y.s < x.e
WHERE CASE WHEN x.object = y.object THEN x.polarity <> y.polarity ELSE x.polarity = 1 AND y.polarity = 1 END""")
def d8_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicting assertions of one subject and predicate whose intervals overlap."""
    return conflicts.conflict_edges(_assertions(spark, sf))


@query()
def i1_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A heaviest conflict-free choice in each component (checked by i4_certificate and by brute force in the tests)."""
    return conflicts.resolve(_assertions(spark, sf))


def _optimum(weight: str) -> str:
    """SQL that enumerates the independent sets of each component: component, n, weight of the heaviest."""
    return f"""
WITH RECURSIVE {ASSERTIONS}, w AS (SELECT id, {weight} AS weight FROM a),
e AS (SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON x.subject = y.subject AND x.predicate = y.predicate AND x.id <> y.id AND x.s < y.e AND y.s < x.e
  WHERE CASE WHEN x.object = y.object THEN x.polarity <> y.polarity ELSE x.polarity = 1 AND y.polarity = 1 END),
r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), c AS (SELECT id, coalesce(min(y), id) AS component FROM a LEFT JOIN r ON a.id = r.x GROUP BY id),
v AS (SELECT c.component, c.id, weight, coalesce((SELECT list(b) FROM e WHERE e.a = c.id), []) AS near FROM c JOIN w ON c.id = w.id),
s(component, last, total, banned) AS (SELECT component, id, weight, near FROM v UNION ALL SELECT s.component, v.id, s.total + v.weight, list_concat(s.banned, v.near) FROM s JOIN v ON s.component = v.component AND v.id > s.last AND NOT list_contains(s.banned, v.id)),
b AS (SELECT component, max(total) AS weight FROM s GROUP BY component), k AS (SELECT component, count(*) AS n FROM c GROUP BY component)"""


@query(_optimum("1 + id % 9") + " SELECT component, n, CAST(weight AS BIGINT) AS weight, 0::BIGINT AS conflicts FROM b JOIN k USING (component)")
def i4_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """Each component's chosen weight and the conflicts left among the chosen; the SQL finds the greatest weight by enumeration."""
    a = _assertions(spark, sf)
    r = staged(conflicts.resolve(a), "resolved")
    chosen = r.where("chosen").select("id", "component")
    bad = conflicts.conflict_edges(a).join(sorted_join(chosen.toDF("a", "component")), "a").join(sorted_join(chosen.select(F.col("id").alias("b"))), "b").groupBy("component").agg(n().alias("conflicts"))
    sums = r.join(sorted_join(a.select("id", "weight")), "id").groupBy("component").agg(n().alias("n"), F.sum(F.when(F.col("chosen"), F.col("weight")).otherwise(0)).alias("weight"))
    return sums.join(sorted_join(bad), "component", "left").select("component", "n", "weight", F.coalesce("conflicts", F.lit(0).cast("bigint")).alias("conflicts"))


@query(_optimum("1 + id % 9 + CASE WHEN id % 97 = 0 THEN 5 ELSE 0 END") + " SELECT component, n, CAST(weight AS BIGINT) AS weight FROM b JOIN k USING (component) WHERE component IN (SELECT component FROM c WHERE id % 97 = 0)")
def i9_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The components that a change of some weights touches, with their new optimum; all other components keep their solution."""
    a = _assertions(spark, sf)
    former = staged(conflicts.resolve(a), "resolved")
    changed = a.where("id % 97 = 0").select("id", (F.col("weight") + 5).alias("weight"))
    new, touched = conflicts.resolve_changed(a, changed, former)
    weights = a.select("id", (F.col("weight") + F.when(F.col("id") % 97 == 0, 5).otherwise(0)).alias("weight"))
    again = new.join(sorted_join(touched), "component")
    return again.join(sorted_join(weights), "id").groupBy("component").agg(n().alias("n"), F.sum(F.when(F.col("chosen"), F.col("weight")).otherwise(0)).alias("weight"))


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS f, l_suppkey AS s, l_partkey AS p FROM lineitem), k AS (SELECT f, s, row_number() OVER (PARTITION BY f ORDER BY s) AS i FROM (SELECT DISTINCT f, s FROM l)), m AS (SELECT f, max(i) AS m, (SELECT 0) AS z FROM k GROUP BY f),
g(f, i, took, w) AS (SELECT f, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM m UNION ALL SELECT g.f, k.i, CASE WHEN t.t THEN list_concat(g.took, [k.s]) ELSE g.took END, g.w + CASE WHEN t.t THEN 1 + k.s % 9 ELSE 0 END FROM g JOIN k ON g.f = k.f AND k.i = g.i + 1, (VALUES (true), (false)) AS t(t)),
parts AS (SELECT f, p, list(s) AS near FROM l GROUP BY f, p), b AS (SELECT g.f, g.took, any_value(g.w) + coalesce(sum(CASE WHEN list_has_any(q.near, g.took) THEN 0 ELSE 1 + q.p % 9 END), 0) AS w FROM g JOIN m ON g.f = m.f AND g.i = m.m JOIN parts q ON q.f = g.f GROUP BY g.f, g.took)
SELECT b.f AS order_key, CAST(max(w) AS BIGINT) AS weight, CAST(any_value(t.t) - max(w) AS BIGINT) AS flow FROM b JOIN (SELECT f, sum(w) AS t FROM (SELECT DISTINCT f, 's' AS k, s, 1 + s % 9 AS w FROM l UNION SELECT DISTINCT f, 'p', p, 1 + p % 9 FROM l) GROUP BY f) t ON b.f = t.f GROUP BY b.f""")
def i4_bipartite(spark: SparkSession, sf: str) -> DataFrame:
    """Heaviest choice of suppliers and parts of each order with no part beside its supplier, by a least cut; the flow is its certificate."""
    import pandas as pd

    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_set(F.struct(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))).alias("e"))  # noqa: E741

    def run(batches):
        for batch in batches:
            out = []
            for key, edges in zip(batch["order_key"], batch["e"], strict=True):
                near, weight, color = {}, {}, {}
                for e in edges:
                    s, p = (0, int(e["s"])), (1, int(e["p"]))
                    for x, y in ((s, p), (p, s)):
                        near.setdefault(x, set()).add(y)
                        weight[x], color[x] = 1 + x[1] % 9, x[0]
                chosen, flow = conflicts.min_cut(sorted(near), weight, near, color)
                out.append((key, sum(weight[v] for v in chosen), flow))
            yield pd.DataFrame(out, columns=["order_key", "weight", "flow"])

    return l.mapInPandas(run, "order_key bigint, weight bigint, flow bigint")
