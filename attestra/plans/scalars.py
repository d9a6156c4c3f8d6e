"""Scalar functions of inventory part B over the tables, and the scans and gates that are plain expressions."""

from __future__ import annotations

import difflib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prob
from ..operators.decisions import LABELS, POSITIVE, decision_rows
from ..session import table
from .metrics import correct, count, n, sql
from .registry import query

# Words without content, and negations, of the shallow lexical rule.
STOPWORDS = "a an the of to in on and or is are was were be been by for with that this these those as at from it its has have had can may do does did"
NEGATIONS = "no not neither without"


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def _list(words: str) -> Column:
    return F.array(*map(F.lit, words.split()))


def _sql_list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


@query("""
SELECT doc_id, sha256('{"end":' || least(length(text), 80) || ',"origin":"' || source || '","source":"' || source || '","start":0}' || substr(text, 1, 80)) AS evidence_id,
  CAST(least(length(text), 80) AS BIGINT) AS span_end FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND length(text) > 0""")
def b3_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Content-addressed evidence: the id binds source, origin, offsets and the exact span (here the first 80 characters of
    each non-empty text)."""
    d = table(spark, sf, "documents").where("source is not null and text is not null and length(text) > 0")
    end = F.least(F.length("text"), F.lit(80)).cast("bigint")
    head = F.concat(F.lit('{"end":'), end, F.lit(',"origin":"'), "source", F.lit('","source":"'), "source", F.lit('","start":0}'))
    return d.select("doc_id", F.sha2(F.concat(head, F.substring("text", 1, 80)), 256).alias("evidence_id"), end.alias("span_end"))


@query("""
WITH r AS (SELECT * FROM (VALUES ('same', NULL, true), ('different', NULL, true), ('uncertain', 'different', false)) AS v(p, inverse, sym)),
e AS (SELECT DISTINCT id, entity_1 AS s, gold_label AS p, entity_2 AS o FROM identity_pairs WHERE entity_1 IS NOT NULL AND entity_2 IS NOT NULL),
i AS (SELECT e.id, CASE WHEN inverse IS NULL THEN s ELSE o END AS s, coalesce(inverse, e.p) AS p, CASE WHEN inverse IS NULL THEN o ELSE s END AS o, sym FROM e JOIN r ON e.p = r.p)
SELECT id, CASE WHEN sym AND s > o THEN o ELSE s END AS subject, p AS predicate, CASE WHEN sym AND s > o THEN s ELSE o END AS object FROM i""")
def b4_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Triples in canonical direction: inverse predicates turned round, ends of symmetric ones in order; unknown predicates have no row."""
    relations = spark.createDataFrame([("same", None, True), ("different", None, True), ("uncertain", "different", False)], "predicate string, inverse string, symmetric boolean")
    e = table(spark, sf, "identity_pairs").where("entity_1 is not null and entity_2 is not null")
    e = e.select("id", F.col("entity_1").alias("s"), F.col("gold_label").alias("predicate"), F.col("entity_2").alias("o")).distinct()
    i = e.join(F.broadcast(relations), "predicate")  # three rows
    turned = F.col("inverse").isNotNull()
    i = i.select("id", F.when(turned, F.col("o")).otherwise(F.col("s")).alias("s"), F.coalesce("inverse", "predicate").alias("predicate"), F.when(turned, F.col("s")).otherwise(F.col("o")).alias("o"), "symmetric")
    swap = F.col("symmetric") & (F.col("s") > F.col("o"))
    return i.select("id", F.when(swap, F.col("o")).otherwise(F.col("s")).alias("subject"), "predicate", F.when(swap, F.col("s")).otherwise(F.col("o")).alias("object"))


@query(sql("""
, z AS (SELECT id, p, ln(greatest(p, 1e-15)) / 2.0 + 0.3 AS a, ln(greatest(1 - p, 1e-15)) / 2.0 AS b FROM d WHERE NOT error AND p IS NOT NULL),
t AS (SELECT id, p, 1 / (1 + exp(b - a)) AS q FROM z)
SELECT id, round(0.25 * p + 0.75 * q, 9) AS p FROM t"""))
def b6_transformed(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities after temperature 2, a bias of 0.3 on the positive logit and a shrinkage weight of 0.75 towards the result."""
    rows = decision_rows(spark, sf).where("not error and p is not null")
    return rows.select("id", F.round(prob.transformed(F.col("p"), 2.0, weight=0.75, bias=0.3), 9).alias("p"))


@query("""
WITH m AS (SELECT vec_id, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings), x AS (SELECT vec_id, v, list_transform(v, lambda t: exp(t - list_max(v))) AS w FROM m)
SELECT vec_id, round(list_max(w) / list_sum(w), 6) AS top_share, round(1 / (1 + exp(-list_max(v))), 6) AS sigmoid FROM x""")
def b7_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax of each vector (its greatest share) with the greatest value subtracted first, and the sigmoid of the greatest value."""
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", F.round(F.array_max(prob.softmax(F.col("v"))), 6).alias("top_share"), F.round(prob.sigmoid(F.array_max("v")), 6).alias("sigmoid"))


@query(sql("""
, x AS (SELECT item, max(p) FILTER (WHERE arm = 'contract_a') AS a, max(p) FILTER (WHERE arm = 'contract_b') AS b FROM d WHERE NOT error GROUP BY item)
SELECT item, round(a, 9) AS same, round((1 - a) * b, 9) AS related, round((1 - a) * (1 - b), 9) AS different,
  CASE WHEN a >= (1 - a) * b AND a >= (1 - a) * (1 - b) THEN 'same' WHEN b >= 1 - b THEN 'related' ELSE 'different' END AS answer FROM x WHERE a IS NOT NULL AND b IS NOT NULL"""))
def b8_conditional(spark: SparkSession, sf: str) -> DataFrame:
    """Two binary answers composed to three classes: a, (1 - a) b and (1 - a)(1 - b), and the first greatest of them."""
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("p")))
    x = decision_rows(spark, sf).where("not error").groupBy("item").agg(pick("contract_a").alias("a"), pick("contract_b").alias("b")).where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    three = [a, (1 - a) * b, (1 - a) * (1 - b)]
    answer = F.when((three[0] >= three[1]) & (three[0] >= three[2]), "same").when(b >= 1 - b, "related").otherwise("different")
    return x.select("item", *[F.round(c, 9).alias(name) for c, name in zip(three, ("same", "related", "different"), strict=True)], answer.alias("answer"))


@query("""SELECT DISTINCT id, to_json({'claim': claim, 'title': title}) AS payload FROM relation_examples WHERE claim IS NOT NULL AND title IS NOT NULL""")
def b9_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Input projection of a whitelist of fields: no label, group or split can reach a backend."""
    r = table(spark, sf, "relation_examples").where("claim is not null and title is not null")
    return r.select("id", F.to_json(F.struct("claim", "title")).alias("payload")).distinct()


@query(f"""
WITH r AS (SELECT DISTINCT id, claim, evidence FROM relation_examples WHERE claim IS NOT NULL AND evidence IS NOT NULL),
w AS (SELECT id, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')) AS c, list_distinct(regexp_extract_all(lower(array_to_string(evidence, chr(10))), '[a-z0-9]+')) AS e FROM r),
k AS (SELECT id, c, e, list_filter(c, lambda x: NOT list_contains({_sql_list(STOPWORDS)}, x)) AS content FROM w)
SELECT id, CASE WHEN len(list_intersect(content, e)) / CAST(greatest(1, len(content)) AS DOUBLE) < 0.6 THEN 'NOT_ENOUGH_INFO'
  WHEN list_has_any(c, {_sql_list(NEGATIONS)}) <> list_has_any(e, {_sql_list(NEGATIONS)}) THEN 'REFUTES' ELSE 'SUPPORTS' END AS label FROM k""")
def b10_lexical_label(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed shallow rule: below 60 % of the claim's content words in the evidence there is not enough, else the negations decide."""
    r = table(spark, sf, "relation_examples").where("claim is not null and evidence is not null").select("id", "claim", "evidence").distinct()
    k = r.select("id", _words(F.col("claim")).alias("c"), _words(F.concat_ws("\n", "evidence")).alias("e")).withColumn("content", F.array_except("c", _list(STOPWORDS)))
    share = F.size(F.array_intersect("content", "e")) / F.greatest(F.lit(1), F.size("content"))
    negated = lambda c: F.arrays_overlap(c, _list(NEGATIONS))
    return k.select("id", F.when(share < 0.6, "NOT_ENOUGH_INFO").when(negated("c") != negated("e"), "REFUTES").otherwise("SUPPORTS").alias("label"))


@F.pandas_udf(T.StringType())
def _mention(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()), na_action="ignore")


@query()
def b11_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in compatibility form, case-folded, letters and digits only (no SQL: it has no compatibility form; see the tests)."""
    rows = table(spark, sf, "er_examples").select("example_id", "mention_1", "mention_2").distinct()
    return rows.select("example_id", _mention("mention_1").alias("mention_1"), _mention("mention_2").alias("mention_2"))


@F.pandas_udf(T.DoubleType())
def _title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@query()
def b12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs labelled different whose titles are alike by matching blocks, at 0.65 or more (no SQL: matching blocks are no edit
    distance; see the tests)."""
    rows = table(spark, sf, "identity_pairs").where("gold_label = 'different'").select("id", F.col("record_1")["title"].alias("a"), F.col("record_2")["title"].alias("b")).distinct()
    rows = rows.where("a is not null and b is not null").withColumn("ratio", _title_ratio("a", "b"))
    return rows.where("ratio >= 0.65").select("id", F.round("ratio", 6).alias("ratio"))


@query("""
SELECT id, array_to_string(list_transform(list_sort(map_keys(record_1)), lambda k: k || ': ' || coalesce(record_1[k], '')), ' | ') AS text
FROM (SELECT DISTINCT id, record_1 FROM identity_pairs WHERE record_1 IS NOT NULL)""")
def b13_record_text(spark: SparkSession, sf: str) -> DataFrame:
    """A record as text: its attributes in order of their names."""
    rows = table(spark, sf, "identity_pairs").where("record_1 is not null").select("id", F.array_sort(F.map_entries("record_1")).alias("e")).distinct()
    return rows.select("id", F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit(": "), F.coalesce(x["value"], F.lit("")))), " | ").alias("text"))


@query(sql("""
, x AS (SELECT item, min_by(p, id) FILTER (WHERE arm = 'contract_a' AND NOT error) AS a, min_by(p, id) FILTER (WHERE arm = 'contract_b' AND NOT error) AS b FROM d GROUP BY item)
SELECT item, round(ln(greatest(a, 1e-6)), 6) AS f1, round(ln(greatest(1 - a, 1e-6)), 6) AS f2, round(ln(greatest(b, 1e-6)), 6) AS f3, round(ln(greatest(1 - b, 1e-6)), 6) AS f4
FROM x WHERE a IS NOT NULL AND b IS NOT NULL"""))
def b14_features(spark: SparkSession, sf: str) -> DataFrame:
    """The log probabilities of two arms, clipped at 1e-6, as one feature vector; an example without both has none."""
    x = paired_probabilities(spark, sf)
    logs = [F.log(F.greatest(c, F.lit(1e-6))) for c in (F.col("a"), 1 - F.col("a"), F.col("b"), 1 - F.col("b"))]
    return x.select("item", *[F.round(c, 6).alias(f"f{i}") for i, c in enumerate(logs, 1)])


def paired_probabilities(spark: SparkSession, sf: str, keep: list[str] | None = None) -> DataFrame:
    """item, a, b: the first valid probability of either contract arm, of examples that have both; `keep` adds columns of arm a."""
    rows = decision_rows(spark, sf).where("not error and p is not null")
    first = lambda arm, c: F.min_by(F.when(F.col("arm") == arm, F.col(c)), F.when(F.col("arm") == arm, F.col("id")))
    x = rows.groupBy("item").agg(first("contract_a", "p").alias("a"), first("contract_b", "p").alias("b"), *[first("contract_a", c).alias(c) for c in keep or []])
    return x.where("a is not null and b is not null")


@query(sql("""
SELECT label || ':' || CASE WHEN score < 0.9 THEN '0' WHEN score < 0.99 THEN '1' ELSE '2' END AS key, count(*) AS n, count(*) FILTER (WHERE label = gold) AS correct
FROM d WHERE label = 'same' AND score BETWEEN 0 AND 1 GROUP BY 1"""))
def b15_rank_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of label and score bin of the accepted edges, with their counts."""
    rows = decision_rows(spark, sf).where((F.col("label") == POSITIVE) & F.col("score").between(0, 1))
    key = F.concat("label", F.lit(":"), F.when(F.col("score") < 0.9, "0").when(F.col("score") < 0.99, "1").otherwise("2"))
    return rows.groupBy(key.alias("key")).agg(n().alias("n"), count(correct()).alias("correct"))


@query("""
SELECT result_id AS id, sha256('{"dependencies":{"pair":' || len(pair) || '},"model":"' || backend_name || '","policy":"p1","question":"' || decision_primitive || '","schema":"' || backend_version || '","state":"' || example_id || '"}') AS key
FROM evaluation_results WHERE pair IS NOT NULL AND backend_name IS NOT NULL AND decision_primitive IS NOT NULL AND backend_version IS NOT NULL AND example_id IS NOT NULL""")
def b17_semantic_key(spark: SparkSession, sf: str) -> DataFrame:
    """Cache keys that bind state, question, model, schema and policy versions and dependency generations; what lacks one has no key."""
    parts = ["pair", "backend_name", "decision_primitive", "backend_version", "example_id"]
    rows = table(spark, sf, "evaluation_results").dropna(subset=parts[1:]).where("pair is not null")
    text = F.concat(F.lit('{"dependencies":{"pair":'), F.size("pair"), F.lit('},"model":"'), "backend_name", F.lit('","policy":"p1","question":"'), "decision_primitive", F.lit('","schema":"'), "backend_version", F.lit('","state":"'), "example_id", F.lit('"}'))
    return rows.select(F.col("result_id").alias("id"), F.sha2(text, 256).alias("key"))


@query(sql("""
, g AS (SELECT grp, count(*) AS n FROM d WHERE label = 'same' GROUP BY grp), m AS (SELECT mu, rho, mu * (1 / rho - 1) AS a, (1 - mu) * (1 / rho - 1) AS b FROM (VALUES (0.05::DOUBLE, 0.1::DOUBLE), (0.2::DOUBLE, 0.4::DOUBLE)) AS v(mu, rho))
SELECT n, mu, rho, count(*) AS groups, round(any_value(1 - exp(lgamma(b + n) - lgamma(a + b + n) + lgamma(a + b) - lgamma(b))), 6) AS risk, round(any_value(1 - exp(n * ln(1 - mu))), 6) AS independent FROM g, m GROUP BY n, mu, rho"""))
def b21_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Beta-binomial risk that a group of n accepted edges holds a wrong one, at mean mu and correlation rho; and if independent.

    The zero class is the product over i < n of (b + i) / (a + b + i), which needs no gamma function.
    """
    g = decision_rows(spark, sf).where(F.col("label") == POSITIVE).groupBy("grp").agg(n().alias("n")).groupBy("n").agg(n().alias("groups"))
    grid = spark.createDataFrame([(0.05, 0.1), (0.2, 0.4)], "mu double, rho double")
    x = g.join(F.broadcast(grid))  # two rows
    a, b = F.col("mu") * (1 / F.col("rho") - 1), (1 - F.col("mu")) * (1 / F.col("rho") - 1)
    x = x.withColumns({"a": a, "b": b})
    log_zero = F.expr("aggregate(sequence(0, cast(n as int) - 1), 0.0D, (s, i) -> s + ln((b + i) / (a + b + i)))")
    return x.select("n", "mu", "rho", "groups", F.round(1 - F.exp(log_zero), 6).alias("risk"), F.round(1 - F.exp(F.col("n") * F.log(1 - F.col("mu"))), 6).alias("independent"))


@query("""
WITH c AS (SELECT DISTINCT o.o_custkey AS k, l.l_suppkey AS s, CAST((l.l_suppkey % 90 + 5) / 100.0 AS DOUBLE) AS p FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey)
SELECT k, count(*) AS required, round(least(1.0, sum(1 - p)), 6) AS "union", round(1 - exp(sum(ln(p))), 6) AS product, round(1 - min_by(p, s), 6) AS single FROM c GROUP BY k""")
def b22_dependency_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk that any distinct prerequisite fails: union bound, product if independent, and of the primary (smallest) one alone."""
    c = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), "l_suppkey").distinct()
    c = c.withColumn("p", F.expr("(l_suppkey % 90 + 5) / 100.0").cast("double"))
    return c.groupBy("k").agg(n().alias("required"), F.round(F.least(F.lit(1.0), F.sum(1 - F.col("p"))), 6).alias("union"), F.round(1 - F.exp(F.sum(F.log("p"))), 6).alias("product"), F.round(1 - F.min_by("p", "l_suppkey"), 6).alias("single"))


@query("""
WITH a AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, regexp_extract(props, '[0-9]+') AS object, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS polarity,
  CASE WHEN event_id % 3 = 0 THEN 'x' ELSE 'y' END AS scope, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s, CAST(floor(epoch(ts) / 3600) AS BIGINT) + event_id % 12 AS e FROM events),
b AS (SELECT *, object <> '' AND polarity <> 0 AND s < e AS good, lead(id) OVER w AS next FROM a WINDOW w AS (PARTITION BY subject ORDER BY id))
SELECT CASE WHEN NOT x.good OR NOT y.good THEN 'unknown' WHEN x.scope <> y.scope OR x.predicate <> y.predicate THEN 'clear'
  WHEN NOT ((x.object = y.object AND x.polarity <> y.polarity) OR (x.predicate = 'view' AND x.object <> y.object AND x.polarity = 1 AND y.polarity = 1)) THEN 'clear'
  WHEN greatest(x.s, y.s) < least(x.e, y.e) THEN 'conflict' ELSE 'clear' END AS verdict, count(*) AS n FROM b x JOIN b y ON x.next = y.id GROUP BY 1""")
def b23_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Three-way verdict on neighbouring assertions of a subject: an unsupported one makes it unknown, never clear."""
    start = F.floor(F.unix_timestamp("ts") / 3600).cast("bigint")
    a = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.regexp_extract("props", "[0-9]+", 0).alias("object"),
        F.when(F.col("event_id") % 11 == 0, 0).when(F.col("event_id") % 7 == 0, -1).otherwise(1).alias("polarity"), F.when(F.col("event_id") % 3 == 0, "x").otherwise("y").alias("scope"),
        start.alias("s"), (start + F.col("event_id") % 12).alias("e"))
    from ..operators.ordering import ranked

    placed = ranked(a, ["subject"], "id", name="k")
    second = placed.select("subject", (F.col("k") - 1).alias("k"), *[F.col(c).alias(f"{c}2") for c in a.columns if c != "subject"])
    return placed.join(second, ["subject", "k"]).groupBy(conflict_verdict("view").alias("verdict")).agg(n().alias("n"))


def conflict_verdict(functional: str) -> Column:
    """unknown, clear or conflict of two assertions (columns, and the same with a 2) of one subject; `functional` names a predicate
    that has one object at a time."""
    c = F.col
    good = lambda t: (c(f"object{t}") != "") & c(f"polarity{t}").isin(-1, 1) & (c(f"s{t}") < c(f"e{t}"))
    same = (c("object") == c("object2")) & (c("polarity") != c("polarity2"))
    other = (c("predicate") == functional) & (c("object") != c("object2")) & (c("polarity") == 1) & (c("polarity2") == 1)
    met = (c("scope") == c("scope2")) & (c("predicate") == c("predicate2")) & (same | other) & (F.greatest("s", "s2") < F.least("e", "e2"))
    return F.when(~(good("") & good("2")), "unknown").when(met, "conflict").otherwise("clear")


@query(sql("""
, s AS (SELECT item, arm, max(tokens_in) AS t, bool_or(tokens_in IS NULL) AS unknown FROM d GROUP BY ALL)
SELECT item, CASE WHEN bool_or(unknown) THEN NULL ELSE CAST(sum(t) AS BIGINT) END AS charged, count(*) AS sites FROM s GROUP BY item"""))
def b24_charged(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens charged to an example: each distinct site once; null where the usage of any is unknown."""
    s = decision_rows(spark, sf).groupBy("item", "arm").agg(F.max("tokens_in").alias("t"), F.bool_or(F.col("tokens_in").isNull()).alias("unknown"))
    return s.groupBy("item").agg(F.when(~F.bool_or("unknown"), F.sum("t")).alias("charged"), n().alias("sites"))


# Forms of credentials, by name.
SECRETS = {"bearer": r"[Bb]earer [A-Za-z0-9._-]{16,}", "key": r"sk-[A-Za-z0-9]{16,}", "assignment": r"(?:password|secret|token)\s*[=:]\s*\S{6,}"}


@query("SELECT pattern, count(*) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS pattern FROM documents WHERE regexp_matches(text, '{v}')" for k, v in SECRETS.items()) + ") GROUP BY pattern")
def b26_credentials(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with what looks like a credential, by the pattern's name; what matches is never shown."""
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(v), F.lit(k)) for k, v in SECRETS.items()]))
    return table(spark, sf, "documents").select(F.explode(hit).alias("pattern")).groupBy("pattern").agg(n().alias("documents"))


def redacted(text: Column) -> Column:
    """Text with all credentials replaced."""
    for pattern in SECRETS.values():
        text = F.regexp_replace(text, pattern, "[redacted]")
    return text


@query(sql("""
, m AS (SELECT arm, split, CAST(count(*) AS DOUBLE) AS n, avg(score) AS s FROM d GROUP BY ALL), x AS (SELECT arm, split, n, s + CASE WHEN split = 'evaluation' THEN 1e-3 ELSE 1e-12 END AS t, s FROM m)
SELECT arm, split, abs(t - s) <= greatest(1e-9 * greatest(abs(t), abs(s)), 1e-9) AS equal FROM x"""))
def b28_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports compared cell by cell: a difference within the tolerance is none, a missing cell is one."""
    m = decision_rows(spark, sf).groupBy("arm", "split").agg(F.avg("score").alias("s"))
    other = m.select(F.col("arm").alias("arm2"), F.col("split").alias("split2"), (F.col("s") + F.when(F.col("split") == "evaluation", 1e-3).otherwise(1e-12)).alias("t"))
    both = m.join(other, (F.col("arm") == F.col("arm2")) & (F.col("split") == F.col("split2")), "full_outer")
    return both.select(F.coalesce("arm", "arm2").alias("arm"), F.coalesce("split", "split2").alias("split"), F.coalesce(prob.close(F.col("s"), F.col("t")), F.lit(False)).alias("equal"))


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    """Canonical JSON of JSON texts: sorted keys, no blanks; null for what is no strict JSON."""

    def one(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


@query("""SELECT event_id, sha256(replace(props, ' ', '')) AS digest FROM events WHERE json_valid(props)""")
def b1_canonical_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the canonical JSON of each event's properties (these have one key, so SQL needs to drop the blanks only)."""
    return table(spark, sf, "events").select("event_id", F.sha2(_canonical("props"), 256).alias("digest")).where("digest is not null")


@query(sql("""
SELECT arm, CASE WHEN error THEN 'ERROR' WHEN c.top >= 0.9 THEN 'ABSTAIN' ELSE label END AS vetoed, count(*) AS n
FROM d JOIN (SELECT result_id, list_max(list_transform(map_values(distribution), lambda x: abs(x - 0.5) * 2)) AS top FROM evaluation_results) c ON d.id = c.result_id WHERE d.dist IS NOT NULL GROUP BY ALL"""))
def c3_qualifier_veto(spark: SparkSession, sf: str) -> DataFrame:
    """A check of 0.9 or more turns an answer into an abstention (here: how far each class is from undecided); failed calls stay errors."""
    rows = decision_rows(spark, sf).where("dist is not null")
    veto = F.exists(F.map_values("dist"), lambda p: F.abs(p - 0.5) * 2 >= 0.9)
    return rows.groupBy("arm", F.when(F.col("error"), "ERROR").when(veto, "ABSTAIN").otherwise(F.col("label")).alias("vetoed")).agg(n().alias("n"))


FORBIDDEN = ("gold", "split", "grp")


def stripped(rows: DataFrame) -> DataFrame:
    """Rows without what a policy must not see; fails if a column of that name is left in a struct."""
    out = rows.drop(*FORBIDDEN)
    inner = [f"{f.name}.{g.name}" for f in out.schema if isinstance(f.dataType, T.StructType) for g in f.dataType if g.name in FORBIDDEN]
    if inner:
        raise ValueError(f"columns a policy must not see: {inner}")
    return out


@query(sql("""SELECT id, item, arm, label, round(score, 6) AS score FROM d"""))
def c4_features(spark: SparkSession, sf: str) -> DataFrame:
    """Policy inputs without gold, split or group."""
    return stripped(decision_rows(spark, sf)).select("id", "item", "arm", "label", F.round("score", 6).alias("score"))


@query(sql("""
SELECT arm, CASE WHEN execution_mode IS NULL OR execution_mode NOT IN ('replay', 'live') THEN 'mode' WHEN dist IS NULL THEN 'distribution' WHEN label NOT IN ('same', 'different') THEN 'label'
  WHEN dist[label] < greatest(dist['same'], dist['different']) THEN 'not maximal' WHEN dist[label] < CASE WHEN label = 'same' THEN 0.8 ELSE 0.6 END THEN 'threshold' ELSE 'commit' END AS state, count(*) AS n FROM d GROUP BY ALL"""))
def c13_commit_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Why a decision may not be committed, in this order: execution mode, distribution, label, not the most probable label, below
    its label's threshold."""
    rows = decision_rows(spark, sf)
    own = F.try_element_at("dist", F.col("label"))
    state = (
        F.when(F.col("execution_mode").isNull() | ~F.col("execution_mode").isin("replay", "live"), "mode")
        .when(F.col("dist").isNull(), "distribution")
        .when(~F.col("label").isin(LABELS), "label")
        .when(own < F.greatest(F.col("dist")["same"], F.col("dist")["different"]), "not maximal")
        .when(own < F.when(F.col("label") == POSITIVE, 0.8).otherwise(0.6), "threshold")
        .otherwise("commit")
    )
    return rows.groupBy("arm", state.alias("state")).agg(n().alias("n"))
