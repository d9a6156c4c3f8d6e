"""Queries of the text and record operators over the tables of a directory; each reads its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, staged, table
from . import bpe, bundles, forms, grouping, linkage, names, overlap, packing, pieces, spans

#: The file of the vocabulary byte_bpe_50k.
VOCABULARY = os.environ.get("BYTE_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


# 1 same or near-same records across splits


def _split_records(spark: SparkSession, sf: str) -> DataFrame:
    """Claims, evidence and both records of a pair as texts of three kinds, with the side of the split."""
    rel = table(spark, sf, "relation_examples").where("split in ('train', 'calibration', 'evaluation')")
    idp = table(spark, sf, "identity_pairs").where("split in ('train', 'calibration', 'evaluation')")
    train = F.col("split") == "train"
    claims = rel.select(F.lit(1).alias("kind"), "id", train.alias("train"), F.col("claim").alias("text"))
    evidence = rel.select(F.lit(2).alias("kind"), "id", train.alias("train"), F.concat_ws("\n", "evidence").alias("text"))
    pairs = idp.select(F.lit(3).alias("kind"), "id", train.alias("train"), F.explode(F.array(F.map_values("record_1"), F.map_values("record_2"))).alias("values"))
    return claims.unionByName(evidence).unionByName(pairs.select("kind", "id", "train", F.concat_ws("\n", "values").alias("text")))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """table_key, id (held out), train_id, containment: each pair of rows once, with its greatest containment."""
    matches, members = overlap.near_same(_split_records(spark, sf))
    held = members.where("not train").select(F.col("a").alias("ea"), F.col("b").alias("eb"), "kind", "id").distinct()
    train = members.where("train").select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("id").alias("train_id")).distinct()
    rows = matches.join(held, ["ea", "eb"]).join(train, ["ta", "tb"]).where("id <> train_id")
    key = F.when(F.col("kind") == 3, "identity_pairs").otherwise("relation_examples").alias("table_key")
    return rows.groupBy(key, "id", "train_id").agg(F.round(F.max("containment"), 6).alias("containment"))


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows of one table, one in train and the other not, with the same or near-same claim, evidence or record."""
    return _overlaps(spark, sf).select(F.least("id", "train_id").alias("id_1"), F.greatest("id", "train_id").alias("id_2"))


@query
def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows that also stand in train, and their pairs, by table, split and source."""
    where = None
    for name in ("relation_examples", "identity_pairs"):
        own = table(spark, sf, name).select(F.lit(name).alias("table_key"), "id", "split", "source_code").dropDuplicates(["id"])
        where = own if where is None else where.unionByName(own)
    rows = _overlaps(spark, sf).join(where, ["table_key", "id"])
    return rows.groupBy("table_key", "split", "source_code").agg(F.countDistinct("id").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("containment"), 6).alias("mean_containment"))


# 2 visually identical text


def _looked_at(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "er_examples").select(F.lit("er_examples").alias("table_key"), F.col("example_id").alias("row_key"), F.col("mention_1").alias("text_1"), F.col("mention_2").alias("text_2"))
    titles = table(spark, sf, "identity_pairs").select(F.lit("identity_pairs").alias("table_key"), F.col("id").alias("row_key"), F.col("record_1")["title"].alias("text_1"), F.col("record_2")["title"].alias("text_2"))
    return names.unionByName(titles).withColumns({"form_1": forms.visual_form("text_1"), "form_2": forms.visual_form("text_2")})


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose two texts differ as strings but look the same; a null text looks like nothing."""
    rows = _looked_at(spark, sf).where((F.col("form_1") == F.col("form_2")) & (F.col("text_1") != F.col("text_2")))
    return rows.select("table_key", "row_key").distinct()


@query
def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every name and title with its one visual form; repeated deliveries once."""
    rows = _looked_at(spark, sf)
    return rows.select("table_key", "row_key", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"text_{i}").alias("text"), F.col(f"form_{i}").alias("form")) for i in (1, 2)])).alias("x")).select("table_key", "row_key", "x.*").distinct()


# 3 splitting oversized items


def _long_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "relation_examples").select("id", F.posexplode("evidence").alias("item_pos", "item"))
    return rows.where(F.length("item") > pieces.LIMIT)


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items of evidence that come out in more than one piece."""
    return pieces.pieces(_long_items(spark, sf), "item").where("piece_no = 1").select("id", "item_pos").distinct()


SQL["p3_found"] = """
SELECT DISTINCT id, CAST(i - 1 AS INTEGER) AS item_pos
FROM (SELECT id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM relation_examples) WHERE length(evidence[i]) > 1200
"""


@query
def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every item above 1,200 characters; repeated deliveries once."""
    return pieces.pieces(_long_items(spark, sf).dropDuplicates(["id", "item_pos"]), "item")


@query
def p3_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every long item rebuilt from its pieces: number of characters and digest; and its longest piece, which is within the limit."""
    cut = p3_pieces(spark, sf).select("id", "item_pos", "piece_no", F.length("piece").alias("n"), F.expr("substring(piece, overlap + 1)").alias("own"))
    rows = cut.groupBy("id", "item_pos").agg(F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("x"), F.max("n").alias("longest"))
    item = F.array_join(F.transform("x", lambda p: p["own"]), "")
    return rows.select("id", "item_pos", F.length(item).cast("bigint").alias("n_chars"), F.sha2(item, 256).alias("digest"), (F.col("longest") <= pieces.LIMIT).alias("within"))


SQL["p3_rebuilt"] = """
SELECT DISTINCT id, CAST(i - 1 AS INTEGER) AS item_pos, length(evidence[i]) AS n_chars, sha256(evidence[i]) AS digest, true AS within
FROM (SELECT id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM relation_examples) WHERE length(evidence[i]) > 1200
"""


# 4 matching entities across sources without keys


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records of the two catalogues that describe one work."""
    return p4_links(spark, sf).select("left_id", "right_id")


@query
def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    """The matched pairs with their confidence."""
    return linkage.link(table(spark, sf, "catalog_left"), "left_id", "record_1", table(spark, sf, "catalog_right"), "right_id", "record_2")


# 5 splits that keep related records together


def _linked_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The ids of both tables, and their linking keys; a key links within its own table and kind only."""
    rel = table(spark, sf, "relation_examples").select("id", "group_id", "document_id")
    idp = table(spark, sf, "identity_pairs").select("id", "identity_groups")
    keyed = rel.select("id", F.explode(F.array(*[F.concat(F.lit(kind), bundles.linking_id(c)) for kind, c in (("g:", "group_id"), ("d:", "document_id"))])).alias("key"))
    paired = idp.select("id", F.explode("identity_groups").alias("key")).select("id", F.concat(F.lit("i:"), bundles.linking_id("key")).alias("key"))
    ids = rel.select("id", F.lit("relation_examples").alias("table_key")).unionByName(idp.select("id", F.lit("identity_pairs").alias("table_key")))
    return ids, keyed.unionByName(paired)


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each id that is bundled with another, with the smallest id of its bundle."""
    ids, keys = _linked_records(spark, sf)
    return bundles.bundles(ids, "id", keys, "id", "key").where("bundle_size > 1").select(F.col("record").alias("id"), "bundle_id")


@query
def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The target split of every id of both tables."""
    ids, keys = _linked_records(spark, sf)
    plan = table(spark, sf, "split_plan").where("split_target is not null and target_fraction is not null")
    fractions = {r["split_target"]: r["target_fraction"] for r in plan.collect()}  # a fixed table of three rows
    return bundles.assigned(bundles.bundles(ids, "id", keys, "id", "key"), fractions).select(F.col("record").alias("id"), "bundle_id", "split_target")


@query
def p5_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each target split, and bundles that stand in more than one (there are none). Single rows fill what the bundles leave, so
    the totals are the plan's to the row."""
    rows = p5_splits(spark, sf)
    divided = rows.groupBy("bundle_id").agg(F.count_distinct("split_target").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("divided"))
    return rows.groupBy("split_target").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(divided))  # one row


SQL["p5_totals"] = """
WITH t AS (SELECT count(*) AS t FROM (SELECT id FROM relation_examples WHERE id IS NOT NULL UNION SELECT id FROM identity_pairs WHERE id IS NOT NULL)),
p AS (SELECT split_target, round_even(t * target_fraction / sum(target_fraction) OVER (), 0) AS n, t, row_number() OVER (ORDER BY target_fraction DESC, split_target DESC) AS k FROM split_plan, t)
SELECT split_target, CAST(CASE WHEN k = 1 THEN t - (SELECT sum(n) FROM p WHERE k > 1) ELSE n END AS BIGINT) AS n, 0::BIGINT AS divided FROM p
"""


# 6 variant spellings of names


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    sides = [F.struct(F.concat(F.col("example_id"), F.lit(f"#{i}")).alias("mention_key"), F.col(f"mention_{i}").alias("mention")) for i in (1, 2)]
    return table(spark, sf, "er_examples").select(F.explode(F.array(*sides)).alias("x")).select("x.*")


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair of mention keys, smaller first, that name one entity."""
    groups = staged(names.linked(_mentions(spark, sf), "mention_key", "mention"), "linked")
    left, right = groups.withColumnRenamed("mention_key", "mention_key_1"), groups.withColumnRenamed("mention_key", "mention_key_2")
    return left.join(right, "group_id").where("mention_key_1 < mention_key_2").select("mention_key_1", "mention_key_2")


@query
def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every non-blank mention."""
    return names.linked(_mentions(spark, sf), "mention_key", "mention")


# 7 consolidating pairwise matches


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity linked with another, and the smallest entity of its group."""
    verdicts = table(spark, sf, "evaluation_results").where(F.col("raw_error").isNull() & (F.lower(F.trim("predicted_label")) == "same") & (F.size("pair") == 2))
    judged = verdicts.select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"))
    rows = table(spark, sf, "identity_pairs").select("identity_groups", "entity_1", "entity_2")
    sides = rows.select(F.explode(F.array(*[F.struct(F.get("identity_groups", F.lit(i)).alias("k"), F.col(f"entity_{i + 1}").alias("e")) for i in (0, 1)])).alias("x")).select("x.*")
    sides = sides.where("trim(k) <> '' and trim(e) <> ''").distinct()
    least = sides.groupBy("k").agg(F.min("e").alias("a"))
    links = judged.where("trim(a) <> '' and trim(b) <> ''").unionByName(sides.join(least, "k").select("a", F.col("e").alias("b")))
    return grouping.boruvka(links, "a", "b").select(F.col("node").alias("entity_id"), F.col("root").alias("group_entity"))


SQL["p7_found"] = """
WITH RECURSIVE sides AS (
  SELECT DISTINCT k, e FROM (SELECT identity_groups[1] AS k, entity_1 AS e FROM identity_pairs
                             UNION ALL SELECT identity_groups[2], entity_2 FROM identity_pairs) WHERE trim(k) <> '' AND trim(e) <> ''),
judged AS (
  SELECT pair[1] AS a, pair[2] AS b FROM evaluation_results
  WHERE raw_error IS NULL AND lower(trim(predicted_label)) = 'same' AND len(pair) = 2 AND trim(pair[1]) <> '' AND trim(pair[2]) <> ''),
links AS (SELECT a, b FROM judged WHERE a <> b UNION SELECT (min(e) OVER (PARTITION BY k)), e FROM sides),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT r.node, l.b FROM reach r JOIN edges l ON r.other = l.a)
SELECT node AS entity_id, least(node, min(other)) AS group_entity FROM reach GROUP BY node
"""


# 8 encoding with a public tokenizer


@query
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the token ids of its text; [] for empty and null texts."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", bpe.token_ids(spark, "text", VOCABULARY).alias("ids"))


# 9 filling fixed-capacity containers


@query
def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's pieces with their container of 2,048 tokens."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return packing.packed(docs.select("doc_id", bpe.token_count(spark, "text", VOCABULARY).alias("n_tokens")), "doc_id", "n_tokens")


@query
def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, the least number that any packing needs, and the unused share."""
    used = p9_containers(spark, sf).groupBy("container_id").agg(F.sum("piece_size").alias("filled"))
    out = used.agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"))
    return out.select("containers", F.ceil(F.col("tokens") / packing.CAPACITY).alias("least"), "tokens", "fullest", F.round(1 - F.col("tokens") / (F.col("containers") * packing.CAPACITY), 6).alias("unused"))


# 10 long exact spans shared between records


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair of documents that have at least 200 consecutive code points in common."""
    return spans.Shared(table(spark, sf, "documents"), "doc_id", "text").pairs("doc_id_1", "doc_id_2")


@query
def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document stands elsewhere."""
    return spans.Shared(table(spark, sf, "documents"), "doc_id", "text").shares("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
