"""A versioned, auditable fact store on Parquet directories.

A version is a set of Parquet snapshots; the journal entry that names it is created exclusively and is the commit point, so
that of two writers of one version one fails and readers never see half a version. Orphan snapshots of failed commits are
ignored. Commands carry an idempotency key: the same key and fingerprint returns the former event, another fingerprint fails.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import peeled, reachable, violations

FACTS = "id string, subject string, predicate string, object string, evidence array<string>, depends_on array<string>, label string, score double, active boolean, retracted_because string"
NODES = "id string, type string"
RELATIONS = "predicate string, domain string, range string, allow_self boolean, unique boolean"


class Conflict(Exception):
    """A stale version, or a key that was used for another command."""


class Rejected(Exception):
    """A command that breaks the store's rules; nothing of it is visible."""


def canonical(value: object) -> str:
    """JSON with sorted keys and without blanks; no NaN or infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def frame_digest(df: DataFrame) -> str:
    """Order-free digest of a DataFrame's rows: count and sums of row hashes."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).first()
    return digest([r["n"], r["x"], r["s"]])


class FactStore:
    """Nodes, facts and a relation schema by version. `policy` maps predicates to the least score of a fact; facts of other
    predicates are rejected."""

    def __init__(self, spark: SparkSession, path: str, policy: dict[str, float] | None = None):
        self.spark, self.path, self.policy = spark, path, policy or {}
        os.makedirs(f"{path}/journal", exist_ok=True)

    def journal(self) -> list[dict]:
        """The events in order (one small file each)."""
        names = sorted(x for x in os.listdir(f"{self.path}/journal") if x.endswith(".json"))
        return [json.load(open(f"{self.path}/journal/{x}", encoding="utf-8")) for x in names]

    def version(self) -> int:
        return len(self.journal())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """nodes, facts or relations as of a version; empty before the first."""
        events = self.journal()[: self.version() if version is None else version]
        schema = {"nodes": NODES, "facts": FACTS, "relations": RELATIONS}[name]
        if not events:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{events[-1]['data']}/{name}")

    def _publish(self, op: str, key: str, fingerprint: str, expected: int, frames: dict[str, DataFrame], detail: dict) -> dict:
        events = self.journal()
        for e in events:
            if e["key"] == key:
                if e["fingerprint"] != fingerprint:
                    raise Conflict("the key was used for another command")
                return e
        if expected != len(events):
            raise Conflict(f"expected version {expected}, found {len(events)}")
        data = uuid.uuid4().hex
        for name in ("nodes", "facts", "relations"):
            frames.get(name, self.read(name)).write.parquet(f"{self.path}/data/{data}/{name}")
        errors = self.check(*[self.spark.read.schema(s).parquet(f"{self.path}/data/{data}/{n}") for n, s in (("nodes", NODES), ("facts", FACTS), ("relations", RELATIONS))])
        if errors:
            raise Rejected("; ".join(errors))
        event = {"version": len(events) + 1, "op": op, "key": key, "fingerprint": fingerprint, "data": data, "detail": detail, "previous": events[-1]["hash"] if events else ""}
        event["hash"] = digest(event)
        try:
            with open(f"{self.path}/journal/{event['version']:012d}.json", "x", encoding="utf-8") as file:
                file.write(canonical(event))
        except FileExistsError:
            raise Conflict("another writer published this version") from None
        return event

    @staticmethod
    def check(nodes: DataFrame, facts: DataFrame, relations: DataFrame) -> list[str]:
        """What is wrong with a state: schema violations of active facts, missing prerequisites, cycles."""
        active = facts.where("active")
        bad = [f"{r['rule']}: {r['subject']}" for r in violations(nodes, active.select("id", "subject", "predicate", "object"), relations).limit(20).collect()]
        needs = active.select(F.col("id").alias("node"), F.explode("depends_on").alias("needs"))
        if not needs.join(active.select(F.col("id").alias("needs")), "needs", "left_anti").isEmpty():
            bad.append("prerequisite missing or inactive")
        if not facts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            bad.append("fact id used twice")
        if not needs.isEmpty() and peeled(active.select(F.col("id").alias("node")), needs).count() != active.count():
            bad.append("dependency cycle")
        return bad

    def commit(self, key: str, expected: int, nodes: DataFrame | None = None, facts: DataFrame | None = None, relations: DataFrame | None = None) -> dict:
        """Adds nodes and facts; replaces the schema if given. Facts below their predicate's threshold reject the command."""
        parts = {"nodes": nodes, "facts": facts, "relations": relations}
        fingerprint = digest({k: frame_digest(v) for k, v in parts.items() if v is not None})
        frames = {}
        if nodes is not None:
            frames["nodes"] = self.read("nodes").unionByName(nodes).distinct()
        if facts is not None:
            gate = self.spark.createDataFrame([(k, v) for k, v in self.policy.items()], "predicate string, least double")
            weak = facts.join(F.broadcast(gate), "predicate", "left").where("least is null or score is null or score < least or size(evidence) = 0")
            if not weak.isEmpty():
                raise Rejected("a fact is below its threshold, without evidence, or of an unknown predicate")
            frames["facts"] = self.read("facts").unionByName(facts)
        if relations is not None:
            frames["relations"] = relations
        return self._publish("commit", key, fingerprint, expected, frames, {})

    def retract(self, key: str, expected: int, evidence: list[str], reason: str, reviewer: str) -> dict:
        """Withdraws evidence: facts that cite it, and all that depend on them, turn inactive; nothing is deleted."""
        if not reason or not reviewer:
            raise Rejected("a retraction needs a reason and a reviewer")
        facts = self.read("facts")
        active = facts.where("active")
        hit = active.where(F.arrays_overlap("evidence", F.array(*[F.lit(e) for e in evidence]))).select(F.col("id").alias("node"))
        gone = reachable(hit, active.select(F.explode("depends_on").alias("s"), F.col("id").alias("t")), "node", "s", "t").select(F.col("node").alias("id"), F.lit(True).alias("gone"))
        out = facts.join(gone, "id", "left").select("id", "subject", "predicate", "object", "evidence", "depends_on", "label", "score", (F.col("active") & F.col("gone").isNull()).alias("active"), F.when(F.col("gone"), reason).otherwise(F.col("retracted_because")).alias("retracted_because"))
        return self._publish("retract", key, digest([sorted(evidence), reason, reviewer]), expected, {"facts": out}, {"reason": reason, "reviewer": reviewer})

    def migrate(self, key: str, expected: int, relations: DataFrame) -> dict:
        """Replaces the relation schema; the whole state must satisfy the new one."""
        return self._publish("migrate", key, frame_digest(relations), expected, {"relations": relations}, {})

    def audit(self) -> list[str]:
        """Breaks of the journal's hash chain: versions in a row, links to the former hash, hashes as recomputed."""
        bad, previous = [], ""
        for i, e in enumerate(self.journal(), 1):
            if e["version"] != i:
                bad.append(f"version {i}: number")
            if e["previous"] != previous:
                bad.append(f"version {i}: link")
            if digest({k: v for k, v in e.items() if k != "hash"}) != e["hash"]:
                bad.append(f"version {i}: hash")
            previous = e["hash"]
        return bad

    def view(self) -> DataFrame:
        """Active facts by subject, predicate and object, with their sorted ids."""
        return self.read("facts").where("active").groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set("id")).alias("assertions"))
