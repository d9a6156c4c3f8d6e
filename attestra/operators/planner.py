"""Corpus planner: nested stages of ranked, group-closed samples with counted work and cost. It never authorizes a run."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import ranked
from .store import digest


def validate(config: dict) -> list[str]:
    """What is wrong with a plan's settings: stages (growing integers), seed, arms, repeats, attempts, unit_cost, budget."""
    bad = [k for k in ("stages", "seed", "arms", "repeats", "attempts", "unit_cost", "budget") if k not in config]
    if bad:
        return [f"missing: {k}" for k in bad]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x > 0
    if not config["stages"] or not all(map(whole, config["stages"])) or config["stages"] != sorted(set(config["stages"])):
        bad.append("stages")
    bad += [k for k in ("arms", "repeats", "attempts") if not whole(config[k])]
    for k in ("unit_cost", "budget"):
        try:
            d = Decimal(str(config[k]))
            if isinstance(config[k], (bool, float)) or not d.is_finite() or d < 0:
                bad.append(k)
        except ArithmeticError:
            bad.append(k)
    return bad


def staged_sample(rows: DataFrame, key: str, group: str, domain: str, stages: list[int], seed: int) -> DataFrame:
    """Rows with the first stage that takes them: each domain's rows rank by digest, a stage takes the ranks up to its share,
    and then the whole groups of what it took. Rows of a null domain or key are never taken."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    held = rows.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).withColumn("_o", order)
    placed = ranked(held, [domain], "_o", key, name="_r").drop("_o")
    domains = placed.agg(F.count_distinct(domain).alias("_d"))
    share = F.expr("CASE " + " ".join(f"WHEN _r <= ceil({s} / _d) THEN {i}" for i, s in enumerate(stages)) + " END")
    taken = placed.join(F.broadcast(domains)).withColumn("_stage", share)  # one row is broadcast
    first = taken.where("_stage is not null").groupBy(group).agg(F.min("_stage").alias("stage"))
    return rows.join(first, group).select(*rows.columns, "stage")


def plan(rows: DataFrame, key: str, group: str, domain: str, config: dict) -> tuple[DataFrame, dict]:
    """(rollup by stage and domain, summary with the plan's hash and blockers). Stages are nested: counts are cumulative."""
    bad = validate(config)
    if bad:
        raise ValueError(", ".join(bad))
    sample = staged_sample(rows, key, group, domain, config["stages"], config["seed"])
    work = config["arms"] * config["repeats"] * config["attempts"]
    stages = sample.select(domain, F.explode(F.sequence("stage", F.lit(len(config["stages"]) - 1))).alias("stage"))
    roll = stages.groupBy("stage", domain).agg(F.count(F.lit(1)).alias("rows")).withColumn("decisions", F.col("rows") * work)
    most = roll.groupBy("stage").agg(F.sum("decisions").alias("d")).agg(F.max("d")).first()[0] or 0
    cost = Decimal(most) * Decimal(str(config["unit_cost"]))
    blockers = [] if cost <= Decimal(str(config["budget"])) else ["budget"]
    return roll, {"cost": str(cost), "blockers": blockers, "authorized": False, "plan": digest({k: str(v) for k, v in sorted(config.items())})}
