"""Probability of monotone lineage: an OR of proofs, each an AND of atoms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .graph import components

MAX_STATES = 65_536


def canonical(proofs: Column) -> Column:
    """Proofs as sorted sets without duplicates and without supersets of another proof; an empty proof absorbs all (TRUE)."""
    sets = F.array_distinct(F.transform(proofs, lambda p: F.array_sort(F.array_distinct(p))))
    minimal = lambda p: ~F.exists(sets, lambda q: (q != p) & (F.size(F.array_except(q, p)) == 0))
    return F.array_sort(F.filter(sets, minimal))


def bounds(formulas: DataFrame, atoms: DataFrame) -> DataFrame:
    """formula_id, lower, upper: Frechet bounds, whatever the dependence of atoms.

    A proof of n atoms lies within [max(0, sum p - n + 1), min p], the OR within [max lower, min(1, sum of uppers)]. A
    formula without proofs is 0; a proof without atoms is 1; an atom without a probability makes its proofs unknown ([0, 1]).
    """
    p = formulas.select("formula_id", F.posexplode_outer("proofs").alias("proof", "atoms"))
    flat = p.select("formula_id", "proof", F.explode_outer("atoms").alias("atom"), (F.size("atoms") == 0).alias("empty"))
    q = flat.join(atoms.select("formula_id", "atom", "p"), ["formula_id", "atom"], "left")
    known = F.when(F.col("atom").isNull(), F.lit(1.0)).otherwise(F.col("p"))
    each = q.groupBy("formula_id", "proof").agg(F.count(F.lit(1)).alias("n"), F.count(known).alias("k"), F.sum(known).alias("s"), F.min(known).alias("m"))
    each = each.select("formula_id", "proof", F.when(F.col("proof").isNull(), 0.0).when(F.col("k") < F.col("n"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("s") - F.col("n") + 1)).alias("lo"), F.when(F.col("proof").isNull(), 0.0).when(F.col("k") < F.col("n"), 1.0).otherwise(F.col("m")).alias("up"))
    return each.groupBy("formula_id").agg(F.round(F.max("lo"), 9).alias("lower"), F.round(F.least(F.lit(1.0), F.sum("up")), 9).alias("upper"))


def parts(formulas: DataFrame) -> DataFrame:
    """formula_id, part, proofs: the groups of proofs that share atoms, directly or through others. Parts of a formula have no atom in
    common, so they are independent. Formulas without proofs, or with an empty proof (TRUE), have no row."""
    f = formulas.select("formula_id", canonical(F.col("proofs")).alias("proofs")).where(~F.exists("proofs", lambda p: F.size(p) == 0))
    p = staged(f.select("formula_id", F.posexplode("proofs").alias("no", "atoms")), "proofs")
    name = lambda a: F.concat(F.col("formula_id").cast("string"), F.lit("|"), a)
    links = p.select(name(F.col("atoms")[0]).alias("a"), F.explode("atoms").alias("x"), "formula_id").select("a", name(F.col("x")).alias("b"))
    roots = components(links, "a", "b")
    placed = p.withColumn("node", name(F.col("atoms")[0])).join(roots, "node")
    return placed.groupBy("formula_id", F.col("root").alias("part")).agg(F.collect_list("atoms").alias("proofs"))


def proof_bounds(formulas: DataFrame, atoms: DataFrame) -> DataFrame:
    """formula_id, parts, lower, upper of the probability with independent atoms: within a part the proofs may depend on each other in
    any way, parts are independent. A proof's probability is the product of its atoms'."""
    p = parts(formulas).select("formula_id", "part", F.posexplode("proofs").alias("no", "atoms"))
    flat = p.select("formula_id", "part", "no", F.explode("atoms").alias("atom")).join(atoms, ["formula_id", "atom"])
    proofs = flat.groupBy("formula_id", "part", "no").agg(F.exp(F.sum(F.log("p"))).alias("q"))
    each = proofs.groupBy("formula_id", "part").agg(F.max("q").alias("lo"), F.least(F.lit(1.0), F.sum("q")).alias("up"))
    none = lambda c: 1 - F.when(F.max(c) >= 1, 0.0).otherwise(F.exp(F.sum(F.log1p(-F.when(F.col(c) < 1, F.col(c)).otherwise(0.0)))))
    return each.groupBy("formula_id").agg(F.count(F.lit(1)).alias("parts"), F.round(none("lo"), 9).alias("lower"), F.round(none("up"), 9).alias("upper"))


def worlds(formulas: DataFrame, atoms: DataFrame, max_atoms: int = 16) -> DataFrame:
    """formula_id, p, state: the probability with independent atoms by summing all worlds, part by part. A part of more than
    `max_atoms` atoms goes to `exact`; where that gives bounds only, p is null and the state says so. Formulas without proofs
    are 0, with an empty proof 1."""
    split = staged(parts(formulas).withColumn("id", F.concat(F.col("formula_id").cast("string"), F.lit("|"), "part")), "parts")
    flat = split.select("id", "formula_id", F.explode(F.array_distinct(F.flatten("proofs"))).alias("atom"))
    own = staged(flat.join(atoms, ["formula_id", "atom"]).select(F.col("id").alias("formula_id"), "atom", "p"), "atoms")
    small = own.groupBy("formula_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_atoms).select("formula_id")
    named = split.select(F.col("id").alias("formula_id"), "proofs")
    done = _summed(named.join(small, "formula_id"), own.join(small, "formula_id")).select("formula_id", "p", F.lit("exact").alias("state"))
    rest = exact(named.join(small, "formula_id", "left_anti"), own.join(small, "formula_id", "left_anti"))
    rest = rest.select("formula_id", F.when(F.col("state") == "exact", F.col("lower")).alias("p"), "state")
    each = done.unionByName(rest).join(split.select(F.col("id").alias("part_id"), F.col("formula_id").alias("f")), F.col("formula_id") == F.col("part_id"))
    none = F.when(F.max("p") >= 1, 0.0).otherwise(F.exp(F.sum(F.log1p(-F.when(F.col("p") < 1, F.col("p")).otherwise(0.0)))))
    whole = each.groupBy(F.col("f").alias("formula_id")).agg(F.when(F.count("p") == F.count(F.lit(1)), F.round(1 - none, 12)).alias("p"), F.max("state").alias("state"))
    fixed = formulas.select("formula_id", F.exists("proofs", lambda p: F.size(p) == 0).alias("_true"), (F.size("proofs") == 0).alias("_false")).where("_true or _false")
    return whole.unionByName(fixed.select("formula_id", F.when(F.col("_true"), 1.0).otherwise(0.0).alias("p"), F.lit("exact").alias("state")))


def _summed(formulas: DataFrame, atoms: DataFrame) -> DataFrame:
    numbered = atoms.groupBy("formula_id").agg(F.array_sort(F.collect_list(F.struct("atom", "p"))).alias("a"))
    f = formulas.join(numbered, "formula_id").select("formula_id", "proofs", "a")
    names = F.transform("a", lambda x: x["atom"])
    f = f.withColumn("masks", F.transform("proofs", lambda p: F.aggregate(F.array_distinct(p), F.lit(0).cast("bigint"), lambda m, x: m + F.pow(F.lit(2.0), F.array_position(names, x) - 1).cast("bigint"))))
    w = f.select("formula_id", "masks", "a", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.pow(F.lit(2.0), F.size("a")) - 1).cast("bigint"))).alias("w"))
    true = F.exists("masks", lambda m: F.col("w").bitwiseAND(m) == m)
    weight = F.expr("aggregate(transform(a, (x, i) -> CASE WHEN (w div CAST(power(2, i) AS BIGINT)) % 2 = 1 THEN x.p ELSE 1 - x.p END), 1.0D, (s, x) -> s * x)")
    return w.groupBy("formula_id").agg(F.sum(F.when(true, weight).otherwise(0.0)).alias("p"))


def shannon(proofs: list[list[str]], p: dict[str, float], max_states: int = MAX_STATES) -> tuple[float, float, str]:
    """(lower, upper, state) of one formula with independent atoms: exact by memoized expansion.

    Parts without common atoms are expanded apart; the most frequent atom is decided first, ties by name. Beyond `max_states`
    the formula is staged with the bounds that hold whatever the dependence; with an atom of no valid probability, with [0, 1].
    """
    sets = {frozenset(x) for x in proofs}
    atoms = set().union(*sets) if sets else set()
    if any(a not in p or not 0 <= p[a] <= 1 for a in atoms):
        return 0.0, 1.0, "staged: probability"
    memo: dict[frozenset, float] = {}

    def minimal(s: set[frozenset]) -> frozenset:
        return frozenset(x for x in s if not any(y < x for y in s))

    def value(s: frozenset) -> float:
        if not s:
            return 0.0
        if frozenset() in s:
            return 1.0
        if s in memo:
            return memo[s]
        if len(memo) > max_states:
            raise OverflowError
        parts: list[tuple[set, set]] = []
        for x in s:
            own, names = {x}, set(x)
            rest = []
            for q, m in parts:
                if m & names:
                    own |= q
                    names |= m
                else:
                    rest.append((q, m))
            parts = [*rest, (own, names)]
        if len(parts) > 1:
            out = 1.0
            for q, _ in parts:
                out *= 1 - value(frozenset(q))
            out = 1 - out
        else:
            count: dict[str, int] = {}
            for x in s:
                for a in x:
                    count[a] = count.get(a, 0) + 1
            a = min(count, key=lambda k: (-count[k], k))
            yes, no = minimal({x - {a} for x in s}), frozenset(x for x in s if a not in x)
            out = p[a] * value(yes) + (1 - p[a]) * value(no)
        memo[s] = out
        return out

    try:
        v = value(minimal(sets))
    except (OverflowError, RecursionError):
        low = max((max(0.0, sum(p[a] for a in x) - len(x) + 1) for x in sets), default=0.0)
        return low, min(1.0, sum(min(p[a] for a in x) for x in sets)), "staged: states"
    return v, v, "exact"


def exact(formulas: DataFrame, atoms: DataFrame) -> DataFrame:
    """formula_id, lower, upper, state by `shannon`, in Arrow batches of formulas with their own atoms."""
    own = atoms.groupBy("formula_id").agg(F.map_from_entries(F.collect_list(F.struct("atom", "p"))).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [shannon([list(x) for x in proofs], dict(p) if p is not None else {}) for proofs, p in zip(batch["proofs"], batch["p"], strict=True)]
            yield pd.DataFrame({"formula_id": batch["formula_id"], "lower": [round(r[0], 12) for r in rows], "upper": [round(r[1], 12) for r in rows], "state": [r[2] for r in rows]})

    kind = formulas.schema["formula_id"].dataType.simpleString()
    return formulas.join(own, "formula_id", "left").select("formula_id", "proofs", "p").mapInPandas(run, f"formula_id {kind}, lower double, upper double, state string")
