"""Ordered operators, matchings, flows and fits against brute force on small fixtures."""

import difflib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import conflicts, fitting, matching, ordering, policies
from attestra.plans import reports, scalars


def test_running_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1.0, 2.0, 2.0, 5.5]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v double, rank string")
    got = {r.i: (r.k, r.s) for r in ordering.running(df, ["g"], [F.desc("v"), "i"], {"k": F.lit(1), "s": F.col("v")}).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] if r[2] is not None else -1e9), r[1]))
        total = 0.0
        for k, r in enumerate(own, 1):
            total += r[2] or 0.0
            assert got[r[1]] == (k, pytest.approx(total))
    q = {r.g: (r.m, r.hi) for r in ordering.quantiles(df.where("g is not null"), ["g"], "v", {"m": 0.5, "hi": 0.9}).collect()}
    for g in ("a", "b"):
        v = [r[2] for r in rows if r[0] == g and r[2] is not None]
        assert q[g] == (pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.9)))
    assert ordering.ranked(df.limit(0), ["g"], "i").count() == 0
    h = spark.range(0, 60).select("id", ordering.harmonic(F.col("id")).alias("h")).collect()
    assert all(r.h == pytest.approx(sum(1 / k for k in range(1, r.id + 1)), abs=1e-10) for r in h)


def test_disjoint(spark):
    rng = random.Random(2)
    rows = [(f"k{i}", rng.randrange(20), rng.choice([[], None, ["a"], [None, "b"], *[[f"i{rng.randrange(40)}", f"i{rng.randrange(40)}"] for _ in range(9)]])) for i in range(120)]
    rows = [(k, r, x if x is not None else []) for k, r, x in rows]
    used, want = set(), set()
    for k, _, items in sorted(rows, key=lambda r: (r[1], r[0])):
        own = {x for x in items if x is not None}
        if not own & used:
            want.add(k)
            used |= own
    df = spark.createDataFrame(rows, "key string, rank int, items array<string>")
    assert {r.key for r in matching.disjoint(df, "key", "rank", "items").collect()} == want
    assert matching.disjoint(df.limit(0), "key", "rank", "items").count() == 0


def test_coloring_and_chain(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("p", "p"), ("q", None), ("a", "b")]
    got = {r.node: (r.root, r.color) for r in matching.coloring(spark.createDataFrame(edges, "u string, v string"), "u", "v").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 0), "d": ("a", 1), "x": ("x", None), "y": ("x", None), "z": ("x", None), "p": ("p", None)}
    rows = spark.createDataFrame([("j", i, f"e{i}") for i in range(6)] + [("k", 0, "e"), ("n", 1, None)], "j string, at int, body string").fillna("")
    chain = matching.hash_chain(rows, "j", ["at"], "body")
    assert matching.chain_breaks(chain, "j", "body").count() == 0
    spoilt = chain.withColumn("body", F.when((F.col("j") == "j") & (F.col("at") == 2), "other").otherwise(F.col("body")))
    assert [(r.j, r.version) for r in matching.chain_breaks(spoilt, "j", "body").collect()] == [("j", 3)]
    links = {(r.j, r.version): r.link for r in chain.collect()}
    other = {(r.j, r.version): r.link for r in matching.hash_chain(spoilt.select("j", "at", "body"), "j", ["at"], "body").collect()}
    assert [v for v in range(1, 7) if links["j", v] != other["j", v]] == [3, 4, 5, 6]  # a change shows in every later link


def test_min_cut():
    rng = random.Random(3)
    for _ in range(80):
        m, k = rng.randrange(1, 6), rng.randrange(1, 6)
        nodes = [(0, i) for i in range(m)] + [(1, i) for i in range(k)]
        near = {v: set() for v in nodes}
        for a, b in itertools.product(range(m), range(k)):
            if rng.random() < 0.45:
                near[0, a].add((1, b))
                near[1, b].add((0, a))
        weight = {v: rng.randrange(0, 9) for v in nodes}
        chosen, flow = conflicts.min_cut(nodes, weight, near, {v: v[0] for v in nodes})
        assert not any(b in near[a] for a in chosen for b in chosen)
        best = max(sum(weight[v] for v in s) for r in range(len(nodes) + 1) for s in itertools.combinations(nodes, r) if not any(b in near[a] for a in s for b in s))
        assert sum(weight[v] for v in chosen) == best == sum(weight.values()) - flow
    ring = list(range(300))
    weight, edges = {v: 1 for v in ring}, [(v, (v + 1) % 300) for v in ring]
    edges += [(v, (v + 151) % 300) for v in range(0, 300, 2)]
    got, state = conflicts.solve(weight, edges)
    assert state == "exact: flow" and len(got) == 150


def test_conflict_edges_over_time(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        start = rng.choice([None, rng.randrange(-50, 4000)])
        end = rng.choice([None, (start or 0) + rng.choice([0, 1, 20, 30, 900, 3000])])
        rows.append((i, rng.choice("st"), "p", rng.choice("xyz"), "all", rng.choice([1, 1, -1]), start, end))
    df = spark.createDataFrame(rows, "id int, subject string, predicate string, object string, scope string, polarity int, start bigint, end bigint")
    got = {(r.a, r.b) for r in conflicts.conflict_edges(df).collect()}
    want = set()
    for x, y in itertools.combinations(rows, 2):
        s, e = [(r[6] if r[6] is not None else -math.inf) for r in (x, y)], [(r[7] if r[7] is not None else math.inf) for r in (x, y)]
        clash = x[5] != y[5] if x[3] == y[3] else x[5] == y[5] == 1
        if x[1] == y[1] and clash and s[0] < e[0] and s[1] < e[1] and max(s) < min(e):
            want.add((x[0], y[0]))
    assert got == want and len(got) == conflicts.conflict_edges(df).count()


def test_changed_components(spark):
    rows = [(i, "s", f"p{i // 4}", f"o{i % 3}", "all", 1, 0, 10, 1 + i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, subject string, predicate string, object string, scope string, polarity int, start bigint, end bigint, weight int")
    former = conflicts.resolve(df)
    changed = spark.createDataFrame([(0, 50), (5, 1 + 5 % 5)], "id int, weight int")
    new, touched = conflicts.resolve_changed(df, changed, former)
    assert [r.component for r in touched.collect()] == [0]  # the second change keeps the weight
    full = conflicts.resolve(df.withColumn("weight", F.when(F.col("id") == 0, 50).otherwise(F.col("weight"))))
    key = lambda d: sorted((r.id, r.component, r.chosen) for r in d.collect())
    assert key(new) == key(full)


def test_crossfit(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, f"g{i % 37}", float(rng.random() < 1 / (1 + math.exp(-(0.5 + 2 * a - b)))), a, b))
    rows += [(900, None, 1.0, 0.0, 0.0), (901, "g1", None, 0.0, 0.0), (902, "g1", 1.0, None, 0.0)]
    df = spark.createDataFrame(rows, "id int, grp string, y double, f1 double, f2 double")
    got = fitting.crossfit(df, "id", "grp", "y", ["f1", "f2"], folds=3).collect()
    assert len(got) == 400 and len({(r.fold, rows[r.id][1]) for r in got}) == 37
    fold = {r.id: r.fold for r in got}
    x = np.array([[1, r[3], r[4]] for r in rows[:400]])
    y = np.array([r[2] for r in rows[:400]])
    for k in range(3):
        out = np.array([fold[i] != k for i in range(400)])
        w = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-x[out] @ w))
            d = np.diag([0.0, 1.0, 1.0])
            w += np.linalg.solve(x[out].T @ (x[out] * (p * (1 - p))[:, None]) + d, x[out].T @ (y[out] - p) - d @ w)
        for r in got:
            if r.fold == k:
                assert r.p == pytest.approx(1 / (1 + math.exp(-x[r.id] @ w)), abs=1e-6)
    assert fitting.crossfit(df.limit(0), "id", "grp", "y", ["f1", "f2"], folds=3).count() == 0


def test_drawn_sums(spark):
    df = spark.createDataFrame([(f"g{i}", 1, i) for i in range(500)], "grp string, n int, v int")
    t = policies.drawn_sums(df, "grp", ["n", "v"], 160).collect()
    n = np.array([r.n for r in t])
    assert len(t) == 160 and abs(n.mean() - 500) < 8 and 18 < n.std() < 27  # Poisson: mean and deviation of 500 weights
    again = {r.draw: r.v for r in policies.drawn_sums(df.repartition(7), "grp", ["n", "v"], 160).collect()}
    assert {r.draw: r.v for r in t} == again


def test_pairwise_scores(spark):
    rng = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(16)]
    pairs = list(itertools.combinations(nodes, 2))
    predicted, truth = [p for p in pairs if rng.random() < 0.3], [p for p in pairs if rng.random() < 0.3]
    frame = lambda x: spark.createDataFrame(x, "a string, b string")
    r = reports.pairwise_scores(frame(predicted), frame(truth), frame(pairs[:9]), spark.createDataFrame([(v,) for v in nodes], "node string")).first()
    p, t = set(predicted), set(truth)
    assert r.prec == pytest.approx(len(p & t) / len(p), abs=1e-6) and r.recall == pytest.approx(len(p & t) / len(t), abs=1e-6)
    assert r.open_triangles == sum(sum(q in p for q in itertools.combinations(x, 2)) == 2 for x in itertools.combinations(nodes, 3)) and r.hard == len(p & set(pairs[:9]))
    empty = reports.pairwise_scores(frame([]), frame([]), frame([]), spark.createDataFrame([("a",)], "node string")).first()
    assert (empty.prec, empty.recall, empty.f1, empty.open_triangles) == (1.0, 1.0, 1.0, 0)


def test_text_scalars(spark):
    df = spark.createDataFrame([("Ｆull-Width Ⅳ ß", "Deep Nets"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(scalars._mention("a")).collect()] == ["fullwidthivss", None, ""]
    two = spark.createDataFrame([("Deep nets for text", "Deep Nets for Texts"), ("abc", "xyz")], "a string, b string")
    got = [r[0] for r in two.select(scalars._title_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, "deep nets for text", "deep nets for texts").ratio(), 0.0]
    secret = spark.createDataFrame([("key sk-abcdefghijklmnop1234 here",), ("password = hunter22",), ("plain",)], "t string")
    assert [r[0] for r in secret.select(scalars.redacted(F.col("t"))).collect()] == ["key [redacted] here", "[redacted]", "plain"]
    with pytest.raises(ValueError):
        scalars.stripped(spark.createDataFrame([(1, (2,))], "id int, s struct<gold: int>"))


def test_delta_index():
    from attestra.operators.delta import DeltaIndex

    rng = random.Random(8)
    weight = {v: rng.randrange(0, 9) for v in range(90)}
    edges = [(8 * (a // 8) + i, 8 * (a // 8) + j) for a in range(0, 64, 8) for i, j in itertools.combinations(range(8), 2) if rng.random() < 0.35]
    edges += [(v, v + 1) for v in range(64, 82)]  # a path of 19
    index = DeltaIndex(weight, edges)

    def whole() -> float:
        parts, seen = [], set()
        near = {v: [] for v in weight}
        for a, b in edges:
            near[a].append(b)
            near[b].append(a)
        for root in weight:
            if root not in seen:
                queue = [root]
                seen.add(root)
                for v in queue:
                    for u in near[v]:
                        if u not in seen:
                            seen.add(u)
                            queue.append(u)
                parts.append(queue)
        return sum(sum(weight[v] for v in conflicts.solve({v: weight[v] for v in p}, [(a, b) for a, b in edges if a in p])[0]) for p in parts)

    assert index.total == whole()
    for _ in range(12):
        v = rng.randrange(90)
        weight[v] = rng.randrange(0, 30)
        before = index.solved
        assert index.update(v, weight[v]) == whole() and index.solved == before + 1
    with pytest.raises(ValueError):
        index.update(1000, 1)
    assert DeltaIndex({}, []).total == 0
