import random

import pytest

from attestra import session
from attestra.operators import conflicts, graph, lineage
from attestra.plans import graphs, registry


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges + [(1, None)], "a int, b int"), "a", "b").collect()}
    assert got == union_find(edges)


def test_components_empty(spark):
    assert graph.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_cascade(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "s string, t string")
    got = graph.reachable(spark.createDataFrame([("a",), (None,)], "n string"), edges, "n", "s", "t")
    assert {r.n for r in got.collect()} == {"a", "b", "c"}


def test_horn_keeps_no_unfounded_cycle(spark):
    rules = spark.createDataFrame([("1", "x", ["y"]), ("2", "y", ["x"]), ("3", "c", ["a", "b"]), ("4", "d", ["c"]), ("5", "z", [])], "rule string, head string, body array<string>")
    got = graph.horn_closure(rules, spark.createDataFrame([("a",), ("b",)], "fact string"))
    assert {r.fact for r in got.collect()} == {"a", "b", "c", "d", "z"}


def test_peel(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "node string, needs string")
    assert {(r.node, r.level) for r in graph.peeled(nodes, needs).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def brute(proofs, p):
    atoms = sorted({a for x in proofs for a in x})
    total = 0.0
    for w in range(1 << len(atoms)):
        true = {a for i, a in enumerate(atoms) if w >> i & 1}
        if any(set(x) <= true for x in proofs):
            v = 1.0
            for a in atoms:
                v *= p[a] if a in true else 1 - p[a]
            total += v
    return total


def test_lineage(spark):
    rng = random.Random(4)
    rows, atoms, want = [], [], {}
    for i in range(40):
        proofs = [[f"x{rng.randrange(6)}" for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 5))]
        p = {f"x{k}": rng.choice([0.0, 1.0, rng.random()]) for k in range(6)}
        rows.append((i, proofs))
        atoms += [(i, a, v) for a, v in p.items()]
        want[i] = brute(proofs, p)
        assert lineage.shannon(proofs, p)[0] == pytest.approx(want[i], abs=1e-12)
    f = spark.createDataFrame(rows, "formula_id int, proofs array<array<string>>")
    a = spark.createDataFrame(atoms, "formula_id int, atom string, p double")
    for op in (lineage.worlds(f, a), lineage.exact(f, a)):
        got = {r.formula_id: r[1] for r in op.collect()}
        assert got == pytest.approx(want, abs=1e-8)
    for r in lineage.bounds(f, a).collect():
        assert r.lower - 1e-8 <= want[r.formula_id] <= r.upper + 1e-8


def test_lineage_caps_and_edges():
    assert lineage.shannon([], {}) == (0.0, 0.0, "exact")
    assert lineage.shannon([[]], {}) == (1.0, 1.0, "exact")
    assert lineage.shannon([["a"]], {})[2].startswith("staged")
    many = lineage.shannon([[f"a{i}"] for i in range(30)], {f"a{i}": 0.1 for i in range(30)})
    assert many[2] == "exact" and many[0] == pytest.approx(1 - 0.9**30)
    chain = [[f"a{i}", f"a{i + 1}", f"a{(7 * i) % 40}"] for i in range(39)]
    assert lineage.shannon(chain, {f"a{i}": 0.5 for i in range(40)}, max_states=50) == (0.0, 1.0, "staged: states")


def heaviest(weight, edges):
    nodes, best = sorted(weight), 0
    for w in range(1 << len(nodes)):
        got = {v for i, v in enumerate(nodes) if w >> i & 1}
        if not any(a in got and b in got for a, b in edges):
            best = max(best, sum(weight[v] for v in got))
    return best


@pytest.mark.parametrize("enumerate_to", [16, 0])
def test_independent_sets(monkeypatch, enumerate_to):
    monkeypatch.setattr(conflicts, "ENUMERATE", enumerate_to)
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 11)
        weight = {i: rng.randrange(0, 9) for i in range(n)}
        edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.25]
        chosen, state = conflicts.solve(weight, edges)
        assert not any(a in chosen and b in chosen for a, b in edges)
        if state.startswith("exact"):
            assert sum(weight[v] for v in chosen) == heaviest(weight, edges)


@pytest.mark.parametrize("states", [20_000, 1])
def test_independent_sets_by_search(monkeypatch, states):
    for name, value in (("ENUMERATE", 0), ("FLOW", 0), ("FOREST", 0), ("STATES", states)):
        monkeypatch.setattr(conflicts, name, value)
    rng = random.Random(8)
    for i in range(200):
        n = rng.randrange(1, 12)
        weight = {i: rng.randrange(0, 9) for i in range(n)}
        edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < rng.choice([0.2, 0.4, 0.7])]
        chosen, state = conflicts.solve(weight, edges, rng.choice([None, {v: i for i, v in enumerate(rng.sample(range(n), n))}]))
        assert state == "exact: search" and not any(a in chosen and b in chosen for a, b in edges)
        assert sum(weight[v] for v in chosen) == heaviest(weight, edges)


@pytest.mark.parametrize("blocks", [20, 900])
def test_no_component_is_left(blocks):
    """A chain of triangles has no two colours, no small cut set, and here up to 2,700 vertices; each is solved whole."""
    rng = random.Random(blocks)
    weight = {i: rng.randrange(1, 9) for i in range(3 * blocks)}
    edges = [(i + a, i + b) for i in range(0, 3 * blocks, 3) for a, b in ((0, 1), (0, 2), (1, 2))] + [(i - 1, i) for i in range(3, 3 * blocks, 3)] + [(i - 2, i + 1) for i in range(3, 3 * blocks, 3)]
    best = {None: 0}  # by the place taken in the last triangle
    for i in range(0, 3 * blocks, 3):
        free = {p: [v for q, v in best.items() if (q, p) not in ((2, 0), (1, 1))] for p in range(3)}
        best = {p: max(v) + weight[i + p] for p, v in free.items() if v} | {None: max(best.values())}
    chosen, state = conflicts.solve(weight, edges)
    assert state.startswith("exact") and not any(a in chosen and b in chosen for a, b in edges)
    assert sum(weight[v] for v in chosen) == max(best.values())


@pytest.mark.parametrize("name", ["i4_certificate", "i9_delta"])
def test_resolution_gathers_no_table(spark, monkeypatch, tmp_path, name):
    """Joins of sides that grow with the events are no broadcasts, however small Spark takes the staged files for."""
    plans, staged = [], session.staged

    def planned(df, label="stage"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return staged(df, label)

    for module in (graph, graphs, conflicts):
        monkeypatch.setattr(module, "staged", planned)
    rng = random.Random(5)
    rows = [(i, rng.randrange(3 * 10**5), rng.randrange(9), rng.choice("ab"), f'{{"k": {rng.randrange(4)}}}') for i in range(300)]
    events = spark.createDataFrame(rows, "event_id bigint, t bigint, user_id bigint, event_type string, props string")
    events.selectExpr("event_id", "timestamp_seconds(t) as ts", "user_id", "event_type", "props").write.parquet(f"{tmp_path}/events.parquet")
    out = registry.queries()[name](spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert out.count() > 0 and sum("SortMergeJoin" in p for p in plans) > 2
    assert not [line for p in plans for line in p.splitlines() if "Broadcast" in line]


def test_resolution(spark):
    rows = [(1, "s", "p", "x", 1, 0, 10, 5), (2, "s", "p", "y", 1, 5, 7, 9), (3, "s", "p", "x", -1, None, None, 3), (4, "t", "p", "x", 1, 0, 1, 2)]
    a = spark.createDataFrame([(r[0], r[1], r[2], "all", *r[3:]) for r in rows], "id int, subject string, predicate string, scope string, object string, polarity int, start bigint, end bigint, weight bigint")
    got = {r.id: r.chosen for r in conflicts.resolve(a).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}
    c = conflicts.certificate(a, conflicts.resolve(a)).first()
    assert (c["rows"], c["chosen"], c["weight"], c["conflicts"]) == (4, 3, 14, 0)
    assert conflicts.resolve(a.limit(0)).count() == 0


def test_resolution_of_long_components(spark):
    """2,100 assertions of one subject, each in conflict with the next one, are solved as a whole, among smaller components."""
    rng = random.Random(9)
    weight = {i: rng.randrange(1, 9) for i in range(2100)}
    rows = [(i, "s", "p", "all", f"x{i}", 1, 2 * i, 2 * i + 3, w) for i, w in weight.items()]
    rows += [(5000 + i, f"t{i // 3}", "p", "all", f"x{i}", 1, None, None, 1 + i % 3) for i in range(60)]
    rng.shuffle(rows)
    a = spark.createDataFrame(rows, "id int, subject string, predicate string, scope string, object string, polarity int, start bigint, end bigint, weight bigint")
    got = conflicts.resolve(a).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows) and all(r.state.startswith("exact") for r in got)
    take = skip = 0
    for w in weight.values():
        take, skip = skip + w, max(take, skip)
    chosen = {r.id for r in got if r.chosen}
    assert not any(i in chosen and i + 1 in chosen for i in weight)
    assert sum(weight[i] for i in chosen if i < 5000) == max(take, skip)
    assert {i for i in chosen if i >= 5000} == {5002 + 3 * i for i in range(20)}
