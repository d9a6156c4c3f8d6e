"""Record operators against brute force, with nulls, repeats, skew, empty tables and extra columns."""

import collections
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import bundles, grouping, linkage, names, overlap, spans, strings, words


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


@pytest.mark.parametrize("method", [grouping.boruvka, grouping.hook_and_shortcut])
def test_groups(spark, method):
    rng = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    hub = [("hub", f"h{i:03d}") for i in range(200)]
    rest = [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    edges = chain + hub + rest + hub[:5] + [(b, a) for a, b in rest[:9]]
    df = spark.createDataFrame([(a, b, "x") for a, b in edges + [("a", None), (None, None)]], "a string, b string, node string")
    got = {r.node: r.root for r in method(df, "a", "b").collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])
    assert method(df.limit(0), "a", "b").count() == 0
    assert method(df.where("b is null"), "a", "b").count() == 0


def test_bundles_and_splits(spark):
    rng = random.Random(5)
    keys = [(f"id{i}", rng.choice(["k1", "k2", None] + [f"x{rng.randrange(300)}"] * 6)) for i in range(400)]
    keys += [(f"big{i}", "hot") for i in range(200)]  # a third of all rows share a key
    rows = spark.createDataFrame(sorted({k for k, _ in keys} | {"alone"}), "string").toDF("id")
    out = bundles.bundles(rows, "id", spark.createDataFrame(keys + keys[:20], "id string, key string"), "id", "key")
    want = union_find([(k, f"~{v}") for k, v in keys if v])
    got = {r.record: r.bundle_id for r in out.collect()}
    for a, b in itertools.combinations(sorted(got)[:150], 2):
        assert (got[a] == got[b]) == (want.get(a, a) == want.get(b, b))
    split = bundles.assigned(out, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(split) == len(got)
    by = collections.defaultdict(set)
    for r in split:
        by[r.bundle_id].add(r.split_target)
    assert all(len(v) == 1 for v in by.values())
    n = collections.Counter(r.split_target for r in split)
    assert abs(n["test"] / len(split) - 0.1) < 0.02 and abs(n["validation"] / len(split) - 0.1) < 0.02


def test_closest_total():
    rng = random.Random(6)
    assert bundles.closest({2: 10, 7: 1}, 7) == {2: 0, 7: 1} and bundles.closest({2: 5, 5: 1}, 5) == {2: 0, 5: 1}
    for i in range(400):
        sizes = {s: rng.randrange(0, (7, 60)[i % 2]) for s in rng.sample(range(1, (12, 40)[i % 3 == 0]), rng.randrange(1, 5))}
        total = sum(s * m for s, m in sizes.items())
        target = rng.randrange(0, total + 5)
        reach = 1
        for s, m in sizes.items():
            for _ in range(m):
                reach |= reach << s
        best = min((abs(t - target), t) for t in range(total + 1) if reach >> t & 1)
        got = bundles.closest(sizes, target)
        assert all(0 <= got[s] <= m for s, m in sizes.items())
        assert sum(s * k for s, k in got.items()) == best[1]


def test_linking_ids(spark):
    df = spark.createDataFrame([(" G1 ",), ("g1",), ("N/A",), (" unknown",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(bundles.linking_id("x")).collect()] == ["g1", "g1", None, None, None, None]


def test_near_same(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        n = rng.choice([1, 2, 5, 14, 30, 45, 90, 170])
        base = [rng.choice(vocabulary) for _ in range(n)]
        rows.append((1, f"t{i}", True, " ".join(base)))
        other = list(base)
        for _ in range(rng.randrange(0, max(1, n // 4))):
            other[rng.randrange(n)] = rng.choice(vocabulary)
        rng.shuffle(other)
        rows.append((1, f"e{i}", False, ". ".join(other).upper()))
    rows += [(1, f"copy{i}", True, "the same stock claim stands here very often indeed") for i in range(150)]
    rows += [(1, "ecopy", False, "The same STOCK claim stands here very often, indeed."), (2, "k2", False, rows[0][3]), (1, "n1", False, None), (1, "n2", True, "  "), (None, "n3", True, "x"), (1, None, True, "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "kind int, id string, train boolean, text string, a string")
    matches, members = overlap.near_same(df)
    held = members.where("not train").select(F.col("a").alias("ea"), F.col("b").alias("eb"), "id")
    train = members.where("train").select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("id").alias("tid"))
    got = {(r.id, r.tid) for r in matches.join(held, ["ea", "eb"]).join(train, ["ta", "tb"]).collect()}
    bags = {(k, i, t): collections.Counter(words.folded_array(pa.array([x]))[0].as_py().split()) for k, i, t, x in rows if k is not None and i is not None and x and x.strip()}
    want = set()
    for (k, i, t), a in bags.items():
        for (k2, j, t2), b in bags.items():
            if k == k2 and not t and t2:
                longer = max(sum(a.values()), sum(b.values()))
                if sum((a & b).values()) >= longer - (-(-longer // 6) if longer >= 6 else 0):
                    want.add((i, j))
    assert got == want and len([x for x in got if x[0] == "ecopy"]) == 150
    empty, none = overlap.near_same(df.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_names(spark):
    groups = [
        ["Ramona Tukuzagagid", "Tukuzagagid, Ramona", "RAMONA TUKUZAGAGID", "Ramona Tukuuagagid", "Dr. R. Tukuzagagid", "Ｒamona Tukuzagagid"],
        ["Deborah Tukuzagagid", "Debbie Tukuzagagid"],
        ["Vebinafukek University of Urban Hydrology", "VUUH (Vebinafukek)", "Univ. of Urban Hydrology, Vebinafukek", "Vebinafukek Univ. Urba. Hydr.", "The Vebinafukek University of Urban Hydrology Ltd"],
        ["Vebinafukek University of Polar Chemistry"],
        ["vodivoredatase-3 alpha", "Vodivoredatase 3 α", "alpha-vodivoredatase 3"],
        ["vodivoredatase-4 alpha"],
        ["N-acetyl-pizegutipuvol", "acetyl-pizeguttipuvol (N)", "pizegutipuvol, N-acetyl", "N-acetylpizegutipuvol"],
        ["O-acetyl-pizegutipuvol"],
        ["Игорь Чахекушемачан", "ЧАХЕКУШЕМАЧАН, ИГОРЬ"],
    ]
    rows = [(f"g{i}m{j}", m, "x") for i, g in enumerate(groups) for j, m in enumerate(g)] + [("null", None, "x"), ("blank", " ", "x"), ("g0m0", groups[0][0], "x"), ("long", "x" * 30_000, "x")]
    got = {r.k: r.group_id for r in names.linked(spark.createDataFrame(rows, "k string, m string, root string"), "k", "m").collect()}
    assert "null" not in got and "blank" not in got and "long" in got
    for a, b in itertools.combinations([r[0] for r in rows if r[0].startswith("g")], 2):
        if a != b:
            assert (got[a] == got[b]) == (a.split("m")[0] == b.split("m")[0]), (a, b)
    assert names.linked(spark.createDataFrame([], "k string, m string"), "k", "m").count() == 0


def test_names_in_no_list(spark):
    """Given names, fields and substituents that no list holds."""
    groups = [
        ["Hiroshi Tanakamura", "H. Tanakamura", "Tanakamura, Hiroshi", "Tanakamura, H.", "Hirsohi Tanakamura"],
        ["Kiyoshi Tanakamura"],
        ["Keiko Mori-Okabayashi", "K. Mori-Okabayashi", "Mori Okabayashi, Keiko"],
        ["Univ. of Astronomy, Toronto", "Toronto University of Astronomy", "UNIVERSITY OF ASTRONOMY TORONTO"],
        ["Univ. of Astronomy, Tampere"],
        ["Univ. of Palaeontology, Toronto"],
        ["Toronto Institute of Palaeontology", "Toronto Inst. Pala.", "TIP (Toronto)"],
        ["Trieste Institute of Palaeontology"],
        ["Univ. Toronto, Astronomy"],
        ["Univ. Tampere, Astronomy"],
        ["Zagreb Institute of Physics"],
        ["Zagreb Institute of Physiology"],
        ["ZIP (Zagreb)"],
        ["N-benzosyl-togudipurane", "togudipurane, N-benzosyl"],
        ["N-xylosyl-togudipurane"],
    ]
    rows = [(f"g{i}m{j}", m) for i, g in enumerate(groups) for j, m in enumerate(g)]
    got = {r.k: r.group_id for r in names.linked(spark.createDataFrame(rows, "k string, m string"), "k", "m").collect()}
    for a, b in itertools.combinations([r[0] for r in rows], 2):
        assert (got[a] == got[b]) == (a.split("m")[0] == b.split("m")[0]), (dict(rows)[a], dict(rows)[b])


def test_string_measures():
    rng = random.Random(5)
    a, b = [["".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(500)] for _ in range(2)]
    (x, n), (y, m) = strings.matrix(pa.array(a)), strings.matrix(pa.array(b))
    assert strings.edits(x, n, y, m).tolist() == [names.edits(p, q, 99) for p, q in zip(a, b, strict=True)]
    measure = lambda p, q: strings.jaro_winkler(*strings.matrix(pa.array([p])), *strings.matrix(pa.array([q])))[0]
    assert measure("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and measure("a", "b") == 0 and measure("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert names.edits("abcd", "abdc", 3) == 1 and names.edits("abc", "xyz", 2) == 3 and names.edits("", "ab", 3) == 2


def test_linkage(spark):
    kind = "left_id int, record_1 map<string,string>, context string, l string"
    works = [
        ("On the nested catalyst of zodeval", "Margaret Nakonen, Zoltan Pefovak", "Annals of Data Provenance (Turunuv)", "2020"),
        ("On the nested catalyst of sonepuosin", "Margaret Nakonen, Zoltan Pefovak", "Annals of Data Provenance (Turunuv)", "2017"),
        ("Panel discussion", "Robert Masam, Wilma Sukel", "Journal of Cell Mechanics (Ruboloz)", "2008"),
        ("Panel discussion", "Cedric Fozamul, Fiona Ziradeb", "Journal of Polar Chemistry (Zetovet)", "1999"),
    ]
    filler = [(f"Word{i} alpha{i} beta{i % 7} study", f"Name{i}surname Peter", f"Journal (Place{i % 9})", "2001") for i in range(60)]
    left = [(i, dict(zip(("title", "authors", "venue", "year"), w, strict=True)), None, "x") for i, w in enumerate(works + filler)] + [(900, None, None, "x"), (901, {}, "c", "x"), (0, dict(zip(("title", "authors", "venue", "year"), works[0], strict=True)), None, "x")]
    right = [(100 + i, {"heading": w[0].upper().replace("ZODEVAL", "ZODEVLA"), "by": w[1].replace("Margaret", "M."), "date": w[3]}, None, "x") for i, w in enumerate(works + filler)] + [(990, None, None, "x")]
    a = spark.createDataFrame(left, kind)
    b = spark.createDataFrame(right, kind.replace("left_id", "right_id").replace("record_1", "record_2"))
    got = {(r.left_id, r.right_id): r.confidence for r in linkage.link(a, "left_id", "record_1", b, "right_id", "record_2").collect()}
    assert set(got) == {(i, 100 + i) for i in range(len(works) + len(filler))}
    assert all(0.5 <= v <= 1 for v in got.values())
    assert linkage.link(a.limit(0), "left_id", "record_1", b, "right_id", "record_2").count() == 0


def test_linkage_many_authors(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    people, terms = [word() for _ in range(300)], [word() for _ in range(120)]
    works = [(rng.sample(terms, 6), rng.sample(people, 14)) for _ in range(60)]
    record = lambda t, a: {"title": " ".join(t), "authors": a, "venue": "Journal (Place)", "year": "2001"}
    left, right = [], []
    for i, (t, a) in enumerate(works):
        left += [(4 * i, record(t, ", ".join(a)), None), (4 * i + 1, record(t, f"{a[0]} et al."), None)]
        right += [(1000 + 4 * i, record(t, ", ".join(a)), None), (1000 + 4 * i + 1, record(t[:4], ", ".join(a)), None)]
    a = spark.createDataFrame(left, "left_id int, record_1 map<string,string>, context string")
    b = spark.createDataFrame(right, "right_id int, record_2 map<string,string>, context string")
    want = {(4 * i + x, 1000 + 4 * i + y) for i in range(60) for x in (0, 1) for y in (0, 1)}
    for hot in (linkage.HOT, 3):  # with 3, nearly all pairs of attributes are split by a third
        monkeypatch.setattr(linkage, "HOT", hot)
        got = {(r.left_id, r.right_id) for r in linkage.link(a, "left_id", "record_1", b, "right_id", "record_2").collect()}
        assert got == want


def test_linkage_levels_apart(spark, monkeypatch):
    """No stage holds the joins of more than one level: the driver gets the metrics of all joins of a stage from each of its tasks."""
    joins, staged = [], linkage.staged

    def counted(df, label="stage"):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return staged(df, label)

    monkeypatch.setattr(linkage, "HOT", 0)  # split until half of the twelve attributes are met: six levels
    monkeypatch.setattr(linkage, "staged", counted)
    own = [spark.createDataFrame([(i, list(range(12)), [1.0] * 12) for i in ids], "id int, attrs array<bigint>, weights array<double>") for ids in (range(5), range(10, 15))]
    got = {(r.l, r.r): r.mask for r in linkage._candidates(*own).collect()}
    assert got == {(x, y): (1 << 12) - 1 for x in range(5) for y in range(10, 15)}
    assert len(joins) > 18 and max(joins) <= 9


def test_linkage_gathers_no_table(spark, monkeypatch):
    """No join of linkage is a broadcast, however small Spark takes the staged files for."""
    plans, staged = [], linkage.staged

    def planned(df, label="stage"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(linkage, "staged", planned)
    monkeypatch.setattr(linkage, "HOT", 3)
    record = lambda i: {"title": f"word{i} alpha{i % 2} beta study", "authors": f"Name{i}", "venue": "Journal (Place)"}
    a = spark.createDataFrame([(i, record(i), None) for i in range(12)], "left_id int, record_1 map<string,string>, context string")
    b = spark.createDataFrame([(i + 100, record(i), None) for i in range(12)], "right_id int, record_2 map<string,string>, context string")
    out = linkage.link(a, "left_id", "record_1", b, "right_id", "record_2")
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert {(r.left_id, r.right_id) for r in out.collect()} == {(i, i + 100) for i in range(12)}
    assert sum("SortMergeJoin" in p for p in plans) > 8
    assert not [line for p in plans for line in p.splitlines() if "Broadcast" in line]


def test_shared_spans(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    p, q, short = noise(400), noise(200), noise(199)
    texts = {1: noise(50) + p + noise(9), 2: p + noise(300), 3: noise(150) + p[100:320] + "é中", 4: noise(80) + q, 5: q + noise(300), 6: noise(7) + short, 7: short + noise(250), 8: "", 9: None, 10: noise(300), 12: "x" * 450, 13: "y" * 30 + "x" * 260}
    texts[11] = texts[10]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc bigint, body string, key string")
    shared = spans.Shared(df, "doc", "body")
    windows = collections.defaultdict(set)
    for k, t in texts.items():
        for i in range(len(t or "") - 199):
            windows[t[i : i + 200]].add(k)
    want = {pair for v in windows.values() for pair in itertools.combinations(sorted(v), 2)}
    assert {(r.a, r.b) for r in shared.pairs("a", "b").collect()} == want
    got = {r.doc: r for r in shared.shares("doc").collect()}
    for k, t in texts.items():
        covered = set()
        for i in range(len(t or "") - 199):
            if len(windows[t[i : i + 200]]) > 1:
                covered.update(range(i, i + 200))
        assert (got[k].n_chars, got[k].n_shared) == (len(t or ""), len(covered))
    assert spans.Shared(df.limit(0), "doc", "body").pairs("a", "b").count() == 0
