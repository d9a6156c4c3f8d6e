import gzip
import json
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from attestra.operators import planner, policies
from attestra.operators.store import FACTS, NODES, RELATIONS, Conflict, FactStore, Rejected
from attestra.sources import files
from attestra.streaming import journal


@pytest.fixture
def store(spark, tmp_path):
    s = FactStore(spark, str(tmp_path / "store"), {"supports": 0.8})
    s.commit("k1", 0, nodes=spark.createDataFrame([("a", "claim"), ("b", "doc")], NODES), relations=spark.createDataFrame([("supports", "doc", "claim", False, False)], RELATIONS))
    return s


def fact(spark, id_="f1", score=0.9, evidence=("e1",), needs=(), subject="b", obj="a"):
    return spark.createDataFrame([(id_, subject, "supports", obj, list(evidence), list(needs), "same", score, True, None)], FACTS)


def test_store_lifecycle(spark, store):
    first = store.commit("k2", 1, facts=fact(spark))
    assert store.commit("k2", 1, facts=fact(spark)) == first  # a retry changes nothing
    with pytest.raises(Conflict):
        store.commit("k2", 2, facts=fact(spark, "f9"))
    with pytest.raises(Conflict):
        store.commit("k3", 1, facts=fact(spark, "f9"))
    with pytest.raises(Rejected):
        store.commit("k4", 2, facts=fact(spark, "f3", score=0.5))
    with pytest.raises(Rejected):
        store.commit("k5", 2, facts=fact(spark, "f4", obj="missing"))
    with pytest.raises(Rejected):
        store.commit("k6", 2, facts=fact(spark))  # ids are used once
    extra = spark.createDataFrame([("c", "claim")], NODES)
    store.commit("k7", 2, nodes=extra, facts=fact(spark, "f2", needs=["f1"], evidence=["e2"], obj="c"))
    assert store.version() == 3 and store.view().count() == 2
    with pytest.raises(Rejected):
        store.retract("k8", 3, ["e1"], "", "me")
    store.retract("k8", 3, ["e1"], "wrong", "me")
    assert store.read("facts").where("active").count() == 0 and store.read("facts").count() == 2
    assert store.read("facts", 3).where("active").count() == 2
    with pytest.raises(Rejected):
        store.migrate("k9", 4, spark.createDataFrame([("supports", "nothing", "claim", False, False)], RELATIONS)) if store.commit("k10", 4, nodes=spark.createDataFrame([("d", "claim")], NODES), facts=fact(spark, "f5", obj="d", evidence=["e3"])) is None else store.migrate("k9", 5, spark.createDataFrame([("supports", "nothing", "claim", False, False)], RELATIONS))
    assert store.audit() == []
    path = f"{store.path}/journal/{2:012d}.json"
    event = json.load(open(path))
    event["detail"] = {"x": 1}
    json.dump(event, open(path, "w"))
    assert store.audit() == ["version 2: hash"]


def test_sources(spark, tmp_path):
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "x.json.gz"), "a int").agg(F.sum("a")).first()[0] == 3
    lines = spark.createDataFrame([('{"a": 1, "a": 2}',), ('{"a": NaN}',), ('{"a": 1}',), ("{",)], "value string")
    assert files.strict_errors(lines).count() == 3
    (tmp_path / "p.tsv").write_text("COL title VAL A b COL year VAL 1999\tCOL title VAL A  b\t1\nbroken\n")
    rows = files.attribute_pairs(spark, str(tmp_path / "p.tsv")).collect()
    assert rows[0].record_1 == {"title": "A b", "year": "1999"} and rows[0].gold_label == "same" and rows[1].line_error == "broken"
    (tmp_path / "m.txt").write_text("one\ntwo\n")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "m.txt", "in/m.txt")
    assert files.archive_members(spark, str(tmp_path / "t.tar.gz"), ".txt").count() == 2
    manifest = spark.createDataFrame([("m.txt", 8, "0" * 64), ("gone", 1, "0" * 64)], "name string, bytes bigint, sha256 string")
    errors = {r.name: r.error for r in files.manifest_errors(spark, str(tmp_path / "m.txt"), manifest).collect()}
    assert errors == {"m.txt": "changed", "gone": "missing"}
    path = str(tmp_path / "a.json")
    assert files.create_artifact(path, {"x": 1}) == files.create_artifact(path, {"x": 1})
    with pytest.raises(FileExistsError):
        files.create_artifact(path, {"x": 2})
    cache = spark.createDataFrame([("k", "r1", 1), ("k", "r2", 2), ("k", "bad", 3)], "key string, response string, at int").withColumn("sha256", F.when(F.col("response") == "bad", "x").otherwise(F.sha2("response", 256)))
    got = files.cached(spark.createDataFrame([("k",), ("l",)], "key string"), cache)
    assert {r.key: r.response for r in got.collect()} == {"k": "r2", "l": None}


def test_streaming_ingest_is_exactly_once(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:10:00", 2.0), ("a", "2024-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "call string, at string, v double").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "in"), "call string, at timestamp, v double")
    for _ in range(2):
        journal.ingest(journal.read_journal(spark, *args), "call", "at", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = journal.usage_windows(journal.read_journal(spark, *args), "at", "call", "v").writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.call, r.n, r.total) for r in spark.sql("select * from usage").collect()} == {("a", 2, 2.0), ("b", 1, 2.0)}


def test_bounds_and_budget(spark):
    assert policies.binomial_upper(0, 0, 0.05) is None and policies.binomial_upper(0, 0, 0.05, 1.0) == 1.0
    assert policies.binomial_upper(0, 20, 0.05) == pytest.approx(1 - 0.05 ** (1 / 20))
    u = policies.binomial_upper(3, 20, 0.05)
    assert sum(math.comb(20, i) * u**i * (1 - u) ** (20 - i) for i in range(4)) == pytest.approx(0.05, abs=1e-9)
    assert policies.zero_error_sample_size(0.05, 0.05) == 59
    rows = spark.createDataFrame([("g", 1, 0.9), ("g", 2, 0.7), ("g", 3, 0.6), ("g", 4, 0.85), ("h", 5, 0.1)], "g string, id int, score double")
    assert {r.id for r in policies.admit_budget(rows, ["g"], "id", "score", 0.5).collect()} == {1, 4}
    rows = spark.createDataFrame([("a", 0.9, True), ("a", 0.9, False), ("a", 0.1, False), ("a", 0.2, True)], "arm string, p double, gold boolean")
    assert policies.fit_temperature(rows, "arm", "p", "gold").first().temperature > 1


def test_backend_errors_stay(spark):
    from pyspark.sql import types as T

    def backend(rows):
        raise RuntimeError("down")

    out = policies.decide(spark.createDataFrame([(1,)], "id int"), backend, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("error", T.StringType())]))
    assert out.first().error == "RuntimeError: down"


def test_planner(spark):
    rows = spark.createDataFrame([(i, f"g{i // 2}", f"d{i % 3}") for i in range(120)], "id int, grp string, domain string")
    config = {"stages": [30, 60], "seed": 1, "arms": 2, "repeats": 1, "attempts": 1, "unit_cost": "0.01", "budget": "1"}
    roll, summary = planner.plan(rows, "id", "grp", "domain", config)
    by = {}
    for r in roll.collect():
        by[r.stage] = by.get(r.stage, 0) + r.rows
    assert 30 <= by[0] < by[1] <= 120 and summary["blockers"] == ["budget"] and summary["authorized"] is False
    assert planner.validate(config | {"arms": True, "budget": 1.5}) == ["arms", "budget"]


def test_purge_components(spark, tmp_path):
    """A calibration row is dropped when its component, over both ends, holds an evaluation row."""
    import hashlib

    from attestra.plans import registry

    split = lambda e: int(hashlib.sha256(e.encode()).hexdigest()[:8], 16) % 10
    names = [f"e{i}" for i in range(200)]
    cal, held = [e for e in names if 6 <= split(e) < 8], [e for e in names if split(e) >= 8]
    pairs = [(cal[0], "shared"), (held[0], "shared"), (cal[1], "x"), (cal[2], "x"), (cal[2], held[1]), (cal[3], "alone"), (cal[4], None), (held[1], "y")]
    kind = "result_id bigint, example_id string, pair array<string>, backend_name string, backend_version string, decision_primitive string, distribution map<string,double>, confidence double, gold_label string, predicted_label string, latency_ms double, tokens_used struct<input:bigint,output:bigint>, raw_error string, execution_mode string, recorded_at timestamp"
    rows = [(i, "x", list(p), "a", "1", "t", {"same": 1.0}, 0.9, "same", "same", 1.0, (1, 1), None, "m", None) for i, p in enumerate(pairs)]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/evaluation_results.parquet")
    got = {r.id for r in registry.queries()["c5_purge_components"](spark, str(tmp_path)).collect()}
    assert got == {5, 6}
    assert {r.id for r in registry.queries()["c5_purge_groups"](spark, str(tmp_path)).collect()} - got == {0, 2, 3, 4}  # the shortcut
