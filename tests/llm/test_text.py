"""Text operators against plain implementations, with nulls, empty and long texts, ties, empty tables and extra columns."""

import base64
import os
import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import bpe, forms, packing, pieces, queries, words

VOCABULARY = os.path.exists(queries.VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_forms_equal_composition(rows):
    got = forms.canonical_array(pa.array(rows, type=pa.string())).to_pylist()
    for text, form in zip(rows, got, strict=True):
        if text is None:
            assert form is None
        elif not any(0xAC00 <= ord(c) < 0xD7A4 or 0x1100 <= ord(c) < 0x1200 for c in text):
            assert form == unicodedata.normalize("NFC", "".join(forms._replacement(c) for c in text))


def test_forms_look():
    same = [("Ｒamona", "Ramona"), ("Ѕuѵоfіg", "Suvofig"), ("áb", "áb"), ("re​bor­ite", "reborite"), ("a　b", "a b"), ("ﬁne", "fine"), ("x‑y", "x-y"), ("각", "각")]
    other = [("a  b", "a b"), ("Ab", "ab"), ("á", "a"), ("colour", "color"), ("ab ", "ab")]
    f = lambda x: forms.canonical_array(pa.array([x]))[0].as_py()
    assert all(f(a) == f(b) for a, b in same) and all(f(a) != f(b) for a, b in other)
    assert f("") == "" and forms.canonical_array(pa.array([], pa.string())).to_pylist() == []
    assert f("Ａ" * 100_000) == "A" * 100_000


def test_folded_words():
    rows = ["Layered defi-\nciency Dedáis", None, "", " . ", "НИНА нина", "<b>x</b>", "52.8%"]
    assert words.folded_array(pa.array(rows)).to_pylist()[:4] == ["layered deficiency dedais", None, "", ""]
    a, b = words.folded_array(pa.array(rows)).to_pylist()[4].split()
    assert a == b
    w = words.words(pa.array(rows))
    assert [int(x) for x in w.bounds[1:] - w.bounds[:-1]] == [3, 0, 0, 0, 2, 3, 2]


@pytest.mark.skipif(not VOCABULARY, reason="no vocabulary file")
def test_bpe_equals_public_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["'s", "'ll", "'re", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'", "a", "Zq", "9", "½", "中文", "é", "’", "!!", "'S", "²", "𝐀", "😀", "ing", "<|endoftext|>"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "a" * 5000, "xy" * 3000, "中" * 3000]
    # single pre-tokens above the length from which they are merged by themselves, of letters in which many merges apply
    for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ab", "aaab", "éüñç", "中文字"):
        rows += ["".join(rng.choices(letters, k=rng.randrange(400, 2500))) for _ in range(6)]
    words = ["the", "ing", "tion", "er", "on", "ss", "and"]
    rows += ["".join(rng.choice(words) for _ in range(400)) for _ in range(6)]
    e = bpe.Encoder(open(queries.VOCABULARY, "rb").read())
    want = [plain.encode_ordinary(x or "") for x in rows]
    assert e.encode(pa.array(rows)).to_pylist() == want
    assert e.counts(pa.array(rows)).to_pylist() == [len(x) for x in want]
    assert e.encode(pa.array([], pa.string())).to_pylist() == []
    e.forget()
    assert e.encode(pa.array(rows[:50])).to_pylist() == want[:50]


@pytest.mark.skipif(not VOCABULARY, reason="no vocabulary file")
def test_token_columns(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x")], "doc_id int, text string, ids string")
    got = {r.doc_id: (r.n, r.t) for r in df.select("doc_id", bpe.token_count(spark, "text", queries.VOCABULARY).alias("n"), bpe.token_ids(spark, "text", queries.VOCABULARY).alias("t")).collect()}
    assert got == {1: (2, [15496, 995]), 2: (0, []), 3: (0, [])}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_fills_every_slot_once(histogram):
    slots = packing.plan(histogram, 64)
    load, seen = {}, {s: 0 for s in histogram}
    import numpy as np

    for s, n in histogram.items():
        for rank in range(n):
            at = int(np.searchsorted((slots.size << 40) | slots.lo, (s << 40) | rank, side="right")) - 1
            assert slots.size[at] == s
            c = int(slots.base[at] + (rank - slots.lo[at]) // slots.each[at])
            load[c] = load.get(c, 0) + s
            seen[s] += 1
    total = sum(s * n for s, n in histogram.items())
    assert seen == histogram and all(v <= 64 for v in load.values()) and len(load) == slots.containers
    assert slots.containers <= 2 * -(-total // 64)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 50, 700, 2048, 2049, 6000, None]), "x") for i in range(500)] + [(1000 + i, 333, "x") for i in range(400)]
    out = packing.packed(spark.createDataFrame(rows, "k int, n int, container_id string").select("k", "n", "container_id"), "k", "n").toPandas()
    assert out.groupby("container_id").piece_size.sum().max() <= 2048
    sums = out.groupby("k").piece_size.sum().to_dict()
    assert sums == {k: n for k, n, _ in rows if n}
    assert (out[out.piece_size == 0].empty) and not out.duplicated(["k", "piece"]).any()
    whole = out.groupby("k").size()
    assert all(whole[k] == max(1, -(-n // 2048)) for k, n, _ in rows if n)
    total = sum(n or 0 for _, n, _ in rows)
    assert out.container_id.nunique() <= 1.05 * -(-total // 2048) + 1 and out.container_id.max() == out.container_id.nunique() - 1
    assert packing.packed(spark.createDataFrame([], "k int, n int"), "k", "n").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n#中。́", max_size=400), st.integers(30, 80))
def test_pieces_round_trip(text, limit):
    got = pieces.cut(text, limit, 4, 10)
    if not text:
        assert got == []
        return
    back = text[got[0][0] : got[0][1]]
    for (_, e), (s, f) in zip(got, got[1:], strict=False):
        assert 4 <= e - s <= 10 and f - s <= limit
        back += text[e:f]
    assert back == text and got[0][1] <= limit


def test_pieces_boundaries(spark):
    text = ("Sentence one is here. " * 100).strip()
    for s, e in pieces.cut(text)[:-1]:
        assert text[e - 1] == "." and text[s] == "S"
    df = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "short", 5)], "id int, item string, start int").drop("start")
    rows = pieces.pieces(df, "item").orderBy("id", "piece_no").collect()
    assert {r.id for r in rows} == {1, 4} and "".join(r.piece[r.overlap :] for r in rows if r.id == 1) == text
    with pytest.raises(ValueError):
        pieces.cut("x", 100, 10, 60)
