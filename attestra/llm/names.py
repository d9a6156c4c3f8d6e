"""Variant spellings of names typed by people (problem 6).

A mention is read as a person, organisation, protein or compound: its rare name (surname, place, stem) and what must agree
besides (given name, kind and field, number and letter, position and substituent). The parts are found by their places in
the mention; lists serve only for short forms and for typing errors in common words. Names are blocked by phonetic codes of
their sorted tokens: the consonants in classes, with each single deletion, so that names one typing error apart share a
block. Pairs of a block that agree in the rest are compared by Jaro-Winkler similarity and edit distance; accepted pairs
are clustered by connected components. Short forms (initials of given names, abbreviated fields, acronyms) join the one
group they fit, and stay by themselves where several fit. Spellings are compared once each, however many mentions have them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from . import strings
from .forms import canonical_array
from .grouping import boruvka
from .words import folded_array

# Given names with their short forms.
NICKNAMES = """
alexander alex sasha; andrew andy drew; anthony tony; barbara barb babs; benjamin ben benny; catherine cathy;
charles charlie chuck; christopher chris kit; daniel dan danny; david dave; deborah debbie deb; donald don;
dorothy dot dottie; edward ned ed eddie; elizabeth liz beth betty eliza; frances fran; frederick fred freddy;
gregory greg; harold harry hal; helena lena; henry hank; jacqueline jackie; james jim jimmy; jennifer jen jenny;
john jack; jonathan jon; joseph joe joey; katherine kate kathy katie; kenneth ken; lawrence larry; leonard len lenny;
lillian lily lil; margaret peggy meg maggie; martin marty; matthew matt; michael mike mick; nicholas nick;
pamela pam; patricia trish pat patty; peter pete; philip phil pip; ramona mona; raymond ray; rebecca becky becca;
richard dick rick; robert bob rob bobby; ronald ron; samuel sam sammy; stephen steve; susan sue susie;
theodore ted teddy theo; thomas tom tommy; timothy tim; ulrich uli; victoria vicky vic; walter walt;
william bill will billy; анна аня; алексей лёша; борис боря; виктор витя; дмитрий дима; екатерина катя; елена лена;
иван ваня; ирина ира; мария маша; михаил миша; наталья наташа; николай коля; ольга оля; павел паша; пётр петя;
роман рома; сергей серёжа; юлия юля; юрий юра
"""
TITLES = "dr prof professor mr mrs ms sir phd md jr sr"
PARTICLES = "von van der den de del della di da du la le ter ten zu zum zur"
# Kinds of organisations with their short forms, and legal forms.
BODIES = """
academy acad; association assoc assn; centre center ctr; college coll; council; department dept; faculty fac; foundation
fdn found; hospital hosp; institute inst; laboratory lab labs laboratories; museum mus; school sch; society soc;
university univ
"""
LEGAL = "inc ltd gmbh llc ag corp co plc sa bv"
LINKS = "of for the and in on"
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
GREEK_LETTERS = "αβγδεζηθικλμνξοπρστυφχψω"
SUBSTITUENTS = "acetyl allyl benzoyl benzyl butyl ethyl formyl methyl pentyl phenyl propargyl propyl tosyl vinyl"
POSITIONS = "c n o p s"
# Consonants that are easily heard alike, by class.
SOUNDS = "bp cgjkqx dt fvw lr mn sz"


def _table(rows: str) -> dict[str, str]:
    """Short and full forms to the full form, folded like the mentions."""
    out = {}
    for row in rows.split(";"):
        forms = [f for f in folded_array(pa.array(row.split())).to_pylist() if f]
        for form in forms:
            out.setdefault(form, forms[0])
    return out


@lru_cache(maxsize=1)
def _lists() -> dict[str, dict[str, str]]:
    same = lambda words: {w: w for w in folded_array(pa.array(words.split())).to_pylist()}
    return {"given": _table(NICKNAMES), "body": _table(BODIES), "greek": same(GREEK), "sub": same(SUBSTITUENTS)}


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two strings; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    old, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, old, row = old, row, [i]
        for j, y in enumerate(b, 1):
            v = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if older is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most and min(old) > most:
            return most + 1
    return min(row[-1], most + 1)


@lru_cache(maxsize=65536)
def _corrected(token: str, kind: str) -> str | None:
    """The full form of the list entry that a token stands for, typing errors allowed; None if none is near."""
    known = _lists()[kind]
    if token in known:
        return known[token]
    if len(token) < 4:
        return None
    most = 1 if len(token) < 7 else 2
    near = {}
    for entry, full in known.items():
        if len(entry) >= 4 and (d := edits(token, entry, most)) <= most:
            near[full] = min(d, near.get(full, 9))
    if not near:
        return None
    best = min(near.values())
    first = [f for f, d in near.items() if d == best]
    return first[0] if len(first) == 1 else None


def sound_code(name: str) -> str:
    """The consonants of a name's sorted tokens as classes, doubled ones once; names without consonants as they are."""
    known = _sounds()
    out = []
    for token in sorted(name.split()):
        for i, ch in enumerate(token):
            c = known.get(ch, ch)
            if c and token[i - 1 : i] != ch:
                out.append(c)
    return "".join(out) or name


@lru_cache(maxsize=1)
def _sounds() -> dict[str, str]:
    out = {ch: group[0] for group in SOUNDS.split() for ch in group}
    return out | dict.fromkeys("aeiouyаеёиоуыэюяйъь", "")


def block_codes(name: str) -> list[str]:
    """The sound code and each code with one sound less."""
    code = sound_code(name)
    return sorted({code} | {code[:i] + code[i + 1 :] for i in range(len(code))}) if len(code) > 2 else [code]


def _substituent(token: str) -> tuple[str, str] | None:
    """Substituent and rest of a token that begins with one, a typing error in it allowed."""
    for sub in sorted(_lists()["sub"], key=len, reverse=True):
        if token.startswith(sub):
            return sub, token[len(sub) :]
    for sub in sorted(_lists()["sub"], key=len, reverse=True):
        for n in (len(sub), len(sub) - 1, len(sub) + 1):
            if len(token) >= n and edits(token[:n], sub, 1) <= 1:
                return sub, token[n:]
    return None


def parse(text: str, folded: str) -> tuple[str, str, str, str] | None:
    """(kind, name, rest, middle) of a mention, or None for one without letters or digits.

    text: the mention with Greek letters spelled out; folded: its folded words.
    """
    tokens = folded.split()
    if not tokens:
        return None
    letters = [t for t in tokens if len(t) == 1]
    # compounds: a position letter, a substituent and a stem, in any order
    if letters and letters[0] in POSITIONS.split() and not any(t.isdigit() for t in tokens):
        for i, token in enumerate(tokens):
            if len(token) > 3 and (cut := _substituent(token)):
                stem = "".join([cut[1], *(t for j, t in enumerate(tokens) if j != i and len(t) > 1)])
                if len(stem) >= 5 and _corrected(token, "given") is None:
                    return "compound", stem, f"{letters[0]} {cut[0]}", ""
        # an unknown substituent stands after the letter, or first where the letter is last
        long = [t for t in tokens if len(t) > 1]
        if len(long) == 2 and len(letters) == 1 and re.search(rf"(?i)(?<!\w){letters[0]}-|\({letters[0]}\)", text):
            sub = long[0] if tokens[-1] == letters[0] else tokens[tokens.index(letters[0]) + 1]
            return "compound", long[1 - long.index(sub)], f"{letters[0]} {sub}", ""
    # proteins: a stem, a number and a Greek letter
    numbers = [t for t in tokens if t.isdigit()]
    greek = [(i, g) for i, t in enumerate(tokens) if (g := _corrected(t, "greek"))]
    if numbers and greek:
        stem = "".join(t for i, t in enumerate(tokens) if i != greek[0][0] and not t.isdigit())
        if stem:
            return "protein", stem, f"{' '.join(numbers)} {greek[0][1]}", ""
    words = [t for t in tokens if t not in LEGAL.split()] or tokens
    # organisations: a place, a kind and fields, or their initials with the place in parentheses
    initials = re.fullmatch(r"\s*(\w{3,6})\s*\(([^()]+)\)\s*", text)
    if initials and len(tokens) >= 2 and tokens[0] and tokens[0][0] == tokens[1][0] and len(tokens[0]) <= 6:
        return "acronym", " ".join(sorted(tokens[1:])), tokens[0][1], "".join(sorted(tokens[0][2:]))
    words = [t for t in words if t not in LINKS.split()] or words
    body = [(i, b) for i, t in enumerate(words) if (b := _lists()["body"].get(t))]
    body = body or [(i, b) for i, t in enumerate(words) if (b := _corrected(t, "body"))]
    if body and len(words) > 1:
        at, kind = body[0]
        rest = [t for i, t in enumerate(words) if i != at]
        # the place stands behind a comma or last where the kind comes first, and else first
        place = rest.pop(-1 if at == 0 else 0)
        # fields cut to a few letters, each with its point
        cut = bool(rest) and len(re.findall(r"\w{2,5}\.", text)) > len(rest)
        return "cut" if cut else "org", place, kind, " ".join(sorted(rest))
    # persons: surname, given name or initial, middle initials
    words = [t for t in words if t not in TITLES.split()] or words
    full = [t for t in words if len(t) > 1 and t not in PARTICLES.split()]
    given = next((i for i, t in enumerate(full) if t in _lists()["given"]), None) if len(full) > 1 else None
    if given is None and len(full) > 1:
        given = next((i for i, t in enumerate(full) if _corrected(t, "given")), None)
    single = [t for t in words if len(t) == 1]
    if given is not None:
        name = " ".join(sorted(t for i, t in enumerate(full) if i != given))
        return "person", name, _corrected(full[given], "given"), "".join(single[:1])
    if full and single:
        if len(full) == 1:
            return "person", full[0], f"{single[0]}.", "".join(single[1:2])
        behind = re.fullmatch(r"[^,]*,((?:\s*\w\b\.?)+)\s*", text)  # nothing but initials behind a comma
        if len(full) > 2 or behind or re.search(r"\w\w[-\u2010\u2011]\w\w", text):
            return "person", " ".join(sorted(full)), f"{single[0]}.", "".join(single[1:2])
    if len(full) in (2, 3) and not any(t.isdigit() for t in tokens):
        # a given name that is in no list, before or behind a surname of one word or two
        return "pair", " ".join(sorted(full)), "", "".join(single[:1])
    return "other", " ".join(sorted(words)), "", ""


_PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "rest", "middle")] + [T.StructField("codes", T.ArrayType(T.StringType()))])


@F.arrow_udf(_PARSED)
def _parsed(texts: pa.Array) -> pa.Array:
    rows = []
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    for text, folded in zip(canonical_array(texts).to_pylist(), folded_array(texts).to_pylist(), strict=True):
        got = parse(text, folded) if text is not None else None
        rows.append(None if got is None else dict(zip(("kind", "name", "rest", "middle"), got, strict=True)) | {"codes": block_codes(got[1])})
    return pa.array(rows, type=pa.struct([("kind", pa.string()), ("name", pa.string()), ("rest", pa.string()), ("middle", pa.string()), ("codes", pa.list_(pa.string()))]))


@F.arrow_udf(T.IntegerType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of names whose Jaro-Winkler similarity is at least 0.85, else 9."""
    (x, n), (y, m) = strings.matrix(a), strings.matrix(b)
    out = np.full(len(n), 9, dtype=np.int32)
    at = np.flatnonzero(np.bitwise_count(strings.letters(x) ^ strings.letters(y)) <= 4)  # two errors change four letters at most
    at = at[strings.jaro_winkler(x[at], n[at], y[at], m[at]) >= 0.85]
    out[at] = strings.edits(x[at], n[at], y[at], m[at])
    return pa.array(out)


def fields_agree(a: str, b: str) -> bool:
    """Whether two lists of fields name the same ones, a typing error in each allowed."""
    left = b.split()
    for w in a.split():
        most = 1 if len(w) < 6 else 2
        near = min(((edits(w, x, most), x) for x in left), default=None)
        if near is None or near[0] > most:
            return False
        left.remove(near[1])
    return not left


def short_fits(kind: str, rest: str, middle: str, full_rest: str, full_middle: str) -> bool:
    """Whether a cut form or an acronym (its kind, rest and middle) stands for a body of that kind and those fields."""
    if kind == "acronym":
        return full_rest[:1] == rest and "".join(sorted(w[0] for w in full_middle.split())) == middle
    left = full_middle.split()
    for w in middle.split():
        fit = next((x for x in left if x.startswith(w)), None) or next((x for x in left if edits(x[: len(w)], w, 1) <= 1), None)
        if fit is None:
            return False
        left.remove(fit)
    return rest == full_rest and not left


def _each_once(function, *columns: pa.Array) -> pa.Array:
    """A function of strings over columns, called once for each distinct combination."""
    known: dict[tuple, bool] = {}
    rows = zip(*[c.to_pylist() for c in columns], strict=True)
    return pa.array([known[k] if k in known else known.setdefault(k, function(*k)) for k in rows], type=pa.bool_())


@F.arrow_udf(T.BooleanType())
def _agree(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each_once(fields_agree, a, b)


@F.arrow_udf(T.BooleanType())
def _fits(kind: pa.Array, rest: pa.Array, middle: pa.Array, full_rest: pa.Array, full_middle: pa.Array) -> pa.Array:
    return _each_once(short_fits, kind, rest, middle, full_rest, full_middle)


def spelled_greek(text: Column) -> Column:
    """Single Greek letters as words; an apostrophe inside a name is dropped."""
    for name, letter in zip(GREEK.split(), GREEK_LETTERS, strict=True):
        text = F.regexp_replace(text, rf"(?<!\p{{L}}){letter}(?!\p{{L}})", f" {name} ")
    return F.regexp_replace(text, r"(?<=\p{L})['’ʼ](?=\p{L})", "")


def near_enough(distance: Column, a: str, b: str) -> Column:
    """One error in a name, two in one of ten letters or more."""
    return (distance <= 1) | ((distance == 2) & (F.least(F.length(a), F.length(b)) >= 10))


@F.arrow_udf(T.BooleanType())
def _both_near(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two names of two or three words each: whether all words are near, with one error in a word of five letters or more and
    two in one of ten."""
    out = np.ones(len(a), dtype=bool)
    for i in range(3):
        (x, n), (y, m) = [strings.matrix(pc.list_element(pc.split_pattern(pc.binary_join_element_wise(c, "  ", ""), " "), i)) for c in (a, b)]
        d = strings.edits(x, n, y, m)
        out &= (d == 0) | ((d == 1) & (np.maximum(n, m) >= 5)) | ((d == 2) & (np.minimum(n, m) >= 10))
    return pa.array(out)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _codes(names: pa.Array) -> pa.Array:
    return pa.array([block_codes(n) for n in names.to_pylist()], type=pa.list_(pa.string()))


def linked(mentions: DataFrame, key: str, text: str) -> DataFrame:
    """key, group_id for each distinct key with a non-blank mention; equal group ids mean one entity.

    A person's mention with only an initial joins the one group of that surname and initial; where several persons fit, the
    middle initial decides, and where it doesn't, mentions with equal initials form a group of their own. A body's cut form or
    acronym joins the one body of that place which it fits. Two or three words without a known given name are a person
    whose given name may be any of them. Other mentions link where their words are the same in any order, up to one typing error. Null and
    blank mentions have no row; a key delivered twice counts once.
    """
    rows = mentions.select(F.col(key).alias("key"), spelled_greek(F.col(text)).alias("text")).where("key is not null and text is not null").distinct()
    forms = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")).repartition(F.col("text"))
    read = forms.select("text", _parsed("text").alias("p")).where("p is not null").select("text", "p.*")
    read = staged(read.withColumn("node", F.concat_ws("|", "kind", "rest", F.when(F.col("rest").endswith(".") | F.col("kind").isin("org", "cut", "acronym"), F.col("middle")).otherwise(""), "name")), "read")
    nodes = staged(read.groupBy("node", "kind", "rest", "name", F.when(F.col("kind").isin("org", "cut"), F.col("middle")).otherwise("").alias("fields")).agg(F.first("codes").alias("codes"), F.max("middle").alias("middle")), "nodes")
    coded = nodes.withColumn("code", F.explode("codes")).drop("codes")
    left = coded.select("kind", "rest", "code", F.col("node").alias("a"), F.col("name").alias("an"), F.col("fields").alias("af"))
    right = coded.select("kind", "rest", "code", F.col("node").alias("b"), F.col("name").alias("bn"), F.col("fields").alias("bf"))
    pairs = left.join(right, ["kind", "rest", "code"]).where("a < b").select("a", "b", "an", "bn", "af", "bf", (F.col("kind") == "pair").alias("two")).distinct()
    # of words without a known given name, each must be near by itself
    one, two = pairs.where("not two"), pairs.where("two")
    near = one.where(near_enough(_distance("an", "bn"), "an", "bn")).where(_agree("af", "bf")).unionByName(two.where(_both_near("an", "bn")))
    links = near.select("a", "b")
    groups = boruvka(links, "a", "b").select("node", "root")
    full = staged(nodes.select("node").join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "named")

    def attached(fits: DataFrame, full: DataFrame) -> DataFrame:
        """full with the short nodes s moved to the one root they fit; agree marks fits that decide where several do."""
        marked = fits.join(full, "node")
        chosen = marked.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.when(F.col("agree"), F.col("root"))).alias("mlo"), F.max(F.when(F.col("agree"), F.col("root"))).alias("mhi"))
        target = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("mlo") == F.col("mhi"), F.col("mlo"))
        chosen = chosen.select(F.col("s").alias("_s"), target.alias("_to")).where("_to is not null")
        old = full.join(chosen.select("_s"), F.col("node") == F.col("_s"), "left_semi").select(F.col("root").alias("_root"), F.col("node").alias("_node"))
        moved = old.join(chosen, F.col("_node") == F.col("_s")).groupBy("_root").agg(F.min("_to").alias("_lo"), F.max("_to").alias("_hi")).where("_lo = _hi")
        # the short forms of one group move together
        return full.join(moved, F.col("root") == F.col("_root"), "left").select("node", F.coalesce("_lo", "root").alias("root"))

    # initials: which groups of full given names fit
    persons = coded.where("kind = 'person'")
    whole = persons.where("not endswith(rest, '.')").select("node", "code", "name", F.substring("rest", 1, 1).alias("initial"), F.col("middle").alias("m"))
    twos = nodes.where("kind = 'pair'").withColumn("w", F.split("name", " "))
    for i in range(3):
        rest = F.array_join(F.concat(F.slice("w", 1, i), F.slice("w", i + 2, 2)), " ")
        two = twos.where(F.size("w") > i).select("node", rest.alias("name"), F.substring(F.get("w", F.lit(i)), 1, 1).alias("initial"), F.col("middle").alias("m"))
        whole = whole.unionByName(two.select("node", F.explode(_codes("name")).alias("code"), "name", "initial", "m"))
    short = persons.where("endswith(rest, '.')").select(F.col("node").alias("s"), "code", F.col("name").alias("sn"), F.substring("rest", 1, 1).alias("initial"), F.col("middle").alias("sm"))
    fits = short.join(whole, ["initial", "code"]).select("s", "sn", "sm", "node", "name", "m").distinct()
    fits = fits.where(near_enough(_distance("sn", "name"), "sn", "name")).select("s", "node", ((F.col("sm") != "") & (F.col("sm") == F.col("m"))).alias("agree"))
    full = staged(attached(fits, full), "named")
    # cut forms join full ones, acronyms both
    for kind in ("cut", "acronym"):
        bodies = coded.where("kind = 'org'" if kind == "cut" else "kind in ('org', 'cut')").select("node", "code", "name", F.col("rest").alias("full_rest"), "fields")
        short = coded.where(F.col("kind") == kind).select(F.col("node").alias("s"), "code", F.col("name").alias("sn"), "kind", "rest", "middle")
        fits = short.join(bodies, "code").drop("code").distinct()
        fits = fits.where(near_enough(_distance("sn", "name"), "sn", "name") & _fits("kind", "rest", "middle", "full_rest", "fields"))
        full = staged(attached(fits.select("s", "node", F.lit(False).alias("agree")), full), "named")
    final = full
    placed = read.select("text", "node").join(final, "node").select("text", "root")
    ids = staged(rows.join(placed, "text").select("key", "root").distinct(), "mentions")
    least = ids.groupBy("root").agg(F.min("key").alias("group_id"))
    return ids.join(least, "root").select(F.col("key").alias(key), "group_id")
