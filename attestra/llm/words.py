"""Words of texts as arrays: one fold for all operators that compare wording.

The fold drops what doesn't change the wording: forms of characters, accents, case, punctuation, markup, and words
divided at a line end. A word is a run of letters or of digits, or two neighbouring ideographs.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _mixed
from .forms import LOOKALIKES, TOP, as_strings, code_points, tables

GAP, ALPHA, DIGIT, IDEO = 0, 1, 2, 3


def unmarked(text: Column) -> Column:
    """Text with tags and character entities as blanks."""
    return F.regexp_replace(text, r"<[/!?]?[A-Za-z][^<>]*>|&#?[A-Za-z0-9]{1,10};", " ")


class Fold(NamedTuple):
    start: np.ndarray
    length: np.ndarray
    body: np.ndarray
    kind: np.ndarray


@lru_cache(maxsize=1)
def fold_table() -> Fold:
    """Code points to their folded letters: the visual form, decomposed, without marks, case-folded."""
    t = tables()
    start, length, body, extra = t.start.copy(), t.length.copy(), [t.body], []
    kind = np.zeros(TOP, dtype=np.uint8)
    base = len(t.body)
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or cp >= 0x20000:
            continue
        ch = chr(cp)
        visual = own = "".join(map(chr, t.body[t.start[cp] : t.start[cp] + t.length[cp]]))
        if own == ch and ch.upper() in LOOKALIKES:  # a small letter whose capital looks like another: case must not matter
            own = LOOKALIKES[ch.upper()].lower()
        folded = "".join(c for c in unicodedata.normalize("NFD", own.casefold()) if not unicodedata.category(c).startswith("M"))
        # what folds to a look-alike after case folding looks like it too
        folded = "".join("".join(map(chr, t.body[t.start[ord(c)] : t.start[ord(c)] + t.length[ord(c)]])) for c in folded)
        if folded != visual:
            start[cp], length[cp] = base + len(extra), len(folded)
            extra.extend(map(ord, folded))
        cat = unicodedata.category(ch)
        kind[cp] = ALPHA if cat[0] == "L" else DIGIT if cat == "Nd" else GAP
    kind[0x3400:0xA000] = kind[0x20000:0x30000] = IDEO
    kind[0x3041:0x3097] = kind[0x30A1:0x30FB] = IDEO
    kind[0xAC00:0xD7A4] = ALPHA
    body.append(np.array(extra, dtype=np.int32))
    return Fold(start, length, np.concatenate(body), kind)


def folded(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points, their rows, and their kinds; words divided by a hyphen at a line end are joined."""
    t = fold_table()
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(points) > 3:
        p = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
        kinds = t.kind[p]
        n = len(points)
        dash = (p[:n] == 0x2D) | (p[:n] == 0xAD) | (p[:n] == 0x2010)
        lf = p[1 : n + 1] == 0x0A
        crlf = (p[1 : n + 1] == 0x0D) & (p[2 : n + 2] == 0x0A)
        after = np.where(lf, kinds[2 : n + 2], np.where(crlf, kinds[3 : n + 3], GAP))
        before = np.concatenate([[GAP], kinds[: n - 1]])
        cut = np.flatnonzero(dash & (after == ALPHA) & (before == ALPHA))
        if len(cut):
            keep = np.ones(n, dtype=bool)
            keep[cut] = keep[cut + 1] = False
            keep[cut[crlf[cut]] + 2] = False
            points, row = points[keep], row[keep]
    size = t.length[points]
    total = int(size.sum())
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    points = t.body[np.repeat(t.start[points], size) + within]
    row = np.repeat(row, size)
    return points, row, t.kind[points]


class Words(NamedTuple):
    """Words of a batch: 64-bit hashes in text order, and each row's bounds among them."""

    hashes: np.ndarray
    bounds: np.ndarray


_position = _mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def words(array: pa.Array) -> Words:
    """The words of each row of an Arrow string array; null and blank rows have none."""
    points, bounds = code_points(array.fill_null("") if array.null_count else array)
    n = len(bounds) - 1
    points, row, kind = folded(points, bounds)
    if not len(points):
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64))
    prev = np.concatenate([[GAP], kind[:-1]])
    first = np.concatenate([[True], row[1:] != row[:-1]])
    start = np.flatnonzero((kind != GAP) & ((prev != kind) | first | (kind == IDEO)))
    inside = kind != GAP
    own = points[inside]
    place = np.cumsum(inside) - 1
    begin = place[start]
    if not len(begin):
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64))
    size = np.diff(np.append(begin, len(own)))
    within = np.arange(len(own)) - np.repeat(begin, size)
    terms = _mixed(own.astype(np.uint64) + np.uint64(1)) * _position[within & 4095]
    hashes = _mixed(np.add.reduceat(terms, begin) + size.astype(np.uint64))
    # ideographs are few and recur: two neighbours make a word
    ideo = kind[start] == IDEO
    pair = np.flatnonzero(ideo[:-1] & ideo[1:] & (np.diff(start) == 1) & (row[start[:-1]] == row[start[1:]]))
    if len(pair):
        joined = hashes.copy()
        joined[pair] = _mixed(hashes[pair] * np.uint64(3) + hashes[pair + 1])
        hashes = joined
    return Words(hashes, np.searchsorted(row[start], np.arange(n + 1)))


def folded_array(array: pa.Array) -> pa.Array:
    """Each text as its folded words with single blanks between; null stays null, no words give ""."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    valid = np.asarray(array.is_valid())
    points, bounds = code_points(array.fill_null("") if array.null_count else array)
    n = len(bounds) - 1
    points, row, kind = folded(points, bounds)
    prev = np.concatenate([[GAP], kind[:-1]]) if len(kind) else kind
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(kind) else np.zeros(0, dtype=bool)
    start = (kind != GAP) & ((prev != kind) | first | (kind == IDEO))
    keep = kind != GAP
    points, row, start = points[keep], row[keep], start[keep]
    lead = start & np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else start
    size = 1 + lead.astype(np.int64)
    out = np.full(int(size.sum()), 0x20, dtype=np.int32)
    out[np.cumsum(size) - 1] = points
    counts = np.bincount(row, weights=size, minlength=n).astype(np.int64) if len(row) else np.zeros(n, dtype=np.int64)
    return as_strings(out, np.concatenate([[0], np.cumsum(counts)]), valid)


@F.arrow_udf(T.StringType())
def _folded(array: pa.Array) -> pa.Array:
    return folded_array(array)


def plain_words(text: Column | str) -> Column:
    """Column of the folded words of a text."""
    return _folded(unmarked(F.col(text) if isinstance(text, str) else text))
