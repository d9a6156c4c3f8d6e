"""One form for texts that look the same (problem 2).

`canonical_array` maps an Arrow string array to its visual form: the UTF-8 buffer of the whole batch is decoded once to
a code-point array, a lookup table gives each code point its replacement (none, one or several code points), the pieces
are placed by their summed lengths, and combining marks are ordered and composed by array operations. No string
function is called per row.

The form: compatibility widths, ligatures and presentation forms are resolved, invisible characters vanish, every kind
of blank becomes one space, letters of other scripts that are drawn like a Latin letter become it, marks are composed
(NFC). Case, accents, spelling and the number of blanks stay as they are. null stays null, "" stays "".
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

# Letters drawn like Latin letters, by script, in natural order.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c",
    "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "а": "a",
    "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ү": "y", "ѵ": "v",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ԍ": "g", "ӏ": "l",
    # Armenian
    "Օ": "O", "օ": "o", "Տ": "S", "Ս": "U", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "ք": "p",
    # Latin beyond ASCII
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʏ": "y",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # punctuation
    "‐": "-", "‑": "-", "‘": "'", "’": "'", "ʼ": "'", "ʹ": "'", "′": "'", "“": '"', "”": '"',
}
BLANKS = "\t\n\v\f\r\x85  "
#: Kinds of compatibility mapping that keep the look of a text.
KINDS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>"}
FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍᠏⠀ㅤﾠ"
LONG_S = "ſ"
TOP = 0x110000
HANGUL, L0, V0, T0 = 0xAC00, 0x1100, 0x1161, 0x11A7


class Tables(NamedTuple):
    start: np.ndarray  # of each code point's replacement in `body`
    length: np.ndarray
    body: np.ndarray
    order: np.ndarray  # canonical combining class
    pairs: np.ndarray  # sorted (first << 21 | second)
    made: np.ndarray  # the composite of each pair


def _replacement(ch: str, depth: int = 0) -> str:
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    cat = unicodedata.category(ch)
    if cat == "Zs" or ch in BLANKS:
        return " "
    if cat in ("Cf", "Cc") or ch in FILLERS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    parts = unicodedata.decomposition(ch).split()
    if not parts or ch == LONG_S or depth > 8:
        return ch
    if parts[0].startswith("<"):
        if parts[0] not in KINDS:
            return ch
        parts = parts[1:]
        if len(parts) > 1 and parts[0] == "0020":  # a mark that stands alone
            return ch
    return "".join(_replacement(chr(int(p, 16)), depth + 1) for p in parts)


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Lookup tables, built by rule from the Unicode data of the interpreter."""
    start, length = np.arange(TOP, dtype=np.int32), np.ones(TOP, dtype=np.int32)
    order = np.zeros(TOP, dtype=np.uint8)
    extra: list[int] = []
    pairs: dict[int, int] = {}
    for cp in range(TOP):
        if 0xD800 <= cp < 0xE000 or HANGUL <= cp < HANGUL + 11172 or 0x4E00 <= cp < 0xA000 or 0x20000 <= cp < 0xE0000 and not unicodedata.decomposition(chr(cp)):
            continue
        if cp >= 0xE1000:
            break
        ch = chr(cp)
        order[cp] = unicodedata.combining(ch)
        to = _replacement(ch)
        if to != ch:
            start[cp], length[cp] = TOP + len(extra), len(to)
            extra.extend(map(ord, to))
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
    keys = np.array(sorted(pairs), dtype=np.int64)
    body = np.concatenate([np.arange(TOP, dtype=np.int32), np.array(extra, dtype=np.int32)])
    return Tables(start, length, body, order, keys, np.array([pairs[k] for k in keys], dtype=np.int32))


def code_points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows one after another, and the rows' bounds among them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    n = len(array)
    bounds = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
    lo, hi = int(bounds[0]), int(bounds[-1])
    raw = memoryview(data)[lo:hi] if data is not None and hi > lo else b""
    points = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    heads = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(heads)])
    return points, before[bounds - lo]


def as_strings(points: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of `code_points`; rows where `valid` is false come out null."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])
    offsets = ends[bounds].astype(np.int64)
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    return out.cast(pa.string())


def _gather(points: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    size = t.length[points]
    if (size == 1).all():
        return t.body[t.start[points]], row
    total = int(size.sum())
    first = np.cumsum(size) - size
    within = np.arange(total) - np.repeat(first, size)
    return t.body[np.repeat(t.start[points], size) + within], np.repeat(row, size)


def _arrange(points: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    """Puts runs of combining marks into canonical order."""
    kind = t.order[points]
    marks = np.flatnonzero(kind)
    if len(marks) < 2:
        return points
    run = np.cumsum(np.concatenate([[True], (np.diff(marks) > 1) | (np.diff(row[marks]) != 0)]))
    place = np.lexsort((np.arange(len(marks)), kind[marks], run))
    points = points.copy()
    points[marks] = points[marks[place]]
    return points


def _compose(points: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Composes each starter with its first unblocked mark, again and again until nothing composes."""
    while len(points) > 1:
        kind = t.order[points].astype(np.int16)
        at = np.arange(len(points))
        starter = np.maximum.accumulate(np.where(kind == 0, at, -1))
        j = at[1:]
        s = starter[j - 1]
        open_ = (s >= 0) & (row[np.maximum(s, 0)] == row[j]) & ((s == j - 1) | ((kind[j] > 0) & (kind[j - 1] < kind[j])))
        cand = j[open_ & ((kind[j] > 0) | (points[j] >= 0x0900))]
        if not len(cand):
            break
        sc = starter[cand - 1]
        a, b = points[sc].astype(np.int64), points[cand].astype(np.int64)
        k = np.minimum(np.searchsorted(t.pairs, a << 21 | b), len(t.pairs) - 1)
        hit = t.pairs[k] == (a << 21 | b)
        new = np.where(hit, t.made[k], 0)
        lv = (a >= L0) & (a < L0 + 19) & (b >= V0) & (b < V0 + 21)
        new = np.where(lv, HANGUL + ((a - L0) * 21 + (b - V0)) * 28, new)
        lvt = (a >= HANGUL) & (a < HANGUL + 11172) & ((a - HANGUL) % 28 == 0) & (b > T0) & (b < T0 + 28)
        new = np.where(lvt, a + (b - T0), new)
        ok = new > 0
        if not ok.any():
            break
        cand, sc, new = cand[ok], sc[ok], new[ok]
        sc, first = np.unique(sc, return_index=True)
        points = points.copy()
        points[sc] = new[first]
        keep = np.ones(len(points), dtype=bool)
        keep[cand[first]] = False
        points, row = points[keep], row[keep]
    return points, row


def canonical_points(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The visual form of rows given as code points and bounds."""
    t, n = tables(), len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    points, row = _gather(points, row, t)
    if (points > 0x2FF).any():
        points = _arrange(points, row, t)
        points, row = _compose(points, row, t)
    return points, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def canonical_array(array: pa.Array) -> pa.Array:
    """The visual form of every row of an Arrow string array."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    valid = np.asarray(array.is_valid())
    filled = array.fill_null("") if array.null_count else array
    points, bounds = canonical_points(*code_points(filled))
    return as_strings(points, bounds, valid)


@F.arrow_udf(T.StringType())
def _canonical(array: pa.Array) -> pa.Array:
    return canonical_array(array)


def visual_form(text: Column | str) -> Column:
    """Column of the visual form. Equal forms mean texts that look the same; null gives null."""
    return _canonical(F.col(text) if isinstance(text, str) else text)
