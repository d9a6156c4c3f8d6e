"""Oversized items cut at natural boundaries (problem 3).

A recursive hierarchy of separators: section, paragraph, sentence, word, character. From each start, a piece ends at the last
boundary of the highest level that lies within the limit and beyond the overlap, so whole sections, paragraphs or sentences
are packed greedily; the next piece starts within the overlap before that end, at a sentence or word start where there is
one. Everything is counted in code points. Only items above the limit reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, LEAST, MOST = 1200, 80, 200
# Separators from the widest to the narrowest; the first group is the end of what stands before.
LEVELS = [
    re.compile(r"(?<=\S)()\s*(?:\f|\n[ \t]*\n[ \t]*\n|\n(?=[ \t]*(?:#{1,6}[ \t]|={3,}|-{3,}|\*{3,})))"),
    re.compile(r"(?<=\S)()[ \t]*(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)"),
    re.compile(r"(?:[.!?…]+[\"'”’)\]]*()(?=\s))|(?:[。！？]+[”’」』）]*())"),
    re.compile(r"(?<=\S)()(?=\s)"),
]


def _ends(text: str, level: int) -> list[int]:
    return [m.start(m.lastindex or 1) for m in LEVELS[level].finditer(text)]


def cut(text: str, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """Start and end of each piece. Pieces are at most `limit` long; consecutive ones share `least` to `most` characters.

    Needs 0 <= least <= most and limit > 2 * most. An item within the limit is one piece, "" has none.
    """
    if not 0 <= least <= most or limit <= 2 * most:
        raise ValueError("the limit must exceed twice the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    ends = [_ends(text, k) for k in range(len(LEVELS))]
    sentence_starts = [m.end() for m in re.finditer(r"(?:[.!?…][\"'”’)\]]*\s+)|(?:[。！？][”’」』）]*\s*)|\n\s*", text)]
    word_starts = [m.start() for m in re.finditer(r"(?<=\s)\S", text)]
    out, start = [], 0
    while n - start > limit:
        end = start + limit
        for level in ends:
            i = bisect_right(level, end) - 1
            if i >= 0 and level[i] > start + most:
                end = level[i]
                break
        else:
            while end > start + most + 1 and unicodedata.combining(text[end]):  # marks stay with their letter
                end -= 1
        out.append((start, end))
        start = end - least
        for starts in (sentence_starts, word_starts):
            lo, hi = bisect_left(starts, end - most), bisect_right(starts, end - least)
            if hi > lo:
                start = starts[hi - 1]
                break
    out.append((start, n))
    return out


_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("piece", T.StringType())]))


def pieces(items: DataFrame, text: str, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Replaces `text` by piece_no (from 0), start, overlap, n_chars and piece, a row for each piece of each item.

    overlap is what a piece shares with the one before it (0 for the first); a piece without its first `overlap` characters,
    appended to the pieces before, gives the item back. Null and empty items have no pieces.
    """

    @F.arrow_udf(_PIECES)
    def cut_long(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [{"start": a, "piece": t[a:b]} for a, b in cut(t, limit, least, most)] for t in texts.to_pylist()]
        return pa.array(rows, type=pa.list_(pa.struct([("start", pa.int32()), ("piece", pa.string())])))

    others = [c for c in items.columns if c != text]
    long = items.where(F.length(text) > limit).withColumn("_cut", cut_long(text))
    short = items.where(F.length(text).between(1, limit)).withColumn("_cut", F.array(F.struct(F.lit(0).alias("start"), F.col(text).alias("piece"))))
    out = long.unionByName(short).select(*others, F.posexplode("_cut").alias("piece_no", "_p"), "_cut")
    before = F.try_element_at("_cut", F.when(F.col("piece_no") > 0, F.col("piece_no")))
    shared = F.coalesce(before["start"] + F.length(before["piece"]) - F.col("_p")["start"], F.lit(0))
    return out.select(*others, "piece_no", F.col("_p")["start"].alias("start"), shared.alias("overlap"), F.length(F.col("_p")["piece"]).alias("n_chars"), F.col("_p")["piece"].alias("piece"))
