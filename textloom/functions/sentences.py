"""Sentence ends and chunk bounds of raw text: what the built-in functions cannot say, in vectorised Python functions."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a full stop abbreviates.
ABBREVIATIONS = frozenset(
    """mr mrs ms dr prof sr jr vs etc inc ltd corp co no vol rev gen col lt st ave blvd dept univ assn bros ph ed est approx govt
    jan feb mar apr jun jul aug sep oct nov dec""".split()
)
_STOP = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)|[。！？]+")
_NEXT = re.compile(r"\s*(\S?)")
_LINE = re.compile(r"\n\s*(?=(?:#{1,6}\s|[-*+]\s|\d+\.\s|>|\S))")


def _held(text: str, at: int) -> bool:
    """Whether the stop at `at` belongs to what it follows: an initial, the number of a list item, or an address of the web."""
    begin = at
    while begin and not text[begin - 1].isspace():
        begin -= 1
    word = text[begin:at].lstrip("([{\"'")
    if len(word) == 1 and "A" <= word <= "Z":
        return text[at] == "."
    if word.isdecimal() and text[at] == ".":
        line = text.rfind("\n", 0, begin) + 1
        return not text[line:begin].strip()
    return "://" in word or word.startswith("www.")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence: cut behind . ! ? unless held, abbreviated or followed by a small letter, and at lines."""
    cuts = {m.start() + 1 for m in _LINE.finditer(text)}
    for m in _STOP.finditer(text):
        word = re.search(r"(\w+)$", text[max(0, m.start() - 20) : m.start()])
        after = _NEXT.match(text, m.end())[1]
        if _held(text, m.start()) or m[0].startswith(".") and word and word[1].lower() in ABBREVIATIONS or after.islower():
            continue
        cuts.add(m.end())
    out, at = [], 0
    for cut in [*sorted(cuts), len(text)]:
        part = text[at:cut]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((at + lead, at + len(part.rstrip())))
        at = cut
    return out


def chunk_spans(text: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of about `size` characters: cut at the sentence end nearest to it within a fifth, else at white space, else there."""
    ends = [b for _, b in sentence_spans(text)]
    out, at = [], 0
    while at < len(text):
        target, around = at + size, max(1, size // 5)
        if target >= len(text):
            out.append((at, len(text)))
            break
        near = [e for e in ends[bisect_left(ends, max(at + 1, target - around)) : bisect_left(ends, target + around + 1)]]
        if near:
            cut = min(near, key=lambda e: (abs(e - target), e))
        else:
            space = re.compile(r"\s").search(text, target, target + around)
            cut = space.end() if space else target
        out.append((at, cut))
        at = cut
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def sentences(text: pd.Series) -> pd.Series:
    """Sentence spans of each text; null has none."""
    return text.map(lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t or "")])


def chunks(text: Column, size: int) -> Column:
    """Spans of chunks of about `size` characters."""

    @F.pandas_udf(_SPANS)
    def cut(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"start": a, "end": b} for a, b in chunk_spans(x or "", size)])

    return cut(text)


def shifted(items: Column, offset: Column) -> Column:
    """Spans of a chunk moved to their place in the text."""
    return F.transform(items, lambda x: x.withField("start", x["start"] + offset).withField("end", x["end"] + offset))
