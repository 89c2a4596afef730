"""Filters shared by the analyses, as column builders: search modes, parts of speech, stop words, ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.tokens import STOPWORDS


def lines_of(value: str | Iterable[str]) -> list[str]:
    """A word list given as lines of text or as a list; trimmed, lower-cased, blanks dropped."""
    parts = value.split("\n") if isinstance(value, str) else value
    return sorted({p.strip().lower() for p in parts if p and p.strip()})


def search(column: Column, kind: str = "all", value: str | Iterable[str] = "") -> Column:
    """all, exact, starts, ends, contains, regex or wordlist; without regard to case. A bad regex matches nothing."""
    low = F.lower(column)
    if kind == "all" or not value:
        return F.lit(True)
    if kind == "wordlist":
        return low.isin(lines_of(value))
    if kind == "regex":
        try:
            re.compile(str(value))
        except re.error:
            return F.lit(False)
        return column.rlike(f"(?i){value}")
    text = str(value).lower()
    kinds = {"exact": low == text, "starts": low.startswith(text), "ends": low.endswith(text), "contains": low.contains(text)}
    if kind not in kinds:
        raise ValueError(f"unknown search type {kind!r}")
    return kinds[kind]


@dataclass(frozen=True)
class PosFilter:
    """Parts of speech to keep or drop; what an empty choice means differs between the analyses."""

    selected: tuple[str, ...] = ()
    keep: bool = True

    def tokens(self, pos: Column) -> Column:
        """Token analyses: an empty choice passes all."""
        if not self.selected:
            return F.lit(True)
        return pos.isin(*self.selected) if self.keep else ~pos.isin(*self.selected)

    def window(self, pos: Column) -> Column:
        """N-grams: all tokens chosen, or none dropped; keeping an empty choice drops all."""
        chosen = lambda p: p.isin(*self.selected) if self.selected else F.lit(False)
        return F.forall(pos, chosen) if self.keep else ~F.exists(pos, chosen)

    def concordance(self, pos: Column) -> Column:
        """Concordances: keeping an empty choice is an error."""
        if self.keep and not self.selected:
            raise ValueError("keep mode needs at least one part of speech")
        return self.tokens(pos)


def without_stopwords(column: Column, remove: bool, exclude: str | Iterable[str] = (), stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Neither a stop word (if asked) nor an excluded word."""
    words = set(lines_of(exclude)) | (set(stopwords) if remove else set())
    return ~F.lower(column).isin(*sorted(words)) if words else F.lit(True)


def between(column: str, least: int = 1, most: int | None = None) -> Column:
    """A frequency range, for use after an aggregation."""
    return (F.col(column) >= least) & (F.lit(True) if most is None else F.col(column) <= most)


def form(target: str = "word") -> Column:
    """The counted form: the word, or the lemma with the word where it is null."""
    return F.coalesce("lemma", "text") if target == "lemma" else F.col("text")


def content(tokens: DataFrame) -> DataFrame:
    """Without punctuation and blank tokens."""
    return tokens.where("not coalesce(is_punct, false) and trim(text) != ''")
