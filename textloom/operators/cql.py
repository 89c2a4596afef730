"""The token-pattern query language: a parser on the driver, compiled to columns and matched per text.

query = element+ ; element = '"word"' | '[' condition? ']' quantifier? ; condition = and ('|' and)* ;
and = test ('&' test)* ; test = '!'? attribute op '"value"' ; op = '=' | '==' | '!=' | '!==' ;
quantifier = '?' | '{n}' | '{m,n}' | '{,n}' | '{m,}'.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ("word", "lemma", "pos", "tag", "dep", "headword", "headlemma", "headpos", "headdep")
#: What an open upper bound means.
MOST = 100


class CQLError(ValueError):
    pass


@dataclass(frozen=True)
class Test:
    attribute: str
    op: str
    value: str
    negated: bool = False


@dataclass(frozen=True)
class Element:
    """Alternatives of conjunctions of tests; none at all matches any token."""

    any_of: tuple[tuple[Test, ...], ...]
    least: int = 1
    most: int = 1


_TEST = re.compile(r'\s*(!?)\s*(?:\(\s*)?([A-Za-z_]+)\s*(!==|!=|===|==|=)\s*"((?:[^"\\]|\\.)*)"\s*\)?\s*')
_COUNT = re.compile(r"\{(\d*)(,?)(\d*)\}|\?")
_WORD = re.compile(r'"((?:[^"\\]|\\.)*)"')


def _conjunction(text: str, at: int) -> tuple[tuple[Test, ...], int]:
    tests = []
    while True:
        m = _TEST.match(text, at)
        if not m:
            raise CQLError(f"no condition at {text[at : at + 20]!r}")
        if m[2] not in ATTRIBUTES:
            raise CQLError(f"unknown attribute {m[2]!r}")
        tests.append(Test(m[2], m[3], m[4], bool(m[1])))
        at = m.end()
        if not text.startswith("&", at):
            return tuple(tests), at
        at += 1


def parse(query: str) -> list[Element]:
    """The elements of a query; CQLError where it is not one."""
    out: list[Element] = []
    at = 0
    while at < len(query):
        if query[at].isspace():
            at += 1
        elif m := _WORD.match(query, at):
            out.append(Element(((Test("word", "=", m[1]),),)))
            at = m.end()
        elif query[at] == "[":
            at += 1
            choices: list[tuple[Test, ...]] = []
            if not (e := re.compile(r"\s*\]").match(query, at)):
                while True:
                    tests, at = _conjunction(query, at)
                    choices.append(tests)
                    if not query.startswith("|", at):
                        break
                    at += 1
                if not query.startswith("]", at):
                    raise CQLError("a bracket is not closed")
                at += 1
            else:
                at = e.end()
            least = most = 1
            if m := _COUNT.match(query, at):
                at = m.end()
                if m[0] == "?":
                    least, most = 0, 1
                elif not m[2]:
                    if not m[1]:
                        raise CQLError("an empty quantifier")
                    least = most = int(m[1])
                else:
                    least, most = int(m[1] or 0), int(m[3] or MOST)
            out.append(Element(tuple(choices), least, most))
        else:
            raise CQLError(f"unexpected {query[at : at + 20]!r}")
    if not out:
        raise CQLError("an empty query")
    return out


def validate(query: str) -> dict:
    try:
        return {"valid": True, "error": None, "pattern_count": len(parse(query))}
    except CQLError as e:
        return {"valid": False, "error": str(e), "pattern_count": 0}


def full_match(value: Column, pattern: str) -> Column:
    """A regular expression over the whole value, without regard to case; a bad one means equality."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lower(value) == pattern.lower()
    return value.rlike(f"(?i)^(?:{pattern})$")


def _column(test: Test) -> Column:
    value = F.coalesce(F.col("text" if test.attribute == "word" else test.attribute), F.lit(""))
    hit = {
        "=": lambda: full_match(value, test.value),
        "!=": lambda: ~full_match(value, test.value),
        "==": lambda: F.lower(value) == test.value.lower(),
        "!==": lambda: F.lower(value) != test.value.lower(),
        "===": lambda: F.lit(False),
    }[test.op]()
    return ~hit if test.negated else hit


def condition(element: Element) -> Column:
    """Whether a token satisfies an element."""
    out = F.lit(False) if element.any_of else F.lit(True)
    for tests in element.any_of:
        both = F.lit(True)
        for t in tests:
            both &= _column(t)
        out |= both
    return out


def with_heads(tokens: DataFrame) -> DataFrame:
    """tokens with headword, headlemma, headpos and headdep, by a join of each token to its head."""
    h = tokens.select("text_id", F.col("tok_idx").alias("head"), F.col("text").alias("headword"), F.col("lemma").alias("headlemma"), F.col("pos").alias("headpos"), F.col("dep").alias("headdep"))
    return tokens.join(h, ["text_id", "head"], "left")


def matches(tokens: DataFrame, query: str) -> DataFrame:
    """(text_id, start, length) of every token position where the query matches.

    Elements take as many tokens as they can, without giving any back; an element that may be empty
    may stand behind the text's end. Matches of punctuation or blanks alone are left out. Per text and
    element an array says which tokens fit; a match walks those arrays, text by text.
    """
    elements = parse(query)
    if any(t.attribute.startswith("head") for e in elements for c in e.any_of for t in c):
        tokens = with_heads(tokens)
    # from the text's end backwards: the next token that does not fit, and so how many do in a row
    back = Window.partitionBy("text_id").orderBy(F.desc("tok_idx")).rowsBetween(Window.unboundedPreceding, 0)
    size = F.count("*").over(Window.partitionBy("text_id"))
    runs = [(F.coalesce(F.min(F.when(~condition(e), F.col("tok_idx"))).over(back), size) - F.col("tok_idx")).alias(f"r{k}") for k, e in enumerate(elements)]
    t = tokens.select("text_id", F.struct("tok_idx", (~F.coalesce("is_punct", F.lit(False))).alias("real"), *runs).alias("t"))
    texts = t.groupBy("text_id").agg(F.sort_array(F.collect_list("t")).alias("t")).withColumn("n", F.size("t"))
    texts = texts.withColumn("at", F.sequence(F.lit(0), F.col("n") - 1))
    for k, e in enumerate(elements):
        texts = texts.withColumn("at", F.transform("at", _step(k, e)))
    # the arrays stay in the text's one row; only its matches are exploded
    spans = F.transform("at", lambda end, i: F.struct(i.alias("start"), (end - i).alias("length")))
    real = lambda x: F.exists(F.slice("t", x["start"] + 1, x["length"]), lambda y: y["real"])
    hits = F.filter(F.filter(spans, lambda x: F.coalesce(x["length"] > 0, F.lit(False))), real)
    return texts.select("text_id", F.explode(hits).alias("x")).select("text_id", "x.start", "x.length")


def _step(k: int, element: Element):
    """From a place in the text, or null, to the place behind element k; null if too few tokens fit."""

    def step(p: Column) -> Column:
        fits = F.when(p < F.col("n"), F.element_at("t", p + 1)[f"r{k}"]).otherwise(F.lit(0))
        return F.when(fits >= element.least, p + F.least(fits, F.lit(element.most)).cast("int"))

    return step
