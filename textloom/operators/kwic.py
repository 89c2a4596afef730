"""Keyword in context: search modes, contexts, sorting, wider contexts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import cql
from textloom.operators.predicates import PosFilter
from textloom.operators.ranking import ranked


def wildcard(pattern: str) -> str:
    """A regular expression for * (any run), ? (any character) and -- (a hyphen, a blank or nothing)."""
    out = []
    for part in re.findall(r"--|\*|\?|.", pattern, re.S):
        out.append({"--": r"[-\s]?", "*": ".*", "?": "."}.get(part, re.sub(r"([\\.^$+{}\[\]()])", r"\\\1", part)))
    return "".join(out)


def _equal(column: Column, pattern: str, lowercase: bool) -> Column:
    column, pattern = (F.lower(column), pattern.lower()) if lowercase else (column, pattern)
    return column.rlike(f"^(?:{wildcard(pattern)})$") if re.search(r"[*?]|--", pattern) else column == pattern


def find(tokens: DataFrame, mode: str, value: str, *, lowercase: bool = False, pos: PosFilter | None = None) -> DataFrame:
    """(text_id, start, length) of the matches of a mode: simple, lemma, phrase, word, character or cql.

    Alternatives a|b are matched one by one, so a token may come twice. Phrases skip punctuation
    between their words. Other modes mean simple. A query in CQL uses neither pos nor lowercase.
    """
    if mode == "cql":
        return cql.matches(tokens, value)
    t = tokens.where("not coalesce(is_punct, false)")
    keep = pos.concordance(F.col("pos")) if pos else F.lit(True)
    out = None
    for choice in [c.strip() for c in value.split("|") if c.strip()] if mode not in ("character",) else [value]:
        words = choice.split()
        one = {
            "lemma": lambda w: _equal(F.col("lemma"), w, lowercase),
            "word": lambda w: _equal(F.col("text"), w, lowercase),
            "phrase": lambda w: _equal(F.col("text"), w, lowercase),
            "character": lambda w: (F.lower("text") if lowercase else F.col("text")).contains(w.lower() if lowercase else w),
        }.get(mode, lambda w: _equal(F.col("text"), w, lowercase) | _equal(F.col("lemma"), w, lowercase))
        if len(words) < 2 or mode in ("lemma", "word", "character"):
            found = t.where(one(choice) & keep).select("text_id", F.col("tok_idx").alias("start"), F.lit(1).alias("length"))
        else:
            w = Window.partitionBy("text_id").orderBy("tok_idx")
            hits = t.select("text_id", "tok_idx", *((one(x) & keep).alias(f"w{k}") for k, x in enumerate(words)))
            all_ = F.col("w0")
            for k in range(1, len(words)):
                all_ &= F.coalesce(F.lead(f"w{k}", k).over(w), F.lit(False))
            found = hits.select("text_id", F.col("tok_idx").alias("start"), (F.lead("tok_idx", len(words) - 1).over(w) - F.col("tok_idx") + 1).alias("length"), all_.alias("hit")).where("hit").drop("hit")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else t.select("text_id", F.col("tok_idx").alias("start"), F.lit(1).alias("length")).limit(0)


def concordance(tokens: DataFrame, found: DataFrame, size: int = 5) -> DataFrame:
    """(text_id, start, keyword, left, right, lemma, pos): matches with up to `size` tokens either side.

    Each text's tokens are gathered once and only texts with matches are touched; punctuation stays in contexts.
    """
    by_text = found.groupBy("text_id").agg(F.collect_list(F.struct("start", "length")).alias("m"))
    t = tokens.join(by_text.select("text_id"), "text_id", "left_semi")
    arrays = t.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "text", "lemma", "pos"))).alias("t"))

    def line(m: Column) -> Column:
        start, end = m["start"], m["start"] + m["length"]
        low, text = F.greatest(F.lit(0), start - size), lambda x: x["text"]
        first = F.element_at("t", start + 1)
        return F.struct(
            start.alias("start"), F.array_join(F.transform(F.slice("t", start + 1, m["length"]), text), " ").alias("keyword"),
            F.transform(F.slice("t", low + 1, start - low), text).alias("left"), F.transform(F.slice("t", end + 1, F.lit(size)), text).alias("right"),
            first["lemma"].alias("lemma"), first["pos"].alias("pos"),
        )

    # one row per text on both sides: its matches are cut out of its arrays before they are exploded
    return arrays.join(by_text, "text_id").select("text_id", F.explode(F.transform("m", line)).alias("x")).select("text_id", "x.*")


def flat(lines: DataFrame) -> DataFrame:
    """Contexts as strings."""
    return lines.withColumns({c: F.array_join(c, " ") for c in ("left", "right")})


def sort_keys(levels: list[str]) -> list[Column]:
    """Columns for levels like 1L:word:ignoreCase, KWIC:lemma, 2R::retrograde, loc, file ID, frec."""
    out = []
    for level in levels:
        place, *options = level.split(":")
        attribute = options[0] if options and options[0] in ("lemma", "pos") else "keyword"
        if place in ("KWIC", "C"):
            key = F.element_at(F.split("keyword", " "), 1) if attribute == "keyword" else F.col(attribute)
        elif re.fullmatch(r"\d+L", place):
            key = F.coalesce(F.try_element_at("left", F.lit(-int(place[:-1]))), F.lit(""))
        elif re.fullmatch(r"\d+R", place):
            key = F.coalesce(F.try_element_at("right", F.lit(int(place[:-1]))), F.lit(""))
        else:
            out.append({"loc": F.col("start"), "file ID": F.col("text_id"), "frec": F.lit(0)}.get(place, F.lit("")))
            continue
        key = F.lower(key) if "ignoreCase" in options else key
        out.append(F.reverse(key) if "retrograde" in options else key)
    return out


def sort(lines: DataFrame, by: str | list[str] = "position", descending: bool | None = None, seed: int = 0) -> DataFrame:
    """lines with a rank: by position, random, frequency (descending by default), left, right, or levels; ties by place."""
    place = [F.asc("text_id"), F.asc("start"), F.asc("keyword")]
    if isinstance(by, list):
        keys = sort_keys(by)
    elif by == "random":
        keys = [F.xxhash64(F.lit(seed), "text_id", "start")]
    elif by == "frequency":
        n = lines.groupBy("keyword").agg(F.count("*").alias("n"))
        lines, keys = lines.join(n, "keyword"), [F.col("n")]
    elif by in ("left", "right"):
        words = F.reverse("left") if by == "left" else F.col("right")
        keys = [F.lower(F.array_join(words, " "))]
    else:
        keys = []
    down = by == "frequency" if descending is None else descending
    out = ranked(lines, *((k.desc() if down else k.asc()) for k in keys), *place)
    return out.drop("n") if by == "frequency" else out


def page(lines: DataFrame, most: int) -> DataFrame:
    """The first lines in rank order, each with the total before the cut."""
    total = lines.agg(F.count("*").alias("total"))
    return lines.where(F.col("rank") <= most).crossJoin(F.broadcast(total))  # total is one row


def extended_context(docs: DataFrame, spans: DataFrame, around: int = 200) -> DataFrame:
    """(text_id, begin, end, before, matched, after): characters around a span; CR LF counts as LF, bounds are kept.

    docs is (text_id, text); spans (text_id, begin, end) in characters of the text with LF line ends.
    """
    text = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = spans.join(docs.select("text_id", text.alias("t")), "text_id").withColumn("low", F.greatest(F.lit(0), F.col("begin") - around))
    cut = lambda a, b: F.substring(F.col("t"), a + 1, b - a)
    return x.select("text_id", "begin", "end", cut(F.col("low"), F.col("begin")).alias("before"), cut(F.col("begin"), F.col("end")).alias("matched"), F.substring(F.col("t"), F.col("end") + 1, F.lit(around)).alias("after"))


def mark_metaphors(lines: DataFrame, metaphors: DataFrame) -> DataFrame:
    """lines with is_metaphor: whether any matched token is marked; metaphors is (text_id, tok_idx)."""
    n = F.size(F.split("keyword", " "))
    each = lines.select("text_id", "start", F.explode(F.sequence(F.col("start"), F.col("start") + n - 1)).alias("tok_idx"))
    hit = each.join(metaphors.select("text_id", "tok_idx"), ["text_id", "tok_idx"], "left_semi").select("text_id", "start").distinct().withColumn("is_metaphor", F.lit(True))
    return lines.join(hit, ["text_id", "start"], "left").withColumn("is_metaphor", F.coalesce("is_metaphor", F.lit(False)))
