"""Text functions: cleaning, normal forms, punctuation, links, names, spans."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.tokens import STOPWORDS, WORD

#: ASCII punctuation, CJK symbols, full-width forms.
PUNCTUATION = r"[!-/:-@\[-`{-~\x{3000}-\x{303E}\x{FF00}-\x{FFEE}]"
# Part-of-speech maps to Penn tags, and from Penn to WordNet's letters by first letters.
CLAWS_TO_PENN = {
    "NN0": "NN", "NN1": "NN", "NN2": "NNS", "NP0": "NNP", "NP1": "NNP", "NP2": "NNPS",
    "VBB": "VBP", "VBD": "VBD", "VBG": "VBG", "VBI": "VB", "VBN": "VBN", "VBZ": "VBZ",
    "VDB": "VBP", "VDD": "VBD", "VDG": "VBG", "VDI": "VB", "VDN": "VBN", "VDZ": "VBZ",
    "VHB": "VBP", "VHD": "VBD", "VHG": "VBG", "VHI": "VB", "VHN": "VBN", "VHZ": "VBZ",
    "VVB": "VBP", "VVD": "VBD", "VVG": "VBG", "VVI": "VB", "VVN": "VBN", "VVZ": "VBZ", "VM0": "MD",
    "AJ0": "JJ", "AJC": "JJR", "AJS": "JJS", "AV0": "RB", "AVP": "RB", "AVQ": "WRB",
    "AT0": "DT", "DT0": "DT", "DPS": "PRP$", "DTQ": "WDT", "PNP": "PRP", "PNI": "PRP", "PNQ": "WP", "PNX": "PRP",
    "PRP": "IN", "PRF": "IN", "CJC": "CC", "CJS": "IN", "CJT": "IN", "CRD": "CD", "ORD": "JJ",
    "PUN": ".", "PUL": "(", "PUR": ")", "PUQ": "''",
    "TO0": "TO", "XX0": "RB", "ZZ0": "SYM", "UNC": "NN", "ITJ": "UH", "EX0": "EX", "POS": "POS",
}
BROWN_TO_PENN = {
    "nn": "NN", "nns": "NNS", "np": "NNP", "nps": "NNPS", "nn$": "NN", "nns$": "NNS", "np$": "NNP", "nps$": "NNPS",
    "nn-tl": "NNP", "nns-tl": "NNPS", "np-tl": "NNP", "nn-hl": "NN", "nns-hl": "NNS", "nr": "NN", "nr-tl": "NNP", "nr-hl": "NN",
    "vb": "VB", "vbd": "VBD", "vbg": "VBG", "vbn": "VBN", "vbz": "VBZ", "vb-hl": "VB", "vbd-hl": "VBD", "vbg-hl": "VBG", "vbn-hl": "VBN",
    "hv": "VB", "hvd": "VBD", "hvg": "VBG", "hvn": "VBN", "hvz": "VBZ",
    "be": "VB", "bed": "VBD", "bedz": "VBD", "beg": "VBG", "bem": "VBP", "ben": "VBN", "ber": "VBP", "bez": "VBZ",
    "do": "VB", "dod": "VBD", "doz": "VBZ", "md": "MD",
    "jj": "JJ", "jjr": "JJR", "jjs": "JJS", "jjt": "JJS", "jj-tl": "JJ", "jj-hl": "JJ",
    "rb": "RB", "rbr": "RBR", "rbt": "RBS", "rp": "RP", "rb-hl": "RB", "wrb": "WRB", "ql": "RB",
    "at": "DT", "dt": "DT", "dti": "DT", "dts": "DT", "dtx": "DT", "ap": "DT", "abn": "DT", "abx": "DT",
    "pp$": "PRP$", "pps": "PRP", "ppss": "PRP", "ppo": "PRP", "ppl": "PRP", "ppls": "PRP", "pn": "PRP", "pn$": "PRP$",
    "wdt": "WDT", "wp$": "WP$", "wps": "WP", "wpo": "WP",
    "in": "IN", "in-tl": "IN", "in-hl": "IN", "cc": "CC", "cs": "IN", "cd": "CD", "cd-tl": "CD", "cd-hl": "CD", "od": "JJ",
    ".": ".", ",": ",", ":": ":", "(": "(", ")": ")", "''": "''", "``": "``", "--": ":", "*": "SYM", "'": "''", '"': "''",
    "to": "TO", "ex": "EX", "uh": "UH", "fw": "FW", "nil": "NN",
}
PENN_TO_WORDNET = {"J": "a", "V": "v", "N": "n", "R": "r"}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which Spark lacks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def claws_to_penn(tag: Column) -> Column:
    """The Penn tag of a CLAWS tag, of the first of an ambiguous pair; NN for unknown ones and none."""
    return F.coalesce(_mapped(CLAWS_TO_PENN, F.upper(F.substring_index(tag, "-", 1))), F.lit("NN"))


def brown_to_penn(tag: Column) -> Column:
    """The Penn tag of a Brown tag; a possessive that has none takes its base's; NN for unknown ones and none."""
    low = F.lower(tag)
    return F.coalesce(_mapped(BROWN_TO_PENN, low), F.when(low.contains("$"), _mapped(BROWN_TO_PENN, F.replace(low, F.lit("$"), F.lit("")))), F.lit("NN"))


def penn_to_wordnet(tag: Column) -> Column:
    """WordNet's letter of a Penn tag, a noun's where it has none."""
    return F.coalesce(_mapped(PENN_TO_WORDNET, F.left(tag, F.lit(1))), F.lit("n"))


def clean(text: Column) -> Column:
    """White space evened out, then control characters dropped, then trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\p{Cc}", ""))


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def custom_clean(text: Column, patterns: Iterable[str]) -> Column:
    """Each pattern's matches dropped; patterns that do not compile are skipped."""
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        text = F.regexp_replace(text, p, "")
    return text


def tokens_of(text: Column, language: str = "en") -> Column:
    """Words; for Chinese each character, in want of a dictionary segmenter."""
    return F.filter(F.split(text, ""), lambda c: F.trim(c) != "") if language == "zh" else F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def preprocess(text: Column, *, patterns: Iterable[str] = (), normalise: bool = True, lower: bool = True, punctuation: bool = True, stopwords: bool = True, language: str = "en") -> Column:
    """Tokens of the cleaned text, step by step: custom patterns, cleaning, normal form, case, punctuation, tokens, stop words."""
    x = clean(custom_clean(text, patterns))
    x = nfkc(x) if normalise else x
    x = F.lower(x) if lower else x
    x = tokens_of(strip_punctuation(x) if punctuation else x, language)
    return F.filter(x, lambda w: ~F.lower(w).isin(*STOPWORDS)) if stopwords else x


def strip_edges(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}_]+", ""), r"[^\p{L}\p{N}_]+$", "")


def context(text: Column, start: Column, end: Column, around: int = 30) -> tuple[Column, Column]:
    """Characters before and after a span, within the text."""
    low = F.greatest(F.lit(0), start - around)
    return F.substring(text, low + 1, start - low), F.substring(text, end + 1, F.lit(around))


def rewrite_links(html: Column) -> Column:
    """Dictionary links: @@@LINK=word and entry://word become links of class dict-link."""
    link = lambda word, text: f'<a class="dict-link" data-word="{word}" href="javascript:void(0)">{text}</a>'
    x = F.regexp_replace(html, r"@@@LINK=([^\s<>]+)", link("$1", "$1"))
    return F.regexp_replace(x, r"(?s)<a[^>]*href=[\"']entry://([^\"']*)[\"'][^>]*>(.*?)</a>", link("$1", "$2"))


def resource_name(path: Column) -> tuple[Column, Column]:
    """(prefix, category) of a file name prefix_category.csv; no category means total."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.csv$", "")
    category = F.regexp_extract(name, r"^[^_]*_(.*)$", 1)
    return F.split(name, "_")[0], F.when(category == "", "total").otherwise(category)


def human_count(n: Column) -> Column:
    one = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(n >= 1_000_000, one(n / 1_000_000.0, "M")).when(n >= 1000, one(n / 1000.0, "K")).otherwise(n.cast("string"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.round(seconds * 1000).cast("bigint")
    part = lambda d, m: (F.floor(ms / d) % m).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("int"), part(60000, 60), part(1000, 60), (ms % 1000).cast("int"))


def list_of(text: Column) -> Column:
    """A string split at semicolons, else at commas, else alone; items of over one character."""
    parts = F.when(text.contains(";"), F.split(text, ";")).when(text.contains(","), F.split(text, ",")).otherwise(F.array(text))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def address_parts(line: Column) -> tuple[Column, Column]:
    """(institution, country) of an address line: first and last comma part, names in brackets and postal digits dropped."""
    parts = F.split(F.trim(F.regexp_replace(line, r"\[.*?\]", "")), ",")
    last = F.regexp_replace(F.regexp_replace(F.trim(F.element_at(parts, -1)), r"\.+$", ""), r"\s+\d+$", "")
    return F.trim(parts[0]), F.when((F.size(parts) > 1) & (last != "") & (F.length(last) < 50), last)
