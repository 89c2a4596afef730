"""Quality rules as a bitmask ledger: each rule is evaluated once, policies and ablations are bit operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.runtime import small_batches

#: What a document is measured by, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_marks", "n_upper", "n_letters")
_SYMBOLS, _MARKS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", b"!?"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122)

#: Rule number n fails a document where its condition holds; a rule keeps its number for ever.
RULES: dict[str, tuple[int, Column | str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > 3 * n_words"),
    "repeated_lines": (3, "10 * n_dup_lines > 3 * n_lines"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 14 * n_words"),
    "marks": (6, "10 * n_marks > 5 * n_words"),
    "capitals": (7, "n_letters >= 50 and 10 * n_upper > 6 * n_letters"),
    "no_letters": (8, "10 * n_letter_words < 6 * n_words"),
}
#: Versions of which rules count; a version never changes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "2024-1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "2024-2": tuple(RULES),
}


def policy_mask(policy: str) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[policy])


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags hold between each two edges."""
    out, full = np.zeros(len(edges) - 1, np.int64), np.flatnonzero(np.diff(edges))
    if len(full):
        # a sum goes on to the next start: between them there are none but empty ranges
        out[full] = np.add.reduceat(flags[: edges[-1]], edges[full], dtype=np.int64)
    return out


def _repeated(lines: list[bytes]) -> int:
    return len(lines) - len(set(lines))


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    begin, end, first = K.word_spans(data, off)
    n_words = np.diff(first)
    lettered = np.logical_or.reduceat(_LETTER[data] | (data >= 0xC3), begin) if len(begin) else np.zeros(0, bool)

    # lines with a word, compared by their bytes
    lines = [[x for x in data[a:b].tobytes().split(b"\n") if x and not x.isspace()] for a, b in zip(off[:-1], off[1:], strict=True)]
    n_dup = np.array([_repeated(x) for x in lines], np.int64)
    n_lines = np.array([len(x) for x in lines], np.int64)
    del lines

    # windows of three words of one text, found twice or more in it: equal keys, then equal words
    words = K.word_hashes(data, begin, end)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), n_words)
    at = np.flatnonzero(doc[: max(0, len(doc) - 2)] == doc[2:])
    key = K.mix(K.mix(K.mix(words[at]) + words[at + 1]) + words[at + 2])
    at = at[np.lexsort((key, doc[at]))]
    a, b = at[:-1], at[1:]
    same = doc[a] == doc[b]
    for k in range(3):
        same &= words[a + k] == words[b + k]
    hit = np.zeros(len(at), bool)
    hit[1:] |= same
    hit[:-1] |= same
    covered = np.zeros(len(begin) + 3, bool)
    for k in range(3):
        covered[at[hit] + k] = True
    return [
        n_words,
        _sums(~K._SEPARATOR[data] & ((data & 0xC0) != 0x80), off),
        _sums(_SYMBOLS[data], off),
        n_dup,
        _sums(covered[: len(begin)], first),
        n_lines,
        _sums(lettered, first),
        _sums(_MARKS[data], off),
        _sums(_UPPER[data], off),
        _sums(_LETTER[data], off),
    ]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the MEASURES as longs, fail_bits) of every row of docs, in one pass without a shuffle.

    Bit n of fail_bits is set where rule n fails the text. Null and empty texts measure zero and fail
    few_words; rows with a null or repeated id each get their own result; texts are read whole; an
    empty table gives no rows; other columns are not read.
    """
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            values = _measure(*K.texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v.astype(np.int64)) for v in values)], ["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    measured = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(1 << n)).otherwise(F.lit(0)) for n, rule in RULES.values()), F.lit(0).cast("bigint"))
    return measured.select(F.col("id").alias(id_col), *MEASURES, bits.alias("fail_bits"))


def apply_policy(found: DataFrame, policy: str = "2024-2") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(policy_mask(p)) != 0
    return found.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))


def ablations(found: DataFrame, policy: str = "2024-2") -> DataFrame:
    """(rule, failed, failed_alone, kept_without): per rule of the policy, from one count per distinct bitmask.

    failed_alone counts what only this rule fails, so what the policy without it would keep besides.
    """
    mask = policy_mask(policy)
    counts = found.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    names = [F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("bigint").alias("bit")) for r in POLICIES[policy]]
    each = counts.select("bits", "n", F.explode(F.array(*names)).alias("r")).select("bits", "n", "r.*")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    mine = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(of(mine).alias("failed"), of(alone).alias("failed_alone"), of((F.col("bits") == 0) | alone).alias("kept_without"))
