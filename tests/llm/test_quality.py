import re
import tracemalloc
from collections import Counter

import numpy as np

from tests.conftest import DATA
from tests.llm.conftest import words
from textloom.llm.quality import RULES, ablations, apply_policy, ledger, policy_mask


def brute(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(df):
    got = apply_policy(ledger(df)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for r in df.select("doc_id", "text").collect():
        m = brute(r.text)
        want.append((r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_awkward_rows(docs):
    check(docs)


def test_lines(spark):
    rows = ["a\na\n\n\na", "\n\n", "x", "a \na", "", "a\n", "\na", "a b c a b c\na b c", None, "q\nq", "\n"]
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").coalesce(1))


def test_thue_morse_lines(spark):
    """Lines and windows that polynomials modulo a power of two can't tell apart; a line that is only white space apart is another line."""
    t = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join(x[k] for k in t) for x in ("ab", "ba"))
    rows = [f"{a}\n{b}", f"{a} {b} c\n{b} {a} c", f"{a} x {b} y {a} x {b}", "a b\na  b\na b"]
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"))


def test_long_text_needs_bounded_memory():
    """A text of 32 MB: about ten bytes of memory for each of its own."""
    from textloom.llm.quality import _measure

    one = b"some words of a line that goes on for a while and ends here\n"
    data = np.frombuffer(one * (32_000_000 // len(one)), np.uint8)
    tracemalloc.start()
    found = _measure(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][0] == 14 * (len(data) // len(one)) and peak < 25 * len(data)


def test_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_verdicts_follow_labels(spark):
    """Documents labelled good stay, and most of those labelled bad go."""
    kept = apply_policy(ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    t = kept.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in t}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_ablations(spark):
    found = ledger(spark.read.parquet(f"{DATA}/documents.parquet"))
    bits = [r.fail_bits for r in found.collect()]
    mask = policy_mask("2024-2")
    for r in ablations(found).collect():
        bit = 1 << RULES[r.rule][0]
        assert r.failed == sum(bool(b & bit) for b in bits)
        assert r.failed_alone == sum(b & mask == bit for b in bits)
        assert r.kept_without == sum(not b & mask & ~bit for b in bits)


def test_empty(nothing):
    assert apply_policy(ledger(nothing)).collect() == []
