import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from tests.llm.conftest import words
from textloom.llm.linededup import dedup_lines, within_one_edit


def near(a, b):
    """Word edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, min_words=5):
    """rows: (id, text, hash); gives the removed (id, hash, line)."""
    lines = []
    for i, text, h in {(i, t, h) for i, t, h in rows if t is not None}:
        for k, line in enumerate(text.split("\n")):
            if w := words(line):
                lines.append(((i is not None, i or 0, k, h), w))
    lines.sort()
    gone = set()
    for x, (p, w) in enumerate(lines):
        for _, v in lines[:x]:
            if v == w or min(len(v), len(w)) >= min_words and abs(len(v) - len(w)) < 2 and near(v, w):
                gone.add(p)
                break
    return gone


def check(df):
    rows = [(r.doc_id, r.text, r.h) for r in df.selectExpr("doc_id", "text", "cast(shiftright(xxhash64(text), 32) as int) h").collect()]
    gone = brute(rows)
    want = []
    for i, text, h in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for k, x in enumerate(lines) if (i is not None, i or 0, k, h) not in gone]
        want.append((i, len(lines), len(lines) - len(left), None if text is None else "\n".join(left)))
    got = list(map(tuple, dedup_lines(df, report=True).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((str(r.doc_id), str(r.text)) for r in dedup_lines(df).collect()) == sorted((str(w[0]), str(w[3])) for w in want)


def test_awkward_rows(docs):
    assert dedup_lines(docs).schema.simpleString() == docs.schema.simpleString()
    check(docs)


def test_random_edits(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
            lines.append(" ".join(w))
        rows.append((rng.randrange(40), "\n".join(lines)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))


def test_thue_morse_lines(spark):
    """Lines that differ in every word but agree under polynomials modulo a power of two; one word of many letters."""
    t = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = (" ".join(x[k] for k in t) for x in ("ab", "ba"))
    long = [("".join(x[k] for k in t)) for x in ("ab", "ba")]
    rows = [(1, a), (2, b), (3, f"{long[0]} is one word of six"), (4, f"{long[1]} is one word of six"), (5, f"{long[1]} {long[0]} three four five"), (6, f"{long[0]} {long[1]} three four five")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))


def test_one_half_that_all_lines_share(spark):
    """A boilerplate half before ever new words, and a line that all documents hold."""
    rng = random.Random(9)
    half = " ".join(f"h{i}" for i in range(8))
    rows = [(i, f"{half} " + " ".join(f"v{rng.randrange(50)}" for _ in range(8)) + "\nsame line for each of them here") for i in range(150)]
    rows += [(i + 200, rows[i][1].replace("v1", "x1", 1)) for i in range(0, 150, 3)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=6), st.lists(st.sampled_from([b"a", b"b"]), max_size=6))
def test_edit_distance(a, b):
    assert within_one_edit(a, b) == near(list(a), list(b))


def test_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet").limit(120).repartition(3))


def test_empty(nothing):
    assert dedup_lines(nothing).collect() == [] and dedup_lines(nothing, report=True).collect() == []
