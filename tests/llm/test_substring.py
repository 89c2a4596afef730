import random

from textloom.llm.substring import _keys, bucket_parts, remove_repeats
from tests.conftest import DATA
from tests.llm.conftest import words


def brute(rows, k):
    """rows: (id, text); a window's places are (id, start), null ids first."""
    first = {}
    key = lambda i: (i is not None, i or 0)
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - k + 1):
            win = tuple(w[s : s + k])
            first[win] = min(first.get(win, (key(i), s)), (key(i), s))
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (key(i), s):
                gone[s : s + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_awkward_rows(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (5, 20):
        assert sorted(map(tuple, remove_repeats(docs, k=k).collect()), key=str) == brute(rows, k)


def test_table(spark):
    t = spark.read.parquet(f"{DATA}/documents.parquet").repartition(7)
    got = sorted(map(tuple, remove_repeats(t).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()], 20)


def test_shared_passage(spark):
    p = " ".join(f"p{i}" for i in range(30))
    t = spark.createDataFrame([(i, f"a{i} {p} b{i}") for i in range(200)], "doc_id int, text string").repartition(9)
    out = {r.doc_id: r for r in remove_repeats(t).collect()}
    assert out[0].n_removed == 0 and all(out[i].kept == f"a{i} b{i}" for i in range(1, 200))


def test_empty(nothing):
    assert remove_repeats(nothing).collect() == []


def test_equal_halves_of_text_hashes(spark):
    """Texts under null ids whose 64-bit hashes agree in their upper half, found among generated ones, stay apart."""
    n = spark.range(400000).selectExpr("concat('t ', id) text").selectExpr("text", "shiftright(xxhash64(text), 32) h")
    twins = n.groupBy("h").agg({"text": "collect_list"}).toDF("h", "t").where("size(t) > 1").head().t[:2]
    same = spark.createDataFrame([(None, x) for x in twins], "doc_id bigint, text string")
    assert same.select(*_keys("doc_id", "text")).distinct().count() == 2


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_thue_morse_words(spark):
    """Words and windows that polynomials modulo a power of two can't tell apart."""
    a = "".join("ab"[x] for x in thue_morse(1024))
    b = "".join("ba"[x] for x in thue_morse(1024))
    rest = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join(["ab"[x] for x in thue_morse(1024)])), (4, " ".join(["ba"[x] for x in thue_morse(1024)]))]
    for k in (20, 1024):
        assert sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id int, text string"), k=k).collect())) == brute(rows, k)


def test_phrases_that_all_documents_hold(spark):
    """Four words that recur in ever new surroundings: buckets are cut into parts, and nothing is lost."""
    rng = random.Random(6)
    phrases = [" ".join(f"p{i}{j}" for j in range(4)) for i in range(9)]
    rows = [(i, " ".join(f"{phrases[rng.randrange(9)]} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(6)) for _ in range(12))) for i in range(150)]
    rows += [(i + 500, t) for i, t in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    parts = bucket_parts(df, "text", 20, 64)
    assert parts.max() > 2 and (parts == 1).sum() > 30
    assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(rows, 20)
