"""Personal data against Python's regular expressions, plain bootstrapping, and planted contexts."""

import hashlib
import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import pii
from textloom.llm.pii import KINDS, LOOSE, PLAIN_FORMS, Bootstrap, find, score
from textloom.llm.queries import op13_pii

ONE = 1_000_000


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN_FORMS[k], text or "") if holds(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def plain_mentions(text):
    blank, out = r"\x20\x09-\x0D", []
    found = list(re.finditer(pii.PLAIN_MENTION, text))
    ends = [0, *(m.end() for m in found)]
    starts = [*(m.start() for m in found), len(text)]
    for k, m in enumerate(found):
        before = re.findall(f"[^{blank}]+", text[ends[k] : starts[k]][-pii.LEFT :].lower())
        after = re.search(f"[^{blank}]+", text[ends[k + 1] : starts[k + 1]][: pii.RIGHT].lower())
        one, two = (before[-1:] or ["^"])[0], (before[-2:-1] or ["^"])[0]
        firsts = {k: re.search(PLAIN_FORMS[k], m[0]) for k in KINDS}
        seed = next((i for i, k in enumerate(KINDS) if firsts[k] and holds(k, firsts[k][0])), None)
        can = [i for i, k in enumerate(KINDS) if len(m[0]) <= pii.LONGEST and re.search(LOOSE[k], m[0])]
        instance = m[0].lower().strip(pii._EDGES) if len(m[0]) <= pii.LONGEST else "#" + hashlib.sha256(m[0].encode()).hexdigest()
        out.append((m.start(), m[0], instance, seed, can, [f"l {one}", f"ll {two} {one}", f"r {after[0] if after else '^'}"]))
    return out


def plain(texts, how=None):
    how = how or Bootstrap()
    found = [plain_mentions(t or "") for t in texts]
    every = [m for f in found for m in f]
    edges = {(p, m[2]) for m in every for p in m[5]}
    seeds, can = {}, {}
    for m in every:
        if m[3] is not None:
            seeds[m[2]] = min(m[3], seeds.get(m[2], 9))
        can[m[2]] = max(m[4], can.get(m[2], []))
    scores = {}
    for _ in range(how.rounds):
        known = {(i, k): ONE for i, k in seeds.items()} | scores
        total, size, reach = defaultdict(int), defaultdict(int), defaultdict(lambda: [0, 0])
        by = defaultdict(list)
        for (i, k), x in known.items():
            by[i].append((k, x))
        for p, i in edges:
            size[p] += 1
            for k, x in by[i]:
                total[p, k] += x
        sure = {(p, k): t // (size[p] + how.smooth) for (p, k), t in total.items() if t >= how.support * ONE and t // (size[p] + how.smooth) >= how.confidence}
        for p, i in edges:
            for k in range(4):
                if (p, k) in sure and i not in seeds and k in can[i]:
                    side = p.startswith("r ")
                    reach[i, k][side] = max(reach[i, k][side], sure[p, k])
        scores = {x: ONE - (ONE - a) * (ONE - b) // ONE for x, (a, b) in reach.items()}
    best = {}
    for (i, k), x in scores.items():
        if x >= how.accept:
            best[i] = min(best.get(i, (0, 9)), (-x, k))
    for text, ms in zip(texts, found, strict=True):
        spans = base(text)
        more = []
        for start, m, i, seed, can_, _ in ms:
            if seed is None and can_ and i in best:
                c = re.search(LOOSE[KINDS[best[i][1]]], m)
                a, b = start + c.start(), start + c.end()
                if not any(x < b and a < y for _, x, y in spans):
                    more.append((KINDS[best[i][1]], a, b))
        n = [sum(s[0] == k for s in spans) for k in KINDS]
        yield (*n, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(sorted(spans + more, key=lambda s: (KINDS.index(s[0]), *s[1:]))))


HARD = ["a@b.cd@e.fg a@b.c_d@e.fg x@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111", "+1 (407) 555-7710 190.137.223.204 +12 +1 2345678 ++12345678", "é🙂 +1 (443) 555-5793\n\nx 日本 me@home.org", "a.b@c", "@@@ a@.b a@b. .@-.-", "5105105105105100 12", "", "12", "no data here"]


def test_any_text(spark):
    rng = random.Random(4)
    pieces = [*"ab.@+-() \n0123459é_%[t]", "[at]", "a@b.c", "+1 555 010-", "1.2.3.4", " tel ", " at ", "4111 1111 1111 1111"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").coalesce(2)
    how = Bootstrap(support=3, smooth=0, confidence=200_000, accept=250_000)
    got, want = [tuple(r)[1:] for r in sorted(find(df, how=how).collect())], list(plain(texts, how))
    assert got == want
    assert sum(s.count(":") // 2 > sum(n) for *n, _, s in want) >= 5


def planted():
    texts = [f"Please call me at +1 (555) 010-{1000 + k} before noon number {k}" for k in range(12)]
    texts += [f"Contact desk: user{k}@mail.example.com for help" for k in range(12)]
    texts += ["Please call me at (555) 010-7777 before noon", "Contact desk: ann[at]example[dot]com for help", "Contact desk: joe@localhost for help. Room 555, in 1998 or 12 of 40", "Elsewhere ann[at]example[dot]com writes", "In 2020 there were 5550107778 of them"]
    return texts


def test_contexts_discover(spark):
    texts = planted()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in find(df).collect()}
    assert [tuple(got[k])[1:] for k in range(len(texts))] == list(plain(texts))
    cut = lambda k: [(s.split(":")[0], texts[k][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[k].spans.split(",") if s]
    assert cut(24) == [("phone", "(555) 010-7777")] and cut(25) == [("email", "ann[at]example[dot]com")] and cut(27) == [("email", "ann[at]example[dot]com")]
    assert cut(26) == [("email", "joe@localhost")] and cut(28) == []
    assert all(got[k].n_phone == 1 for k in range(12))


def test_hard_and_awkward(spark, docs, nothing):
    texts = [None, *HARD, " ".join(HARD)]
    df = spark.createDataFrame([(None if k == 3 else k // 2, t, 1, "z", 2) for k, t in enumerate(texts)], "doc_id bigint, text string, rid int, start string, kind int").repartition(4)
    assert sorted(tuple(r)[1:] for r in find(df).collect()) == sorted(plain(texts))
    assert find(docs).count() == docs.count() and find(nothing).collect() == []


def test_long_texts(spark):
    """Runs that a plain expression reads in quadratic time."""
    n = 100_000
    texts = ["a" * n, "1" * n, "1." * n, "x@" * n, "1 " * n, "+1" * n, "a1" * n + "@b.cd", "a@b.cd " * (n // 10), "[at]" * n, "1.2.3.4 " * (n // 10)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    began = time.time()
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in find(df).collect()}
    assert time.time() - began < 100
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, n // 4, 0, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0), 6: (1, 0, 0, 0), 7: (n // 10, 0, 0, 0), 8: (0, 0, 0, 0), 9: (0, n // 10, 0, 0)}


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_documents(spark, scale):
    df = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, plain([r.text for r in rows]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in find(df.repartition(5)).collect()} == want


def test_main_path_is_native(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = pii._marks(df, "doc_id", "text")
    for x in (pii.base_spans(marks), pii.mentions(marks), score(pii.mentions(marks), Bootstrap(rounds=1)), find(df)):
        plan = x._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
    assert marks.select(F.max(F.size("m_mention"))).first()[0] >= 1


def test_planted_by_sql(spark, tmp_path):
    """The rounds written out as SQL discover the same."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*planted(), *HARD, None])], "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = sorted(con.execute(pii.sql()).fetchall())
    assert sorted(map(tuple, find(df).collect())) == want and sum(w[6].count(":") // 2 > sum(w[1:5]) for w in want) == 4


def test_long_mentions_are_discovered(spark, tmp_path):
    """The query: a context that is sure discovers what stands there, however many numbers follow it or characters it has."""
    row, name, host = " ".join(str(100 + k) for k in range(60)), "ann" * 40, "desk." * 30
    texts = [*planted(), f"Please call me at (555) 010-8888 {row} before noon", f"Contact desk: {name}[at]example[dot]com for help", f"Contact desk: joe@{host}org for help", f"Elsewhere <{name.upper()}[at]EXAMPLE[dot]com> writes"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.spans for r in sorted(op13_pii(spark, str(tmp_path)).collect())][len(planted()) :]
    ann, joe = f"{name}[at]example[dot]com", f"joe@{host}org"
    assert got[0] == "phone:18:39" and texts[-4][18:39] == "(555) 010-8888 100 10"
    assert got[1] == f"email:14:{14 + len(ann)}" and got[2] == f"email:14:{14 + len(joe)}" and got[3] == f"email:11:{11 + len(ann)}"
    assert min(len(ann), len(joe), len(row)) > pii.LONGEST


def test_any_length_as_plain(spark, monkeypatch):
    """Against plain bootstrapping that knows no longest mention."""
    rng = random.Random(9)
    pieces = [*"ab.@+-()0123459é_%[t]:F", "[at]", "[dot]com", "a@b.c", "1.2.3.4", " 12", " (555) 010-7777", "4111 1111 1111 1111", "abcdef0" * 4]
    longs = ["".join(rng.choice(pieces) for _ in range(rng.randint(20, 60))) for _ in range(60)]
    texts = []
    for _ in range(1500):
        x = rng.choice(longs) if rng.random() < 0.5 else "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))
        texts.append(f"{rng.choice(['tel', 'mail to', 'so'])} {rng.choice(['', '(', '<'])}{rng.choice([x, x.upper()])}{rng.choice(['', '.', '>,'])} {rng.choice(['ok', 'end'])}")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").coalesce(2)
    how = Bootstrap(support=3, smooth=0, confidence=100_000, accept=150_000)
    got, short = [tuple(r)[1:] for r in sorted(find(df, how=how, longest=None).collect())], list(plain(texts, how))
    monkeypatch.setattr(pii, "LONGEST", 1 << 40)
    want = list(plain(texts, how))
    assert got == want
    assert sum(a != b for a, b in zip(want, short, strict=True)) >= 30


def test_long_mentions_are_read_once(spark):
    """Runs on which the loose forms would be read in quadratic time or nested too deep."""
    n = 200_000
    texts = ["a1" * n, "f" * n + "1", "x@" + "." * n, "a[at]b" + "[dot]c" * n, "1" + ".:" * n + "a", "1.a" * n, "a." * n + "1", "12 " * n, "1( " * n, "[at]a" * n, "_@" * n]
    df = spark.createDataFrame([(k, f"mail {t} ok") for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    began = time.time()
    marks = pii._marks(df, "doc_id", "text")
    can = [r.can for r in pii.mentions(marks, None).orderBy(F.length("match").desc()).collect()]
    assert time.time() - began < 60 and len(can) >= len(texts) and [0] in can
