"""Hand-computed values, parsers and properties of the reference operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import dates, stats, text
from textloom.operators import biblio, cql, freq, keyness, kwic, predicates, reliability, semantic
from textloom.sources import writers


def test_two_by_two(spark):
    t = spark.createDataFrame([(30, 1000, 10, 2000)], "a int, n1 int, b int, n2 int")
    args = [F.col(c) for c in ("a", "n1", "b", "n2")]
    row = t.select(*(F.round(f(*args), 4).alias(n) for n, f in stats.MEASURES.items())).first()
    want = {"log_likelihood": 29.4627, "chi_squared": 29.8005, "log_ratio": 2.5377, "dice": 0.0577, "mi": 1.1699, "mi3": 10.9837, "t_score": 3.0429, "simple": 6.0, "fisher": 7.1611}
    assert row.asDict() == pytest.approx(want, abs=1e-4)
    assert stats.fisher_p(30, 1000, 10, 2000) == pytest.approx(6.901e-08, rel=1e-3)
    study = spark.createDataFrame([("x", 30), ("y", 970)], "word string, freq int")
    ref = spark.createDataFrame([("x", 10), ("y", 1990)], "word string, freq int")
    for measure, mark in (("log_likelihood", "***"), ("chi_squared", "***"), ("dice", "")):
        assert {r.word: r.significance for r in keyness.keyness(study, ref, measure).collect()}["x"] == mark


def test_log_dice(spark):
    t = spark.createDataFrame([(8, 20, 12), (5, 40, 5), (0, 1, 1)], "f int, a int, b int")
    assert [r[0] for r in t.select(stats.log_dice(F.col("f"), F.col("a"), F.col("b"))).collect()] == [13.0, 11.83, 0.0]


def test_reliability(spark):
    spans = spark.createDataFrame([(1, "1", 0, 4, "A"), (1, "2", 0, 5, "A"), (1, "3", 2, 4, "A")], "doc_id int, coder string, start int, end int, label string")
    r = reliability.ratings(spans, spark.createDataFrame([(1, 10)], "doc_id int, n_chars int"), ["1", "2", "3"])
    agree = {(x.coder1, x.coder2): x.agreement for x in reliability.percent_agreement(r).collect()}
    assert agree == {("1", "2"): 90.0, ("1", "3"): 80.0, ("2", "3"): 70.0}
    assert sorted(x.kappa for x in reliability.cohens_kappa(r).collect()) == [0.4, 0.5455, 0.8]
    assert reliability.fleiss_kappa(r).first().asDict() == {"p": 0.8, "pe": 0.5356, "kappa": 0.5694}
    assert reliability.krippendorff_alpha(r).first().alpha == 0.5837


def test_burst(spark):
    s = spark.createDataFrame([("t", y, n) for y, n in ((2010, 1), (2011, 1), (2012, 6), (2013, 7), (2014, 1), (2016, 2))], "term string, year int, n bigint")
    (b,) = biblio.bursts(s).collect()
    assert (b.burst_start, b.burst_end, b.burst_strength, b.burst_weight) == (2012, 2013, 2.7222, 13)


def test_compound_tags(spark):
    t = spark.createDataFrame([("N3.8+/A2.1",), ("Df/I2.2_MWE",), ("",)], "tag string")
    assert [r[0] for r in t.select(semantic.split_compound(F.col("tag"))).collect()] == [["N3.8+", "A2.1"], ["Df_MWE", "I2.2_MWE"], ["Z99"]]
    assert [r[0] for r in t.select(semantic.major_category(F.col("tag"))).collect()] == ["N", None, None]


def test_dates(spark):
    raw = ["2002-01-04", "2002/1/4", "20020104", "2002", "2002-02-31", "x", " 77 ", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "raw string").select(dates.days(F.col("raw"))).collect()]
    assert got == [11691, 11691, 11691, 11688, None, None, 77, None]


@pytest.mark.parametrize(("query", "n"), [('[pos="NOUN"] []{0,2} [lemma=="be" & pos!="AUX"]', 3), ('"word"', 1), ('[]?[word="x"]', 2), ('[word="a]b"]', 1), ('[!pos="X" | word!=="y"]{2,}', 1)])
def test_cql_accepts(query, n):
    assert cql.validate(query) == {"valid": True, "error": None, "pattern_count": n}


@pytest.mark.parametrize("query", ["", '[pos="N"', '[foo="x"]', "abc", '[pos="N"]{}', "[pos=N]"])
def test_cql_rejects(query):
    assert not cql.validate(query)["valid"]


def tokens(spark, *texts):
    rows = [(t, i, w, w, "X", w in ".,") for t, words in enumerate(texts) for i, w in enumerate(words.split())]
    return spark.createDataFrame(rows, "text_id int, tok_idx int, text string, lemma string, pos string, is_punct boolean")


def test_cql_gives_nothing_back(spark):
    t = tokens(spark, "a b x", "x", ". ,")
    hits = lambda q: sorted((r.text_id, r.start, r.length) for r in cql.matches(t, q).collect())
    assert hits('[]{0,3} [word="x"]') == []
    assert hits('[word="a"] []{0,1} [word="x"]') == [(0, 0, 3)]
    assert hits('[word="x"] []?') == [(0, 2, 1), (1, 0, 1)]
    assert hits("[]{2}") == [(0, 0, 2), (0, 1, 2)]


def model(fits, elements):
    """A plain walk: each element takes what it can."""
    out = []
    for start in range(len(fits[0])):
        at = start
        for f, (least, most) in zip(fits, elements, strict=True):
            n = 0
            while n < most and at < len(f) and f[at]:
                n, at = n + 1, at + 1
            if n < least:
                break
        else:
            if at > start:
                out.append((start, at - start))
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.tuples(st.sampled_from(["a", "b", "a|b", ".*"]), st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=3))
def test_cql_walk(spark, words, elements):
    import re

    elements = [(v, least, max(least, most)) for v, least, most in elements]
    query = " ".join(f'[word="{v}"]{{{least},{most}}}' for v, least, most in elements)
    fits = [[bool(re.fullmatch(v, w)) for w in words] for v, _, _ in elements]
    got = sorted((r.start, r.length) for r in cql.matches(tokens(spark, " ".join(words)), query).collect())
    assert got == model(fits, [(a, b) for _, a, b in elements])


def test_search_modes(spark):
    t = spark.createDataFrame([("Thing",), ("the",), ("bath",)], "w string")
    count = lambda *a: t.where(predicates.search(F.col("w"), *a)).count()
    assert [count("starts", "TH"), count("ends", "th"), count("contains", "h"), count("regex", "^t.*g$"), count("regex", "("), count("wordlist", "the\nbath"), count("all")] == [2, 1, 3, 1, 0, 2, 3]
    with pytest.raises(ValueError):
        predicates.PosFilter().concordance(F.col("w"))
    assert kwic.wildcard("a*b?--c.") == r"a.*b.[-\s]?c\."


def test_ngrams_stay_in_their_text(spark):
    t = tokens(spark, "the cat , sat", "on")
    assert sorted(r.ngram for r in freq.ngrams(t, (2, 3, 9)).collect()) == ["cat sat", "the cat", "the cat sat"]
    assert "sat on" in {r.ngram for r in freq.ngrams(t, (2,), cross_text=True).collect()}
    c = freq.ngram_frequency(t, (2, 3))
    assert {(r.parent, r.ngram) for r in freq.nested_ngrams(c).collect()} == {("the cat sat", "the cat"), ("the cat sat", "cat sat")}


def test_shares_and_ranks(spark):
    t = tokens(spark, "a b a c a b", "d . d")
    rows = freq.word_frequency(t).collect()
    assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1)) and abs(sum(r.percentage for r in rows) - 100) < 0.01
    assert [(r.word, r.frequency) for r in sorted(rows, key=lambda r: r.rank)] == [("a", 3), ("b", 2), ("d", 2), ("c", 1)]


def test_text_functions(spark):
    t = spark.createDataFrame([(" Ｆｕｌｌ\twidth ﬁne\u0007, the [x] 42",)], "t string")
    assert t.select(text.preprocess(F.col("t"))).first()[0] == ["full", "width", "fine", "x", "42"]
    row = t.select(text.srt_time(F.lit(3661.5)), text.human_count(F.lit(1234567)), text.list_of(F.lit("a;bb; cc")), text.address_parts(F.lit("[A, B] Univ X, City, Norway 0313."))[1]).first()
    assert tuple(row) == ("01:01:01,500", "1.2M", ["bb", "cc"], "Norway")


def test_identical_coders_agree(spark):
    spans = spark.createDataFrame([(1, c, 2, 5, "A") for c in "12"], "doc_id int, coder string, start int, end int, label string")
    r = reliability.ratings(spans, spark.createDataFrame([(1, 9)], "doc_id int, n_chars int"), ["1", "2"])
    assert reliability.cohens_kappa(r).first().kappa == 1.0 and reliability.krippendorff_alpha(r, "interval").first().alpha == 1.0
    assert reliability.precision_recall(spans, "1").first().f1 == 1.0


def test_label_propagation_and_merging(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)], "id1 bigint, id2 bigint, similarity double")
    got = {r.id: r.cluster for r in biblio.label_propagation(e).collect()}
    assert got[1] == got[2] == got[3] != got[7] and got[7] == got[8]
    rows = [(10 * c + i, c) for c, n in ((1, 5), (2, 1), (3, 2), (4, 2)) for i in range(n)]
    clusters = spark.createDataFrame(rows, "id bigint, cluster bigint")
    into = lambda n: {(r.id // 10, r.cluster) for r in biblio.merge_clusters(clusters, n).collect()}
    assert into(2) == {(1, 1), (2, 1), (3, 1), (4, 4)} and into(1) == {(k, 1) for k in (1, 2, 3, 4)} and into(9) == {(k, k) for k in (1, 2, 3, 4)}


def test_clusters_run_until_nothing_changes(spark):
    """A long chain of keywords against plain synchronous propagation."""
    entries = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"], [f"a{i // 3}"]) for i in range(30)], "id bigint, keywords array<string>, authors array<string>")
    got = {r.id: r.cluster for r in biblio.cluster_entries(entries).collect()}
    links = {i: {j: round(1 / 3, 4) for j in (i - 1, i + 1) if 0 <= j < 30} | {i: round(1 / 3, 4)} for i in range(30)}
    labels = {i: i for i in links}
    for _ in range(50):
        new = {}
        for i, near in links.items():
            votes = {}
            for j, w in near.items():
                votes[labels[j]] = round(votes.get(labels[j], 0) + w, 6)
            new[i] = max(votes, key=lambda x: (votes[x], -x))
        if new == labels:
            break
        labels = new
    assert got == labels
    by_author = {r.id: r.cluster for r in biblio.cluster_entries(entries, "authors").collect()}
    assert all(by_author[i] == 3 * (i // 3) for i in range(30))


def test_fuzzy_find_falls_back_to_other_lengths_and_keeps_every_match(spark):
    needle, least = "abcdef", 0.8

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    def brute(text, near=None):
        found = []
        for lengths in ([6], range(4, 9)):
            for m in lengths:
                for i in range(len(text) - m + 1):
                    if near is not None and not (near - 3 <= i and i + m <= near + 9):
                        continue
                    s = 1 - edits(text[i : i + m].lower(), needle) / max(m, 6)
                    if s >= least:
                        found.append((i, i + m, round(s, 4)))
            if found:
                break
        return sorted(found)

    texts = ["xxabcdefxxABCDEFxxabcxefx", "zzzabcdzzz", "abXcdef", "zabdefzzabdefz", "", "abc", "q" * 40 + "abcdef", None]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "text_id int, text string, near int")
    for near in (None, "near"):
        got = {}
        for r in reliability.fuzzy_find(df, needle, least, near, step=5).collect():
            got.setdefault(r.text_id, []).append((r.start, r.end, r.similarity))
        want = {i: brute(t, 3 if near else None) for i, t in enumerate(texts) if t}
        assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert reliability.fuzzy_find(df, "").count() == 0


def test_text_types_and_bands(spark):
    t = spark.createDataFrame([("LAW",), ("Legal Document",), ("Social Media",), ("own",), (None,)], "t string")
    assert [r[0] for r in t.select(semantic.priority_of(F.col("t"), {"own": ("Z1",)})).collect()] == [["G2", "G2.1"], ["G2", "G2.1"], [], ["Z1"], []]
    tokens_ = spark.createDataFrame([("x", 0, "a", ["A1", "G2.1/B2"], "LAW"), ("x", 1, "b", ["A1", "B1"], "MED"), ("x", 2, "c", ["A1", "B1"], "GEN")], "text_id string, tok_idx int, lemma string, usas_tags array<string>, text_type string")
    rows = semantic.disambiguate(tokens_, semantic.priority_of(F.col("text_type"))).orderBy("tok_idx").collect()
    assert [(r.usas_tag, r.method) for r in rows] == [("G2.1", "priority"), ("B1", "priority"), ("A1", "domain")]
    f = spark.createDataFrame([(x,) for x in (0.9, 0.8, 0.79, 0.6, 0.5, 0.1)], "f double")
    assert [r[0] for r in f.select(reliability.f1_band(F.col("f"))).collect()] == ["excellent", "good", "fair", "moderate", "poor", "very poor"]


def test_gold_summary(spark):
    counts = spark.createDataFrame([("a", "*", 3, 1, 1), ("b", "*", 0, 2, 4), ("a", "X", 3, 1, 1), ("b", "X", 0, 2, 4)], "coder string, label string, tp bigint, fp bigint, fn bigint")
    rows = {(r["kind"], r["item"]): (r["precision"], r["recall"], r["f1"], r["band"]) for r in reliability.gold_summary(counts).collect()}
    assert rows == {("coder", "a"): (0.75, 0.75, 0.75, "fair"), ("coder", "b"): (0.0, 0.0, 0.0, "very poor"), ("label", "X"): (0.5, 0.375, 0.4286, "very poor"), ("mean", "*"): (0.375, 0.375, 0.375, "very poor")}


def test_report_page(spark, tmp_path):
    rows = [("cohens_kappa", "a<b>-c", 0.1235, "slight"), ("cohens_kappa", "a-\"d&", 0.12, None), ("cohens_kappa", None, None, None), ("percent_agreement", "x", -0.5, "poor"), ("zeta", "*", 1.0, "k"), (None, "lost", 1.0, "k")]
    page = reliability.report_page(spark.createDataFrame(rows, "measure string, item string, value double, band string").repartition(3), "A & B")
    got = [r.html for r in page.orderBy("nth").collect()]
    assert len(got) == 5 and got[0].endswith("<h1>A &amp; B</h1>") and "percent" not in got[0]
    cell = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    assert got[1].startswith("<section><h2>Percent agreement</h2>") and cell("x", "-0.5000", "poor") + cell("mean", "-0.5000", "-") in got[1]
    # the mean of 0.1235 and 0.12 is 0.12175: half up in ten-thousandths
    assert cell("-", "-", "-") + cell("a-&quot;d&amp;", "0.1200", "-") + cell("a&lt;b&gt;-c", "0.1235", "slight") + cell("mean", "0.1218", "-") in got[2]
    assert "<h2>zeta</h2>" in got[3] and "mean" not in got[3] and "lost" not in "".join(got)
    writers.write_page(page, str(tmp_path / "page"))
    (part,) = (tmp_path / "page").glob("part-*")
    assert part.read_text("utf-8").splitlines() == got
    empty = reliability.report_page(spark.createDataFrame([], "measure string, item string, value double, band string"))
    assert empty.count() == 2


def test_cooccurrence_pairs(spark):
    rows = [(["b", " a", "b", "", "c"],), (["c", "a"],), (["a"],), ([],), (None,), ([f"{k:04d}" for k in range(300)],)]
    got = {(r.source, r.target): r.weight for r in biblio.cooccurrence(spark.createDataFrame(rows, "x array<string>"), "x").collect()}
    assert got[("a", "c")] == 2 and got[("a", "b")] == got[("b", "c")] == 1 and len(got) == 3 + 300 * 299 // 2
