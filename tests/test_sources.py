"""Readers and writers on small files, the framework tree, connected components, and the entry points' guard."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from textloom.operators import catalog, frameworks, graph
from textloom.sources import readers, writers


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_tokens_from_all_shapes(spark, tmp_path):
    tok = lambda t, h: {"text": t, "head": h, "pos": "X"}
    put(tmp_path / "a.spacy.json", {"tokens": [tok("x", 0), tok("y", 0)]})
    put(tmp_path / "b.json", {"segments": {"s2": {"segment_start": 5.0, "tokens": [tok("c", 0), tok("d", 0)]}, "s1": {"segment_start": 1.0, "tokens": [tok("a", 0)]}}})
    rows = {(r.text_id, r.tok_idx): (r.text, r["head"], r.is_punct) for r in readers.read_tokens(spark, str(tmp_path)).collect()}
    assert rows == {("a", 0): ("x", 0, False), ("a", 1): ("y", 0, False), ("b", 0): ("a", 0, False), ("b", 1): ("c", 1, False), ("b", 2): ("d", 1, False)}


def test_frequency_lists(spark, tmp_path):
    put(tmp_path / "bnc_social_science.csv", "word,lemma,pos,freq\na,a,DT,5\na,a,NN,bad\n")
    t = readers.read_frequencies(spark, str(tmp_path))
    assert readers.resources(t).first().asDict() == {"prefix": "bnc", "category": "social_science", "words": 1, "tokens": 5}
    out = str(tmp_path / "out")
    writers.write_frequencies(t, out)
    assert readers.read_frequencies(spark, out).count() == 2


WOS = """FN Clarivate
VR 1.0
PT J
AU Smith, J
   Doe, A,
TI A long title on corpora
   and tools
SO Journal
PY 2015
C1 [Smith, J] Univ X, City, Norway.
   [Doe, A] Inst Y, Town, Spain 28001
DE corpus; tools
ID tools; methods
TC 7
DT Article
UT WOS:1
ER

PT J
AU Solo, B
TI Using the words based corpora
PY x
RP Solo, Big Institute, Rome
U1 3
ER

EF
"""


def test_bibliographic_exports(spark, tmp_path):
    put(tmp_path / "w.txt", WOS)
    files = readers.read_whole(spark, str(tmp_path))
    assert files.select(readers.source_type(F.col("value"))).first()[0] == "WOS"
    a, b = sorted(readers.read_wos(files).collect(), key=lambda r: r.title)
    assert a.title == "A long title on corpora\nand tools" and a.authors == ["Smith, J", "Doe, A"] and a.year == 2015
    assert a.institutions == ["Univ X", "Inst Y"] and a.countries == ["Norway", "Spain"] and a.keywords == ["corpus", "tools", "methods"]
    assert (a.citation_count, a.doc_type, a.unique_id) == (7, "Journal Article", "WOS:1")
    assert b.keywords == ["words", "corpora"] and b.citation_count == 3 and b.institutions == ["Big Institute"] and b.year is None
    cnki = tmp_path / "c"
    cnki.mkdir()
    (cnki / "c.txt").write_bytes("RT Journal Article\nA1 王一;李二\nT1 标题\nJF 期刊\nYR 2019\nK1 语料;工具\n\nRT Dissertation\nA1 张三\nT1 第二\n".encode("gbk"))
    got = sorted(readers.read_cnki(readers.read_whole(spark, str(cnki))).collect(), key=lambda r: r.doc_type)
    assert [(r.title, r.authors, r.year, r.keywords, r.doc_type) for r in got] == [("第二", ["张三"], None, [], "Dissertation"), ("标题", ["王一", "李二"], 2019, ["语料", "工具"], "Journal Article")]


def test_tagged_corpora_and_archives(spark, tmp_path):
    for d in ("x", "t", "r", "d"):
        (tmp_path / d).mkdir()
    put(tmp_path / "x/A00.xml", '<bncDoc><s n="1"><w c5="AT0" hw="the">The </w><w c5="NN1" hw="cat">cat</w></s></bncDoc>')
    assert [tuple(r) for r in readers.read_bnc(spark, str(tmp_path / "x")).collect()] == [("A00", "The", "the", "DT"), ("A00", "cat", "cat", "NN")]
    put(tmp_path / "t/ca01", "The_AT a_b_NN plain\n")
    assert [tuple(r)[1:] for r in readers.read_tagged(spark, str(tmp_path / "t")).collect()] == [("The", "AT"), ("a_b", "NN"), ("plain", None)]
    put(tmp_path / "r/1.json", {"id": "i", "type": "text", "textId": "t", "coderName": "c", "annotations": [{"text": "abc", "startPosition": 2, "endPosition": 5, "label": "L"}, {"text": "de", "position": 7, "label": "M"}]})
    assert [tuple(r) for r in readers.read_archives(spark, str(tmp_path / "r"), "text").collect()] == [("t", "c", 2, 5, "L", None), ("t", "c", 7, 9, "M", None)]
    put(tmp_path / "d/oxf.json", {"entries": {"cat": {"word": "Cat", "content": "c"}}})
    assert tuple(readers.read_dictionaries(spark, str(tmp_path / "d")).first()) == ("oxf", "cat", "Cat", "c")


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([(0, 0.0, 1.5, " hi "), (1, 1.5, 3.0, "you")], "id int, start double, end double, text string")
    writers.write_srt(t.coalesce(1), str(tmp_path / "srt"))
    assert spark.read.text(str(tmp_path / "srt"), wholetext=True).first()[0].startswith("1\n00:00:00,000 --> 00:00:01,500\nhi\n\n2\n")
    writers.write_table(t.withColumn("a", F.array("id")), str(tmp_path / "tsv"), "tsv")
    tokens = spark.createDataFrame([("c1", 1, "A", "a", "X")], "corpus string, text_id int, text string, lemma string, pos string")
    writers.write_tokens(tokens, str(tmp_path / "tok"))
    assert (tmp_path / "tok/corpus=c1").is_dir()


def test_framework_edits(spark):
    doc = {"name": "F", "root": {"id": "r", "name": "root", "type": "tier", "children": [{"id": "a", "name": "A", "type": "tier", "children": [{"id": "b", "name": "b", "type": "label"}]}]}}
    tree = frameworks.flatten(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    tree = frameworks.add(tree, "F", "/root/A", "n", "new")
    tree = frameworks.define(frameworks.rename(tree, "F", "/root/A", "Z"), "F", "/root/Z/new", "text")
    assert {(r.path, r.definition) for r in tree.collect()} == {("/root", None), ("/root/Z", None), ("/root/Z/b", None), ("/root/Z/new", "text")}
    assert frameworks.delete(tree, "F", "/root/Z").count() == 1
    with pytest.raises(ValueError):
        frameworks.add(tree, "F", "/root/Z", "m", "new")
    with pytest.raises(ValueError):
        frameworks.delete(tree, "F", "/root")


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, 3), (None, 1), (5, 5), (200, 201), (0, 1)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 100: 0, 200: 200, 201: 200}
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


def test_entry_without_the_training_operators(tmp_path):
    """The rest imports when that subpackage and the pipeline are gone."""
    for name in ("textloom", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "textloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'word_frequency' in q and not any(k.startswith('op') for k in q) and set(o) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0


def test_semantic_annotations(spark, tmp_path):
    tok = lambda t: {"text": t, "usas_tag": "A1"}
    put(tmp_path / "a.usas.json", {"success": True, "tokens": [tok("x"), tok("y")]})
    put(tmp_path / "b.json", {"tokens": [tok("spoken")], "usas_annotations": {"segments": {"s10": {"segment_start": 9.5, "tokens": [tok("c")]}, "s2": {"segment_start": 1.5, "tokens": [tok("a"), tok("b")]}}}})
    put(tmp_path / "c.json", {"usas_annotations": {"tokens": []}})
    rows = sorted((r.text_id, r.tok_idx, r.segment_id, r.text, r.usas_tag) for r in readers.read_usas(spark, str(tmp_path)).collect())
    assert rows == [("a", 0, None, "x", "A1"), ("a", 1, None, "y", "A1"), ("b", 0, "s2", "a", "A1"), ("b", 1, "s2", "b", "A1"), ("b", 2, "s10", "c", "A1")]


def test_metaphor_annotations(spark, tmp_path):
    sent = lambda *words: {"tokens": [{"word": w, "is_metaphor": w == "m"} if w != "n" else {"word": w} for w in words]}
    put(tmp_path / "a.mipvu.json", {"success": True, "sentences": [sent("x", "m"), sent("n")]})
    put(tmp_path / "b.json", {"mipvu_annotations": {"success": True, "segments": [{"mipvu_data": {"success": True, "sentences": [sent("a")]}}, {"mipvu_data": {"success": False, "sentences": [sent("lost")]}}, {"other": 1}, {"mipvu_data": {"success": True, "sentences": [sent("m")]}}]}})
    put(tmp_path / "c.json", {"mipvu_annotations": {"success": True, "sentences": [sent("w")], "segments": [{"mipvu_data": {"success": True, "sentences": [sent("no")]}}]}})
    put(tmp_path / "d.mipvu.json", {"success": False, "sentences": [sent("failed")]})
    put(tmp_path / "e.mipvu.json", {"sentences": [sent("silent")]})
    rows = sorted((r.text_id, r.sent_idx, r.tok_idx, r.word, r.is_metaphor) for r in readers.read_mipvu(spark, str(tmp_path)).collect())
    assert rows == [("a", 0, 0, "x", False), ("a", 0, 1, "m", True), ("a", 1, 2, "n", False), ("b", 0, 0, "a", False), ("b", 1, 1, "m", True), ("c", 0, 0, "w", False)]


def test_corpora_of_other_forms(spark, tmp_path):
    for d in ("brown", "oanc", "now"):
        (tmp_path / d).mkdir()
    put(tmp_path / "brown/ca01", "The/at Fulton's/np$-tl 1/2/cd ``/`` x/ppss$ /odd y/zz z\n")
    assert [tuple(r) for r in readers.read_brown(spark, str(tmp_path / "brown")).collect()] == [("ca01", "The", "the", "DT"), ("ca01", "Fulton's", "fulton's", "NNP"), ("ca01", "1/2", "1/2", "CD"), ("ca01", "x", "x", "PRP"), ("ca01", "y", "y", "NN")]
    put(tmp_path / "oanc/a.xml", '<d><s><tok pos="VB" lemma="go">Went</tok><tok type="IN">to</tok></s><w>Sea</w><token pos="">A&amp;B</token><word> </word></d>')
    rows = sorted(tuple(r) for r in readers.read_oanc(spark, str(tmp_path / "oanc")).collect())
    assert rows == [("a", "A&B", "a&b", "NN"), ("a", "Sea", "sea", "NN"), ("a", "Went", "go", "VB"), ("a", "to", "to", "IN")]
    put(tmp_path / "now/n.txt", "A big 3rd día, x_y!\n")
    assert [r.word for r in readers.read_plain_words(spark, str(tmp_path / "now"), 2).collect()] == ["big", "día"]


def test_preprocessed_texts_come_back(spark, tmp_path):
    t = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "text_id int, tokens array<string>")
    writers.write_preprocessed(t, str(tmp_path / "p"), {"language": "en"})
    rows = sorted(tuple(r) for r in readers.read_preprocessed(spark, str(tmp_path / "p")).collect())
    assert rows == [("1", "a b", ["a", "b"], 2, {"language": "en"}), ("2", "", [], 0, {"language": "en"})]


def test_tasks_and_corpora_go(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "text_id int, corpus_id string")
    tags = spark.createDataFrame([(1, "x"), (2, "x")], "text_id int, tag string")
    tasks = spark.createDataFrame([(7, "a", 1), (8, "b", 1), (9, None, 2)], "task_id int, corpus_id string, text_id int")
    t, g, k = catalog.remove_corpora(texts, tags, tasks, spark.createDataFrame([("a",), ("a",)], "corpus_id string"))
    assert sorted(r.text_id for r in t.collect()) == [2, 3] and [tuple(r) for r in g.collect()] == [(2, "x")]
    assert sorted(tuple(r) for r in k.collect()) == [(7, None, None), (8, "b", None), (9, None, 2)]


def test_annotations_are_numbered_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segments": {"10": {"segment_start": 1.0, "tokens": [{"text": "c", "head": 0}]}, "9": {"segment_start": 1.0, "tokens": null}, "b": {"segment_start": 0.5, "tokens": [{"text": "a", "head": 1}, {"text": "b", "head": 0}]}, "z": {"tokens": [{"text": "0", "head": 0}]}}}')
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "b.json").write_text('{"success": true, "sentences": [{"tokens": [{"word": "a"}]}, {"tokens": null}, null, {"tokens": [{"word": "b"}, {"word": "c"}]}]}')
    tokens, usas, mipvu = readers.read_tokens(spark, f"{tmp_path}/a.json"), readers.read_usas(spark, f"{tmp_path}/a.json"), readers.read_mipvu(spark, f"{tmp_path}/m")
    assert sorted((r.tok_idx, r.segment_id, r.text, r["head"]) for r in tokens.collect()) == [(0, "z", "0", 0), (1, "b", "a", 2), (2, "b", "b", 1), (3, "10", "c", 3)]
    assert sorted((r.tok_idx, r.segment_id, r.text) for r in usas.collect()) == [(0, "z", "0"), (1, "b", "a"), (2, "b", "b"), (3, "10", "c")]
    assert sorted((r.tok_idx, r.sent_idx, r.word) for r in mipvu.collect()) == [(0, 0, "a"), (1, 3, "b"), (2, 3, "c")]
    for df in (tokens, usas, mipvu):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
