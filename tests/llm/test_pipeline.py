"""The pipeline's stages, each on what the one before kept, against plain Python; awkward and empty tables."""

import importlib.util

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.conftest import words
from tests.llm.test_linededup import brute
from tests.llm.test_near_sets import kept
from textloom.runtime import materialize


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    stage = [f for _, f in corpus_pipeline.STAGES]
    columns = docs.columns

    known = materialize(stage[0](spark, docs, DATA))
    assert known.columns == columns and known.count() >= 0.98 * docs.count()

    lined = materialize(stage[1](spark, known, DATA))
    rows = [(r.doc_id, r.text, r.h) for r in known.selectExpr("doc_id", "text", "cast(shiftright(xxhash64(text), 32) as int) h").collect()]
    gone = brute(rows)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (True, i, k, h) not in gone) for i, t, h in rows}
    got = {r.doc_id: r for r in lined.collect()}
    assert lined.columns == columns and {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    single = materialize(stage[2](spark, lined, DATA))
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == kept([(i, got[i].text) for i in sorted(got)])

    mixed = materialize(stage[3](spark, single, DATA))
    size = single.select("text").collect()
    total = sum(len(words(r.text)) for r in size)
    took = sum(len(words(r.text)) for r in mixed.collect())
    assert mixed.columns == columns and abs(took - 1.5 * total) <= 0.02 * total

    packed = stage[4](spark, mixed, DATA).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.length.sum() == ids
    full = packed.groupby("sequence_id").length.sum()
    assert full.max() <= 2048 and sum(2048 - n for n in full if n & (n - 1)) <= 0.01 * ids
    again = corpus_pipeline.run(spark, DATA).toPandas()
    assert again.length.sum() == ids


def test_awkward_and_empty_tables(spark, docs, nothing):
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        assert stage(spark, nothing, DATA).collect() == []
    assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() >= docs.count()
    assert corpus_pipeline.STAGES[4][1](spark, nothing, DATA).collect() == []


def test_entry_registers_all():
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {"op7_quality", "op8_mixing", "op12_codes", "op13_pii"} <= set(entry.oracle_sql()) <= names
