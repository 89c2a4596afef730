import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import DATA
from textloom.llm.packing import WordEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abZ'sSt 9%,.!\n\0́ ẛßİ€é")), max_size=40), max_size=4))
def test_word_ids_are_the_tokenizers(texts):
    texts = [*texts, "it's we'LL a,b 5%% don't. <|endoftext|> x<|startoftext|>"]
    got = WordEncoder.of(PATH).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def check(df, padding):
    rows = pack(df, PATH).toPandas()
    want = sorted((str(r.doc_id), ids_of(r.text).tobytes()) for r in df.collect())
    total = sum(len(w[1]) // 4 for w in want)
    assert rows.length.sum() == total and (rows.length > 0).all()
    by = {}
    for key, ids in want:
        by.setdefault(key, []).append(np.frombuffer(ids, "<u4"))
    for r in rows.itertuples():
        key = "None" if r.doc_id != r.doc_id or r.doc_id is None else str(int(r.doc_id))
        assert any(len(a) == r.doc_tokens and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for a in by[key])
    waste = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        n = g.length.sum()
        assert n <= 2048
        waste += 2048 - n if n & (n - 1) else 0
    assert waste <= padding * total


def test_awkward_rows(docs):
    check(docs, 0.01)


def test_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet").repartition(5), 0.01)


def test_pieces_carry_their_ids(docs):
    for r in pack(docs, PATH, with_ids=True).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_empty(nothing):
    assert pack(nothing, PATH).collect() == []


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 5000])
def test_sizes(spark, n):
    check(spark.createDataFrame([(1, "a " * (n - 1))], "doc_id int, text string"), 0.0)
