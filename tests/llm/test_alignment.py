"""Alignment against plain encodings, plain two-pointer groups and plain counts over all documents."""

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm.alignment import Aligner, align, byte_alphabet, merge, spread

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text):
    """Groups of (a ids, b ids) of a whole text, encoded at once; none if it has no tokens."""
    if not text:
        return []
    alphabet = byte_alphabet()
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    names = {i: t for t, i in TOK.get_vocab().items()}
    of_a = [bytes(alphabet[c] for c in names[i]) for i in a]
    of_b = [bytes([int(SP.id_to_piece(i)[3:5], 16)]) if SP.is_byte(i) else SP.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return []
    ends = lambda x: {e: k + 1 for k, e in enumerate(accumulate(map(len, x)))}
    ea, eb = ends(of_a), ends(of_b)
    out, i, j = [], 0, 0
    for e in sorted(ea.keys() & eb.keys()):
        ni, nj = ea[e], eb[e]
        out.append((a[i:ni], b[j:nj]))
        i, j = ni, nj
    return out


def expected(texts):
    groups = [plain(t) for t in texts]
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for g in groups]
    count = Counter(p for x in links for p in set(x))
    best_a, best_b = Counter(), Counter()
    for (x, y), n in count.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    for g, x in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(count[p] == best_a[p[0]] for p in x), sum(count[p] for p in x), hashlib.sha256(text.encode()).hexdigest() if g else "", sum(count[p] == best_b[p[1]] for p in x))


HARD = ["Hello  world ", " a", "\nLe mot", "x\xa0 y\xa0", "ﬁ é", "a\t b\r\n  c \n\n d", "<|endoftext|> <s> <0x41> </s>", "▁x", "a ▁ b", "　a", "x   ", "é\x00b", "日本 語", "don't  'll 's", "🙂🙂 a  b", "é\ń x", ".\n.\n\n.", "\n", " ", "\u0085x \u0085", "a\x1c b \x1fc", "x᠎ y"]


def two_pointers(ends_a, ends_b):
    i = j = g = 0
    of_a, of_b = [], []
    while i < len(ends_a):
        if j < len(ends_b) and ends_b[j] < ends_a[i]:
            of_b.append(g)
            j += 1
        elif j < len(ends_b) and ends_b[j] == ends_a[i]:
            of_a.append(g)
            of_b.append(g)
            i, j, g = i + 1, j + 1, g + 1
        else:
            of_a.append(g)
            i += 1
    return of_a, of_b, g


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_two_pointers(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    of_a, of_b, n = merge(np.array(a), np.array(b))
    assert (of_a.tolist(), of_b.tolist(), n) == two_pointers(a, b)
    at_a, at_b = spread(of_a, of_b, n)
    assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if of_a[i] == of_b[j]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\xa0　 '.,sdtéabcX1▁<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_segments_change_nothing(text):
    aligner = Aligner.of(A, B)
    got = aligner.block([text.encode()])
    want = plain(text)
    assert got.sums[0].tolist()[:3] == [sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want)]
    assert got.digests[0] == (hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want).encode()).hexdigest() if want else "")


def test_hard_texts_and_tables(spark):
    texts = [None, "", *HARD, *HARD[:3], " ".join(HARD), "word " * 3000, "x" * 20_000, "the The THE\nthe"]
    df = spark.createDataFrame([(None if k == 5 else k // 2, t, "z", 1, b"q", 2) for k, t in enumerate(texts)], "doc_id bigint, text string, block string, slot int, slots binary, n int").repartition(3)
    got = sorted((tuple(r)[1:] for r in align(df, A, B).collect()), key=repr)
    assert got == sorted(expected(texts), key=repr)
    assert align(df.limit(0), A, B).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, expected([r.text for r in rows]), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in align(docs.repartition(5), A, B).collect()}
    assert got == want


def test_blocks_do_not_matter(spark, monkeypatch):
    from textloom.llm import alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    want = sorted(map(tuple, align(docs, A, B).collect()))
    monkeypatch.setattr(alignment, "BLOCK", 20_000)
    assert sorted(map(tuple, align(docs, A, B).collect())) == want


@pytest.mark.parametrize("text", HARD)
def test_each_hard_text(text):
    assert Aligner.of(A, B).block([text.encode()]).sums[0][2] == len(plain(text))
