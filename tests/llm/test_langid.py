import zlib

import numpy as np
import pyarrow as pa

from textloom.llm import langid
from textloom.llm.langid import fit, has_letter, identify, known_language, train


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and len(held) > 100
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)
    again = identify(df.drop("lang", "source").selectExpr("doc_id", "text", "'xx' lang"), model=fit(df)).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in again} == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in got}


def plain_logits(model, text):
    """Averages over a text's subwords of three to five bytes, one by one."""
    fold = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    total, n = np.zeros(len(model.langs)), 0
    for size in (3, 4, 5):
        for i in range(len(fold) - size + 1):
            h = size * 0x9E3779B1 & 0xFFFFFFFF
            for c in fold[i : i + size]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            total += model.weights[:, h & 0xFFFF]
            n += 1
    return total / max(n, 1) + model.bias


def test_scores_against_single_subwords(monkeypatch):
    """A model's probabilities from a text's subwords, also where a text spans many blocks."""
    texts = ["The house of the old man", "Das Haus des alten Mannes", "", "x", "été où ça", "ab", "Ende\n  der Zeile, 1234 ###"]
    model = train(texts * 3, ["en", "de", "de", "en", "fr", "en", "de"] * 3)
    for block in (1 << 20, 7):
        monkeypatch.setattr(langid, "_BLOCK", block)
        got, score = model.predict(pa.array(texts))
        for t, g, s in zip(texts, got, score, strict=True):
            z = plain_logits(model, t) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if any(c.isalpha() for c in t):
                assert g == model.langs[int(p.argmax())] and abs(s - p.max()) < 1e-5
            else:
                assert (g, s) == ("und", 0.0)


def test_repeated_rows_are_learned_once(spark):
    """One row that holds most of the table, and a text above the bound, leave the sample small."""
    rows = [(1, "a text in English that recurs", "en")] * 3000 + [(i, f"ein Text auf Deutsch {i}", "de") for i in range(4, 40)] + [(50, "long " * 9000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = identify(df).where("doc_id < 50").groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 3000, "de": 36}


def test_awkward_rows(docs):
    got = identify(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r for r in got}
    assert texts[9].lang_pred == texts[10].lang_pred == texts[11].lang_pred == texts[13].lang_pred == "und"
    assert texts[9].score == 0.0 and texts[9].rejected
    assert {r.lang_pred for r in got} <= {"und", "en", "fr", "de", "es"}
    kept = known_language(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert kept.count() == sum(not r.rejected for r in got)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, "x", None)], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in identify(df).collect()} == {("und", 0.0)} and known_language(df).count() == 0


def test_empty(nothing):
    assert identify(nothing).collect() == [] and known_language(nothing).collect() == []


def test_letters_are_unicodes_letters():
    for text in ("\u00b2", "\u00bd", "\u2167", "\u2460 \u2461", "123", "_", "", "\u0661", "\u0301"):
        assert not has_letter(text)
    for text in ("x", "1\u00e9", "\u00b2\u00aa", "\u6771", "\u02b0", "\u01c5"):
        assert has_letter(text)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(k, f"{k} " + "xyzw " * 400, f"l{k % 3}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.append(sum(map(len, texts))))
    langid.fit(df, most_total=100_000)
    langid.fit(df)
    assert 20_000 < seen[0] < 200_000 < seen[1]
