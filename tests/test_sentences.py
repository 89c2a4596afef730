from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions.sentences import chunk_spans, chunks, sentence_spans, sentences, shifted


def cut(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_sentences():
    assert cut("Dr. Smith paid 3.14 to j.p@x.org. He left! Why? see www.a.b now.") == ["Dr. Smith paid 3.14 to j.p@x.org.", "He left!", "Why? see www.a.b now."]
    assert cut("# Title\nFirst line\n- item one\n1. item two. End") == ["# Title", "First line", "- item one", "1. item two.", "End"]
    assert cut("一。二！") == ["一。", "二！"] and cut("") == []


@given(st.text(alphabet=st.sampled_from("aB.!? \n1"), max_size=80), st.integers(1, 30))
def test_spans_cover_the_text(text, size):
    spans = sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
    parts = chunk_spans(text, size)
    assert "".join(text[a:b] for a, b in parts) == text and all(b - a <= size + max(1, size // 5) for a, b in parts)


def test_columns(spark):
    t = spark.createDataFrame([("One. Two.",), (None,)], "t string")
    got = t.select(sentences("t").alias("s")).select(F.get(shifted(F.col("s"), F.lit(10)), F.lit(1))["start"]).collect()
    assert [r[0] for r in got] == [15, None] and t.select(F.size(chunks(F.col("t"), 4))).first()[0] == 2
