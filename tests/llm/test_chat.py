import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.chat import Parser, chat_digests, format_chats, format_turn, unescape

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, nth int"
HARD = st.lists(st.sampled_from(list("ab\\#:<>/ \n") + ["###", "### ", "</turn>", "</turn>\n", "\\###", "### assistant: "]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5), st.integers(1, 7))
def test_round_trip(turns, step):
    whole = "".join(format_turn(r, t)[0] for r, t in turns)
    parser, got = Parser(), []
    for i in range(0, len(whole), step):
        got += parser.feed(whole[i : i + step])
    assert [(r, t) for r, t, *_ in got] == turns and not parser.rest
    assert all(unescape(whole[a:b]) == t for _, t, a, b in got)


def test_escapes_only_conflicts():
    assert format_turn("user", "a \\ b # c < d")[0] == "### user: a \\ b # c < d </turn>\n"
    assert format_turn("user", "see ### x")[0] == "### user: see \\### x </turn>\n"


def check(df):
    convs = defaultdict(list)
    for r in df.collect():
        convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    want, texts = [], defaultdict(str)
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out = "".join(format_turn(r, t)[0] for r, t in turns)
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(out)))
        texts[c] = out
    assert sorted(map(tuple, chat_digests(df).collect()), key=str) == sorted(want, key=str)
    rows = sorted(format_chats(df).collect(), key=lambda r: (str(r.conv_id), r.nth))
    got, loss = defaultdict(str), defaultdict(str)
    for r in rows:
        got[r.conv_id] += r.rendered
    for r in rows:
        if r.loss_start is not None:
            loss[r.conv_id] += unescape(got[r.conv_id][r.loss_start : r.loss_start + r.loss_length])
    assert got == texts and {w[0]: hashlib.sha256(loss[w[0]].encode()).hexdigest() for w in want} == {w[0]: w[4] for w in want}


def test_awkward_rows(spark):
    hard = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard), (1, 0, None, None), (1, None, "assistant", "x"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "user", "a" * 300000), (None, None, None, None), (2, 3, "ro:le\\#", "é\n### user: 東")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"t{i} </turn>\n") for i in range(3000)]
    check(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5))


def test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_digests(none).collect() == [] and format_chats(none).collect() == []
