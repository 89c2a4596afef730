"""Words of unspaced text against every way to cut it, and a small dictionary of Chinese."""

import math
import random

from textloom.operators.segmentation import segment

WORDS = {"南京": 500, "南京市": 300, "市长": 400, "长江": 600, "长江大桥": 200, "大桥": 450, "江大桥": 2, "研究": 700, "研究生": 300, "生命": 600, "命": 80, "起源": 300, "的": 5000, "我们": 900, "我": 800, "们": 100, "在": 2000, "市": 300, "生": 200}


def every_way(run, weight, unknown):
    if not run:
        yield 0.0, []
        return
    for k in range(1, min(8, len(run)) + 1):
        w = weight.get(run[:k], unknown if k == 1 else None)
        if w is not None:
            for s, rest in every_way(run[k:], weight, unknown):
                yield s + w, [run[:k], *rest]


def best(run, counts):
    total = sum(counts.values()) or 1
    weight = {w: math.log(c) - math.log(total) for w, c in counts.items()}
    ways = list(every_way(run, weight, -math.log(total)))
    top = max(round(s, 7) for s, _ in ways)
    return max((w for s, w in ways if round(s, 7) == top), key=lambda w: [len(x) for x in w])


def test_chinese(spark):
    df = spark.createDataFrame([(1, "南京市长江大桥。研究生命的起源, abc 我们在X大桥"), (2, None), (3, ""), (3, "no ideographs"), (None, "𠀀𠀁我们")], "id int, text string").repartition(3)
    words = spark.createDataFrame([*WORDS.items(), ("大桥", 3), ("起", 0)], "word string, count bigint")
    got = sorted(((r.id, r.words) for r in segment(df, words).collect()), key=str)
    assert got == sorted([(1, ["南京市", "长江大桥", "研究", "生命", "的", "起源", "我们", "在", "大桥"]), (2, []), (3, []), (3, []), (None, ["𠀀", "𠀁", "我们"])], key=str)
    assert all(len(w) == 1 for r in segment(df, words.limit(0)).collect() for w in r.words)
    assert segment(df.limit(0), words).collect() == []


def test_equals_every_way(spark):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(25)}
    runs = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([(k, f"{r}, {r[::-1]}") for k, r in enumerate(runs)], "id int, text string")
    got = {r.id: r.words for r in segment(df, spark.createDataFrame(list(counts.items()), "word string, count int"), pattern="[a-z]+").collect()}
    assert all(got[k] == best(r, counts) + best(r[::-1], counts) for k, r in enumerate(runs))


def test_long_run(spark):
    df = spark.createDataFrame([(1, "研究生命" * 5000)], "id int, text string")
    got = segment(df, spark.createDataFrame(list(WORDS.items()), "word string, count bigint")).first().words
    assert "".join(got) == "研究生命" * 5000 and set(got) <= {"研究", "生命"}
