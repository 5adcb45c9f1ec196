import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import context as C
from quillspan.sources import writers


def plain_line_negative(text, a, z):
    begin = max(text.rfind("\n", 0, a) + 1, a - 120)
    lead, behind = text[begin:a].lower().replace(text[a:z].lower(), "", 1), text[z : z + 20].split("\n")[0].lower()
    lead, behind = re.sub(C.LITERALS, " ", lead), re.sub(C.LITERALS, " ", behind)
    tails = [lead[lead.rfind(p) + len(p) :] for p in C.LINE_PHRASES if p in lead]
    return any(p in behind for p in C.LINE_PHRASES) or any(not any(t in x for t in C.TAKEN_BACK) for x in tails)


def test_contexts_against_a_plain_version(spark):
    rng = random.Random(5)
    parts = ["sample ", "but ", "\n", "4111 ", "x" * 70, " Test ", "however ", "a@test.org ", "ticket ", "demo ", "the real ", "not provided ", "Büro "]
    rows = []
    for _ in range(400):
        head, tail = ("".join(rng.choices(parts, k=rng.randrange(7))) for _ in "ab")
        value = rng.choice(["4111", "sample", ""])
        rows.append((head + value + tail, len(head), len(head) + len(value)))
    at = F.col("t"), F.col("a"), F.col("z")
    got = spark.createDataFrame(rows, "t string, a int, z int").select("t", "a", "z", C.line_negative(*at).alias("line"), C.window_negative(*at).alias("near"), C.positive(*at, F.lit("X"), {"X": ["büro"], "Y": ["4111"]}).alias("pos")).collect()
    for r in got:
        assert r.line == plain_line_negative(r.t, r.a, r.z), r
        assert r.near == any(p in r.t[max(0, r.a - 80) : r.z + 20].lower() for p in C.WINDOW_PHRASES), r
        assert r.pos == ("büro" in r.t[max(0, r.a - 120) : r.z + 20].lower()), r


def test_fallback(spark):
    df = spark.createDataFrame([(0, " ab 12 \n"), (1, "12"), (2, "  "), (3, None), (4, "")], "k int, t string")
    take = lambda mode: {r.k: [(s.start, s.end, s.value, s.source) for s in r.c or []] for r in df.select("k", C.fallback(F.col("t"), {"n": r"\s?[0-9]+"}, mode).alias("c")).collect()}
    full, n = "fallback_full_input", "regex_candidate:n"
    assert take("full_and_regex") == {0: [(1, 6, "ab 12", full), (4, 6, "12", n)], 1: [(0, 2, "12", full)], 2: [], 3: [], 4: []}
    assert take("regex_only") == {0: [(4, 6, "12", n)], 1: [(0, 2, "12", n)], 2: [], 3: [], 4: []}
    assert take("full_only")[0] == [(1, 6, "ab 12", full)]
    with pytest.raises(ValueError):
        C.fallback(F.col("t"), {}, "other")


def test_weights_and_table(spark):
    rows = spark.createDataFrame([(0.0,), (0.2,), (0.4,), (0.79,), (0.8,), (None,)], "f double").select(C.sampling_weight(F.col("f")).alias("w"))
    assert [r.w for r in rows.collect()] == [8.0, 5.0, 3.0, 1.5, 0.5, 0.5]
    w = spark.createDataFrame([("strong_positive_context", "zero_example_b"), ("strong_positive_context", None), (None, None), ("hard_negative_context", "zero_example_b")], "c string, g string")
    assert [r.w for r in w.select(C.context_weight(F.col("c"), F.col("g")).alias("w")).collect()] == [0.6, 0.7, 0.5, 0.8]
    df = spark.createDataFrame([("a|b", 0.5, None), ("c\nd", 1.0, 2)], "name string, f double, n int")
    assert writers.markdown_table(df.orderBy("name")) == "| name | f | n |\n| --- | --- | --- |\n| a\\|b | 0.5000 |  |\n| c d | 1.0000 | 2 |\n"
    with pytest.raises(ValueError):
        writers.markdown_table(df, rows=1)
