import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.functions import checks, distributions, text
from quillspan.operators import calibrate, codec, decode, overlap, prep, redact
from quillspan.sources import readers
from quillspan.streaming.redaction import redact_stream

SPAN = "array<struct<start:int,end:int,type:string,confidence:double,source:string>>"


def one(spark, sql, column):
    return spark.sql(sql).select(column.alias("x")).collect()[0].x


def test_match_offsets_against_re(spark):
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1 é😀\n") for _ in range(40)) for _ in range(60)] + ["", "11", "a1"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.matches(F.col("t"), "1+").alias("m")).collect()
    for r in got:
        assert [(x.start, x.end, x.value) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("1+", r.t)]


def test_serving_overlap_cases(spark):
    def run(spans):
        df = spark.createDataFrame([(spans,)], f"s {SPAN}")
        return [(x.start, x.end, x.type) for x in df.select(overlap.serving(F.col("s")).alias("s")).collect()[0].s]

    assert run([(0, 10, "A", 0.5, "model"), (2, 8, "B", 0.5, "model")]) == [(0, 10, "A")]
    assert run([(0, 10, "A", 0.5, "model"), (2, 8, "B", 0.9, "model")]) == [(2, 8, "B")]
    assert run([(0, 10, "A", 0.9, "model"), (2, 8, "B", 0.6, "rule")]) == [(0, 10, "A")]
    assert run([(0, 10, "A", None, "model"), (2, 8, "B", 0.1, "model")]) == [(2, 8, "B")]
    assert run([]) == []


def test_no_overlaps_after_greedy_policies(spark):
    rng = random.Random(4)
    rows = [([(s := rng.randrange(60), s + rng.randrange(1, 12), rng.choice("AB"), rng.random(), "model") for _ in range(12)],) for _ in range(40)]
    df = spark.createDataFrame(rows, f"s {SPAN}")
    for name in ("longest_first", "confident_first", "cursor"):
        for r in df.select(overlap.POLICIES[name](F.col("s")).alias("s")).collect():
            spans = sorted((x.start, x.end) for x in r.s)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_redaction_modes(spark):
    df = spark.createDataFrame([("call Ann on 555 now", [(12, 15, "PHONE", 1.0, "r"), (5, 8, "PERSON", 1.0, "r")]), ("plain", [])], f"t string, s {SPAN}")
    want = {"tag": "call [PERSON] on [PHONE] now", "mask": "call *** on *** now", "remove": "call  on  now", "label": "call <PERSON> on <PHONE> now"}
    for mode, out in want.items():
        assert [r[0] for r in df.select(redact.redacted(F.col("t"), F.col("s"), mode)).collect()] == [out, "plain"]


def test_inverted_thresholds_and_null_confidence(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (0.1,), (None,)], "c double")
    for hi, lo in ((0.8, 0.3), (0.3, 0.8)):
        assert [r[0] for r in df.select(redact.decision(F.col("c"), F.lit(hi), F.lit(lo))).collect()] == ["AUTO_REDACT", "REVIEW", "PASS", None]


def test_checksums(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "123 456 782", "2123 45670 1"), ("4111 1111 1111 1112", "123 456 789", "9123456701"), ("", "", ""), (None, None, None)], "card string, tfn string, med string")
    got = df.select(checks.is_card(F.col("card")).alias("c"), checks.is_tfn(F.col("tfn")).alias("t"), checks.is_medicare(F.col("med")).alias("m")).collect()
    assert [bool(r.c) for r in got] == [True, False, False, False]
    assert [bool(r.t) for r in got] == [True, False, False, False]
    assert [bool(r.m) for r in got] == [True, False, False, False]


def test_context_reset(spark):
    c = text.after_reset(F.col("c"), ["however", "but"])
    got = spark.createDataFrame([("a but b however c",), ("a However b but c",), ("none",)], "c string").select(c.alias("x")).collect()
    assert [r.x for r in got] == [" c", " c", "none"]


def test_distribution(spark):
    m = "SELECT map('A', 0.5D, 'B', 0.25D, 'C', 0.25D) AS m"
    assert one(spark, m, distributions.entropy_bits(F.col("m"))) == 1.5
    assert one(spark, m, distributions.top_mass(F.col("m"), 2)) == 0.75
    assert [e.key for e in one(spark, m, distributions.ranked(F.col("m")))] == ["A", "B", "C"]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    table, start, end = decode.transition_table(2, {"in_in": 0.3, "o_start": -0.4})
    for t in (1, 2, 4):
        scores = rng.normal(size=(t, 9))
        value = lambda p: start[p[0]] + end[p[-1]] + sum(scores[k, y] for k, y in enumerate(p)) + sum(table[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(9), repeat=t), key=value)
        assert tuple(decode.viterbi(scores, table, start, end)) == best
    assert decode.viterbi(np.full((1, 9), -np.inf), table, start, end) == [0]


def test_tags_and_json():
    out, spans, warnings = codec.parse_tags("<think>x</think>Hi <pii type='PERSON'>A &amp; <pii type=EMAIL>b@c.de</pii></pii>, <pii type=\"X\">open")
    assert out == "Hi A & b@c.de, open" and warnings == ["unclosed"]
    assert [(s["type"], s["value"]) for s in spans] == [("PERSON", "A & b@c.de"), ("EMAIL", "b@c.de")]
    assert codec.generated_json('```json\n{"a": [1, 2]}\n``` trailing }') == '{"a": [1, 2]}'
    assert codec.generated_json('{"spans": [{"a": 1}, {"b": 2}, {"c"') == '{"spans": [{"a": 1}, {"b": 2}]}'
    assert codec.generated_json("none") is None


def test_sweep_equals_plain_counts(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40) / 40, int(rng.random() < 0.4)) for _ in range(500)]
    for r in calibrate.sweep(spark.createDataFrame(rows, "score double, hit int")).collect():
        kept = [h for s, h in rows if s >= r.threshold]
        assert (r.tp, r.fp) == (sum(kept), len(kept) - sum(kept))


def test_searches():
    best, value = calibrate.coordinate_descent(lambda p: -((p["a"] - 1) ** 2) - (p["b"] + 1.5) ** 2, {"a": 0.0, "b": 0.0})
    assert best == {"a": 1.0, "b": -1.5} and value == 0
    assert abs(calibrate.fit_temperature(lambda t: (t - 2.5) ** 2) - 2.5) < 1e-4


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"x","spans":{"EMAIL: q@r.st":[[0,1]],"EMAIL: u":[[3,4]]},"info":{"id":"1"}}\n\nbroken\n')
    from quillspan import schemas

    df = readers.jsonl(spark, str(tmp_path / "a.jsonl"), schemas.OPF_RECORD)
    assert [r.text for r in df.collect() if r._corrupt is None] == ["x"]
    spans = df.filter("text = 'x'").select(readers.span_map(F.col("spans")).alias("s")).collect()[0].s
    assert [(x.label, x.start, x.end) for x in spans] == [("EMAIL", 0, 1), ("EMAIL", 3, 4)]
    out = str(tmp_path / "out")
    assert readers.append_pending(spark.range(5), out, "id") == 5
    assert readers.append_pending(spark.range(8), out, "id") == 3
    assert spark.read.parquet(out).count() == 8
    (tmp_path / "t.csv").write_text('﻿Name,Note,Data Classification,Category Type\n"Date of birth, full",n,P,C\nDate of birth full,n,Q,D\n', encoding="utf-8")
    assert [(r.label, r.data_classification) for r in readers.taxonomy(spark, str(tmp_path / "t.csv")).collect()] == [("DATE_OF_BIRTH_FULL", "P")]
    up = spark.createDataFrame([(b"\xef\xbb\xbfhi",), (b"caf\xe9",)], "b binary").select(readers.decoded_upload(F.col("b"), 3).alias("u")).collect()
    assert [(r.u.text, r.u.truncated) for r in up] == [("hi", False), ("caf", True)]


def test_transcript_offsets(spark):
    t = "user: hello\nthere\nassistant: yes"
    x = one(spark, "SELECT 1", readers.transcript(F.lit(t)))
    assert [(r.role, t[r.start : r.end], r.text) for r in x] == [("user", "hello\nthere", "hello\nthere"), ("assistant", "yes", "yes")]


def test_split_matches_python(spark):
    import hashlib

    for r in spark.range(100).select("id", prep.group_split(F.col("id")).alias("s")).collect():
        b = int(hashlib.sha256(str(r.id).encode()).hexdigest()[:8], 16) % 100
        assert r.s == ("train" if b < 80 else "dev" if b < 90 else "test")


def test_nfc(spark):
    assert one(spark, "SELECT 'é' AS t", text.nfc(F.col("t"))) == "é"


def test_stream_equals_batch(spark, tmp_path):
    rules = {"NUM": "[0-9]+"}
    df = spark.createDataFrame([("a 12 b",), (None,), ("c",)], "text string")
    df.write.parquet(str(tmp_path / "in"))
    q = redact_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), rules).writeStream.format("memory").queryName("quillspan_out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r.redacted_text for r in spark.table("quillspan_out").collect())
    assert got == sorted(r.redacted_text for r in redact_stream(df, rules).collect()) == ["", "a [NUM] b", "c"]
