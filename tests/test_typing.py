import json

from pyspark.sql import functions as F

from quillspan.operators import typing as T


def test_columns(spark):
    text = "bsb for pay 062-000 and dob: 1/2/1999"
    span = "struct<start:int,end:int,value:string>"
    df = spark.createDataFrame([(text, (12, 19, "062-000"), "DATE_OF_BIRTH", "DOB: dob 1/2/1999", "12", "x")], f"t string, s {span}, k string, v string, e string, w string")
    r = df.select(
        T.rescued(F.col("t"), F.col("s"), F.lit(False), F.lit(False)).alias("plain"), T.rescued(F.col("t"), F.col("s"), F.lit(False), F.lit(True)).alias("near"), T.rescued(F.col("t"), F.col("s"), F.lit(True), F.lit(True)).alias("line"),
        T.stripped(F.col("k"), F.col("v")).alias("value"), T.stripped(F.col("k"), F.lit("dob: ")).alias("none"), T.located(F.col("t"), F.lit("dob")).alias("at"), T.located(F.col("t"), F.lit("zz")).alias("lost"),
        T.surface_violation(F.lit("AU_TFN"), F.col("e")).alias("bad"), T.surface_violation(F.lit("LATITUDE"), F.col("e")).alias("good"), T.surface_violation(F.lit("LATITUDE"), F.col("w")).alias("text"),
        T.general_type(F.lit("my phone"), F.lit("WORK_PHONE"), F.lit(8)).alias("home"), T.general_type(F.lit("work phone"), F.lit("WORK_PHONE"), F.lit(10)).alias("work"), T.verdict(F.lit("redact"), F.lit(0.1), F.lit(0.9)).alias("verdict"),
        T.trimmed(F.struct(F.lit(3).alias("start"), F.lit(8).alias("end"), F.lit(" ab  ").alias("value"))).alias("trim"),
    ).collect()[0]
    assert (r.plain.rule, r.plain.decision, r.plain.risk) == ("bsb_format", "redact", 0.85)
    assert (r.near.decision, r.line.decision) == ("review", "ignore")
    assert r.value == "1/2/1999" and r.none is None
    assert (r["at"].start, r["at"].found, r.lost.start, r.lost.found) == (24, True, 0, False)
    assert (r.bad, r.good, r.text) == ("tfn_digits", None, "latitude_range")
    assert (r.home, r.work, r.verdict) == ("PHONE", "WORK_PHONE", "review")
    assert (r.trim.start, r.trim.end, r.trim.value) == (4, 6, "ab")


def test_a_rescue_must_overlap_the_span(spark):
    text = "Write to ann@x.org, then ask for Mr Lee"
    spans = [(9, 18, "ann@x.org"), (36, 39, "Lee"), (9, 12, "ann")]
    df = spark.createDataFrame([(text, s) for s in spans], "t string, s struct<start:int,end:int,value:string>")
    got = [r.x and r.x.rule for r in df.select(T.rescued(F.col("t"), F.col("s"), F.lit(False), F.lit(False)).alias("x")).collect()]
    assert got == ["email_full", None, "email_full"]


def test_frames(spark):
    spans = spark.createDataFrame([(1, i, i * 10, i * 10 + 5, "A" if i % 2 else "B", 0.95) for i in range(6)], "doc_id long, n int, start int, end int, label string, confidence double")
    assert [r.n for r in T.verifier_candidates(spans, ["A"], 2).orderBy("n").collect()] == [1, 3]
    tokens = spark.createDataFrame([(1, 0, 3, -1.0), (1, 3, 9, -3.0)], "doc_id long, start int, end int, logprob double")
    got = {r.n: r.span_confidence for r in T.span_confidence(spans, tokens).collect()}
    assert abs(got[0] - 2.718281828459045**-2) < 1e-12 and got[5] is None
    w = spark.range(100).withColumn("w", F.when(F.col("id") < 10, 1000.0).when(F.col("id") < 20, 0.0).otherwise(0.001))
    ids = [r.id for r in T.weighted_sample(w, "w", "id", 10).collect()]
    assert sorted(ids) == list(range(10))


def test_rows(spark):
    df = spark.createDataFrame([(1, "call Ann", [(5, 8, "PERSON")], json.dumps({"spans": [{"type": "PERSON", "start": 5, "end": 8, "value": "Bob"}, {"type": "X", "start": 0, "end": 1, "value": "c"}, {"type": "PERSON", "start": 5, "end": 99, "value": "Ann"}]}))], "doc_id long, text string, spans array<struct<start:int,end:int,type:string>>, output string")
    m = T.sft_rows(df, "find").collect()[0].messages
    assert [x.role for x in m] == ["system", "user", "assistant"] and json.loads(m[2].content) == {"spans": [{"type": "PERSON", "start": 5, "end": 8}]}
    got = {r.status: r.value for r in T.valid_predictions(df, ["PERSON"]).collect()}
    assert got == {"value_reset": "Ann", "unknown_type": "c", "out_of_range": "Ann"}
