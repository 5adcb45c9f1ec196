import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import align as A
from quillspan.sources import readers, writers


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_strategies(spark):
    gold = frame(spark, [(i, f"t{i % 3}") for i in range(10)])
    assert A.strategy(gold, frame(spark, [(i, "x") for i in range(2, 12)]), "doc_id", "text") == "id"
    assert A.strategy(gold, frame(spark, [(i, "t1") for i in range(3, 12)]), "doc_id", "text") == "text"
    assert A.strategy(gold, frame(spark, [(i, "x") for i in range(20, 23)]), "doc_id", "text") == "order"
    got = A.auto_matched(gold, frame(spark, [(30, "z"), (20, "x")])).orderBy("gold_id").collect()
    assert [(r.strategy, r.gold_id, r.pred_id) for r in got[:3]] == [("order", 0, 20), ("order", 1, 30), ("order", 2, None)]
    by_text = {(r.gold_id, r.pred_id) for r in A.auto_matched(gold, frame(spark, [(50, "t0"), (51, "t0"), (52, "new")])).collect()}
    assert {(0, 50), (3, 51), (None, 52), (6, None)} <= by_text
    assert A.strategy(gold.limit(0), gold, "doc_id", "text") == "order"


def test_token_metrics(spark):
    t = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (0, 2, 1.0), (2, 0, 0.5), (0, 0, 1.0)], "gold int, pred int, prob double")
    got = {r.label: (r.tp, r.fp, r.fn) for r in A.token_metrics(t).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 2, 1), -1: (2, 1, 1)}
    r = A.token_metrics(t).first()
    assert r.accuracy == 0.4 and abs(r.loss - 0.8 * 0.6931471805599453) < 1e-12


def test_offsets(spark):
    text = "é  ünï \nb"
    r = spark.createDataFrame([(text,)], "t string").select(
        A.char_span(F.col("t"), F.lit(2), F.lit(len("é  ünï \n".encode()))).alias("c"), A.line_pieces(F.col("t"), F.lit(10)).alias("p"),
        A.windows(F.lit(10), 4, 1).alias("w"), A.windows(F.lit(0), 4, 1).alias("none"),
        A.token_range(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(a + 2).alias("end")) for a in (0, 2, 4)]), F.lit(6), F.lit(9)).alias("k"),
    ).first()
    assert (r.c.start, r.c.end) == (3, 6) and text[3:6] == "ünï"
    assert [(x.start, x.end, x.value) for x in r.p] == [(10, 16, "é  ünï"), (18, 19, "b")]
    assert [(x.start, x.end) for x in r.w] == [(0, 4), (3, 7), (6, 10)] and r.none == [] and r.k.first is None


def test_labels_and_targets(spark):
    r = spark.range(1).select(
        A.source_key(F.lit("rec"), F.lit(" ")).alias("a"), A.source_key(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("b"),
        (A.stable_id(F.lit("ab"), F.lit("c")) == A.stable_id(F.lit("a"), F.lit("bc"))).alias("same"), (A.stable_id(F.lit(None).cast("string")) == A.stable_id(F.lit(""))).alias("empty"),
        A.soft_targets(F.array(F.struct(F.lit("x").alias("label"), F.lit(0.0).alias("weight"))), F.lit(1.0)).alias("none"),
    ).first()
    assert (r.a, r.b, r.same, r.empty, r.none) == ("rec", "unknown", False, False, None)
    spans = spark.createDataFrame([("A", None), ("A", "Restricted"), ("B", None)], "label string, data_classification string")
    classes = spark.createDataFrame([("A", "PUBLIC")], "label string, data_classification string")
    got = sorted((r.label, r.data_classification, r.class_weight) for r in A.classified(spans, classes).collect())
    assert got == [("A", "public", 0.0), ("A", "restricted", 1.0), ("B", "sensitive", 0.5)]
    assert A.aliased(spans, {}).filter("note IS NOT NULL").count() == 0


def test_entity_scores_rank_rounded_sums(spark):
    # 0.1 + 0.2 is 0.30000000000000004 as a double: B must not pass A by it
    tokens = spark.createDataFrame([(1, 0, "S-A", 0.3), (1, 0, "B-B", 0.1), (1, 0, "E-B", 0.2), (1, 0, "S-C", 0.4), (1, 0, "O", 0.9)], "doc_id long, span int, tag string, prob double")
    assert sorted((r["rank"], r["entity"], r["score"]) for r in A.entity_scores(tokens).collect()) == [(1, "C", 0.4), (2, "A", 0.3), (3, "B", 0.3)]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb, c', None), (2, "é", 0.5)], "id long, text string, score double")
    writers.write_jsonl(df, str(tmp_path / "j"), gzip=True)
    assert sorted(readers.jsonl(spark, str(tmp_path / "j"), df.schema.simpleString()[7:-1].replace(":", " "), strict=True).collect()) == sorted(df.collect())
    writers.write_csv(df, str(tmp_path / "c"))
    assert sorted(spark.read.schema(df.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).collect()) == sorted(df.collect())
    assert json.loads(writers.report(df.filter("id = 1"))) == {"id": 1, "text": 'a "q"\nb, c', "score": None}
    with pytest.raises(ValueError):
        writers.report(df)
    docs = spark.createDataFrame([(1, [("P", "Ann", 9, 12), ("P", "Ann", 0, 3), ("E", "a@b", 4, 7)]), (2, [])], "doc_id long, spans array<struct<label:string,value:string,start:int,end:int>>")
    writers.write_predictions(docs, str(tmp_path / "p"))
    lines = [json.loads(x) for f in (tmp_path / "p").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["example_id"]: x.get("spans") for x in lines} == {1: {"E: a@b": [[4, 7]], "P: Ann": [[0, 3], [9, 12]]}, 2: {}}
