import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan.llm import langid as L


def docs(spark):
    en = ["the house and the garden were green", "she walked with her friends to the river", "this is what they wanted to have"]
    de = ["das Haus und der Garten waren grün", "sie ging mit ihren Freunden zum Fluss", "das ist was sie haben wollten"]
    rows = [(k, f"{t} {k % 7} {u}", lang) for lang, ts in (("en", en), ("de", de)) for k, (t, u) in enumerate(((a, b) for a in ts for b in ts), 100 if lang == "de" else 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learns_and_matches_a_plain_version(spark):
    d = docs(spark)
    langs, matrix = L.train(d)
    assert langs == ["de", "en"]
    counts = {x: [0] * L.BUCKETS for x in langs}
    for r in d.collect():
        for _, g in L.grams(L.codes_of(r.text)):
            for b in g.tolist():
                counts[r.lang][b] += 1
    for k, x in enumerate(langs):
        c = np.array(counts[x]) + 0.5
        assert np.allclose(matrix[: L.BUCKETS, k], np.log(c / c.sum()), atol=1e-4)
    out = L.identify(d, langs, matrix).join(d, "doc_id").collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in out)


def test_batches_and_pieces_change_nothing(spark, monkeypatch):
    langs, matrix = L.train(docs(spark))
    texts = ["the garden and der Fluss " * 50, "a", "", "ging mit", "the garden " * 9]
    whole = L.batch_scores(texts, matrix)
    for k, text in enumerate(texts):
        plain = matrix[L.BUCKETS].astype(float) + sum(matrix[b].astype(float) for _, g in L.grams(L.codes_of(text)) for b in g.tolist())
        assert np.allclose(whole[k], plain, atol=1e-2)
    monkeypatch.setattr(L, "PIECE", 37)
    assert np.allclose(L.batch_scores(texts, matrix), whole, atol=1e-6)


def test_held_out_accuracy(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    from quillspan.llm import queries

    out = queries.op10_language_id(spark, "/root/testdata/sf0.01").filter("held_out AND lang_pred <> 'und'")
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "lang")
    got = out.join(true, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).collect()[0][0]
    assert got > 0.98


def test_odd_rows(spark):
    langs, matrix = L.train(docs(spark))
    big = 2**60 + 1
    d = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "the house"), (big, "the garden"), (5, "the " * 200_000)], "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("held_out", F.lit(9))
    got = {r.doc_id: r for r in L.identify(d, langs, matrix).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert got[None].lang_pred == got[big].lang_pred == got[5].lang_pred == "en"


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert L.identify(d, *L.train(d)).collect()[0].lang_pred == "und"
    assert L.identify(d.limit(0), *L.train(d)).collect() == []


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(200).select("id", L.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert pd.Series([r.h for r in got]).mean() > 0.1
