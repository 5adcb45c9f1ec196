from pyspark.sql import functions as F

from quillspan.llm.exact_dedup import drop_exact_duplicates, exact_groups


def test_hot_text_and_odd_rows(spark):
    rows = [(i, "same " * 50) for i in range(3000)] + [(5000 + i, f"text {i % 700}") for i in range(1400)]
    rows += [(9001, None), (9002, ""), (None, ""), (9003, "x"), (9003, "x"), (None, "y"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep, best in (("largest", max), ("smallest", min)):
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        out = exact_groups(df, keep=keep).withColumn("h", F.col("text_sha256")).collect()
        assert len(out) == len(rows)
        kept = [r for r in out if r.kept]
        assert len(kept) == len(groups)
        want = {tuple(sorted((i for i in g if i is not None))): (best([i for i in g if i is not None], default=None), len(g)) for g in groups.values()}
        assert sorted((r.keep_id if r.keep_id is not None else -1, r.group_size) for r in kept) == sorted((k if k is not None else -1, n) for k, n in want.values())
        assert all(r.doc_id == r.keep_id for r in kept)


def test_drop_carries_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8), (3, None, 9, 1)], "doc_id long, text string, keep_id int, __size int")
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.select("doc_id", "keep_id").collect()) == [(1, 5), (3, 9)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(df).count() == 0 and drop_exact_duplicates(df).count() == 0
