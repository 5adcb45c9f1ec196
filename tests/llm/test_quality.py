import random

from quillspan.llm import quality as Q

AT = Q.LABELLERS.index("variety")


def test_variety_of_long_texts():
    rng = random.Random(3)
    cycle = ["a few lines of words that come again and again."] * 2000
    assert Q.votes(" ".join(cycle))[AT] == Q.votes(" ".join(cycle[:150]))[AT] == "0"
    vocab = [f"{a}{b}{c}" for a in "btklmnprs" for b in "aeiou" for c in "btklmnprs"] * 3
    plain = [rng.choice(vocab) + rng.choice(["", "en", "s", "er"]) for _ in range(30_000)]
    # a whole long text has few distinct words for its length, but is as varied as its parts
    assert len(set(plain)) / len(plain) < 0.2
    assert Q.votes(" ".join(plain))[AT] == Q.votes(" ".join(plain[:1000]))[AT] == "1"


def test_variety_is_the_whole_share_of_a_short_text():
    words = ["a", "b", "a", "c"] * 400
    assert Q.variety(words) == 3 / 1600
    assert Q.variety(words + words) == 3 / 1066 / 3 + 2 * 3 / 1067 / 3


def test_em_against_a_plain_version_and_known_accuracies():
    rng = random.Random(9)
    right = [0.95, 0.9, 0.8, 0.7, 0.85]
    patterns, truth = {}, {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        p = "".join("-" if rng.random() < 0.1 else str(int(good if rng.random() < r else not good)) for r in right)
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    share, p, posterior = Q.estimate(patterns)
    assert abs(share - 0.8) < 0.03
    for j, r in enumerate(right):
        for c in (0, 1):
            assert abs(p[j][c][c] / (p[j][c][0] + p[j][c][1]) - r) < 0.05
    # the posterior is Bayes' rule on the estimates
    for k in list(patterns)[:50]:
        like = [share if c else 1 - share for c in (0, 1)]
        for j, v in enumerate(k):
            like = [x * p[j][c]["01-".index(v)] for c, x in enumerate(like)]
        assert abs(posterior[k] - like[1] / sum(like)) < 1e-3


def test_scores_against_a_plain_version_and_odd_rows(spark):
    rng = random.Random(4)
    vocab = [a + b + c for a in "btklm" for b in "aeiou" for c in ("n", "rd", "st")]
    good = [" ".join(rng.choice(vocab) for _ in range(60)).capitalize() + ". And so on." for _ in range(150)]
    junk = ["!!! BUY ### NOW $$$ " * 12 for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(good + junk)] + [(900, None), (901, ""), (None, good[0]), (902, "word " * 100_000), (903, good[1]), (903, good[1])]
    df = spark.createDataFrame([(i, t, "k", 0.5) for i, t in rows], "doc_id long, text string, votes string, p double")
    model = Q.train(df)
    got = Q.score(df, model).collect()
    assert len(got) == len(rows)
    text = dict(rows[:-6])
    for r in got[:200]:
        words = text[r.doc_id].split()
        x = sum(float(model["w"][Q.xxhash.xxh3_64_intdigest(f) % Q.BUCKETS]) for w in words for f in Q.word_features(w)) / len(words) + model["d"] @ Q.dense(words)
        assert abs(r.score - 1 / (1 + Q.np.exp(-x))) < 1e-5
        assert (r.score >= 0.5) == (r.doc_id < 150)
    odd = {r.doc_id: r.score for r in got[200:]}
    assert odd[900] == odd[901] == 0.0
    assert Q.score(df.limit(0), Q.train(df.limit(0))).collect() == []


def test_sample_is_bounded_though_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit", lambda sample: seen.append(len(sample)) or {"w": Q.np.zeros(Q.BUCKETS), "d": Q.np.zeros(4)})
    Q.train(spark.range(500).selectExpr("id % 3 AS doc_id", "'t ' || id AS text"), fit_docs=10)
    assert seen == [10]


def test_agrees_with_labels(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    from quillspan.llm import queries

    out = queries.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas().sort_values("score")
    y = out["quality"].to_numpy()
    rank = Q.np.arange(len(y))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9
