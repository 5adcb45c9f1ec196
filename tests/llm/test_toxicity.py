import itertools
import random

import numpy as np
import pandas as pd

from quillspan.llm import toxicity as T


def paths(e, trans):
    """Marginals of one chain and of its pairs by listing all paths."""
    n = len(e)
    total, on, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for path in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(e[k] * y for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += p
        on += p * np.array(path)
        for k in range(1, n):
            both[k, path[k - 1], path[k]] += p
    return on / total, both / total


def test_forward_backward_against_all_paths(monkeypatch):
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2)) * 2
    sizes = [6, 0, 9, 1, 3, 4, 12]
    e = rng.normal(size=sum(sizes)) * 3
    for segment in (64, 3, 1):  # chains longer than a segment are one chain still
        monkeypatch.setattr(T, "SEGMENT", segment)
        margin, pair = T.chain_marginals(e, sizes, trans, True)
        at = 0
        for n in sizes:
            if n:
                on, both = paths(e[at : at + n], trans)
                assert np.allclose(margin[at : at + n], on) and np.allclose(pair[at : at + n], both)
            at += n


def test_a_long_document_is_one_chain():
    e = np.zeros(1000)
    e[0] = 20.0  # labels that never change carry the first token's to the last
    margin, _ = T.chain_marginals(e, [1000], np.array([[30.0, 0.0], [0.0, 30.0]]))
    assert margin.min() > 0.99


def test_scores_against_a_plain_version(spark):
    rows = corpus()[:80]
    model = T.fit(pd.DataFrame([(t, y) for _, t, y in rows], columns=["text", "label"]))
    texts = [(i, " ".join(t.split()[: 4 + i % 8]) or "x") for i, t, _ in rows] + [(900, "ban grobblend tem"), (901, "")]
    got = {r.doc_id: r.score for r in T.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        w = t.lower().replace(".", "").split()
        e = np.array([sum(model["w"][T.bucket(f)] for f in T.features(x)) for x in w])
        for k in range(1, len(w)):
            e[k] += model["w"][T.bucket(f"prev w={w[k - 1]}")]
            e[k - 1] += model["w"][T.bucket(f"next w={w[k]}")]
        x = np.append(T.summary(paths(e, model["trans"])[0] if w else np.zeros(0)), 1.0) @ model["curve"]
        assert abs(got[i] - 1 / (1 + np.exp(-x))) < 1e-5


def corpus():
    rng = random.Random(1)
    vocab = [f"{a}{b}{c}" for a in "btklm" for b in "aeiou" for c in ("n", "rd", "st", "lo")]
    bad = ["grobblend", "grobblers", "zwackish"]
    rows = []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randrange(10, 150))]
        label = int(i % 4 == 0)
        if label:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words).capitalize() + ".", label))
    return rows


def test_held_out_accuracy_and_offsets(spark):
    rows = corpus()
    model = T.fit(pd.DataFrame([(t, y) for _, t, y in rows[:300]], columns=["text", "label"]))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows[300:]], "doc_id long, text string")
    text, label = {i: t for i, t, _ in rows}, {i: y for i, _, y in rows}
    out = T.score(df, model).collect()
    assert np.mean([(r.score >= 0.3) == bool(label[r.doc_id]) for r in out]) >= 0.97
    found = {text[r.doc_id][s.start : s.end].lower() for r in out for s in r.spans}
    assert found and all(w.startswith(("grob", "zwack")) for w in found)
    kept = T.drop_toxic(df.selectExpr("doc_id", "text", "1 AS score"), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.score < 0.3}


def test_odd_rows(spark):
    rows = corpus()
    model = T.fit(pd.DataFrame([(t, y) for _, t, y in rows], columns=["text", "label"]))
    df = spark.createDataFrame([(1, None), (2, ""), (None, "İİ grobblend"), (2**60 + 1, "ban " * 50_000), (4, "...")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(df, model).collect()}
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got.values())
    assert got[1].score == got[2].score == got[4].score < 0.3
    assert [(s.start, s.end) for s in got[None].spans] == [(3, 12)]
    assert T.score(df.limit(0), model).collect() == []


def test_one_label_only(spark):
    assert T.fit(pd.DataFrame({"text": ["a"], "label": [0]})) is None
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert T.score(df, None).collect()[0].score == 0.0


def test_sample_is_bounded(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "'t' AS text", "1 AS label")
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic", "1 AS quality")
    s = T.training_sample(docs, labels, most=(7, 5))
    assert s["label"].value_counts().to_dict() == {0: 7, 1: 5}


def test_sample_is_bounded_though_ids_repeat(spark):
    docs = spark.range(1000).selectExpr("id % 4 AS doc_id", "'t' || id AS text")
    labels = spark.range(4).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    assert len(T.training_sample(docs, labels, most=(7, 5))) == 12


def test_score_means_the_same_for_a_sample():
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(["ban", "tem", "kilo", "murd", "lost", "benn"]) for _ in range(40))
    clean = [(plain(), 0) for _ in range(800)]
    toxic = [(plain(), 1) for _ in range(80)] + [(plain() + " grobblend zwackish", 1) for _ in range(120)]
    whole = pd.DataFrame(clean + toxic, columns=["text", "label"])
    sample = pd.DataFrame([(*r, 8.0) for r in clean[::8]] + [(*r, 1.0) for r in toxic], columns=["text", "label", "weight"])
    for rows in (whole, sample):
        model = T.fit(rows)
        scores = [s for s, _ in T.score_texts([plain() for _ in range(50)] + ["ban zwackish grobblend tem"], model, T.Weights(model["w"]), False)]
        # 80 of 880 plain texts are toxic
        assert 0.04 < np.mean(scores[:50]) < 0.2 and scores[-1] > 0.8


def test_weights_are_inverse_sampling_rates(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS int) AS toxic")
    s = T.training_sample(docs, labels, most=(9, 20))
    assert s.groupby("label")["weight"].agg(["min", "max", "size"]).values.tolist() == [[10, 10, 9], [1, 1, 10]]


def test_weight_of_a_row_is_its_number():
    x, y = np.array([[0.0], [1.0], [2.0], [1.5]]), np.array([0.0, 1.0, 1.0, 0.0])
    n = np.array([3, 1, 2, 1])
    assert np.allclose(T._logistic(x, y, n), T._logistic(np.repeat(x, n, 0), np.repeat(y, n), np.ones(7)))
