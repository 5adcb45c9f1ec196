"""Each stage is held against a plain version on the rows that the stage before it kept."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import random

import pytest
from test_decontaminate import brute as leaked
from test_minhash import brute as groups

import corpus_pipeline
from quillspan.llm import queries, toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    vocab = [a + b + c for a in "btklmdr" for b in "aeiou" for c in ("n", "rd", "st", "lo")]
    rows, labels = [], []
    for i in range(360):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        if i % 4 == 0:
            words[3] = words[9] = rng.choice(["zwackish", "grobblend"])
        if i % 17 == 5:
            words = rows[-1][1].split() + ["more"] * (i % 2)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(any(w.startswith(("zwack", "grob")) for w in words))))
    items = [(k, " ".join(rng.choice(vocab) for _ in range(25))) for k in range(4)]
    rows += [(500 + k, "intro here " + t + " outro") for k, t in items] + [(600, None), (601, ""), (None, "alone"), (602, rows[1][1]), (602, rows[1][1])]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    columns = docs.columns
    bench = [r.text for r in spark.read.parquet(sf_dir + "/benchmark.parquet").collect()]
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    model = queries.toxicity_model(spark, sf_dir)
    after = corpus_pipeline.toxic(spark, docs, sf_dir)
    assert after.columns == columns
    texts = [t for _, t in rows(docs)]
    weights = toxicity.Weights(model["w"])
    scores = [toxicity.score_texts([t], model, weights, False)[0][0] for t in texts]
    clean = rows(after)
    assert clean == sorted(((i, t) for (i, t), s in zip(rows(docs), scores) if s < 0.3), key=str)
    assert not any("zwackish" in (t or "") for _, t in clean)

    once = rows(corpus_pipeline.exact(spark, after, sf_dir))
    first = {}
    for i, t in clean:
        if t not in first or (i is not None and (first[t] is None or i < first[t])):
            first[t] = i
    same = {t or "": None for _, t in clean}
    assert len(once) == len(same) and all(first[t] == i or not t for i, t in once)

    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in once], docs.schema)
    apart = rows(corpus_pipeline.near(spark, frame, sf_dir))
    assert apart == sorted(((i, t) for (i, t), g in zip(once, groups(once, 80)) if g[3]), key=str)

    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in apart], docs.schema)
    out = corpus_pipeline.decontaminated(spark, frame, sf_dir)
    assert out.columns == columns
    assert rows(out) == sorted(((i, t) for i, t in apart if not any(leaked(t, b) for b in bench)), key=str)

    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in final} == {i for i, _ in rows(out)}
    room = {}
    for r in final:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1
