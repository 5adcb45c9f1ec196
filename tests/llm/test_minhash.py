import random

import numpy as np
import pandas as pd

from quillspan.llm import minhash as M


def brute(rows, percent, k=5):
    """rows: (id, text). (n, component) of each row by comparing all pairs."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        if not w:
            return set()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    sets = [shingles(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, (i, _) in enumerate(rows):
        for q in range(p):
            j = rows[q][0]
            if i is None or j is None or not sets[p] or not sets[q]:
                continue
            same = len(sets[p] & sets[q])
            if 100 * same >= percent * (len(sets[p]) + len(sets[q]) - same):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)]


def check(spark, rows, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in M.near_groups(df, percent=percent).collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(brute(rows, percent), key=key)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 9, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rng.shuffle(rows)
    check(spark, rows, 85)
    check(spark, rows, 60)


def test_odd_rows(spark):
    check(spark, [(4, None), (5, ""), (6, " \t\n"), (None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f"), (3, "a  b\x0bc d e\nf"), (1, "x y"), (2, "X Y"), (9, "x")], 85)


def test_an_id_with_several_texts_is_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    check(spark, [(3, a), (7, a), (7, b), (9, b), (9, c), (20, c + " more"), (7, None), (5, ""), (5, c), (30, "else"), (2, "x"), (2, "y"), (2, "z")], 85)
    check(spark, [(7, a), (7, b), (7, b + " more"), (1, c), (8, b)], 85)


def test_very_long_texts_and_other_columns(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "start " + long), (4, long[: len(long) // 2])]
    df = spark.createDataFrame([(i, t, t[:3], 1, "k") for i, t in rows], "doc_id long, text string, digest string, n int, key string")
    assert sorted(tuple(r) for r in M.near_groups(df, percent=85).collect()) == sorted(brute(rows, 85))


def test_empty_table(spark):
    assert M.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chain_of_links_is_one_component(spark):
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(12):  # each differs a little from the one before, and much from the first
        words[i * 9] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    check(spark, rows, 85)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    orders = M._borrow_orders()
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
        (x, _), (y, _) = M.registers(a, orders), M.registers(b, orders)
        errors.append(M.estimate(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0] - 2400 / 3600)
    assert abs(np.mean(errors)) < 0.03


def test_drop_keeps_columns_and_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2, 3], "text": [text, text + " more", "else"], "kept": [7, 8, 9], "n": [1, 1, 1]}))
    out = M.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
