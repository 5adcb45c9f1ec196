import hashlib
import random

import numpy as np

from quillspan.llm import suffix_dedup as S


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def check(spark, rows, length=50):
    out = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=length)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "bé", "gamma", "δelta", "no", "ou", "x" * 9]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ing", str(rng.randrange(99))]) for _ in range(n))
    shared = [text(n) for n in (6, 9, 14, 40)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        if i and rng.random() < 0.15:
            parts = [rng.choice(rows)[1]]
        rows.append((rng.choice([i, i, 500 - i]), " ".join(parts)))
    check(spark, rows)
    check(spark, rows, 33)


def test_odd_rows(spark):
    long = "abc " * 200
    check(spark, [(1, None), (2, ""), (3, "short"), (4, long), (5, long), (5, long), (None, long), (6, "zz" + long + "yy"), (7, "é" * 60), (8, "é" * 61), (3, long + "more")])


def test_very_long_text_and_other_columns(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(40_000))
    rows = [(1, long), (2, "x " + long[1000:90_000] + " y"), (3, long[::-1])]
    df = spark.createDataFrame([(i, t, 1, "k", None) for i, t in rows], "doc_id long, text string, id int, key string, spans string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_spans(df).collect()]
    assert sorted(got) == sorted(brute(rows, 50))


def test_empty_table(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_factors(t, pos, owner, depth, least):
    pad = t.tobytes() + bytes(depth)
    out = []
    for i, p in enumerate(pos):
        best = 0
        for j, q in enumerate(pos):
            if owner[j] < owner[i]:
                n = 0
                while n < depth and pad[p + n] == pad[q + n]:
                    n += 1
                best = max(best, n)
        out.append(best if best >= least else 0)
    return out


def test_longest_previous_factors_against_a_quadratic_version():
    rng = np.random.default_rng(4)
    for case in range(60):
        t = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 120)).astype(np.uint8)
        pos = np.sort(rng.choice(len(t), rng.integers(1, len(t) + 1), replace=False))
        owner = rng.integers(-5, 6, len(pos)) * (1 << 40)
        depth = int(rng.choice([8, 11, 16, 23]))
        for least in (1, 5, depth):
            got = S.longest_previous_factors(t, pos, owner, depth, least)
            assert got.tolist() == plain_factors(t, pos, owner, depth, least), (case, least)
    assert S.longest_previous_factors(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), 8).tolist() == []


def test_previous_smaller():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 7, 8, 9, 100, 257]:
        v = rng.integers(0, max(2, n // 3), n)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert S.previous_smaller(v).tolist() == want


def test_previous_factors_follow_the_definition():
    t = np.frombuffer(b"abracadabra-abracadabra-abra", np.uint8)
    owner = np.repeat([2, 1, 3], [12, 12, 4])
    got = S.longest_previous_factors(t, np.arange(len(t)), owner, 12)
    assert got.tolist() == plain_factors(t, np.arange(len(t)), owner, 12, 1)
