"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote on each document: good (1), poor (0) or nothing. Variety is the share of
   distinct words, for long texts its mean over equal windows of 1,000 words or a little more, as the share of a whole
   text falls with its length.
2. Spark counts the vote patterns of all documents; there are at most 3^labellers of them, however large
   the corpus. Expectation-maximisation on these counts estimates the share of good documents and
   each labeller's accuracies for both classes, given that labellers err independently of each other.
3. The posterior of a document's pattern labels a bounded sample (FIT_DOCS documents, chosen by a hash of
   the id) on which a linear scorer over hashed features (words, word shapes, repeats) is fitted by
   Adagrad to the soft labels.
4. The scorer scores every whole text; a score is the probability that a document is good.

Defined results: null and empty texts have no words, the votes of a text without words, and score 0. Rows that repeat
an id are scored each and count each in the patterns; of an empty table nothing is learned and no row comes out; ties
between good and poor votes are for EM to settle; the sample has no more rows than its bound even if ids repeat; columns
other than id and text don't matter; texts of any length are read whole.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import WordCache, bounded_batches, id_in, id_out

#: Bound of the sample that the linear scorer is fitted on.
FIT_DOCS = 4000
BUCKETS = 1 << 18
LABELLERS = ("length", "word_length", "capitals", "symbols", "stutter", "variety", "sentences", "short_words")
_CORE = re.compile(r"^\W+|\W+$")


def variety(words: list[str]) -> float:
    """Mean share of distinct words over equal windows of the whole text, each of 1,000 to 1,999 words; one window if it is shorter."""
    n = len(words)
    parts = max(1, n // 1000)
    ends = [n * k // parts for k in range(parts + 1)]
    return sum(len(set(words[a:z])) / (z - a) for a, z in zip(ends, ends[1:])) / parts


def votes(text: str | None) -> str:
    """One character for each labeller: 1 good, 0 poor, - no vote."""
    words = (text or "").split()
    n = len(words)
    if n < 3:
        return "0" + "-" * (len(LABELLERS) - 1)
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, words)) / n
    bare = sum(not w.isalnum() and not any(c.isalnum() for c in w) for w in words) / n
    marks = sum(text.count(c) for c in "!|#*=<>{}~^_") / n
    stutter = sum(map(operator.eq, words, words[1:])) / n
    distinct = variety(words)
    ends = sum(text.count(c) for c in ".?") / n
    short = sum(len(w) <= 3 for w in words) / n

    def vote(x: float, good: float, poor: float) -> str:
        """Good on one side of the first bound, poor beyond the second."""
        if good < poor:
            return "1" if x <= good else "0" if x >= poor else "-"
        return "1" if x >= good else "0" if x <= poor else "-"

    return "".join([
        vote(n, 30, 5), "1" if 3 <= letters / n <= 9 else "0" if not 2 <= letters / n <= 14 else "-", vote(upper, 0.05, 0.2),
        vote(marks + bare, 0.02, 0.1), vote(stutter, 0.02, 0.08), vote(distinct, 0.35, 0.2) if n > 20 else "-", vote(ends, 0.02, 0.001), vote(short, 0.12, 0.03),
    ])


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good documents, probabilities (labeller x class x vote) and the posterior of each pattern, by EM from
    the weighed votes, a poor one counting four times a good one. Votes: 0 poor, 1 good, 2 none."""
    keys = sorted(patterns)
    if not keys:
        return 0.5, np.zeros((0, 2, 3)), {}
    v = np.array([[{"0": 0, "1": 1, "-": 2}[c] for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    # one sure vote against a document weighs as two for it: junk has its own kinds
    post = np.clip(1 / (1 + np.exp(-((v == 1).sum(axis=1) * 0.5 - (v == 0).sum(axis=1) * 2.0))), 0.02, 0.98)
    for _ in range(rounds):
        both = np.stack([1 - post, post]) * n
        share = (both[1].sum() + 1) / (n.sum() + 2)
        p = np.array([[[both[c][v[:, j] == x].sum() + 0.1 for x in range(3)] for c in (0, 1)] for j in range(v.shape[1])])
        p /= p.sum(axis=2, keepdims=True)
        logs = np.log([1 - share, share])[:, None] + sum(np.log(p[j][:, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return float(share), p, dict(zip(keys, post.tolist(), strict=True))


def word_features(word: str) -> list[str]:
    core = _CORE.sub("", word)
    shape = re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))[:8]
    return ["w=" + core.lower(), "s=" + shape, f"l={min(len(core), 20)}"]


def word_scores(w: np.ndarray) -> WordCache:
    """Sums of a model's weights for words."""
    return WordCache(lambda word: float(sum(w[xxhash.xxh3_64_intdigest(f) % BUCKETS] for f in word_features(word))))


def dense(words: list[str]) -> np.ndarray:
    """Features of the whole text: share of repeats of the word before, share of distinct words, log of the number of words, one."""
    n = len(words)
    return np.array([sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, np.log1p(n) / 10, 1.0])


def fit(sample: pd.DataFrame, epochs: int = 8, seed: int = 7) -> dict:
    """Weights from rows of text and p (posterior of good)."""
    rng = np.random.default_rng(seed)
    rows = []
    for text, p in zip(sample["text"], sample["p"], strict=True):
        words = (text or "").split()
        if words:
            h = np.fromiter((xxhash.xxh3_64_intdigest(f) % BUCKETS for w in words for f in word_features(w)), np.int64)
            at, count = np.unique(h, return_counts=True)
            rows.append((at, count / len(words), dense(words), p))
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    d, d2 = np.zeros(4), np.full(4, 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, dx, p = rows[k]
            err = p - 1 / (1 + np.exp(-np.clip(w[at] @ x + d @ dx, -30, 30)))
            g = err * x - 1e-6 * w[at]
            g2[at] += g * g
            w[at] += 0.3 * g / np.sqrt(g2[at])
            g = err * dx
            d2 += g * g
            d += 0.3 * g / np.sqrt(d2)
    return {"w": w.astype(np.float32), "d": d}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> dict:
    """The scorer's weights, with the estimates behind its labels: share, accuracies, posterior."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    vote = F.pandas_udf(lambda t: t.map(votes), "string")
    patterns = {r["v"]: r["count"] for r in rows.select(vote("text").alias("v")).groupBy("v").count().collect()}
    share, p, posterior = estimate(patterns)
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(fit_docs)
    taken = rows.join(F.broadcast(chosen.distinct()), "id").orderBy(F.xxhash64("id", "text"), "id").limit(fit_docs)
    sample = taken.toPandas().sort_values(["id", "text"], na_position="first")
    sample["p"] = [posterior.get(votes(t), 0.5) for t in sample["text"]]
    return {**fit(sample), "share": share, "accuracies": dict(zip(LABELLERS, p.tolist(), strict=False)), "posterior": posterior}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, votes and label_posterior of each row."""
    w, d, posterior = model["w"], model["d"], model["posterior"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = word_scores(w)
        for f in frames:
            out = []
            for t in f["text"]:
                v = votes(t)
                words = (t or "").split()
                s = 1 / (1 + np.exp(-np.clip(sum(map(scores.__getitem__, words)) / len(words) + d @ dense(words), -30, 30))) if words else 0.0
                out.append((float(s), v, posterior.get(v, 0.5)))
            yield pd.concat([f[["id"]], pd.DataFrame(out, columns=["score", "votes", "label_posterior"], index=f.index)], axis=1)

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, score double, votes string, label_posterior double").withColumn("id", id_out()).withColumnRenamed("id", id_col)
