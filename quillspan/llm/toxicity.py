"""Toxic spans by a linear-chain conditional random field.

Training: of the labelled documents a bounded sample (SAMPLE_DOCS, chosen by a hash of the id)
comes to the driver. Labels are of documents, so tokens are labelled first: a word, or else a stem of
4 to 6 letters, that is far more frequent in toxic documents than in others marks its tokens in toxic
documents; all other tokens are clean. A two-label field (clean, toxic) over hashed features - word,
prefixes, suffix, shape, neighbouring words - is fitted to these tokens by Adagrad on the exact
gradient from forward-backward. Where the bound leaves out labelled documents of a class, the rows that were taken
weigh the inverse of their class's sampling rate (relative to the whole sample), in this fit and in the curve below,
so that a score means the same for every size of input.

Scoring: emissions are sums of feature weights (kept for each word), a chain is a whole document
of any length, and forward-backward gives each token's marginal. A document's score comes
from its marginals by a logistic curve fitted to the sample; its spans are the tokens whose
marginal is at least 0.5, as character offsets.

Defined results: null and empty texts have no tokens and get the curve's score for none; if either
label is missing from the sample, all scores are 0. Rows that repeat an id are scored each; in the label table the
greatest label of an id counts; a sample has no more rows than its bounds even if ids repeat. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, drop_caches, id_in, id_out

#: Bounds of the training sample: clean and toxic documents.
SAMPLE_DOCS = (3000, 1500)
BUCKETS = 1 << 18
#: Tokens that forward-backward takes side by side (no bound of a chain); tokens of a gradient step, of whole documents.
SEGMENT, BATCH_TOKENS = 64, 12_000
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """Features of a token by itself; the first is the word, which its neighbours see too."""
    out = [f"w={word}", f"s={word[-3:]}", "d" if word.isdigit() else "a"]
    return out + [f"p{n}={word[:n]}" for n in (4, 5, 6) if len(word) >= n]


def bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def toxic_marks(docs: list[list[str]], labels: list[int]) -> set[str]:
    """Features (words and stems) that mark toxic tokens: in toxic documents at least 8 times as often as in others, with a
    log-likelihood ratio that chance doesn't reach among as many features."""
    seen = {0: Counter(), 1: Counter()}
    for words, label in zip(docs, labels, strict=True):
        seen[label].update({f for w in set(words) for f in features(w) if f[0] in "wp"})
    n = Counter(labels)
    share = n[1] / (n[0] + n[1])

    def ratio(k: int, m: int) -> float:
        return 2 * (k * np.log(k / (k + m) / share) + (m and m * np.log(m / (k + m) / (1 - share))))

    return {f for f, k in seen[1].items() if k / n[1] >= 8 * seen[0][f] / n[0] and ratio(k, seen[0][f]) >= 36}


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows (all axes but the first) divided by their greatest value, against underflow."""
    return x / x.reshape(len(x), -1).max(axis=1).reshape(-1, *[1] * (x.ndim - 1))


def chain_marginals(e: np.ndarray, sizes: list[int], trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Of all tokens of documents in a row, each one chain from end to end: the marginal of toxic and, if asked for, those of
    the pairs of labels with the token before (tokens x 2 x 2; zeros for a first token). e: the toxic label's score over
    clean's; trans: 2 x 2 scores.

    Chains are exact at any length: forward-backward runs over segments of SEGMENT tokens side by side as products of 2 x 2
    matrices, which then are joined along each document."""
    sizes = np.array([n for n in sizes if n], np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0), np.zeros((0, 2, 2)) if pairs else None
    n_seg = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), n_seg)
    index = np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    begin = np.repeat(np.cumsum(sizes) - sizes, n_seg) + index * SEGMENT
    length = np.minimum(np.repeat(np.cumsum(sizes), n_seg) - begin, SEGMENT)
    m, steps = len(doc), np.arange(length.max())
    mask = steps < length[:, None]
    place = np.where(mask, begin[:, None] + steps, 0)
    p = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
    s = np.stack([1 - p, p], axis=1)[place]
    s = np.where(mask[:, :, None], np.maximum(s, 1e-14), 1.0)
    t = np.exp(trans - trans.max())
    forward, backward = np.empty((m, len(steps), 2, 2)), np.empty((m, len(steps), 2, 2))
    first, last = index == 0, index == np.repeat(n_seg - 1, n_seg)
    cur = t[None] * s[:, 0, None, :]
    cur[first] = s[first, 0, None, :]
    forward[:, 0] = cur
    for k in range(1, len(steps)):
        step = _scaled((cur.reshape(-1, 2) @ t).reshape(-1, 2, 2) * s[:, k, None, :])
        cur = np.where(mask[:, k, None, None], step, cur)
        forward[:, k] = cur
    cur = np.broadcast_to(np.eye(2), (m, 2, 2))
    backward[:, -1] = cur
    for k in range(len(steps) - 2, -1, -1):
        step = _scaled((t[None] * s[:, k + 1, None, :]) @ cur)
        cur = np.where(mask[:, k + 1, None, None], step, cur)
        backward[:, k] = cur
    came, goes = np.zeros((m, 2)), np.ones((m, 2))
    came[first, 0] = 1.0  # a first segment's matrix has equal rows
    order = np.argsort(index, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(index))[:-1])
    for own in levels[:-1]:
        own = own[~last[own]]
        came[own + 1] = _scaled((came[own, None, :] @ forward[own, -1])[:, 0])
    for own in levels[:0:-1]:
        after = s[own, 0] * (backward[own, 0] @ goes[own, :, None])[:, :, 0]
        goes[own - 1] = _scaled(after @ t.T)
    a = (came[:, None, None, :] @ forward)[:, :, 0]
    b = (backward @ goes[:, None, :, None])[:, :, :, 0]
    both = a * b
    margin = np.empty(total)
    margin[place[mask]] = (both[:, :, 1] / both.sum(axis=2))[mask]
    if not pairs:
        return margin, None
    flat_a, flat_b = np.empty((total, 2)), np.empty((total, 2))
    flat_a[place[mask]], flat_b[place[mask]] = a[mask], (b * s)[mask]
    pair = np.zeros((total, 2, 2))
    pair[1:] = flat_a[:-1, :, None] * t * flat_b[1:, None, :]
    pair[np.cumsum(sizes) - sizes] = 0
    norm = pair.sum(axis=(1, 2))
    return margin, pair / np.where(norm > 0, norm, 1)[:, None, None]


class Weights:
    """Scores of words from the model's weights, kept up to WORDS of them."""

    WORDS = 300_000

    def __init__(self, w: np.ndarray):
        self.w = w.tolist()
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 16, 3))

    def rows(self, words: list[str]) -> np.ndarray:
        """Words' own scores and those for the words after and before them."""
        if len(self.index) > self.WORDS:
            self.index.clear()
        index, w, made = self.index, self.w, []
        at = len(index)
        for x in set(words).difference(index):
            index[x] = at + len(made)
            own = features(x)
            made.append((sum([w[bucket(f)] for f in own]), w[bucket("prev " + own[0])], w[bucket("next " + own[0])]))
        if at + len(made) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((at + len(made), 3))])
        if made:
            self.table[at : at + len(made)] = made
        return self.table[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]

    def emissions(self, words: list[str], sizes: list[int]) -> np.ndarray:
        """Of tokens of several documents in a row."""
        r = self.rows(words)
        e = r[:, 0].copy()
        e[1:] += r[:-1, 1]
        e[:-1] += r[1:, 2]
        at = np.cumsum(sizes)[:-1]
        at = at[(at > 0) & (at < len(words))]
        at = np.unique(at)
        e[at] -= r[at - 1, 1]
        e[at - 1] -= r[at, 2]
        return e


def summary(m: np.ndarray) -> np.ndarray:
    """A document's features for the curve: log odds of its highest marginal and of any token being toxic, log of the expected number."""
    if not len(m):
        return np.array([-12.0, -12.0, 0.0])
    m = np.clip(m, 1e-7, 1 - 1e-7)
    top, none = m.max(), np.clip(np.log1p(-m).sum(), -16, -1e-7)
    return np.array([np.log(top / (1 - top)), np.log(-np.expm1(none)) - none, np.log1p(m.sum())])


def relative_weights(sample: pd.DataFrame) -> np.ndarray:
    """The rows' inverse sampling rates (ones without the column), scaled to a mean of one."""
    weight = sample["weight"].to_numpy(float) if "weight" in sample else np.ones(len(sample))
    return weight / weight.mean()


def fit(sample: pd.DataFrame, epochs: int = 6, seed: int = 11) -> dict | None:
    """The model from rows of text, label and, of a sample, weight; None without both labels."""
    labels = sample["label"].astype(int).tolist()
    if len(set(labels)) < 2:
        return None
    weights = relative_weights(sample)
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in tokens(t)], np.int32) for t in sample["text"]]
    words = list(place)
    marks = toxic_marks([[words[k] for k in np.unique(d)] for d in docs], labels)
    own = np.full((len(words), 6), BUCKETS, np.int32)
    near = np.empty((len(words), 2), np.int32)
    marked = np.zeros(len(words), bool)
    for k, x in enumerate(words):
        f = features(x)
        own[k, : len(f)] = [bucket(y) for y in f]
        near[k] = bucket("prev " + f[0]), bucket("next " + f[0])
        marked[k] = any(y in marks for y in f)
    del place, words
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3)  # the last bucket stands for no feature
    trans, t2 = np.zeros((2, 2)), np.full((2, 2), 1e-3)
    for _ in range(epochs):
        order = [k for k in rng.permutation(len(docs)).tolist() if len(docs[k])]
        ends = np.cumsum([len(docs[k]) for k in order])
        for batch in np.split(np.array(order), np.flatnonzero(np.diff(ends // BATCH_TOKENS)) + 1):
            sizes = [len(docs[k]) for k in batch]
            ids = np.concatenate([docs[k] for k in batch])
            share = np.repeat(weights[batch], sizes)
            toxic = np.repeat(np.array(labels)[batch], sizes) > 0
            begins = np.zeros(len(ids), bool)
            begins[np.cumsum(sizes) - sizes] = True
            where = np.full((len(ids), 8), BUCKETS, np.int32)
            where[:, :6] = own[ids]
            inner = np.flatnonzero(~begins)
            where[inner, 6] = near[ids[inner - 1], 0]
            where[inner - 1, 7] = near[ids[inner], 1]
            margin, pair = chain_marginals(w[where].sum(axis=1), sizes, trans, True)
            y = toxic & marked[ids]
            grad = np.bincount(where.ravel(), np.repeat((y - margin) * share, 8), minlength=BUCKETS + 1) - 1e-4 * w
            touched = np.unique(where)
            touched = touched[touched < BUCKETS]
            g2[touched] += grad[touched] ** 2
            w[touched] += 0.5 * grad[touched] / np.sqrt(g2[touched])
            real = np.zeros((2, 2))
            np.add.at(real, (y[inner - 1].astype(int), y[inner].astype(int)), share[inner])
            tg = real - (pair * share[:, None, None]).sum(axis=0) - 1e-3 * trans
            t2 += tg**2
            trans += 0.2 * tg / np.sqrt(t2)
    del docs, own, near
    model = {"w": w[:BUCKETS].astype(np.float32), "trans": trans}
    x = np.array([summary(m) for m in document_marginals(sample["text"].tolist(), Weights(model["w"]), trans)])
    model["curve"] = _logistic(x, np.array(labels, float), weights)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept by Newton's method, from rows of the given weights."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        keep = ridge * np.array([1.0] * (x.shape[1] - 1) + [1e-3])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def document_marginals(texts: list[str | None], weights: Weights, trans: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    words: list[str] = []
    sizes: list[int] = []
    for k, t in enumerate([*texts, None]):
        if k == len(texts) or len(words) > 100_000:
            if words:
                m = chain_marginals(weights.emissions(words, sizes), sizes, trans)[0]
                out += np.split(m, np.cumsum(sizes)[:-1])
            else:
                out += [np.zeros(0)] * len(sizes)
            words, sizes = [], []
        if k < len(texts):
            own = tokens(t)
            words += own
            sizes.append(len(own))
    return out


def score_texts(texts: list[str | None], model: dict | None, weights: Weights | None, with_spans: bool) -> list[tuple[float, list]]:
    if model is None:
        return [(0.0, [])] * len(texts)
    rows = []
    for t, m in zip(texts, document_marginals(texts, weights, model["trans"]), strict=True):
        x = np.append(summary(m), 1.0) @ model["curve"]
        spans = []
        if with_spans and len(m) and m.max() >= 0.5:
            # offsets are of the text itself: lower case can have another length
            low = (t or "").lower()
            place = [(w.start(), w.end()) for w in WORD.finditer(low)]
            if len(low) == len(t or ""):
                spans = [{"start": place[k][0], "end": place[k][1], "marginal": float(m[k])} for k in np.flatnonzero(m >= 0.5)]
            else:
                back = np.cumsum([0, *(len(c.lower()) for c in t)])
                spans = [{"start": int(np.searchsorted(back, place[k][0], "right") - 1), "end": int(np.searchsorted(back, place[k][1], "left")), "marginal": float(m[k])} for k in np.flatnonzero(m >= 0.5)]
        rows.append((float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), spans))
    return rows


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = SAMPLE_DOCS) -> pd.DataFrame:
    """At most so many labelled documents of label 0 and 1, by a hash of the id, and the weight of each: all labels of its
    class in the table over those taken. The ids are chosen from the small label table, so the bounded list is broadcast and
    the documents' text is not shuffled."""
    known = labels.filter(f"`{label_col}` IN (0, 1)").groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("__id"), "__id").limit(most[y]) for y in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    chosen = rows.join(F.broadcast(parts[0].unionByName(parts[1])), "__id").select("__id", "text", "label")
    # an id can have many rows: of each class as many stay as ids were chosen
    taken = [chosen.filter(F.col("label") == y).orderBy(F.xxhash64("__id", "text"), "__id").limit(most[y]) for y in (0, 1)]
    sample = taken[0].unionByName(taken[1]).toPandas().sort_values(["__id", "text"], na_position="first", ignore_index=True)
    sample["weight"] = [max(1.0, total[y] / most[y]) for y in sample["label"]]
    return sample


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """id, score and spans (array of start, end, marginal) for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_caches()
        weights = Weights(model["w"]) if model else None
        for f in frames:
            yield pd.concat([f[["id"]], pd.DataFrame(score_texts(f["text"].tolist(), model, weights, with_spans), columns=["score", "spans"], index=f.index)], axis=1)

    bounded_batches(docs.sparkSession)
    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, "id long, score double, spans array<struct<start:int,end:int,marginal:double>>")
    return out.withColumn("id", id_out()).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: dict | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs whose score is below the threshold, with all columns; no shuffle."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drop_caches()
        weights = Weights(model["w"]) if model else None
        for texts in frames:
            yield pd.Series([s for s, _ in score_texts(texts.tolist(), model, weights, False)], dtype="float64")

    bounded_batches(docs.sparkSession)
    scorer = F.pandas_udf(run, "double")
    return docs.filter(scorer(F.col(f"`{text_col}`").cast("string")) < threshold)
