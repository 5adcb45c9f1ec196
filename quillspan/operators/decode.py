"""BIOES decoding: Viterbi over label scores, labels to spans, spans to labels. Labels: 0 is O, then B, I, E, S of each class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of the transition biases, in order.
BIASES = ("o_o", "o_start", "in_in", "in_end", "end_o", "end_start")
NEVER = -np.inf


def transition_table(classes: int, biases: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, start and end scores: what BIOES forbids is -inf, the rest its bias (0 by default)."""
    b = {**dict.fromkeys(BIASES, 0.0), **(biases or {})}
    n = 1 + 4 * classes
    tag = ["O", *["BIES"[k % 4] for k in range(4 * classes)]]
    kind = [-1, *[k // 4 for k in range(4 * classes)]]
    table = np.full((n, n), NEVER)
    for i in range(n):
        for j in range(n):
            if tag[i] in "OES" and tag[j] in "OBS":
                after = "o" if tag[i] == "O" else "end"
                table[i, j] = b[f"{after}_o"] if tag[j] == "O" else b[f"{after}_start"]
            elif tag[i] in "BI" and tag[j] in "IE" and kind[i] == kind[j]:
                table[i, j] = b["in_in"] if tag[j] == "I" else b["in_end"]
    start = np.array([0.0 if t in "OBS" else NEVER for t in tag])
    end = np.array([0.0 if t in "OES" else NEVER for t in tag])
    return table, start, end


def viterbi(scores: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """Best path; the best label of each token if no path is finite."""
    t = len(scores)
    if not t:
        return []
    at, back = scores[0] + start, np.zeros((t, scores.shape[1]), np.int64)
    for k in range(1, t):
        through = at[:, None] + table
        back[k] = through.argmax(axis=0)
        at = through.max(axis=0) + scores[k]
    at = at + end
    if not np.isfinite(at).any():
        return scores.argmax(axis=1).tolist()
    path = [int(at.argmax())]
    for k in range(t - 1, 0, -1):
        path.append(int(back[k, path[-1]]))
    return path[::-1]


def decoded(rows: DataFrame, classes: int, biases: dict[str, float] | None = None) -> DataFrame:
    """id, labels of rows with id, scores (array<array<float>>)."""
    table, start, end = transition_table(classes, biases)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "labels": [viterbi(np.array([np.asarray(x, float) for x in s]), table, start, end) if s is not None else None for s in f["scores"]]})

    return rows.select("id", "scores").mapInPandas(run, "id long, labels array<int>")


def token_spans(tokens: DataFrame) -> DataFrame:
    """Spans of id, pos, tag (O, B, I, E, S), label: a gap, another label, B, S or what follows E or S begins a new one."""
    w = Window.partitionBy("id").orderBy("pos")
    inside = tokens.filter("tag <> 'O'").withColumn("pp", F.lag("pos").over(w)).withColumn("pt", F.lag("tag").over(w)).withColumn("pl", F.lag("label").over(w))
    new = F.col("pp").isNull() | (F.col("pp") != F.col("pos") - 1) | (F.col("pl") != F.col("label")) | F.col("tag").isin("B", "S") | F.col("pt").isin("E", "S")
    isle = inside.withColumn("isle", F.sum(new.cast("int")).over(w))
    return isle.groupBy("id", "isle").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first("label").alias("label")).drop("isle")


def token_labels(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """id, pos, tag, label of tokens (id, pos, start, end): a token belongs to the span that covers most of it (ties: the earlier)."""
    s = spans.select(F.col("id").alias("i"), F.col("start").alias("s"), F.col("end").alias("e"), "label")
    both = tokens.join(s, (F.col("id") == F.col("i")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left")
    shared = F.least("end", "e") - F.greatest("start", "s")
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("id", "pos").orderBy(shared.desc_nulls_last(), "s", "label"))).filter("rn = 1")
    own = Window.partitionBy("id", "s", "e", "label")
    first, last = F.col("pos") == F.min("pos").over(own), F.col("pos") == F.max("pos").over(own)
    tag = F.when(F.col("s").isNull(), "O").when(first & last, "S").when(first, "B").when(last, "E").otherwise("I")
    return best.select("id", "pos", tag.alias("tag"), "label")
