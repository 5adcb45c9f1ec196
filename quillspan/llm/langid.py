"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters) of every labelled text; tasks give (language, bucket, count) rows of
what they saw, which Spark adds up; the driver receives at most 2^15 counts for each language, whatever the input. The
log-probability matrix is broadcast, and scoring gathers the matrix rows of the n-grams of a batch of texts, a sparse
product with one entry for each n-gram, and adds them up by text in numpy.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing was learned;
ties go to the language first in order; null labels are not learned from; rows that repeat an id are scored each;
other columns don't matter, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, id_in, id_out

BUCKETS = 1 << 15
#: Characters that are handled at once; longer texts are added up piece by piece.
PIECE = 1 << 18


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id", of: int = 4, rest: int = 2) -> Column:
    """Rows that no label is learned from: crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == rest


def grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that starts at each position) of code points; n-grams over a text's end are the caller's to drop."""
    c = codes.astype(np.uint32)
    h = c * np.uint32(0x9E3779B1)
    yield 1, (h >> np.uint32(17)).astype(np.int32)
    for n in (2, 3):
        h = ((h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77)) ^ (c[n - 1 :] * np.uint32(0xC2B2AE3D))
        yield n, ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int32)


def codes_of(text: str) -> np.ndarray:
    """Code points in lower case; digits, punctuation and white space are one space each."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = c < 128
    c[low & ~((c >= 97) & (c <= 122))] = 32
    return np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])


def text_grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of one text, piece by piece; each n-gram once."""
    for a in range(0, max(1, len(codes) - 2), PIECE):
        piece = codes[a : a + PIECE + 2]
        last = a + PIECE >= len(codes) - 2
        for _, g in grams(piece):
            yield g if last else g[:PIECE]


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability matrix (buckets x languages, the prior in a last row)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for label, text in zip(f["label"], f["text"], strict=True):
                if not text or not has_letter(text):
                    continue
                v = sums.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                v[BUCKETS] += 1
                for g in text_grams(codes_of(text)):
                    v[:BUCKETS] += np.bincount(g, minlength=BUCKETS)
        for label, v in sums.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"label": label, "bucket": at.astype(np.int32), "n": v[at]})

    bounded_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    got = rows.mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(got["label"]))
    counts = np.zeros((len(languages), BUCKETS + 1))
    counts[got["label"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"]
    logs = np.log((counts[:, :BUCKETS] + 0.5) / (counts[:, :BUCKETS].sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    prior = np.log(counts[:, BUCKETS:] / counts[:, BUCKETS:].sum())
    return languages, np.concatenate([logs, prior], axis=1).T.astype(np.float32).copy()


def batch_scores(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log posteriors (not normalised), texts x languages: the prior and the sum over a text's n-grams, each as often as it occurs."""
    total = np.tile(matrix[BUCKETS].astype(np.float64), (len(texts), 1))
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0

    def add() -> None:
        starts = np.cumsum([0] + [len(g) for _, g in waiting[:-1]])
        sums = np.add.reduceat(matrix[np.concatenate([g for _, g in waiting])], starts, axis=0, dtype=np.float64)
        np.add.at(total, [k for k, _ in waiting], sums)

    for k, text in enumerate(texts):
        for g in text_grams(codes_of(text)):
            if len(g):
                waiting.append((k, g))
                size += len(g)
            if size >= PIECE:
                add()
                waiting, size = [], 0
    if waiting:
        add()
    return total


def identify(docs: DataFrame, languages: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (posterior) for each row, and held_out of the id."""

    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            at = [k for k, t in enumerate(texts) if languages and t and has_letter(t)]
            out = [("und", 0.0)] * len(texts)
            s = batch_scores([texts[k] for k in at], sent.value)
            best = s.argmax(axis=1) if len(at) else []
            for k, row, b in zip(at, s, best, strict=True):
                out[k] = (languages[b], float(1 / np.exp(row - row[b]).sum()))
            yield pd.concat([f[["id", "held_out"]], pd.DataFrame(out, columns=["lang_pred", "score"], index=f.index)], axis=1)

    bounded_batches(docs.sparkSession)
    rows = docs.select(id_in(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, held_out boolean, lang_pred string, score double").withColumn("id", id_out()).withColumnRenamed("id", id_col)
