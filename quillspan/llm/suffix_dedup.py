"""Removal of byte strings that an earlier document has, by longest-previous-factor arrays.

A byte goes if a window of `length` bytes around it also starts in a document with a smaller id, that is,
if the longest previous factor of a suffix - its longest match with a suffix of an earlier document - is at least
`length` bytes long. One suffix array of all text is not needed: equal windows have equal minimizers (the least hash of
their 16-byte grams), so the windows of a document are cut into runs with one minimizer, and only
runs with equal minimizers have to meet.

1. Texts travel once, compressed, by (id, hash); later steps read that same exchange again.
   Exact copies of a smaller id go as a whole and take no further part.
2. Minimizers that occur in several documents are found (6-byte hashes, each once for a batch).
3. The text of the runs with such minimizers goes to the minimizer's group. Within a batch, a run
   whose text an earlier document of the batch has is settled there, so what a popular passage
   sends is one run for each batch and not one for each document.
4. The suffixes that begin a window of a group's runs are sorted by their first `length` bytes, ties by document id. In
   that order the previous and next smaller document ids are found, and the longer match with either suffix is the
   longest previous factor, up to `length`: any suffix between has a greater id, any one beyond a shorter match.
5. The matched windows' bytes return to their documents and are cut out.

Defined results: null text counts as empty; documents shorter than a window stay whole; rows with a
null id stay whole and match nothing; rows that repeat an id never remove from each other, as ties of equal ids keep
both; an empty table gives no rows; columns other than id and text don't matter; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import NO_ID, id_in, id_out, input_bytes

GRAM = 16
#: Bytes of input behind one group of minimizers and one group of runs; of text that a worker holds at a time. Groups of
#: minimizers are so small that a document's shared ones mostly lie in groups of their own at any size of input.
GROUP_BYTES, RUN_GROUP_BYTES, BATCH_BYTES, CHUNK_BYTES = 1 << 21, 3 << 19, 3 << 20, 1 << 18
#: Begins what a batch has settled by itself; neither a compressed frame nor a frame's length begins so.
OWN = b"OWN!"
MASK48 = np.uint64((1 << 48) - 1)


def prefix_words(t: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` bytes of the suffixes at pos as big-endian 64-bit words (words x suffixes), zeros beyond the end."""
    word = np.concatenate([t.astype(np.uint64), np.zeros(depth + 16, np.uint64)])
    for step in (1, 2, 4):
        word = (word[:-step] << np.uint64(8 * step)) | word[step:]
    out = np.stack([word[pos + k] for k in range(0, depth, 8)])
    if depth % 8:
        out[-1] &= ~np.uint64(0) << np.uint64(64 - 8 * (depth % 8))
    return out


def common_prefix(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes suffixes (words x suffixes) share at their beginning, up to depth."""
    x = a ^ b
    first = (x != 0).argmax(axis=0)
    x = x[first, np.arange(x.shape[1])]
    inside = sum((x < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
    return np.where(x == 0, depth, np.minimum(8 * first + inside, depth))


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each value the last place before it with a smaller value, or -1; all searches go up and down one tree of minima together."""
    n = len(v)
    out = np.full(n, -1, np.int64)
    near = np.flatnonzero(v[1:] > v[:-1]) + 1
    out[near] = near - 1
    tree = [v]
    while len(tree[-1]) > 1:
        m = tree[-1]
        m = np.concatenate([m, np.full(len(m) % 2, np.iinfo(v.dtype).max, v.dtype)])
        tree.append(np.minimum(m[::2], m[1::2]))
    todo = np.flatnonzero(out < 0)
    end = todo.copy()  # the search goes leftward from here, in units of the level
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for m in tree:
        odd = end % 2 == 1
        hit = odd & (m[np.maximum(end - 1, 0)] < v[todo])
        waiting.append((todo[hit], end[hit] - 1))
        todo, end = todo[~hit], end[~hit] // 2
        todo, end = todo[end > 0], end[end > 0]
    who, at = np.empty(0, np.int64), np.empty(0, np.int64)
    for level in range(len(waiting) - 1, -1, -1):
        if len(who):
            right = np.minimum(2 * at + 1, len(tree[level]) - 1)
            at = np.where((2 * at + 1 < len(tree[level])) & (tree[level][right] < v[who]), right, 2 * at)
        who, at = np.concatenate([who, waiting[level][0]]), np.concatenate([at, waiting[level][1]])
    out[who] = at
    return out


def longest_previous_factors(t: np.ndarray, pos: np.ndarray, owner: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """Of the suffixes of byte array t at pos, the length (up to depth) of the longest match with one of a smaller owner;
    0 where that is less than `least`. Suffixes with no neighbour in the order that matches `least` bytes are left out early."""
    out = np.zeros(len(pos), np.int64)
    words = prefix_words(t, pos, depth)
    order = np.lexsort((owner, *words[::-1]))
    words, o = words[:, order], owner[order]
    if not len(order):
        return out
    lcp = common_prefix(words[:, 1:], words[:, :-1], depth)
    group = np.concatenate([[0], np.cumsum(lcp < least)])
    # of each stretch of matching suffixes: whether it has several owners, and whether their ids ever fall
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    several = np.maximum.reduceat(o, begin) != np.minimum.reduceat(o, begin)
    falls = np.zeros(len(o), np.int64)
    falls[1:] = (o[1:] < o[:-1]) & (group[1:] == group[:-1])
    falls = np.add.reduceat(falls, begin) > 0
    size = np.diff(np.concatenate([begin, [len(o)]]))
    for wanted, step in ((several, 1), (several & falls, -1)):  # the previous, then the next smaller owner
        k = np.flatnonzero(np.repeat(wanted, size))[::step]
        if not len(k):
            continue
        ranks = np.unique(o[k], return_inverse=True)[1].astype(np.int64)
        # stretches that the search has left behind hold greater values only
        far = group[k] if step < 0 else group[-1] - group[k]
        p = previous_smaller(ranks + far * (int(ranks.max()) + 1))
        has = np.flatnonzero(p >= 0)
        a, b = k[has], k[p[has]]
        match = np.full(len(a), depth) if least == depth else common_prefix(words[:, a], words[:, b], depth)
        out[order[a]] = np.maximum(out[order[a]], match)
    return out


def minimizer_runs(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one minimizer in the texts data[starts:ends], each of at least `length`
    bytes: (text's index, first window's offset in data, number of windows, minimizer)."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    for step in (1, 2, 4):
        b = (b[:-step] << np.uint64(8 * step)) | b[step:]
    h = b[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (b[8:] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    w, done = length - GRAM + 1, 1
    while done < w:
        step = min(done, w - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    if not len(h):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    valid = np.zeros(len(h) + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, np.minimum(ends - length + 1, len(h)), -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = np.concatenate([[True], h[1:] != h[:-1]])
    new[starts] = True
    new[1:] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(h)]]))
    good = inside[at]
    at, n = at[good], n[good]
    return np.searchsorted(starts, at, "right") - 1, at, n, h[at]


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], bytes, np.ndarray, np.ndarray]]:
    """Texts of at least `length` bytes, joined to pieces of about CHUNK_BYTES for the vector code."""
    at, size = [], 0
    for i, t in enumerate([*texts, None]):
        if at and (t is None or size + len(t) > CHUNK_BYTES):
            ends = np.cumsum([len(texts[k]) for k in at])
            yield at, b"".join(texts[k] for k in at), np.concatenate([[0], ends[:-1]]), ends
            at, size = [], 0
        if t is not None and len(t) >= length:
            at.append(i)
            size += len(t)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows with their texts, about BATCH_BYTES at a time."""
    unzip = zstandard.ZstdDecompressor()
    kept, texts, size = [], [], 0
    for f in frames:
        begin = 0
        for k, z in enumerate(f["z"]):
            texts.append(unzip.decompress(z))
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                kept.append(f.iloc[begin : k + 1])
                begin = k + 1
                yield pd.concat(kept, ignore_index=True), texts
                kept, texts, size = [], [], 0
        if begin < len(f):
            kept.append(f.iloc[begin:])
    if kept:
        yield pd.concat(kept, ignore_index=True), texts


def _groups(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where the groups of equal neighbours begin and end in arrays sorted together."""
    n = len(keys[0])
    if not n:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], n], strict=True))


def _sized(b: bytes) -> bytes:
    return len(b).to_bytes(4, "little") + b


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zipper = zstandard.ZstdCompressor(level=1)
        for f in frames:
            rows = []
            for t in f["text"]:
                b = (t or "").encode("utf-8", "surrogatepass")
                rows.append((len(b), hashlib.sha256(b).hexdigest(), zipper.compress(b)))
            yield pd.concat([f[["id"]], pd.DataFrame(rows, columns=["n", "sha", "z"], index=f.index)], axis=1)

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id long, n long, sha string, z binary")
    # keys that can't be null: a filter for nulls in some joins only would give each of them an exchange of its own
    return rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.xxhash64("sha").alias("key"), "n", "sha", "z")


def _minimizers(length: int, groups: int):
    """Rows for the groups of minimizers; those that this batch already shows to be shared go along, marked OWN."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, texts in _batches(f[f["lead"].eq(True) & (f["n"] >= length)] for f in frames):
            ids, keys = rows["id"].to_numpy(), rows["key"].to_numpy()
            found = [(np.asarray(at)[k], h) for at, data, s, e in _chunks(texts, length) for k, _, _, h in [minimizer_runs(data, s, e, length)]]
            if not found:
                continue
            doc = np.concatenate([x[0] for x in found]).astype(np.int64)
            h = np.concatenate([x[1] for x in found]) & MASK48
            order = np.lexsort((ids[doc], h))
            doc, h = doc[order], h[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            doc, h = doc[once], h[once]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            at = np.flatnonzero(first)
            size = np.diff(np.concatenate([at, [len(h)]]))
            many = np.repeat(size > 1, size)
            out = []
            d, x = doc[many], h[many]
            order = np.argsort(d, kind="stable")
            d, x = d[order], x[order]
            for a, z in _groups(d):
                out.append((int(d[a]) % groups, np.int64(ids[d[a]]).tobytes(), np.int64(keys[d[a]]).tobytes(), OWN + _six(x[a:z])))
            d, x = doc[at], h[at]  # of each minimizer the first document
            g = (x % np.uint64(groups)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            g, d, x = g[order], d[order], x[order]
            for a, z in _groups(g):
                names, at_name = np.unique(d[a:z], return_inverse=True)
                out.append((int(g[a]), zstandard.compress(ids[names].tobytes(), 1), keys[names].tobytes(), _sized(zstandard.compress(at_name.astype("<u4").tobytes(), 1)) + _six(x[a:z])))
            yield pd.DataFrame(out, columns=["g", "ids", "keys", "blob"])

    return run


def _shared(f: pd.DataFrame) -> pd.DataFrame:
    """Of one group: the minimizers that several documents have, for each of these documents."""
    h, ids, keys, out = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for i, k, blob in zip(f["ids"], f["keys"], f["blob"], strict=True):
        if blob.startswith(OWN):
            out.append((int(np.frombuffer(i, np.int64)[0]), int(np.frombuffer(k, np.int64)[0]), blob[len(OWN) :]))
            continue
        n = 4 + int.from_bytes(blob[:4], "little")
        at = np.frombuffer(zstandard.decompress(blob[4:n]), "<u4")
        h.append(_from_six(blob[n:]))
        ids.append(np.frombuffer(zstandard.decompress(i), np.int64)[at])
        keys.append(np.frombuffer(k, np.int64)[at])
    h, ids, keys = np.concatenate(h), np.concatenate(ids), np.concatenate(keys)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    good = counts[inverse] > 1
    h, ids, keys = h[good], ids[good], keys[good]
    order = np.lexsort((keys, ids))
    h, ids, keys = h[order], ids[order], keys[order]
    out += [(int(ids[a]), int(keys[a]), _six(h[a:z])) for a, z in _groups(ids, keys)]
    return pd.DataFrame(out, columns=["id", "key", "six"])


def _runs(length: int, groups: int):
    """Runs of windows with shared minimizers, packed by group; spans settled within the batch go along, marked OWN."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zipper = zstandard.ZstdCompressor(level=1)
        for rows, texts in _batches(f[f["six"].notna()] for f in frames):
            ids, keys = rows["id"].to_numpy(), rows["key"].to_numpy()
            want = [_from_six(b"".join(x)) for x in rows["six"]]
            best: dict[bytes, int] = {}
            found: list[tuple[int, int, bytes, int]] = []
            for at, data, s, e in _chunks(texts, length):
                k, begin, n, h = minimizer_runs(data, s, e, length)
                h = h & MASK48
                cut = np.searchsorted(k, np.arange(len(at) + 1))
                for q, doc in enumerate(at):
                    a, z = cut[q], cut[q + 1]
                    for j in (a + np.flatnonzero(np.isin(h[a:z], want[doc]))).tolist():
                        p = int(begin[j])
                        x = data[p : p + int(n[j]) + length - 1]
                        found.append((doc, p - int(s[q]), x, int(h[j])))
                        i = int(ids[doc])
                        if best.get(x, i) >= i:
                            best[x] = i
            settled: dict[int, list] = {}
            sent: dict[int, list] = {}
            for doc, p, x, h in found:
                if best[x] < ids[doc]:
                    settled.setdefault(doc, []).append((p, p + len(x)))
                else:
                    sent.setdefault(h % groups, []).append((int(ids[doc]), int(keys[doc]), p, x))
            out = [(d % groups, int(ids[d]), int(keys[d]), OWN + np.array(v, "<i4").tobytes()) for d, v in settled.items()]
            for g, v in sent.items():
                meta = np.array([(i, k, p, len(x)) for i, k, p, x in v], np.int64).tobytes()
                out.append((g, len(v), 0, zipper.compress(meta + b"".join(x for *_, x in v))))
            yield pd.DataFrame(out, columns=["g", "id", "key", "blob"])

    return run


def _matches(length: int):
    """Of one group: the spans of each document that an earlier one has."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        meta, parts, out = [np.empty((0, 4), np.int64)], [], []
        for n, key, blob in zip(f["id"], f["key"], f["blob"], strict=True):
            if blob.startswith(OWN):
                out.append((int(n), int(key), blob[len(OWN) :]))
                continue
            raw = zstandard.decompress(blob)
            meta.append(np.frombuffer(raw, np.int64, int(n) * 4).reshape(-1, 4))
            parts.append(raw[int(n) * 32 :])
        meta = np.concatenate(meta)
        t = np.frombuffer(b"".join(parts), np.uint8)
        sizes = meta[:, 3]
        starts = np.cumsum(sizes) - sizes
        if not len(sizes):
            return pd.DataFrame(out, columns=["id", "key", "blob"])
        which = np.repeat(np.arange(len(sizes)), sizes - length + 1)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
        factor = longest_previous_factors(t, starts[which] + offset, meta[which, 0], length, least=length)
        hit = np.flatnonzero(factor >= length)
        w, o = which[hit], offset[hit]
        runs = _groups(w, o - np.arange(len(o)))
        cut, last = np.array([a for a, _ in runs], np.int64), np.array([z - 1 for _, z in runs], np.int64)
        begin = meta[w[cut], 2] + o[cut]
        end = meta[w[cut], 2] + o[last] + length
        ids, keys = meta[w[cut], 0], meta[w[cut], 1]
        order = np.lexsort((keys, ids))
        ids, keys, spans = ids[order], keys[order], np.stack([begin, end], 1)[order].astype("<i4")
        out += [(int(ids[a]), int(keys[a]), spans[a:z].tobytes()) for a, z in _groups(ids, keys)]
        return pd.DataFrame(out, columns=["id", "key", "blob"])

    return run


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, z in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = False) -> DataFrame:
    """One row for each input row: id, n_bytes, n_removed, n_spans, spans (of bytes, half open), kept_sha256 and,
    if asked for, the remaining bytes as kept_text (invalid UTF-8 replaced)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    size = input_bytes(docs)
    groups, run_groups = (max(8, math.ceil(size / x)) for x in (GROUP_BYTES, RUN_GROUP_BYTES))
    packed = _packed(docs, id_col, text_col)
    own_text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.select(id_in(id_col).alias("id"), F.sha2(own_text, 256).alias("sha")).filter(F.col("id") != F.lit(NO_ID)).groupBy("sha").agg(F.min("id").alias("id"))
    first = first.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.xxhash64("sha").alias("key"), F.lit(True).alias("lead"))
    # all three joins with packed take all its columns, so that one exchange of the texts serves them
    whole = packed.join(first, ["id", "key"], "left")
    minimizers = whole.mapInPandas(_minimizers(length, groups), "g long, ids binary, keys binary, blob binary")
    wanted = minimizers.groupBy("g").applyInPandas(_shared, "id long, key long, six binary").groupBy("id", "key").agg(F.collect_list("six").alias("six"))
    runs = packed.join(wanted, ["id", "key"], "left").mapInPandas(_runs(length, run_groups), "g long, id long, key long, blob binary")
    spans = runs.groupBy("g").applyInPandas(_matches(length), "id long, key long, blob binary").groupBy("id", "key").agg(F.collect_list("blob").alias("spans"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for f in frames:
            rows = []
            for i, n, sha, lead, z, s in zip(f["id"], f["n"], f["sha"], f["lead"], f["z"], f["spans"], strict=True):
                if i != NO_ID and not lead and n >= length:
                    gone = [(0, int(n))]
                else:
                    gone = merged(np.frombuffer(b"".join(s), "<i4").reshape(-1, 2)) if s is not None else []
                kept = None
                if gone or with_text:
                    b, at, parts = unzip.decompress(z), 0, []
                    for x, y in gone:
                        parts.append(b[at:x])
                        at = y
                    kept = b"".join([*parts, b[at:]])
                    sha = hashlib.sha256(kept).hexdigest()
                rows.append((i, n, sum(y - x for x, y in gone), len(gone), [{"start": x, "end": y} for x, y in gone], sha, kept.decode("utf-8", "replace") if with_text else None))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept_text"])

    out = whole.join(spans, ["id", "key"], "left").select("id", "n", "sha", F.coalesce("lead", F.lit(False)).alias("lead"), "z", "spans")
    out = out.mapInPandas(cut, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept_text string")
    out = out.withColumn("id", id_out()).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept_text")
