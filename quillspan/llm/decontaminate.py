"""Benchmark decontamination over templates, so that re-parameterised questions are caught too.

Texts become sequences of template words: lower case without outer punctuation, with numbers, names
(capitalised words) and units replaced by typed placeholders. A capitalised word that begins a sentence may be a
name or not, so texts are read both ways. Scripts that put no spaces between words are cut into characters.
Windows of WINDOW template words of the benchmark (twice as many for items mostly of such scripts), with at least
LITERALS words that are no placeholders, are hashed; an item shorter than a window is one window. Windows with fewer
literal words are hashed by their exact words, so that copies of them are found as well.
A document's windows are looked up in those tables.
Matches of a document and an item are then checked slot by slot: within one alignment (the item's
place less the document's), one value of the item must always have become the same value in
the document, and distinct values distinct ones; windows that break this are dropped.

The benchmark's table is broadcast in parts of at most PART_WINDOWS windows (about 100 MB at most);
a larger benchmark takes several passes over the documents, one for each part, so nothing of
unbounded size is broadcast. Items of equal words are searched for once. Nothing is shuffled but the matches.

Defined results: null and empty texts match nothing; items with fewer than MIN_ITEM words are not searched for, as
any text could hold them; a null id of a document is kept as it is, a null id or text of an item is no item; items that
repeat an id are searched for each, so a document can have a row for each of them. Columns of documents and benchmark
other than ids and texts don't matter and may have any names; empty tables match nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import WordCache, bounded_batches, id_in, id_out, worker_cache

WINDOW, LITERALS, MIN_ITEM, PART_WINDOWS = 8, 5, 5, 2_000_000
UNITS = frozenset("mm cm m km mg g kg t ml l s sec min h hr hours minutes seconds days weeks months years inch inches ft feet yd yards mile miles lb lbs oz kb mb gb tb hz khz mhz ghz v kw w j kj cal kcal eur usd gbp euro euros dollar dollars pound pounds cent cents percent % € $ £".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|[a-z]{1,3})?$")
_OUTER = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
_WORD = re.compile(r"\w|[%€$£]")
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Flags in the low bits of a word's code: it ends a sentence, it may be a name, it is a number, a unit, a word at all.
ENDS, CAPITAL, IS_NUMBER, IS_UNIT, IS_WORD, FLAGS = (np.uint64(x) for x in (1, 2, 4, 8, 16, 31))
SLOTS = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>")) & ~FLAGS | np.uint64(4) for k in ("number", "unit", "name")}


def word_code(word: str) -> int:
    """64-bit hash of a word's core in lower case, with flags in its low bits; only ENDS for mere punctuation."""
    if word == "\n":
        return 1  # a line's end ends a sentence
    core = word if word.isalpha() else word[:-1]
    if core.isalpha() and (core is word or word[-1] in ",;.!?:"):
        ends, low, number = int(core is not word and word[-1] not in ","), core.lower(), False
    else:
        ends = int(word[-1:] in ".!?:;…" or word.rstrip("\"')]")[-1:] in ".!?")
        core = _OUTER.sub("", word)
        if not _WORD.search(core):
            return ends
        low = core.lower()
        number = NUMBER.match(low)
    kind = 4 if number else 8 if low in UNITS else 2 if core[:1].isupper() and not core.isupper() else 0
    return xxhash.xxh64_intdigest(low) & ~31 | 16 | kind | ends


def word_codes() -> WordCache:
    return WordCache(word_code)


def split(text: str | None) -> list[str]:
    """Words and line ends of a text."""
    t = (text or "").replace("\n", " \n ").replace("\t", " ").replace("\r", " ")
    if not t.isascii():
        t = _UNSPACED.sub(r" \g<0> ", t)
    return [p for p in t.split(" ") if p]


class Template:
    """A text's words as codes: exact, with placeholders (codes), and with sentence beginners as names too (named)."""

    def __init__(self, text: str | None, cache: WordCache):
        self.parts = split(text)
        raw = np.fromiter(map(cache.__getitem__, self.parts), np.uint64, len(self.parts))
        begins = np.ones(len(raw), bool)
        begins[1:] = (raw[:-1] & ENDS) > 0
        self.real = np.flatnonzero(raw & IS_WORD)
        raw, begins = raw[self.real], begins[self.real]
        self.exact = raw & ~FLAGS
        capital = (raw & CAPITAL) > 0
        codes = np.where(raw & IS_NUMBER, SLOTS["number"], np.where(raw & IS_UNIT, SLOTS["unit"], self.exact))
        self.codes = np.where(capital & ~begins, SLOTS["name"], codes)
        self.named = np.where(capital, SLOTS["name"], codes)
        self.slot, self.named_slot = (self.codes & np.uint64(4)) > 0, (self.named & np.uint64(4)) > 0

    def word(self, k: int) -> str:
        return _OUTER.sub("", self.parts[self.real[k]]).lower()


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    if len(codes) < size:
        return np.empty(0, np.uint64)
    h = np.full(len(codes) - size + 1, size, np.uint64)
    for j in range(size):
        h = (h ^ codes[j : len(codes) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


class Items:
    """Of benchmark items: the sorted tables of window hashes, by the windows' size and whether their words are exact, with
    rows of hash, item's index, place and whether sentence beginners are names; and each item's ids, words and slots."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        cache, rows, known = word_codes(), {}, {}
        self.words: list[tuple[list[int], list[str], np.ndarray, np.ndarray]] = []
        for item, text in items:
            t = Template(text, cache)
            own = t.exact.tobytes() + t.codes.tobytes() + t.named.tobytes()
            if own in known:
                self.words[known[own]][0].append(item)
                continue
            k = known[own] = len(self.words)
            self.words.append(([item], [t.word(q) for q in range(len(t.real))], t.slot, t.named_slot))
            n = len(t.real)
            size = min(2 * window if sum(bool(_UNSPACED.match(w)) for w in self.words[k][1]) > n / 2 else window, n)
            if size < MIN_ITEM:
                continue
            literal, named = (size - np.convolve(s, np.ones(size, int), "valid") >= min(LITERALS, size) for s in (t.slot, t.named_slot))
            h, g = window_hashes(t.codes, size), window_hashes(t.named, size)
            for exact, hashes, at, mode in ((False, h, literal, 0), (False, g, named & (g != h), 1), (True, window_hashes(t.exact, size), ~literal, 0)):
                at = np.flatnonzero(at)
                if len(at):
                    rows.setdefault((size, exact), []).append(np.stack([hashes[at], *(np.broadcast_to(np.asarray(x, np.uint64), len(at)) for x in (k, at, mode))], 1))
        tables = {key: np.concatenate(v) for key, v in rows.items()}
        self.tables = {key: t[np.argsort(t[:, 0], kind="stable")] for key, t in tables.items()}


def _places(h: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(place in the document, item's index, place in the item, mode) of equal hashes."""
    a = np.searchsorted(t[:, 0], h)
    for p in np.flatnonzero(t[np.minimum(a, len(t) - 1), 0] == h).tolist():
        k = int(a[p])
        while k < len(t) and t[k, 0] == h[p]:
            yield p, int(t[k, 1]), int(t[k, 2]), int(t[k, 3])
            k += 1


def match(text: str | None, cache: WordCache, items: Items) -> list[tuple]:
    """(item, windows, matched words, words of the item, whether all slots have the item's own values, first and last matched
    place in the document's words) of each item that has a consistent window in the text."""
    t = Template(text, cache)
    hits: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for (size, exact), table in items.tables.items():
        if exact:
            looked = [(window_hashes(t.exact, size), None)]
        else:
            h, g = window_hashes(t.codes, size), window_hashes(t.named, size)
            other = np.flatnonzero(g != h)
            looked = [(h, None), (g[other], other)]
        for hashes, at in looked:
            for p, k, place, mode in _places(hashes, table) if len(hashes) else ():
                hits.setdefault((k, (p if at is None else int(at[p])) - place), set()).add((place, size, mode))
    best: dict[int, tuple] = {}
    for (k, shift), found in sorted(hits.items()):
        _, words, slot, named_slot = items.words[k]
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        covered: set[int] = set()
        windows, same = set(), True
        for place, size, mode in sorted(found):
            slots = named_slot if mode else slot
            pairs = {(words[q], t.word(q + shift)) for q in range(place, place + size) if slots[q]}
            if any(there.get(x, y) != y or back.get(y, x) != x for x, y in pairs) or not len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                continue
            there.update(pairs)
            back.update((y, x) for x, y in pairs)
            same &= all(x == y for x, y in pairs)
            windows.add((place, size))
            covered.update(range(place, place + size))
        if windows and (k not in best or len(covered) > best[k][1]):
            best[k] = (len(windows), len(covered), len(words), same, min(covered) + shift, max(covered) + shift)
    return [(item, *found) for k, found in sorted(best.items()) for item in items.words[k][0]]


def _item_parts(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about PART_WINDOWS words, one part at a time in the driver."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).collect()[0][0] or 0
    parts = max(1, math.ceil(total / PART_WINDOWS))
    for part in range(parts):
        yield sorted((r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toLocalIterator())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document and item with a consistent match: id, item_id, n_windows, n_words (matched words of the
    item), item_words, exact (every slot has the item's own value), first_word and last_word (places in the document)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for own in _item_parts(benchmark, item_col, item_text_col):
        found = rows.mapInPandas(_search(_sent(docs, own, window)), "id long, item_id long, n_windows int, n_words int, item_words int, exact boolean, first_word int, last_word int")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("id", id_out()).withColumnRenamed("id", id_col)


def _sent(docs: DataFrame, items: list[tuple[int, str]], window: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(Items(items, window))


def _search(items: Broadcast):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("template words", word_codes)
        for f in frames:
            rows = [(i, *m) for i, t in zip(f["id"], f["text"], strict=True) for m in match(t, cache, items.value)]
            yield pd.DataFrame(rows, columns=["id", "item_id", "n_windows", "n_words", "item_words", "exact", "first_word", "last_word"])

    return run


def _matcher(items: Broadcast):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = worker_cache("template words", word_codes)
        for texts in series:
            yield pd.Series([bool(match(t, cache, items.value)) for t in texts], dtype="bool")

    return F.pandas_udf(run, "boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the rows that have a consistent match with an item; all columns stay as they are. No shuffle."""
    bounded_batches(docs.sparkSession)
    for own in _item_parts(benchmark, item_col, item_text_col):
        docs = docs.filter(~_matcher(_sent(docs, own, window))(F.col(f"`{text_col}`").cast("string")))
    return docs
