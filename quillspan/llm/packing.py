"""Tokenised documents packed into as few sequences as possible: best fit, then swaps.

Each document's ids are made once (words are encoded once and kept by a bounded cache, since no token
spans white space) and only lengths and checksums go on. A document longer than a sequence is cut
into full pieces and a rest. Pieces are dealt at random to blocks of bounded size; a block packs its
pieces best-fit decreasing and then improves the underfull bins, all of them: it moves one piece to another bin, or
exchanges one for one, one for two or two for one, whenever that makes the sum of squared fills larger, until
bins empty or no exchange helps. Full bins are done; the pieces of all underfull bins of all blocks
meet again in fewer blocks, round after round, until one block holds the rest (or a round puts
less than LEAST_SAVING of its pieces into full bins: the same mix would come again). So a block is never larger than BLOCK pieces and the result is nearly one global packing.

Defined results: a null or empty text still has its end id, a piece of one token. Rows that repeat an
id are packed each on its own. Sequence ids are unique numbers without order. An empty table has no
pieces; columns other than id and text don't matter to `pack_documents`; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, id_in, id_out, kept, scratch, stored, worker_cache

#: Pieces that one task packs together.
BLOCK = 20_000
#: Fresh deals in a row without a gain, after which a block's search ends.
RESTARTS = 6
#: Share of pieces that a round must put into full bins for the rest to be dealt again.
LEAST_SAVING = 0.01


class WordIds(dict):
    """Token ids (little-endian 32-bit) of space-delimited words, kept up to WORDS of them, none of them over LONGEST characters
    (about 200 bytes for a word of usual length).

    A word of letters, maybe with closing punctuation, is the ids of its letters and those of its punctuation, if the tokenizer's
    own normaliser turns its letters into letters only (some grow a combining mark, which would join the punctuation).
    Such letters go to the model itself, spelled as the tokenizer's byte-level step does (a character for each byte), which
    spares the whole encoder's work; this holds for a tokenizer of that kind only, and else the encoder is used."""

    WORDS, LONGEST = 700_000, 64
    #: ASCII marks, of which any row behind letters is one part to the tokenizer (an apostrophe can begin another part).
    CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(256 + k) for k, b in enumerate(rest)}
        samples = ("The", "naïveté", "straße", "ночь", "ELLE", "日本", "end.)", "ÉLAN,")
        self.direct = not self.of_letters(samples) and all(self[w] == self.encoded([w])[0] for w in samples)
        self.clear()

    def encoded(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def of_letters(self, words: Iterable[str]) -> list[str]:
        """Keeps ids of the words that are letters, maybe with closing punctuation; returns the others."""
        tokenize, normal, spelling, closing, pack = self.tokenizer.model.tokenize, self.tokenizer.normalizer.normalize_str, self.spelling, self.CLOSING, struct.pack
        rest = []
        for w in words:
            core = w if w.isalpha() else w.rstrip(closing)
            ids = self.get(core)
            if ids is None or len(core) == len(w):
                low = core.lower() if core.isascii() else normal(core)
                if not low.isalpha() or not core.isalpha():
                    rest.append(w)
                    continue
                found = [t.id for t in tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(spelling))]
                self[core] = ids = pack(f"<{len(found)}I", *found)
                if len(core) == len(w):
                    continue
            elif not core.isalpha():
                rest.append(w)
                continue
            tail = w[len(core) :]
            if tail not in self:
                self[tail] = self.encoded([tail])[0]
            self[w] = ids + self[tail]
        return rest

    def ids(self, texts: list[list[str]]) -> Iterator[bytes]:
        """Ids of texts that are split into words. New words of all texts go to the encoder together; room is made only
        between two calls, so that all words of a call are here at its end."""
        if len(self) > self.WORDS:
            self.clear()
        new = [w for w in set().union(*texts) if w not in self]
        odd = self.of_letters(new) if self.direct else new
        self.update(zip(odd, self.encoded(odd), strict=True))
        for words in texts:
            yield b"".join(map(self.__getitem__, words))
        for w in [w for w in new if len(w) > self.LONGEST]:
            del self[w]


def word_ids(tokenizer_json: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_json)
    tokenizer.encode_special_tokens = True
    return WordIds(tokenizer)


def word_parts(text: str) -> list[str]:
    """Parts of a text between spaces and line ends. Tokens never hold white space, so the parts' ids joined are the text's."""
    return text.replace("\n", " ").split(" ")


def tokenised(docs: DataFrame, tokenizer_json: str, max_tokens: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, end, step = worker_cache(f"ids of {tokenizer_json}", lambda: word_ids(tokenizer_json)), end_id.to_bytes(4, "little"), 4 * max_tokens
        for f in frames:
            parts, size, begin = [], 0, 0
            texts = [t or "" for t in f["text"]]
            for k, t in enumerate(texts):
                parts.append(word_parts(t))
                size += len(t)
                if size > 1 << 21 or k + 1 == len(texts):
                    rows = []
                    for i, ids in zip(f["id"].iloc[begin : k + 1], cache.ids(parts), strict=True):
                        ids += end
                        for n, a in enumerate(range(0, len(ids), step)):
                            x = ids[a : a + step]
                            rows.append((i, n, a // 4, len(x) // 4, zlib.crc32(x)))
                    yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
                    parts, size, begin = [], 0, k + 1

    bounded_batches(docs.sparkSession)
    return docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], room: int, order: list[int] | None = None) -> list[list[int]]:
    """Bins (of indexes into lengths) by best fit: the fullest bin that has space takes the piece. Longest pieces first
    unless an order is given."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = defaultdict(list)
    spaces: list[int] = []  # sorted, those with bins
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True) if order is None else order:
        n = lengths[i]
        at = bisect.bisect_left(spaces, n)
        if at == len(spaces):
            bins.append([])
            b, left = len(bins) - 1, room - n
        else:
            s = spaces[at]
            b = by_space[s].pop()
            if not by_space[s]:
                del spaces[at]
            left = s - n
        bins[b].append(i)
        if left:
            if not by_space[left]:
                bisect.insort(spaces, left)
            by_space[left].append(b)
    return bins


class _Pool:
    """Pieces that bins offer, by length: of each length present the bins that have one, and a bit for it in a mask,
    so that the longest piece up to a bound is one operation."""

    def __init__(self):
        self.mask, self.bins = 0, defaultdict(Counter)

    def add(self, n: int, b: int) -> None:
        self.bins[n][b] += 1
        self.mask |= 1 << n

    def remove(self, n: int, b: int) -> None:
        own = self.bins[n]
        own[b] -= 1
        if not own[b]:
            del own[b]
            if not own:
                self.mask ^= 1 << n

    def longest(self, most: int) -> int:
        """The greatest length up to most, or 0."""
        return (self.mask & ((1 << most + 1) - 1)).bit_length() - 1 if most > 0 and self.mask else 0

    def some_bin(self, n: int) -> int:
        return next(iter(self.bins[n]))


def _single_swap(lens: list[int], space: int, pool: _Pool) -> tuple[int, list[int], int]:
    """The exchange that fills a bin most by one piece from elsewhere, for none, one or two of its own: gain, own lengths that leave, length that comes."""
    best = (0, [], 0)
    outs = {0: []} | {x: [x] for x in lens}
    for two in (False, True):
        if two:
            outs = {x + y: [x, y] for k, x in enumerate(lens) for y in lens[:k]}
        for out, who in outs.items():
            came = pool.longest(space + out)
            if came - out > best[0]:
                best = (came - out, who, came)
                if best[0] == space:
                    return best
    return best


def _two_for_one(bins: dict[int, list[int]], order: list[int], space: dict[int, int]) -> bool:
    """One pass over the bins, fullest first: two pieces of an emptier bin come for one of a bin's own or for none, the pair that
    fills it most. Whether anything was exchanged."""
    sums: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for b in order:
        lens = sorted(set(bins[b]))
        for k, x in enumerate(lens):
            for y in lens[: k + 1]:
                if x != y or bins[b].count(x) > 1:
                    sums[x + y].append((b, x, y))
    keys = sorted(sums)
    place = {b: k for k, b in enumerate(order)}
    changed = False
    for b in order:
        found = (0, 0, None)
        for out in {0, *bins[b]}:
            k = bisect.bisect_right(keys, space[b] + out) - 1
            while k >= 0 and keys[k] - out > found[0]:
                # only bins that come later are emptier; pairs that have gone are dropped on the way
                live = sums[keys[k]]
                while live and not (place[live[-1][0]] > place[b] and _holds(bins[live[-1][0]], live[-1])):
                    live.pop()
                if live:
                    found = (keys[k] - out, out, live[-1])
                    break
                k -= 1
            if found[0] == space[b]:
                break
        gain, out, pair = found
        if pair:
            a, x, y = pair
            for n in (x, y):
                bins[a].remove(n)
                bins[b].append(n)
            if out:
                bins[b].remove(out)
                bins[a].append(out)
            space[b] -= gain
            space[a] += gain
            changed = True
    return changed


def _holds(lens: list[int], pair: tuple[int, int, int]) -> bool:
    _, x, y = pair
    return lens.count(x) > (x == y) and y in lens


def improve(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    """The bins after swap-based search among all underfull ones, until no exchange raises the sum of squared fills.

    Bins are visited from the fullest on, and take pieces only from bins that are no fuller, so any exchange that makes
    them fuller raises that sum. Full bins and emptied ones take no further part."""
    full, live = [], []
    for b in bins:
        (full if sum(lengths[i] for i in b) == room else live).append(b)
    by_length: dict[int, list[int]] = defaultdict(list)
    for b in live:
        for i in b:
            by_length[lengths[i]].append(i)
    lens = {k: [lengths[i] for i in b] for k, b in enumerate(live)}
    done: list[list[int]] = []
    while True:
        space = {k: room - sum(x) for k, x in lens.items()}
        for k in [k for k, s in space.items() if s in (0, room)]:
            done.append(lens.pop(k))
            del space[k]
        order = sorted(lens, key=lambda k: (space[k], k))
        pool = _Pool()
        for k in order:
            for n in lens[k]:
                pool.add(n, k)
        changed = False
        for b in order:
            own = lens[b]
            for n in own:
                pool.remove(n, b)
            while space[b] and own:
                gain, out, came = _single_swap(own, space[b], pool)
                if not gain:
                    break
                a = pool.some_bin(came)
                pool.remove(came, a)
                lens[a].remove(came)
                for n in out:
                    own.remove(n)
                    lens[a].append(n)
                    pool.add(n, a)
                own.append(came)
                space[b] -= gain
                space[a] += gain
                changed = True
        if not changed:
            order = sorted((k for k in lens if space[k] not in (0, room)), key=lambda k: (space[k], k))
            if not _two_for_one(lens, order, space):
                break
    done += lens.values()
    return full + [[by_length[n].pop() for n in b] for b in done if b]


def pack_block(lengths: list[int], room: int) -> list[list[int]]:
    """Best fit and swaps from the longest pieces on, and from a shuffled order, which leaves more room for swaps. Of these
    the fewer bins stay; then the pieces of the underfull bins, and of as many full ones for variety, are dealt anew in other
    orders, until RESTARTS deals in a row have emptied no bin."""
    rng = random.Random(5)
    by_length = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    fill = lambda b: sum(lengths[i] for i in b)

    def shuffled(who: list[int]) -> list[list[int]]:
        order = sorted(who, key=lengths.__getitem__)
        rng.shuffle(order)
        return improve(best_fit(lengths, room, order), lengths, room)

    best = min((improve(best_fit(lengths, room, by_length), lengths, room), shuffled(by_length)), key=len)
    tries, least = RESTARTS, -(-sum(lengths) // room)
    while tries and len(best) > least:
        full, under = [b for b in best if fill(b) == room], [b for b in best if fill(b) < room]
        rng.shuffle(full)
        mixed, rest = under + full[: len(under)], full[len(under) :]
        again = shuffled([i for b in mixed for i in b])
        tries -= 1
        if len(again) < len(mixed):
            tries = RESTARTS
        if (len(again), -sum(fill(b) ** 2 for b in again)) < (len(mixed), -sum(fill(b) ** 2 for b in mixed)):
            best = rest + again
    return best


def packed(pieces: DataFrame, room: int, block: int = BLOCK) -> DataFrame:
    """pieces (any columns, one of them length) with sequence_id and offset."""
    with scratch(pieces.sparkSession):
        return kept(_packed(pieces.select("*"), room, block))


def _packed(pieces: DataFrame, room: int, block: int) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    done: DataFrame | None = None
    todo, number, last, before = stored(pieces), 0, None, 0
    while True:
        count = todo.count()
        blocks = max(1, math.ceil(count / block))
        final = blocks == 1 or last is not None and count > (1 - LEAST_SAVING) * last
        dealt = todo.withColumn("__b", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns if c != "length"], F.lit(number)), F.lit(blocks)).cast("int"))
        out = stored(dealt.groupBy("__b").applyInPandas(_block_packer(room, before, final), f"{schema}, sequence_id long, offset long"))
        full = out.filter("sequence_id IS NOT NULL")
        done = full if done is None else done.unionByName(full)
        if final:
            return done
        todo, number, last, before = out.filter("sequence_id IS NULL").select(*[F.col(f"`{c}`") for c in pieces.columns]), number + 1, count, before + blocks


def _block_packer(room: int, before: int, final: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sequence ids are (block, bin), with a running number of blocks over all rounds; bins with space get none unless this
    is the last round."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        lengths = f["length"].tolist()
        bins = pack_block(lengths, room)
        seq: list[int | None] = [None] * len(f)
        offset: list[int | None] = [None] * len(f)
        base = before + int(f["__b"].iloc[0]) << 22
        for k, b in enumerate(bins):
            if not final and sum(lengths[i] for i in b) < room:
                continue
            at = 0
            for i in b:
                seq[i], offset[i] = base + k, at
                at += lengths[i]
        f = f.drop(columns="__b")
        f["sequence_id"], f["offset"] = pd.array(seq, "Int64"), pd.array(offset, "Int64")
        return f

    return run


def pack_documents(docs: DataFrame, tokenizer_json: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenised(docs, tokenizer_json, max_tokens, end_id, id_col, text_col)
    return packed(pieces, max_tokens).withColumn("id", id_out()).withColumnRenamed("id", id_col)
