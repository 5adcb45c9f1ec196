"""Near-duplicate documents with HyperMinHash registers, banding, an estimate and a full check.

1. Sketch: the distinct 64-bit hashes of a document's word shingles; the hash's top bits name one of
   128 buckets, and of each bucket's smallest hash the count of leading zeros (6 bits) and the next 10
   bits are kept. Empty buckets take the register of another bucket in an order fixed by the empty
   bucket (dense registers keep the collision probability equal to the Jaccard similarity).
2. Classes: documents with equal shingle sets (128-bit digest of the sorted set) are one class; only
   its smallest id, the representative, goes on. Thousands of copies cost one row.
3. Bands of 4 registers are hashed; sharing one makes two representatives candidates. At similarity
   0.85 a pair shares none of 32 bands with probability (1 - 0.85^4)^32 < 1e-10.
4. Within a band's group no pairs are listed: each member is paired with the group's pivot, the member
   that shares most bands with others. Candidates pass the size bound (the similarity is at most the
   ratio of sizes) and the collision-corrected estimate (rejected only below a Hoeffding bound of
   1e-9), then the whole sets are compared.
5. Links form components by min-label propagation with pointer jumping over stored tables.
6. The exact rest: in a group that now spans more than one component, members outside the pivot's
   component can still be linked with members of other components (pairs within a component can't
   change it). Those pairs come from a prefix filter over whole sets: in one order of all shingles,
   rare ones first, two sets with enough in common share a shingle among the first of both, early
   enough for the rest to suffice. Any order is right; a count table of fixed size makes it a good
   one. Copies that differ too much from one another share common shingles only, late in that
   order, so a large group of them yields few pairs. What passes is compared in full.
   No link between different texts is lost, and a group of near copies costs one pair for each member.

Defined results: null text and text without words have no shingles, are linked with nothing and are
kept. A null id is kept, without a component. Rows that repeat an id are one node of the graph, with
the links of all their texts. Very long texts are read whole; columns other than id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import drop_caches, id_in, id_out, kept, scratch, stored, unique_join

REGISTERS, BAND, MANTISSA = 128, 4, 10
#: Entries of the table of shingle counts that orders shingles by rarity.
COUNTS = 1 << 18
LOG_DOUBT = float(-np.log(1e-9) / 2)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words_per: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles: ASCII lower case, words parted by ASCII white space.
    With fewer words than words_per the whole sequence is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(words_per, len(words))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
        h ^= h >> np.uint64(29)
    return np.unique(mix64(h))


def _borrow_orders(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def registers(s: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, int]:
    """HyperMinHash registers of a sorted set of hashes, and how many buckets had a hash of their own."""
    bits = REGISTERS.bit_length() - 1
    bucket = (s >> np.uint64(64 - bits)).astype(np.int64)
    own, first = np.unique(bucket, return_index=True)
    rest = s[first] << np.uint64(bits)
    top = np.frexp(np.maximum(rest, 1).astype(np.float64))[1].astype(np.int64) - 1
    # rounding to float can lift an all-ones value to the next power of two
    top = np.minimum(top - ((rest >> np.minimum(top, 63).astype(np.uint64)) == 0), 63)
    zeros = np.minimum(63 - top, 63)
    after = np.where(top >= MANTISSA, rest >> np.maximum(top - MANTISSA, 0).astype(np.uint64), rest << np.maximum(MANTISSA - top, 0).astype(np.uint64))
    value = (zeros.astype(np.uint16) << MANTISSA) | (after & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    out = np.zeros(REGISTERS, np.uint16)
    out[own] = value
    if len(own) < REGISTERS:
        has = np.zeros(REGISTERS, bool)
        has[own] = True
        empty = np.flatnonzero(~has)
        lent = orders[empty, has[orders[empty]].argmax(axis=1)]
        out[empty] = out[lent]
    return out, len(own)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the collisions expected of independent sets of n and m members."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    expected = 0.169919487159739093975315012348 * 2.0 ** (REGISTERS.bit_length() - 1 - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    same = (a == b).sum(axis=1)
    return np.where(same == REGISTERS, 1.0, np.maximum(same - expected, 0) / REGISTERS)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 5, with_text: bool = False) -> DataFrame:
    """id, n (size of the shingle set), digest, regs, own and, if asked for, text of each row; digest, regs and own are null for an empty set."""
    carried = ["id", "text"] if with_text else ["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_caches()
        orders = _borrow_orders()
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingle_set(text, words_per)
                if len(s):
                    regs, own = registers(s, orders)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), regs.tobytes(), own))
                else:
                    rows.append((0, None, None, 0))
            yield pd.concat([b[carried], pd.DataFrame(rows, columns=["n", "digest", "regs", "own"], index=b.index)], axis=1)

    return docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, ", ".join([f"{c} {'long' if c == 'id' else 'string'}" for c in carried] + ["n long, digest binary, regs binary, own int"])).withColumn("id", id_out())


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the size bound and the estimate can't reject."""
    ra, rb = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("own").alias(f"o{x}")) for x in "ab")
    both = pairs.join(ra, "a").join(rb, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                doubt = np.sqrt(LOG_DOUBT / np.maximum(np.minimum(p["oa"], p["ob"]).to_numpy(), 1))
                yield p.loc[estimate(x, y, p["na"].to_numpy(), p["nb"].to_numpy()) >= percent / 100 - doubt, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, percent: int, words_per: int) -> DataFrame:
    """Pairs whose whole sets have 100 * intersection >= percent * union."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, None
        for p in batches:
            good = []
            for ta, tb in zip(p["ta"], p["tb"], strict=True):
                if tb is None or tb != last:
                    last, last_set = tb, shingle_set(tb, words_per)
                s = shingle_set(ta, words_per)
                same = len(np.intersect1d(s, last_set, assume_unique=True))
                good.append(same > 0 and 100 * same >= percent * (len(s) + len(last_set) - same))
            yield p.loc[good, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long").distinct()


def _rarity(texts: DataFrame, words_per: int) -> np.ndarray:
    """How many of the texts have a shingle of each of COUNTS hash values. Tasks give their non-zero counts as rows, which Spark adds up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(COUNTS, np.int64)
        for b in batches:
            for t in b["text"]:
                np.add.at(table, (shingle_set(t, words_per) % np.uint64(COUNTS)).astype(np.int64), 1)
        at = np.flatnonzero(table)
        yield pd.DataFrame({"bucket": at, "n": table[at]})

    found = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTS, np.int64)
    table[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return table


def _rest(sides: DataFrame, texts: DataFrame, percent: int, words_per: int) -> DataFrame:
    """Pairs (a, b) of different components, one of them at least apart, that a prefix filter over whole sets can't rule
    out. sides: id, comp, apart."""
    rows = stored(texts.join(sides, "id"))
    rarity = _rarity(rows, words_per)

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for i, comp, apart, t in zip(f["id"], f["comp"], f["apart"], f["text"], strict=True):
                s = shingle_set(t, words_per)
                n = len(s)
                if n:
                    first = n - -(-percent * n // 100) + 1
                    s = s[np.lexsort((s, rarity[(s % np.uint64(COUNTS)).astype(np.int64)]))][:first]
                    out.append(pd.DataFrame({"shingle": s.view(np.int64), "id": i, "comp": comp, "apart": apart, "n": n, "left": n - np.arange(len(s))}))
            if out:
                yield pd.concat(out, ignore_index=True)

    found = rows.select("id", "comp", "apart", "text").mapInPandas(prefix, "shingle long, id long, comp long, apart boolean, n long, left long")
    a, b = (found.select("shingle", *[F.col(c).alias(x + c) for c in ("id", "comp", "apart", "n", "left")]) for x in "ab")
    both = a.filter("aapart").join(b, "shingle").filter(f"acomp <> bcomp AND 100 * least(an, bn) >= {percent} * greatest(an, bn) AND {100 + percent} * least(aleft, bleft) >= {percent} * (an + bn)")
    return both.select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b")).distinct()


def components(links: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(id, comp): the smallest id that links (a, b) reach, for each id that has a link.
    Each round takes the least label of all neighbours, then the label of the label. first: labels so far."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp"))
    if first is not None:
        nodes = nodes.unionByName(first).groupBy("id").agg(F.min("comp").alias("comp"))
    labels = stored(nodes)
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        # a label's own node learns of the smaller label as well, so components merge in few rounds
        hooked = labels.join(near, "id", "left").withColumn("new", F.least("comp", "m"))
        told = hooked.filter("new < comp").groupBy(F.col("comp").alias("id")).agg(F.min("new").alias("t"))
        hooked = hooked.join(told, "id", "left").select("id", F.col("comp").alias("old"), F.least("new", "t").alias("comp"))
        hooked = stored(hooked)
        up = hooked.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        # a large component's label is a key of many rows
        after = stored(unique_join(hooked, up, "comp", "id").select("id", F.least("comp", "up").alias("comp"), "old"))
        if after.filter("comp < old").isEmpty():
            return after.select("id", "comp")
        labels = after.select("id", "comp")


def _classes(sk: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of sketches with ids and shingles: classes of equal sets with a unique number each (id, digest, n, regs, own), and the
    links (a, b) between classes that repeated ids make (None if no id repeats with another text).

    A class's number is its smallest id. An id with several texts counts for the class of its smallest digest only; a
    class left without an id gets a number beyond all ids, which can't become a component's smallest."""
    several = stored(sk.groupBy("id").agg(F.min("digest").alias("own_digest"), F.max("digest").alias("last")).filter("own_digest < last").select("id", "own_digest"))
    first = [F.first(c).alias(c) for c in ("n", "regs", "own")]
    if several.isEmpty():
        return sk.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *first), None
    rows = sk.join(several, "id", "left").withColumn("counts", F.when(F.col("own_digest").isNull() | (F.col("own_digest") == F.col("digest")), F.col("id")))
    most = sk.agg(F.max("id").alias("most"))
    number = F.coalesce("id", F.col("most") + 1 + F.monotonically_increasing_id())
    classes = stored(rows.groupBy("digest").agg(F.min("counts").alias("id"), F.count(F.lit(1)).alias("copies"), *first).crossJoin(F.broadcast(most)).withColumn("id", number).drop("most"))
    mine = classes.select("digest", F.col("id").alias("b"))
    links = rows.filter("own_digest IS NOT NULL").select("digest", "own_digest").distinct().join(mine, "digest").join(classes.select(F.col("digest").alias("own_digest"), F.col("id").alias("a")), "own_digest")
    return classes, links.filter("a <> b").select("a", "b").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words_per: int = 5) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept. Linked: 100 * intersection >= percent * union."""
    with scratch(docs.sparkSession):
        return kept(_near_groups(docs, id_col, text_col, percent, words_per))


def _near_groups(docs: DataFrame, id_col: str, text_col: str, percent: int, words_per: int) -> DataFrame:
    all_sk = stored(sketches(docs, id_col, text_col, words_per))
    classes, repeats = _classes(all_sk.filter("n > 0 AND id IS NOT NULL"))
    reps = stored(classes)
    width = 2 * BAND
    key = F.expr(f"explode(transform(sequence(0, {REGISTERS // BAND - 1}), i -> xxhash64(i, substring(regs, i * {width} + 1, {width}))))")
    bands = reps.select("id", key.alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "size")
    members = stored(bands.join(shared, "key").distinct())
    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    pivots = members.join(score, "id").groupBy("key").agg(F.max(F.struct("score", -F.col("id"))).alias("top")).select("key", (-F.col("top.col2")).alias("pivot"))
    grouped = stored(members.select("key", "id").join(pivots, "key"))
    star = stored(_likely(grouped.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), reps, percent))
    # whole texts of the classes that some band pairs with another, one row of each class; a later step may need any of them
    wanted = members.select("id").distinct()
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if repeats is None:
        texts = stored(plain.join(wanted, "id", "left_semi"))
    else:
        # with repeated ids a row is known by its id and digest
        digests = sketches(docs, id_col, text_col, words_per, True).filter("n > 0 AND id IS NOT NULL").select("digest", "text")
        texts = stored(digests.join(reps.join(wanted, "id").select("digest", "id"), "digest").groupBy("id").agg(F.min("text").alias("text")))
    links = _links(star, texts, percent, words_per)
    links = stored(links if repeats is None else links.unionByName(repeats))
    comp = components(links)
    labelled = stored(unique_join(grouped, comp, "id", "key").withColumn("comp", F.coalesce("comp", "id")))
    of_pivot = labelled.filter("id = pivot").select("key", F.col("comp").alias("pcomp"))
    groups = labelled.join(of_pivot, "key").withColumn("apart", F.col("comp") != F.col("pcomp"))
    split = groups.filter("apart").select("key").distinct()
    sides = stored(groups.join(split, "key", "left_semi").groupBy("id").agg(F.max("comp").alias("comp"), F.max("apart").alias("apart")))
    if not sides.isEmpty():
        more = stored(_links(_rest(sides, texts, percent, words_per), texts, percent, words_per))
        if not more.isEmpty():
            comp = components(more.unionByName(links), comp)
    by_digest = reps.select("digest", F.col("id").alias("rep")).join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    out = unique_join(all_sk.select("id", "n", "digest"), by_digest, "digest", "id")
    comp_id = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    if repeats is not None:
        # a row without words can share its id with rows that have some
        least = out.groupBy("id").agg(F.min("comp").alias("least"))
        out, comp_id = unique_join(out, least, "id", "n"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    out = out.select("id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words_per: int = 5) -> DataFrame:
    """docs with one document of each near-duplicate group; all columns stay as they are."""
    gone = near_groups(docs, id_col, text_col, percent, words_per).filter("NOT kept").select(F.col(id_col).cast("long").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
