import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspan.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, pieces, room):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(ids), room)):
            x = ids[a : a + room]
            want.append((i, n, a, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces], key=key) == sorted(want, key=key)
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= room
    return len(bins), -(-sum(r.length for r in pieces) // room)


def test_round_trip_and_fill(spark):
    rng = random.Random(2)
    words = ["the", "Élan,", "don't", "x1y2", "naïve word", "12,5", "ΣΑΣ", "áb", "<|endoftext|>", "tab\tbed", "e", "​z", "İ"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 60, 400]))) + rng.choice(["", "\n", "\r\n x"])) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "the"), (902, "the end"), (902, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, least = checked(rows, P.pack_documents(df, PATH, 128).collect(), 128)
    assert n <= least + 2


def test_rounds_join_the_underfull_bins(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randrange(30, 90)) for i in range(600)], "id long, length long")
    out = P.packed(df, 128, block=40).collect()
    one = len(P.pack_block([r.length for r in out], 128))
    assert len(out) == 600
    assert len({r.sequence_id for r in out}) <= one * 1.06


def test_swaps_empty_a_bin():
    lengths = [6, 5, 4, 3, 6, 6]
    bins = [[0, 3], [1, 2], [4], [5]]  # 9, 9, 6, 6 of 10
    better = P.improve([list(b) for b in bins], lengths, 10)
    fills = [sum(lengths[i] for i in b) for b in better]
    assert sum(f * f for f in fills) > 81 + 81 + 36 + 36 and max(fills) <= 10
    assert sorted(i for b in better for i in b) == list(range(6))


def test_swap_two_for_one():
    lengths = [3, 3, 5, 4]  # bin a: 3 3; bin b: 5 4 of 10
    better = P.improve([[0, 1], [2, 3]], lengths, 10)
    assert sorted(sum(lengths[i] for i in b) for b in better) == [5, 10]
    lengths = [4, 4, 7]  # 7 goes for 4 4 of another bin only as a pair
    better = P.improve([[0, 2], [1]], lengths, 12)
    assert sorted(i for b in better for i in b) == [0, 1, 2]


def subset_fill(lengths, room):
    """Bins filled one after the other as far as any subset of what is left allows."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        reach = {left[0]: (0, None)}
        for n in left[1:]:
            for total in sorted(reach, reverse=True):
                if total + n <= room and total + n not in reach:
                    reach[total + n] = (n, total)
            if room in reach:
                break
        total, gone = max(reach), []
        while reach[total][1] is not None:
            gone.append(reach[total][0])
            total = reach[total][1]
        for n in [total, *gone]:
            left.remove(n)
        bins += 1
    return bins


@pytest.mark.parametrize("low, high", [(300, 900), (400, 800), (350, 1100)])
def test_swaps_are_no_worse_than_filling_by_subsets(low, high):
    rng = random.Random(low)
    lengths = [rng.randrange(low, high) for _ in range(1000)]
    bins = P.pack_block(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(1000))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 2048
    assert len(bins) <= subset_fill(lengths, 2048)


def test_more_than_four_hundred_underfull_bins_meet():
    rng = random.Random(12)
    lengths = [rng.randrange(500, 800) for _ in range(6000)]
    before, bins = P.best_fit(lengths, 2048), P.pack_block(lengths, 2048)
    under = lambda bs: sum(sum(lengths[i] for i in b) < 2048 for b in bs)
    assert under(before) > 1000 and under(bins) < under(before) - 400


def test_every_letter_behind_and_before_punctuation():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    cache = P.WordIds(tokenizer)
    assert cache.direct
    words = [f"a{c}B." for c in map(chr, range(0x110000)) if c.isalpha()]
    words += ["ALİ.", "BELGESİ,", "İ)", "(İ)", "İ'll", "don't", "ΣΑΣ;", "ŉ.", "ǰ,", "ﬁ!", "é́.", "x́,", "١٢.", "a‍b.", "²x,", "ªb.", "ﬀ?"]
    rng = random.Random(3)
    marks = list("aBİß́ΣЯ中९٣'\".,-_)(ǰﬁ²Ⅷ\u200d\u0307\U0001F600")
    words += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 7))) for _ in range(20_000)]
    want = [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    got = list(cache.ids([[w] for w in words]))
    wrong = [w for w, a, b in zip(words, want, got, strict=True) if b != b"".join(v.to_bytes(4, "little") for v in a)]
    assert not wrong


def test_long_words_and_other_columns(spark):
    rows = [(1, "x" * 5000 + " y"), (2, "Ünïcode" * 900), (3, "a.b" * 2000)]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, length int, sequence_id int")
    checked(rows, P.pack_documents(df, PATH, 128).collect(), 128)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_valid(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) for _ in range(500)]
    bins = P.pack_block(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 100


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
