import random

from quillspan.llm import decontaminate as D

ITEM = "A train leaves Boston at 9 and travels 120 km in 3 hours toward the old harbour, while Alice walks 4 km. How long does Alice walk?"
SAME = "some words before it. " + ITEM + " and after"
OTHER = ITEM.replace("120", "75").replace("Alice", "Marie").replace("Boston", "Lyon").replace("3 hours", "7 minutes")
# the second Alice has become another name than the first, so windows with both break
MIXED = "while Alice walks 4 km. how long does the Bob walk"


def brute(text, item, window=8):
    """Whether a window of the item's words is in the text, either with a one-to-one change of its slots (numbers, units,
    names; a capitalised word that begins a sentence is read both ways) or, with few other words, as it is."""

    def words(t):
        """(core, kinds it can be read as) of each word."""
        out, begins = [], True
        for line in (t or "").replace("\t", " ").replace("\r", " ").split("\n"):
            begins = True
            for w in line.split(" "):
                core = D._OUTER.sub("", w)
                if w and D._WORD.search(core):
                    low = core.lower()
                    if D.NUMBER.match(low):
                        kinds = ["<n>"]
                    elif low in D.UNITS:
                        kinds = ["<u>"]
                    elif core[0].isupper() and core != core.upper():
                        kinds = [low, "<c>"] if begins else ["<c>"]
                    else:
                        kinds = [low]
                    out.append((low, kinds))
                if w:
                    begins = w[-1] in ".!?:;…" or w.rstrip("\"')]")[-1:] in (".", "!", "?")
        return out

    a, b = words(item), words(text)
    n = min(window, len(a))
    for p in range(len(a) - n + 1):
        for way in (0, -1) if n >= D.MIN_ITEM else ():
            own = [(low, kinds[way]) for low, kinds in a[p : p + n]]
            few = sum(k[0] != "<" for _, k in own) < min(D.LITERALS, n)
            if few and way:
                continue
            for q in range(len(b) - n + 1):
                there = b[q : q + n]
                if few:
                    if [x for x, _ in own] == [y for y, _ in there]:
                        return True
                    continue
                for read in (0, -1):
                    if [k for _, k in own] == [kinds[read] for _, kinds in there]:
                        pairs = {(x, y) for (x, k), (y, _) in zip(own, there) if k[0] == "<"}
                        if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                            return True
    return False


def test_copies_and_changed_slots(spark):
    docs = spark.createDataFrame([(1, SAME), (2, OTHER), (3, "nothing of the sort " * 30), (4, None), (5, ""), (None, ITEM), (6, "word " * 30_000 + ITEM), (6, SAME)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, None), (None, ITEM), (12, "too short"), (13, "five words are just enough")], "item_id long, text string")
    got = sorted(((r.doc_id or -1), r.item_id, r.exact) for r in D.contaminated(docs, bench).collect())
    assert got == [(-1, 10, True), (1, 10, True), (2, 10, False), (6, 10, True), (6, 10, True)]
    kept = D.drop_contaminated(docs.selectExpr("doc_id", "text", "1 AS item_id"), bench)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_slots_must_be_consistent():
    items = D.Items([(1, "pay 5 now and then pay 5 later on")], 8)
    assert D.match("pay 7 now and then pay 7 later on", D.word_codes(), items)
    assert not D.match("pay 7 now and then pay 8 later on", D.word_codes(), items)


def test_against_brute_force():
    rng = random.Random(8)
    vocab = ["the", "cat", "ran", "12", "7", "Anna", "Bob", "km", "end.", "to", "go"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(4, 14)))) for k in range(25)]
    found = D.Items(items, 8)
    for _ in range(150):
        text = " ".join(rng.choice(vocab) for _ in range(10))
        base = rng.choice(items)[1].split()
        text += " " + " ".join(rng.choice(["9", w]) if w == "12" else rng.choice([w, w, w, w, "go"]) for w in base) + " " + " ".join(rng.choice(vocab) for _ in range(5))
        got = {m[0] for m in D.match(text, D.word_codes(), found)}
        assert got == {k for k, t in items if brute(text, t)}


def test_windows_of_few_literal_words_match_as_they_are():
    texts = ["Compute 12 x 34 + 56 - 78 / 9", "1 2 3 4 5 6 7 8 9 10", "pay 5 Euro am Montag", "Der Hund Der Kater Das Haus Die Maus Ein Tag"]
    items = D.Items(list(enumerate(texts)), 8)
    for k, t in enumerate(texts):
        assert [m[0] for m in D.match("so it goes: " + t + " and on", D.word_codes(), items)] == [k]
    assert not D.match("1 2 3 4 5 6 8 7 9 10 and compute 12 x 34 + 56 - 78 / 7", D.word_codes(), items)


def test_names_that_begin_a_sentence():
    items = D.Items([(1, "Tom has 3 apples and buys 4 more"), (2, "every day Tom has 3 pears and buys 4 more of them")], 8)
    found = lambda t: [m[0] for m in D.match(t, D.word_codes(), items)]
    assert found("Well. Anna has 5 apples and buys 7 more") == [1]
    assert found("Today Anna has 5 apples and buys 7 more") == [1]
    assert found("Well. Anna has 5 apples and buys 5 more") == []


def test_scripts_without_spaces():
    items = D.Items([(1, "小明有三个苹果他又买了四个苹果请问他现在一共有多少个苹果呢"), (2, "太郎は三つのりんごを持っています")], 8)
    assert [m[0] for m in D.match("问题：小明有三个苹果他又买了四个苹果请问他现在一共有多少个苹果呢？答案", D.word_codes(), items)] == [1]
    assert not D.match("小明有三个梨子", D.word_codes(), items)


def test_equal_items_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, SAME, 3, "k")], "doc_id long, text string, item int, id string")
    bench = spark.createDataFrame([(1, ITEM, 9), (2, ITEM, 9), (2, ITEM, 9)], "item_id long, text string, doc_id int")
    assert sorted(r.item_id for r in D.contaminated(docs, bench).collect()) == [1, 2, 2]
    assert D.drop_contaminated(docs, bench).columns == docs.columns


def test_parts_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_WINDOWS", 10)
    docs = spark.createDataFrame([(1, SAME), (2, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"{k} " + ITEM) for k in range(5)], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 5
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, SAME)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 0 and D.drop_contaminated(docs, bench).count() == 1
    assert D.contaminated(docs.limit(0), bench).count() == 0
