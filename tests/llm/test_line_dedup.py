import os
import random
import re
from collections import Counter

from quillspan.llm import line_dedup as L


def plain_lines(html):
    t = re.sub(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ", html or "")
    t = re.sub(r"(?i)</?(?:p|div|br|li|h1)(?:\\s[^>]*)?/?>", "\n", t)
    t = re.sub(r"<[^>]*>", "", t).replace("&lt;", "<").replace("&amp;", "&")
    return [x for x in (re.sub(r"[ \t\r]+", " ", x).strip(" ") for x in t.split("\n")) if x]


def brute(rows, ratio=0.3, least=4):
    host = lambda u: (re.match(r"[a-z]+://([^/?#:]+)", (u or "").lower()) or [None, ""])[1]
    pages, seen = Counter(), Counter()
    for _, u, html in rows:
        pages[host(u)] += 1
        seen.update((host(u), x) for x in set(plain_lines(html)))
    out = []
    for i, u, html in rows:
        h, lines = host(u), plain_lines(html)
        good = [x for x in lines if not (pages[h] >= least and seen[h, x] >= 2 and seen[h, x] > ratio * pages[h])]
        out.append((i, h, pages[h], len(lines), len(lines) - len(good), "\n".join(good)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r) for r in L.strip_boilerplate(df).collect()), key=key) == sorted(brute(rows), key=key)


def test_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        h = rng.choice(["a.org"] * 6 + ["b.com", "c.net", f"s{i}.io"])
        body = "".join(f"<p class=x>{rng.choice(['text', 'more', 'own'])} {rng.randrange(60)}</p>" for _ in range(rng.randrange(6)))
        nav = "<div>Home &amp; Go</div><br/>" if rng.random() < 0.6 else "<!-- x --><script>no()</script>"
        rows.append((i, f"https://{h.upper() if i % 5 == 0 else h}/p/{i}?q", nav + body + "<li>foot  er</li>" * (i % 3)))
    check(spark, rows)


def test_odd_rows(spark):
    same = (7, "http://h.org/a", "<p>one</p><p>two</p>")
    rows = [(1, None, "<p>a</p>"), (2, "not a url", None), (3, "http://h.org", ""), (None, "http://h.org/x", "<p>one</p>"), same, same, same, (8, "http://h.org/b", "<p>long " + "w " * 200_000 + "</p><p>one</p>")]
    check(spark, rows)


def test_empty_table(spark):
    assert L.strip_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_stored_tables_are_small(spark, tmp_path, monkeypatch):
    """Lines and result lie on the disk at once beside their shuffle, so each must be well under its plain size."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(2000)]
    rows = [(i, f"http://h{i % 9}.org/{i}", "".join(f"<p>{' '.join(rng.choices(words, k=30))}</p>" for _ in range(20))) for i in range(1000)]
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    ratios, real = {}, L.stored

    def ratio(name, df):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        ratios[name] = size(df) / size(spark.read.parquet(str(tmp_path / name)))
        return df

    monkeypatch.setattr(L, "stored", lambda df, *a: ratio("lines", real(df, *a)) if "lines" in df.columns else real(df, *a))
    ratio("result", L.strip_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)))
    assert len(ratios) == 2 and max(ratios.values()) < 0.75, ratios
