import re

import pytest

from quillspan.llm import surrogates as S

KEY = b"k"
TEXT = 'Mail Ann.Lee@mail.example.com or ann.lee@MAIL.example.com, call +1 (403) 555-9312 or +1 403-555-9312, pay 4111 1111 1111 1111, host 10.1.2.3 and 8.8.4.4, token = "1beb58b8af68854f0e01" password=7602ad27cf5550de1c by Frau Anna Müller and Dr. Hans Иванов.'


@pytest.mark.parametrize("n", [2, 3, 10, 26, 100, 257])
def test_permutation(n):
    assert sorted(S.permute(KEY, "t", x, n) for x in range(n)) == list(range(n))


def test_types_formats_and_coreference():
    new, spans = S.replaced(TEXT, KEY)
    kinds = [s["type"] for s in spans]
    assert kinds == ["EMAIL", "EMAIL", "PHONE", "PHONE", "CARD", "IP", "IP", "SECRET", "SECRET", "NAME", "NAME", "NAME", "NAME"]
    by = [s["surrogate"] for s in spans]
    assert all(new[s["start"] : s["end"]] == s["surrogate"] for s in spans)
    assert by[0].lower() == by[1].lower() and spans[0]["entity"] == spans[1]["entity"]
    assert re.sub(r"\D", "", by[2]) == re.sub(r"\D", "", by[3]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[2])
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", by[4]) and S.luhn(by[4].replace(" ", "")) % 10 == 0
    assert by[5].startswith("10.") and not by[6].startswith("10.")
    assert re.fullmatch("[0-9a-f]{20}", by[7])
    assert by[9] in S.FEMALE and by[11] in S.MALE
    assert re.fullmatch("[A-Z][a-zà-ÿß][a-z]{4}|[A-Z].{5}", by[10]) and re.fullmatch("[А-Я][а-я]{5}", by[12])
    for s, original in zip(spans, re.findall(r"Ann.Lee@\S+com", TEXT)):
        assert original not in new
    assert [s["type"] for s in S.replaced(new, KEY)[1]] == kinds


def test_distinct_within_and_between_documents(spark):
    rows = [(i, f"x a{i}@e.org y 10.0.{i // 200}.{i % 200} z +49 30 {1000 + i} {2000 + i}") for i in range(400)] + [(900, rows_again) for rows_again in ("a7@e.org", "a7@e.org")]
    out = S.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), KEY)
    assert S.collisions(out).count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert got[900].text in got[7].text


def test_clash_in_a_document_takes_another_round():
    first = S.surrogate("IP", "9.9.9.9", KEY)
    new, spans = S.replaced(f"9.9.9.9 and {first}", KEY)
    assert len({s["surrogate"] for s in spans}) == 2 and first not in new and "9.9.9.9" not in new


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "nothing"), (None, "b@c.de"), (4, "word " * 50_000 + "b@c.de"), (5, "1.2.3 4.5.6.7.8 12345 user@ @x"), (6, "9" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = {r.doc_id: r for r in S.with_surrogates(df, KEY).collect()}
    assert got[1].text is None and got[2].text == "" and got[3].n_entities == 0
    assert got[None].n_entities == got[4].n_entities == 1 and got[4].text.endswith(got[None].text)
    assert got[5].n_entities == 0 and len(got[6].text) == 5000
    assert S.with_surrogates(df.limit(0), KEY).collect() == []


def test_spellings_of_secrets():
    value = "9233A8EC77D01B2F"
    for lead in ('TOKEN = "', "Password: ", 'export API_KEY="', '{"secret":"', "{'api-key' : '", "PASSWD=", "token="):
        assert [(lead + value)[a:z] for a, z, k in S.entities(lead + value) if k == "SECRET"] == [value], lead
    assert [s["type"] for s in S.replaced("token=some.long.name@mail.example.com", KEY)[1]] == ["EMAIL"]


def test_texts_that_hold_no_digit():
    for text in ("passwd=CorrectHorse", "AKIA" + "ABCDEFGH" * 2, "ghp_" + "abcdef" * 5, "sk-" + "abcde" * 4, "M. Dupont arrive"):
        assert S.entities(text), text


def test_later_mentions_of_a_name():
    text = "Dr Anna Schmidt called. Schmidt said that Anna's car, a Schmidt-Benz, is Mr Lee's. Lee knows. Schmidts mail: x.Schmidt@mail.example.com"
    new, spans = S.replaced(text, KEY)
    by = {}
    for s in spans:
        by.setdefault(s["entity"], set()).add(s["surrogate"])
    assert all(len(v) == 1 for v in by.values())
    assert [s["type"] for s in spans] == ["NAME"] * 7 + ["EMAIL"]
    assert "Schmidt " not in new and "Anna" not in new and "Lee" not in new and "Schmidt-" not in new and "Schmidts mail" in new
    assert all(new[s["start"] : s["end"]] == s["surrogate"] for s in spans)
    assert "and Mr" in S.replaced("Mr and Mrs Lee, he and Mr Poe", KEY)[0]


@pytest.mark.parametrize("kind", ["NAME", "EMAIL"])
def test_formats_that_a_document_uses_up(kind):
    low = "abcdefghijklmnopqrstuvwxyz"
    real = {
        "NAME": S.FEMALE + S.MALE,
        "EMAIL": [f"{a}@{b}.de" for a in low for b in low],
    }[kind]
    text = " ; ".join(("Dr " if kind == "NAME" else "") + x for x in real)
    new = [s["surrogate"] for s in S.replaced(text, KEY)[1]]
    assert len(new) == len(set(new)) == len(real) and not set(new) & set(real)
