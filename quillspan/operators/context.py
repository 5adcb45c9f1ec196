"""Negative and positive contexts of a span, fallback candidates, weights by context and by score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import contains_any, matches

# Phrases that make a window around a span a negative one.
WINDOW_PHRASES = [
    "not a phone", "not a student", "not an id", "not a pii", "system-generated", "system generated", "permit ref", "fake", "sample", "test token", "placeholder",
    "reference code", "reference number", "ticket", "ticket id", "invoice", "room:", "not staff", "no pii", "dummy", "example email", "demo", "sandbox", "sample email",
    "test page", "training slide", "training data only", "copied from", "checklist", "did not provide", "not provided", "should not be treated", "should not be redacted",
    "not her phone number", "not her date of birth", "not her family contact", "campus helpdesk number", "booking date", "room booking",
]
# Phrases that make a line negative, and words that take a phrase before them back.
LINE_PHRASES = ["sample", "fake", "test", "dummy", "demo", "placeholder", "checklist", "not provided", "helpdesk", "training data"]
TAKEN_BACK = ["but ", "but,", "however", "actually", "the real", "this one", "this number", "this card", "the actual", "actual details", "details below"]
# What a phrase does not count in (e-mail addresses, links and host names, in lower case).
LITERALS = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|https?://[^ \t\r\n]+|\b[a-z0-9.-]+\.(?:com|org|net|edu|gov|au|test)\b"


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Lower-case text from `before` characters in front of a span to `after` behind it."""
    begin = F.greatest(F.lit(0), start - before)
    return F.lower(F.substring(text, begin + 1, end + after - begin))


def window_negative(text: Column, start: Column, end: Column, phrases: list[str] = WINDOW_PHRASES) -> Column:
    return contains_any(around(text, start, end, 80, 20), phrases)


def positive(text: Column, start: Column, end: Column, kind: Column, markers: dict[str, list[str]]) -> Column:
    """Whether a marker of the span's type stands near it; false for types without markers."""
    near, out = around(text, start, end, 120, 20), F.lit(False)
    for name, words in sorted(markers.items()):
        out = F.when(kind == name, contains_any(near, words)).otherwise(out)
    return out


def line_negative(text: Column, start: Column, end: Column, phrases: list[str] = LINE_PHRASES, taken_back: list[str] = TAKEN_BACK) -> Column:
    """Whether a phrase stands on the span's line: in the 20 characters behind it, or in the 120 before it with no word
    after its last place that takes it back. The span's own value and LITERALS don't count."""
    own = F.lower(F.substring(text, start + 1, end - start))
    begin = F.greatest(F.lit(0), start - 120)
    lead = F.lower(F.substring_index(F.substring(text, begin + 1, start - begin), "\n", -1))
    behind = F.lower(F.substring_index(F.substring(text, end + 1, F.lit(20)), "\n", 1))
    at = F.position(own, lead)
    lead = F.when((at > 0) & (F.length(own) > 0), F.overlay(lead, F.lit(""), at, F.length(own))).otherwise(lead)
    lead, behind = (F.regexp_replace(x, LITERALS, " ") for x in (lead, behind))
    # only a phrase whose last place counts is left of the words that take it back
    cut = F.array(*(F.when(F.contains(lead, F.lit(p)), F.substring_index(lead, p, -1)) for p in phrases))
    return contains_any(behind, phrases) | F.exists(cut, lambda tail: tail.isNotNull() & ~contains_any(tail, taken_back))


def fallback(text: Column, patterns: dict[str, str], mode: str = "full_and_regex") -> Column:
    """array<struct<start,end,value,source>> of candidates where no detector found any. Modes: full_only (the text without
    outer white space), regex_only (all matches of the patterns, trimmed), full_and_regex. Of equal places the first stays."""
    if mode not in ("full_only", "regex_only", "full_and_regex"):
        raise ValueError(f"unknown mode {mode}")
    kind = "array<struct<start:int,end:int,value:string,source:string>>"

    def trimmed(value: Column, start: Column, source: str) -> Column:
        body = F.regexp_replace(value, r"^\s+", "")
        bare, begin = F.regexp_replace(body, r"\s+$", ""), start + F.length(value) - F.length(body)
        return F.struct(begin.alias("start"), (begin + F.length(bare)).alias("end"), bare.alias("value"), F.lit(source).alias("source"))

    found = [F.array(trimmed(text, F.lit(0), "fallback_full_input"))] if mode != "regex_only" else []
    if mode != "full_only":
        each = lambda name: lambda m: trimmed(m["value"], m["start"], f"regex_candidate:{name}")
        found += [F.transform(matches(text, p), each(name)) for name, p in patterns.items()]
    spans = F.filter(F.concat(*found) if found else F.array().cast(kind), lambda s: s["end"] > s["start"])
    first = lambda acc, s: F.when(F.exists(acc, lambda x: (x["start"] == s["start"]) & (x["end"] == s["end"])), acc).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(spans.cast(kind), F.array().cast(kind), first)


def context_weight(context: Column, group: Column) -> Column:
    """A row's default weight by its context's type and its ambiguity group."""
    return (
        F.when(context == "hard_negative_context", 0.8).when(context == "reverse_negative_context", 0.5)
        .when(group.startswith("zero_example_"), 0.6).when(context == "strong_positive_context", 0.7).otherwise(0.5)
    )


def sampling_weight(f1: Column) -> Column:
    """Steps by a label's F1: the worse a label is found, the more of it is sampled; a null F1 counts as found well."""
    return F.when(f1 < 0.2, 8.0).when(f1 < 0.4, 5.0).when(f1 < 0.6, 3.0).when(f1 < 0.8, 1.5).otherwise(0.5)
