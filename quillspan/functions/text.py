"""Scalar text functions over columns: contexts, normalisation, offsets of matches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of a pattern that never matches empty. The i-th start is the length of all parts
    between matches so far plus the matches before it; sizes are code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    starts = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["b"])).alias("start"), (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, starts).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def left_context(text: Column, start: Column, chars: int) -> Column:
    begin = F.greatest(F.lit(0), start - chars)
    return F.lower(F.substring(text, begin + 1, start - begin))


def window_context(text: Column, start: Column, end: Column, chars: int) -> Column:
    begin = F.greatest(F.lit(0), start - chars)
    return F.lower(F.substring(text, begin + 1, end + chars - begin))


def line_prefix(text: Column, start: Column) -> Column:
    return F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)


def line_context(text: Column, start: Column, end: Column) -> Column:
    """The lines that hold a span, lower case."""
    return F.lower(F.concat(line_prefix(text, start), F.substring(text, start + 1, end - start), F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)))


def _any_of(markers: list[str]) -> str:
    return "|".join("\\Q" + m + "\\E" for m in markers)


def contains_any(context: Column, markers: list[str]) -> Column:
    """One pattern for all markers: a chain of tests would repeat the context's expression for each."""
    return context.rlike(_any_of(markers))


def after_reset(context: Column, markers: list[str]) -> Column:
    """What stands after the last of the markers; all of it without one."""
    return F.regexp_replace(context, f"(?is)^.*(?:{_any_of(markers)})", "")


def collapsed(text: Column) -> Column:
    """Near-duplicate key: lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def nfc(text: Column) -> Column:
    """Unicode normal form C; no Spark built-in has it."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return F.pandas_udf(run, "string")(text)


def cleaned_lines(text: Column) -> Column:
    """Text recognition clean-up: white space collapsed in lines, lines of mostly symbols dropped, blank lines squeezed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    symbols = lambda x: F.length(F.regexp_replace(x, r"[A-Za-z0-9\s]", ""))
    kept = F.filter(lines, lambda x: (x == "") | (2 * symbols(x) <= F.length(x)))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def normalised_value(kind: Column, value: Column) -> Column:
    """Value for comparison by type: digits only for number types, else lower case, plain dashes, collapsed white space."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), "[‐‑‒–—−]", "-"), r"\s+", " "))
    return F.when(kind.isin("PHONE", "CARD", "ACCOUNT"), digits(value)).otherwise(plain)


def label_code(name: Column) -> Column:
    """Canonical label of a display name."""
    return F.trim(F.regexp_replace(F.upper(name), r"[^A-Z0-9]+", "_"), F.lit("_"))
