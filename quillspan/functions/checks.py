"""Checksums and shapes of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import digits

#: Weights of the tax file number and of the Medicare number.
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)


def digit_list(d: Column) -> Column:
    return F.transform(F.filter(F.split(d, ""), lambda c: c != ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))


def weighted(d: Column, weights: tuple[int, ...]) -> Column:
    pairs = F.zip_with(F.slice(digit_list(d), 1, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def is_card(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def is_tfn(value: Column) -> Column:
    d = digits(value)
    return F.length(d).isin(8, 9) & (F.pmod(weighted(d, TFN_WEIGHTS), F.lit(11)) == 0) & (F.length(d) == 9)


def is_medicare(value: Column) -> Column:
    """Ten or eleven digits, the first 2 to 6, the ninth the weighted sum of the first eight modulo ten."""
    d = digits(value)
    return F.length(d).isin(10, 11) & F.substring(d, 1, 1).between("2", "6") & (F.pmod(weighted(F.substring(d, 1, 8), MEDICARE_WEIGHTS), F.lit(10)) == F.substring(d, 9, 1).try_cast("int"))


def is_bsb(value: Column) -> Column:
    return F.length(digits(value)) == 6


def is_ipv4(value: Column) -> Column:
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")


def is_private_ipv4(value: Column) -> Column:
    return is_ipv4(value) & value.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|127\.|169\.254\.)")


def is_email(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def is_date(value: Column) -> Column:
    return value.rlike(r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{2}|[0-9]{4})$")


def format_candidates(value: Column) -> Column:
    """Labels that a value's shape allows, in a fixed order, always with NON_PII."""
    rules = [
        ("EMAIL_ADDRESS", is_email(value)), ("IP_ADDRESS", is_ipv4(value)), ("PAYMENT_CARD_NUMBER", is_card(value)), ("AU_TFN", is_tfn(value)),
        ("MEDICARE_NUMBER", is_medicare(value)), ("BSB", is_bsb(value) & value.rlike("^[0-9 -]+$")), ("DATE", is_date(value)),
        ("PHONE", value.rlike(r"^\+?[0-9][0-9 ()-]+$") & F.length(digits(value)).between(8, 15)),
    ]
    return F.concat(*[F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for name, test in rules], F.array(F.lit("NON_PII")))
