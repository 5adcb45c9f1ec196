"""Label distributions as map<string,double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a teacher's verdict weighs.
VERDICT_WEIGHTS = {"strong": 3.0, "likely": 1.5, "neutral": 1.0, "unlikely": 0.5, "reject": 0.1}


def ranked(dist: Column) -> Column:
    """Entries by probability, then by label: array<struct<key,value>>."""
    return F.array_sort(F.map_entries(dist), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def top_mass(dist: Column, k: int) -> Column:
    return total(F.transform(F.slice(ranked(dist), 1, k), lambda e: e["value"]))


def uncertainty(dist: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - top_mass(dist, 3))


def entropy_bits(dist: Column) -> Column:
    return F.aggregate(F.map_values(dist), F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def normalised(dist: Column) -> Column:
    s = total(F.map_values(dist))
    return F.transform_values(dist, lambda _, v: F.when(s > 0, v / s).otherwise(0.0))


def from_verdicts(verdicts: Column) -> Column:
    """Distribution of map<label,verdict>: each verdict's weight over their sum; unknown verdicts count as neutral."""
    weights = F.create_map(*[F.lit(x) for pair in VERDICT_WEIGHTS.items() for x in pair])
    return normalised(F.transform_values(verdicts, lambda _, v: F.coalesce(F.try_element_at(weights, v), F.lit(1.0))))


def composite_risk(dist: Column, weights: dict[str, float], default: float = 0.5) -> Column:
    """Sum of p x class weight without NON_PII."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    parts = F.transform(F.filter(F.map_entries(dist), lambda e: e["key"] != "NON_PII"), lambda e: e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(default)))
    return total(parts)
