"""Overlap policies over an array of span structs with start, end, type and confidence.

Each is a fold over the sorted array inside one expression, so a document's spans stay in one row and
nothing is shuffled. They differ in order and in what a conflict does; `POLICIES` names them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = Callable[[Column], list[Column]]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by(spans: Column, key: Key) -> Column:
    """spans sorted by ascending keys."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for x, y in reversed(list(zip(key(a), key(b), strict=True))):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return F.array_sort(spans, compare)


def _conf(s: Column) -> Column:
    return F.coalesce(s["confidence"], F.lit(0.0))


def _length(s: Column) -> Column:
    return s["end"] - s["start"]


def _empty(spans: Column) -> Column:
    return F.filter(spans, lambda _: F.lit(False))


def keep_first(spans: Column, key: Key, same_label: bool = False) -> Column:
    """In order, a span stays if it overlaps none that stays."""

    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: overlaps(k, s) & ((k["type"] == s["type"]) if same_label else F.lit(True)))
        return F.when(clash, kept).otherwise(F.array_append(kept, s))

    return F.aggregate(by(spans, key), _empty(spans), step)


def serving(spans: Column) -> Column:
    """Rules before models, then by start, longer, type. In conflict with the first such span that stays, a span takes its
    place only if strictly more confident. After that, kept spans can overlap each other."""
    order = by(spans, lambda s: [F.when(s["source"] == "rule", 0).otherwise(1), s["start"], -_length(s), s["type"]])

    def step(kept: Column, s: Column) -> Column:
        hit = F.transform(kept, lambda k: overlaps(k, s))
        at = F.array_position(hit, F.lit(True))
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (_conf(s) > _conf(k)), s).otherwise(k))
        return F.when(at == 0, F.array_append(kept, s)).otherwise(swapped)

    return F.aggregate(order, _empty(spans), step)


def longest_first(spans: Column) -> Column:
    return keep_first(spans, lambda s: [s["start"], -_length(s), s["type"]])


def confident_first(spans: Column) -> Column:
    return keep_first(spans, lambda s: [-_conf(s), -_length(s), s["start"], s["type"]])


def ranked_first(spans: Column, rank: dict[str, int]) -> Column:
    """By the class rank of the type, confidence, length, start, type."""
    table = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    return keep_first(spans, lambda s: [-F.coalesce(F.try_element_at(table, s["type"]), F.lit(0)), -_conf(s), -_length(s), s["start"], s["type"]])


def per_label(spans: Column) -> Column:
    return keep_first(spans, lambda s: [s["type"], s["start"], -_length(s)], same_label=True)


def cursor(spans: Column) -> Column:
    """Left to right: a span stays if it begins at or after the end of the last that stayed."""
    order = by(spans, lambda s: [s["start"], s["end"], s["type"]])
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(order, _empty(spans), lambda kept, s: F.when(s["start"] >= last(kept), F.array_append(kept, s)).otherwise(kept))


POLICIES: dict[str, Callable[[Column], Column]] = {"serving": serving, "longest_first": longest_first, "confident_first": confident_first, "per_label": per_label, "cursor": cursor}


def merged_intervals(spans: DataFrame, *keys: str) -> DataFrame:
    """Union of touching or overlapping spans of each key: keys, start, end, n."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("__isle", isle).groupBy(*keys, "__isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("__isle")


def covered_length(targets: DataFrame, cover: DataFrame, key: str = "doc_id") -> DataFrame:
    """targets with `covered`: characters of each target inside the union of the key's cover spans."""
    union = merged_intervals(cover.select(key, "start", "end"), key).select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    clip = F.greatest(F.lit(0), F.least("end", "__e") - F.greatest("start", "__s"))
    joined = targets.join(union, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left")
    return joined.groupBy(*targets.columns).agg(F.coalesce(F.sum(clip), F.lit(0)).cast("long").alias("covered"))
