"""Data preparation: records, weights, label maps, validation, splits, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def training_weight(confidence: Column, rule_verified: Column) -> Column:
    """0.8 from a confidence of 0.85 on, below that 0.4 + 0.4 x its share of 0.85; verified by a rule 0.2 more, 1 at most."""
    base = F.when(confidence >= 0.85, 0.8).otherwise(0.4 + 0.4 * confidence / 0.85)
    return F.when(rule_verified, F.least(F.lit(1.0), base + 0.2)).otherwise(base)


def group_split(key: Column, train: int = 80, dev: int = 10) -> Column:
    """Split of a key by the first 32 bits of its SHA-256, so that one key is in one split."""
    b = F.pmod(F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(100))
    return F.when(b < train, "train").when(b < train + dev, "dev").otherwise("test")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same each time: those with the least hash of key and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def remap(dist: DataFrame, alias: DataFrame, key: str = "id") -> DataFrame:
    """id, label, p with labels by alias (raw, canonical); the mass of labels that become one is added."""
    out = dist.join(F.broadcast(alias), dist["label"] == alias["raw"], "left").withColumn("label", F.coalesce("canonical", "label"))
    return out.groupBy(key, "label").agg(F.sum("p").alias("p"))


def alias_map(raw: DataFrame, canonical: DataFrame, overrides: DataFrame) -> DataFrame:
    """raw labels with their canonical one and how it was found: exact, normalised, override or unmapped."""
    code = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    names = canonical.select(F.col("label").alias("c"))
    a = raw.join(F.broadcast(names.withColumnRenamed("c", "exact")), F.col("raw") == F.col("exact"), "left")
    by_code = names.groupBy(code(F.col("c")).alias("k")).agg(F.min("c").alias("norm"))
    a = a.join(F.broadcast(by_code), code(F.col("raw")) == F.col("k"), "left").join(F.broadcast(overrides.select(F.col("raw").alias("o"), F.col("label").alias("over"))), F.col("raw") == F.col("o"), "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("norm").isNotNull(), "normalised").when(F.col("over").isNotNull(), "override").otherwise("unmapped")
    return a.select("raw", F.coalesce("exact", "norm", "over").alias("canonical"), how.alias("how"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order; dropDuplicates would take any."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def span_errors(text: Column, start: Column, end: Column, value: Column) -> Column:
    """Names of what is wrong with a span, empty if nothing."""
    tests = [("range", ~((start >= 0) & (start < end) & (end <= F.length(text)))), ("value", F.substring(text, start + 1, end - start) != value), ("empty", F.trim(value) == "")]
    return F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of each group; Spark keeps only k for each group before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")


def pooled(vectors: Column, how: str = "mean") -> Column:
    """Of an array of equally long vectors the mean, first or last."""
    if how != "mean":
        return F.element_at(vectors, 1 if how == "first" else -1)
    zero = F.transform(F.element_at(vectors, 1), lambda x: x.cast("double") * 0)
    return F.transform(F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)), lambda x: x / F.size(vectors))
