"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned on their normalised text with splitters that Spark samples
(repartitionByRange), sorted externally within each partition, and equal neighbours are compared in
full by the sort-based window that runs over that order; no second exchange moves the text. A
splitter holds the text's first 64 characters and a hash of the whole, so that the sample that the
driver gathers has rows of bounded size; the sort and the comparison take the whole text.

A text with more rows than half a partition's share is hot. There are at most 2 x partitions such
texts, so their hashes fit a broadcast of known size. Rows of a hot text get a salt from their id
and lie in several neighbouring runs; the runs' summaries (one row for each run) are then joined by
SHA-256 of the text. The hash serves only to find hot texts: a collision makes another text
salted too, and changes no result.

Defined results: null text counts as empty; empty texts equal each other; of rows with equal text
the smallest (or largest) id stays, a null id loses to any other, and of rows that repeat the same
id and text one stays. Other columns are carried by `drop_exact_duplicates` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import partitions, text_or_empty

ROW, TEXT, HASH, SALT, HEAD = "__row", "__text", "__hash", "__salt", "__head"
SPLITTER_CHARS = 64


def _runs(rows: DataFrame, keep: str) -> DataFrame:
    """rows: __row struct with field id, __text. Adds __salt (null unless hot), __rn, __keep and __size of the run."""
    p = partitions(rows.sparkSession)
    rows = rows.withColumn(HASH, F.xxhash64(TEXT))
    counts = rows.groupBy(HASH).count()
    total = rows.select(F.count(F.lit(1)).alias("total"))
    hot = counts.join(F.broadcast(total), F.col("count") > F.col("total") / (2 * p)).filter("count > 64").select(HASH, F.lit(True).alias("__hot"))
    salted = rows.join(F.broadcast(hot), HASH, "left").withColumn(SALT, F.when(F.col("__hot"), F.pmod(F.xxhash64(F.col(f"{ROW}.id"), F.lit(7)), F.lit(4 * p)))).drop("__hot")
    # head and hash follow from the text, so rows of one text and salt meet, and the window needs no exchange
    run = Window.partitionBy(HEAD, HASH, SALT, TEXT)
    best = F.col(f"{ROW}.id").asc_nulls_last() if keep == "smallest" else F.col(f"{ROW}.id").desc_nulls_last()
    return (
        salted.withColumn(HEAD, F.substring(TEXT, 1, SPLITTER_CHARS)).repartitionByRange(HEAD, HASH, SALT)
        .withColumn("__rn", F.row_number().over(run.orderBy(best)))
        .withColumn("__keep", F.first(f"{ROW}.id").over(run.orderBy(best)))
        .withColumn("__size", F.count(F.lit(1)).over(run))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Column | None = None) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256 of the normalised text.
    normalise: an expression for the text to compare (default: the text itself, null as empty)."""
    text = text_or_empty(text_col) if normalise is None else F.coalesce(normalise, F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias(ROW), text.alias(TEXT))
    runs = _runs(rows, keep).select(F.col(f"{ROW}.id").alias("id"), SALT, "__rn", "__keep", "__size", F.sha2(TEXT, 256).alias("sha"))
    cold = runs.filter(F.col(SALT).isNull()).select("id", F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("__rn") == 1).alias("kept"), "sha")
    salted = runs.filter(F.col(SALT).isNotNull())
    pick = F.min if keep == "smallest" else F.max
    groups = salted.filter("__rn = 1").groupBy("sha").agg(pick("__keep").alias("keep_id"), F.sum("__size").alias("group_size"), F.min(SALT).alias("first_salt"))
    # equal ids share a salt, so the winner's run holds every row of the winning id
    wins = (F.col("__rn") == 1) & F.when(F.col("keep_id").isNull(), F.col(SALT) == F.col("first_salt")).otherwise(F.col("id") == F.col("keep_id"))
    hot = salted.join(F.broadcast(groups), "sha").select("id", "keep_id", "group_size", F.coalesce(wins, F.lit(False)).alias("kept"), "sha")
    return cold.unionByName(hot).select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows whose text another row keeps; all columns stay as they are."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")).alias(ROW), text_or_empty(text_col).alias(TEXT))
    first = _runs(rows, keep).filter("__rn = 1")
    cold = first.filter(F.col(SALT).isNull()).select(ROW)
    best = F.col(f"{ROW}.id").asc_nulls_last() if keep == "smallest" else F.col(f"{ROW}.id").desc_nulls_last()
    hot = first.filter(F.col(SALT).isNotNull()).withColumn("__rn", F.row_number().over(Window.partitionBy(F.sha2(TEXT, 256)).orderBy(best))).filter("__rn = 1").select(ROW)
    return cold.unionByName(hot).select(f"{ROW}.all.*")
