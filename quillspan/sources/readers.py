"""Readers and writers of the engine's files; schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import schemas


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines of a file, glob or folder, gzip included; blank lines are skipped. strict: a malformed line fails and names its file."""
    df = spark.read.schema(schema + ("" if strict else ", _corrupt string")).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df if strict else df.withColumn("_file", F.col("_metadata.file_path"))


def raw_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of one nested corpus object: id, metadata, text, labels, hard_negatives."""
    df = spark.read.schema(schemas.RAW_CORPUS).option("multiLine", True).json(path).select(F.explode("records").alias("r"))
    df = df.select("r.id", F.col("r.input.metadata").alias("metadata"), F.col("r.positive_sample.text").alias("text"), F.col("r.positive_sample.labels").alias("labels"), F.col("r.hard_negatives").alias("hard_negatives"))
    return df.limit(limit) if limit else df


def hard_negatives(records: DataFrame) -> DataFrame:
    """Documents without spans from the records' hard negatives, with ids <id>-HN-01, -02, ..."""
    x = records.select("id", F.posexplode("hard_negatives").alias("k", "h"))
    return x.select(F.concat("id", F.format_string("-HN-%02d", F.col("k") + 1)).alias("id"), "h.text", "h.note")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy CSV (a byte-order mark is dropped): label code, classification, category; the first of equal names counts."""
    from quillspan.functions.text import label_code
    from quillspan.operators.prep import first_of

    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip().lower().replace(" ", "_") for c in df.columns]).withColumn("_pos", F.monotonically_increasing_id())
    return first_of(df.withColumn("label", label_code(F.col("name"))).filter("label <> ''"), ["label"], ["_pos"])


def span_map(column: Column, with_value: bool = True) -> Column:
    """array<struct<label,start,end>> of map<"LABEL: value" or "LABEL", [[start, end], ...]>."""
    label = lambda k: F.split_part(k, F.lit(": "), F.lit(1)) if with_value else k
    return F.flatten(F.transform(F.map_entries(column), lambda e: F.transform(e["value"], lambda x: F.struct(label(e["key"]).alias("label"), x[0].alias("start"), x[1].alias("end")))))


def to_span_map(spans: Column) -> Column:
    """map<label, [[start, end], ...]> of an array of structs, labels in order."""
    labels = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
    return F.map_from_entries(F.transform(labels, lambda x: F.struct(x, F.transform(F.filter(spans, lambda s: s["label"] == x), lambda s: F.array(s["start"], s["end"])))))


def transcript(text: Column) -> Column:
    """Turns of a chat transcript: array<struct<role,start,end,text>>; a turn begins with `user: ` or `assistant: ` on a new line."""
    from quillspan.functions.text import matches

    heads = matches(text, r"(?m)^(?:user|assistant): ")
    return F.transform(heads, lambda h, i: F.struct(F.split_part(h["value"], F.lit(":"), F.lit(1)).alias("role"), h["end"].alias("start"), F.coalesce(F.try_element_at(heads, i + 2)["start"] - 1, F.length(text)).alias("end"), F.substring(text, h["end"] + 1, F.coalesce(F.try_element_at(heads, i + 2)["start"] - 1, F.length(text)) - h["end"]).alias("text")))


def decode_bytes(content: bytes | None) -> str | None:
    """Text of bytes: UTF-8 with or without a byte-order mark, else Windows-1252, else Latin-1."""
    if content is None:
        return None
    for name in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def decoded_upload(content: Column, limit: int | None = None) -> Column:
    """struct<text,truncated> of uploaded bytes; Spark's own decode has no Windows-1252, so an Arrow function does it."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(decode_bytes)

    text = F.pandas_udf(run, "string")(content)
    return F.struct((F.substring(text, 1, limit) if limit else text).alias("text"), (F.length(text) > limit if limit else F.lit(False)).alias("truncated"))


def append_pending(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the Parquet table at path doesn't have yet; a run that broke off goes on where it stopped."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    n = df.count()
    df.write.mode("append").parquet(path)
    return n
