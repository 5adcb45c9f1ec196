"""The redaction of documents on a stream, and windows over events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import matches
from quillspan.operators.redact import redacted


def redact_stream(docs: DataFrame, rules: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs (batch or streaming) with redacted_text and n_spans; only narrow expressions, so both kinds run the same plan."""
    found = None
    for kind, pattern in rules.items():
        own = F.transform(matches(F.coalesce(F.col(text_col), F.lit("")), pattern), _typed(kind))
        found = own if found is None else F.concat(found, own)
    return docs.withColumn("__s", found).withColumn("redacted_text", redacted(F.coalesce(F.col(text_col), F.lit("")), F.col("__s"))).withColumn("n_spans", F.size("__s")).drop("__s")


def _typed(kind: str):
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("type"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Tumbling counts by event type; on a stream rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
