"""Span tables derived from the driver's tables, as DataFrames and as the same thing in SQL.

`gold` and `pred` take an order as a document and its line items as spans, so that matching, overlap and
calibration run on data of the tables' size. `detected` holds spans found in the documents' text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import matches

LABELS = ("EMAIL", "PHONE", "PERSON", "ADDRESS", "TFN")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
CARD = r"[0-9]{16}"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    start = (F.col("l_linenumber") * 12 + F.col("l_partkey") % 9).cast("int")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", F.col("l_linenumber").alias("n"), start.alias("start"), (start + 4 + F.col("l_suppkey") % 13).cast("int").alias("end"),
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 5 + 1).cast("int")).alias("label"), ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7) % 97 / 97.0).alias("confidence"),
    )


def gold(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n, start, end, label: distinct within a document by n."""
    return _spans(spark, d).filter("l_partkey % 8 <> 0").select("doc_id", "n", "start", "end", "label")


def pred(spark: SparkSession, d: str) -> DataFrame:
    """The same spans seen by a detector that misses, shifts and mislabels some, with confidences."""
    s = _spans(spark, d).filter("l_partkey % 10 <> 1")
    shift = F.when(F.col("l_partkey") % 4 == 0, (F.col("l_suppkey") % 3).cast("int")).otherwise(0)
    label = F.when(F.col("l_partkey") % 7 == 0, F.lit("PERSON")).otherwise(F.col("label"))
    source = F.when(F.col("l_partkey") % 6 == 0, "rule").otherwise("model")
    return s.select("doc_id", "n", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), label.alias("label"), "confidence", source.alias("source"))


SQL = """
raw_spans AS (SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber AS n, CAST(l_linenumber*12 + l_partkey%9 AS INT) AS s,
  CAST(l_linenumber*12 + l_partkey%9 + 4 + l_suppkey%13 AS INT) AS e, ['EMAIL','PHONE','PERSON','ADDRESS','TFN'][CAST(l_partkey%5+1 AS INT)] AS label,
  ((l_partkey*31 + l_suppkey*7) % 97) / 97.0::DOUBLE AS confidence FROM lineitem),
gold AS (SELECT doc_id, n, s, e, label FROM raw_spans WHERE l_partkey % 8 <> 0),
pred AS (SELECT doc_id, n, s + CASE WHEN l_partkey%4=0 THEN CAST(l_suppkey%3 AS INT) ELSE 0 END AS s, e + CASE WHEN l_partkey%4=0 THEN CAST(l_suppkey%3 AS INT) ELSE 0 END AS e,
  CASE WHEN l_partkey%7=0 THEN 'PERSON' ELSE label END AS label, confidence, CASE WHEN l_partkey%6=0 THEN 'rule' ELSE 'model' END AS source FROM raw_spans WHERE l_partkey % 10 <> 1)
"""


def arrays(spans: DataFrame) -> DataFrame:
    """doc_id, spans: array of start, end, type, confidence, source, n."""
    conf = F.col("confidence") if "confidence" in spans.columns else F.lit(None).cast("double")
    source = F.col("source") if "source" in spans.columns else F.lit("model")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.col("label").alias("type"), conf.alias("confidence"), source.alias("source"), "n")).alias("spans"))


def detected(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, spans of documents: e-mails, IPv4 addresses and card-like numbers with offsets."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    def typed(kind: str, pattern: str, confidence: float):
        return F.transform(matches(F.col("text"), pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("type"), m["value"].alias("value"), F.lit(confidence).alias("confidence"), F.lit("rule").alias("source")))

    found = [typed(*x) for x in (("EMAIL", EMAIL, 1.0), ("IP", IPV4, 0.8), ("CARD", CARD, 0.9))]
    # the cheap test spares texts without a digit or an @ the three passes
    return docs.withColumn("spans", F.when(F.col("text").rlike("[0-9@]"), F.concat(*found)).otherwise(F.filter(found[0], lambda _: F.lit(False))))


def _sql_matches(kind: str, pattern: str, conf: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS type, {conf}::DOUBLE AS confidence, m[i] AS value,
  CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS s
  FROM (SELECT doc_id, m, p, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM documents WHERE text IS NOT NULL) WHERE len(m) > 0)"""


SQL_DETECTED = "found AS (SELECT doc_id, type, confidence, value, s, CAST(s + length(value) AS INT) AS e FROM (" + " UNION ALL ".join(_sql_matches(*x) for x in (("EMAIL", EMAIL, "1.0"), ("IP", IPV4, "0.8"), ("CARD", CARD, "0.9"))) + "))"
