"""Typing of spans: deterministic rescue, prefix stripping, verifier gates and verdicts, confidences, sampling, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import digits, left_context, matches

# Rules of the deterministic rescue in order (name, pattern, type, needed word, decision).
RESCUE = [
    ("bsb_format", r"\b[0-9]{3}[-\s]?[0-9]{3}\b", "BANK_ACCOUNT_NUMBER", "bsb", "redact"),
    ("account_number", r"(?i)\b(?:account|acct)\s*(?:number\s*)?(?:#\s*)?[0-9]{6,12}\b", "BANK_ACCOUNT_NUMBER", None, "redact"),
    ("email_full", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL_ADDRESS", None, "redact"),
    ("au_mobile", r"\b04[0-9]{2}\s?[0-9]{3}\s?[0-9]{3}\b", "MOBILE", None, "redact"),
    ("vehicle_rego", r"(?i)\b(?:rego|reg\.?|registration)\s*(?:#\s*|number\s*)?[A-Z0-9]{4,8}\b", "VEHICLE_REGO", None, "review"),
    ("number_plate", r"\b[A-Z]{1,3}[0-9]{3}[A-Z]?\b", "NUMBER_PLATE", None, "review"),
]
#: Words that stand before a value and are no part of it.
PREFIXES = {
    "DATE_OF_BIRTH": r"d\.?\s*o\.?\s*b\.?|date\s+of\s+birth|born", "AU_TFN": r"t\.?\s*f\.?\s*n\.?|tax\s+file\s+number",
    "STUDENT_ID": r"id", "CENTRELINK_REFERENCE_NUMBER": r"crn|centrelink(?:\s+reference(?:\s+number)?)?",
}


def rescued(text: Column, s: Column, line_negative: Column, window_negative: Column) -> Column:
    """struct<rule,type,decision,risk> after the first rescue rule whose pattern is in the value, or in the window of 150
    characters before and 20 behind at a place that overlaps the span; null if none. A negative line ignores, a negative window reviews."""
    begin = F.greatest(F.lit(0), s["start"] - 150)
    window = F.substring(text, begin + 1, s["end"] + 20 - begin)
    out = F.lit(None)
    for name, pattern, kind, word, decision in reversed(RESCUE):
        here = lambda m: (begin + m["start"] < s["end"]) & (begin + m["end"] > s["start"])
        hit = s["value"].rlike(pattern) | (window.rlike(pattern) & F.exists(matches(window, pattern), here))
        if word:
            hit = hit & F.contains(F.lower(window), F.lit(word))
        d = F.when(line_negative, "ignore").when(window_negative, "review").otherwise(decision)
        risk = F.when(line_negative, 0.0).when(window_negative, 0.20).when(F.lit(decision) == "redact", 0.85).otherwise(0.25)
        out = F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("type"), d.alias("decision"), risk.alias("risk"))).otherwise(out)
    return out


def stripped(kind: Column, value: Column) -> Column:
    """value without the words that name its type, as often as they stand there; null if nothing is left."""
    out = value
    for label, words in PREFIXES.items():
        out = F.when(kind == label, F.regexp_replace(value, rf"(?i)^(?:(?:{words})\s*[:=\-]?\s+)+", "")).otherwise(out)
    return F.nullif(F.trim(out), F.lit(""))


def trimmed(s: Column) -> Column:
    """Span without white space at its value's ends; offsets move along."""
    left = F.length(s["value"]) - F.length(F.ltrim(s["value"]))
    right = F.length(s["value"]) - F.length(F.rtrim(s["value"]))
    return s.withField("start", (s["start"] + left).cast("int")).withField("end", (s["end"] - right).cast("int")).withField("value", F.trim(s["value"]))


def general_type(text: Column, kind: Column, start: Column) -> Column:
    """WORK_ types without a word of work before them become the plain type."""
    work = left_context(text, start, 48).rlike(r"\b(?:work|office|business|employer)\b")
    return F.when(kind.startswith("WORK_") & ~work, F.regexp_replace(kind, "^WORK_", "")).otherwise(kind)


def verifier_candidates(spans: DataFrame, types: list[str], most: int, max_confidence: float = 0.9) -> DataFrame:
    """Of each document the first spans, by place, of risky types or low confidence: a costly model sees no more."""
    risky = spans.filter(F.col("label").isin(types) | (F.col("confidence") < max_confidence))
    w = Window.partitionBy("doc_id").orderBy("start", "end", "label", "n")
    return risky.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).drop("__rn")


def verdict(decision: Column, non_pii: Column, wrong_type: Column) -> Column:
    return F.when(non_pii >= 0.70, "ignore").when(wrong_type >= 0.80, "review").otherwise(decision)


def span_confidence(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans with the exponential of the mean log probability of the tokens (doc_id, start, end, logprob) they overlap."""
    t = tokens.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"), "logprob")
    both = spans.join(t, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left")
    return both.groupBy(*spans.columns).agg(F.exp(F.avg("logprob")).alias("span_confidence"))


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by the smallest -log(u) / weight with u from a hash of key and seed."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return df.filter(F.col(weight) > 0).withColumn("__k", -F.log(u) / F.col(weight)).orderBy("__k", key).limit(n).drop("__k")


def located(text: Column, value: Column) -> Column:
    """First place of value in text; struct<start,end,found>. Not found: place 0, as a teacher's row keeps its text."""
    at = F.call_function("locate", value, text)
    found = at > 0
    start = F.when(found, at - 1).otherwise(0)
    return F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), found.alias("found"))


def surface_violation(kind: Column, value: Column) -> Column:
    """Name of what a value lacks for its type, null if it has the type's form."""
    d = F.length(digits(value))
    return (
        F.when((kind == "EMAIL") & ~value.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), "email_form")
        .when((kind == "AU_TFN") & ~d.isin(8, 9), "tfn_digits")
        .when((kind == "MEDICARE_NUMBER") & ~d.isin(10, 11), "medicare_digits")
        .when((kind == "PHONE") & ~d.between(8, 15), "phone_digits")
        .when((kind == "LATITUDE") & ~F.coalesce(value.try_cast("double").between(-90, 90), F.lit(False)), "latitude_range")
        .when((kind == "LONGITUDE") & ~F.coalesce(value.try_cast("double").between(-180, 180), F.lit(False)), "longitude_range")
        .when(kind.endswith("_EXPIRY") & ~value.rlike(r"[/-]"), "expiry_separator")
        .when(kind.endswith("_ID") & value.rlike(r"(?i)@|https?://"), "id_with_address")
    )


def sft_rows(docs: DataFrame, system: str, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """messages: system, user (the text) and assistant (the spans as JSON) of each document."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    answer = F.to_json(F.struct(F.transform(spans_col, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")))
    return docs.withColumn("messages", F.array(turn("system", F.lit(system)), turn("user", F.col(text_col)), turn("assistant", answer)))


def valid_predictions(docs: DataFrame, labels: list[str], id_col: str = "doc_id", text_col: str = "text", json_col: str = "output") -> DataFrame:
    """id, type, start, end, value, status of predicted spans in JSON: ok, unknown_type, out_of_range or value_reset (the value
    is then what the offsets say); equal ones count once."""
    schema = "struct<spans:array<struct<type:string,start:int,end:int,value:string>>>"
    x = docs.select(id_col, text_col, F.explode(F.from_json(json_col, schema)["spans"]).alias("s")).select(id_col, text_col, "s.*")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length(text_col))
    own = F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start"))
    status = F.when(~F.coalesce(F.col("type").isin(labels), F.lit(False)), "unknown_type").when(~F.coalesce(inside, F.lit(False)), "out_of_range").when(~own.eqNullSafe(F.col("value")), "value_reset").otherwise("ok")
    return x.withColumn("status", status).withColumn("value", F.when(F.col("status") == "value_reset", own).otherwise(F.col("value"))).drop(text_col).distinct()
