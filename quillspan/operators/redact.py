"""Decisions from policies, redaction of text, response payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision(confidence: Column, high: Column, low: Column) -> Column:
    """Two thresholds, exchanged if inverted."""
    top, bottom = F.greatest(high, low), F.least(high, low)
    return F.when(confidence >= top, "AUTO_REDACT").when(confidence >= bottom, "REVIEW").when(confidence.isNotNull(), "PASS")


def applied_policy(suppressed: Column, reason: Column, own: Column, by_confidence: Column, action: Column, default: str) -> Column:
    """Precedence: suppressed, a decision that has its reason, redact or review, confidence, the type's action, the default."""
    return F.when(suppressed, "ignore").when(reason.isNotNull() & own.isNotNull(), own).when(own.isin("redact", "review"), own).otherwise(F.coalesce(by_confidence, action, F.lit(default)))


def is_redacted(d: Column) -> Column:
    return d.isin("redact", "AUTO_REDACT")


def safety_decision(line_negative: Column, source: Column, top1: Column, top3: Column, non_pii: Column, window_negative: Column, positive: Column, risk: Column, threshold: Column) -> Column:
    """Guards in order; the first that holds decides: struct<decision,reason,risk>. threshold: of the label, may be null."""
    review = F.greatest(risk, F.lit(0.25))
    rules = [
        (line_negative, "ignore", "line_local_negative_context", F.lit(0.0)),
        (source == "full_input", "review", "fallback_analysis_review", review),
        (non_pii >= 0.85, "ignore", "non_pii_high", F.lit(0.0)),
        ((source == "broad_regex") & ~positive & (top1 < 0.20), "ignore", "broad_regex_without_positive_context", F.lit(0.0)),
        (window_negative & ~positive & (top1 < 0.70), "ignore", "negative_context_without_positive_context", F.lit(0.0)),
        (~positive & (top1 < 0.20), "ignore", "low_evidence_without_positive_context", F.lit(0.0)),
        (non_pii >= 0.50, "review", "safety_review_non_pii_uncertain", review),
        (threshold.isNotNull() & (top1 < threshold), "review", "low_pii_evidence_per_label", review),
        ((top1 < 0.20) & (top3 < 0.40), "review", "low_pii_evidence", review),
        (window_negative & (top1 < 0.70), "review", "negative_context_uncertain", review),
        (risk >= 0.25, "review", "high_top3_uncertainty_risk", risk),
    ]
    row = lambda d, r, x: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"), x.cast("double").alias("risk"))
    out = row("redact", "low_top3_uncertainty_risk", risk)
    for test, d, r, x in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), row(d, r, x)).otherwise(out)
    return out


def redacted(text: Column, spans: Column, mode: str = "tag") -> Column:
    """text without its spans' values: `tag` puts [TYPE], `mask` one * for a character, `remove` nothing, `label` <TYPE>.
    Spans need no order; one that begins before the end of the last is skipped."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    put = {"tag": lambda s: F.concat(F.lit("["), s["type"], F.lit("]")), "label": lambda s: F.concat(F.lit("<"), s["type"], F.lit(">")), "mask": lambda s: F.repeat(F.lit("*"), s["end"] - s["start"]), "remove": lambda s: F.lit("")}[mode]
    pieces = F.aggregate(
        order,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put(s)).alias("out"))).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, pieces).otherwise(text)


def response(docs: DataFrame, id_col: str, redacted_col: str, spans_col: str) -> DataFrame:
    """One JSON payload for each document: visible spans (not PASS) without their values."""
    shown = F.transform(F.filter(F.col(spans_col), lambda s: s["decision"] != "PASS"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["decision"].alias("decision")))
    return docs.select(id_col, F.to_json(F.struct(F.col(redacted_col).alias("redacted_text"), F.size(shown).alias("span_count"), shown.alias("spans"))).alias("payload"))
