"""Detection, overlap and redaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import checks, text
from quillspan.operators import overlap, redact
from quillspan.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _flat(df, spans="spans"):
    return df.select("doc_id", F.explode(spans).alias("x")).select("doc_id", "x.start", "x.end", "x.type", "x.n")


def recursive(order: str, step: str, partition: str = "doc_id", only: str = "") -> str:
    """SQL of a fold: spans of a document in order; state `kept` is a list of structs with s, e, label, confidence, n."""
    return f"""WITH RECURSIVE {fx.SQL},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rn FROM pred {only}),
  fold(doc_id, grp, rn, kept) AS (
    SELECT doc_id, CAST({partition.split(",")[-1].strip()} AS VARCHAR), rn, [struct_pack(s := s, e := e, label := label, confidence := confidence, n := n)] FROM ranked WHERE rn = 1
    UNION ALL
    SELECT f.doc_id, f.grp, r.rn, {step} FROM fold f JOIN ranked r ON r.doc_id = f.doc_id AND CAST({"r." + partition.split(",")[-1].strip()} AS VARCHAR) = f.grp AND r.rn = f.rn + 1)
  SELECT doc_id, k.s AS "start", k.e AS "end", k.label AS type, k.n AS n
  FROM (SELECT doc_id, unnest(kept) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY rn DESC) AS last FROM fold) WHERE last = 1)"""


_NEW = "struct_pack(s := r.s, e := r.e, label := r.label, confidence := r.confidence, n := r.n)"
_KEEP = f"CASE WHEN len(list_filter(f.kept, lambda k: k.s < r.e AND r.s < k.e)) = 0 THEN list_append(f.kept, {_NEW}) ELSE f.kept END"
_CURSOR = f"CASE WHEN r.s >= f.kept[-1].e THEN list_append(f.kept, {_NEW}) ELSE f.kept END"
_HIT = "list_position(list_transform(f.kept, lambda k: k.s < r.e AND r.s < k.e), true)"
_SERVE = f"""CASE WHEN coalesce({_HIT}, 0) = 0 THEN list_append(f.kept, {_NEW})
  WHEN r.confidence > f.kept[{_HIT}].confidence THEN f.kept[1:{_HIT}-1] || [{_NEW}] || f.kept[{_HIT}+1:] ELSE f.kept END"""
RANK = {"TFN": 3, "EMAIL": 2, "PHONE": 2, "PERSON": 1}
_RANK_SQL = "CASE label WHEN 'TFN' THEN 3 WHEN 'EMAIL' THEN 2 WHEN 'PHONE' THEN 2 WHEN 'PERSON' THEN 1 ELSE 0 END"


@query("ovl_01_serving", recursive("CASE WHEN source='rule' THEN 0 ELSE 1 END, s, e - s DESC, label", _SERVE))
def ovl_01(spark, d):
    return _flat(fx.arrays(fx.pred(spark, d)).select("doc_id", overlap.serving(F.col("spans")).alias("spans")))


@query("ovl_02_longest_first", recursive("s, e - s DESC, label", _KEEP))
def ovl_02(spark, d):
    return _flat(fx.arrays(fx.pred(spark, d)).select("doc_id", overlap.longest_first(F.col("spans")).alias("spans")))


@query("ovl_03_confident_first", recursive("confidence DESC, e - s DESC, s, label", _KEEP))
def ovl_03(spark, d):
    return _flat(fx.arrays(fx.pred(spark, d)).select("doc_id", overlap.confident_first(F.col("spans")).alias("spans")))


@query("ovl_04_ranked_first", recursive(f"{_RANK_SQL} DESC, confidence DESC, e - s DESC, s, label", _KEEP))
def ovl_04(spark, d):
    return _flat(fx.arrays(fx.pred(spark, d)).select("doc_id", overlap.ranked_first(F.col("spans"), RANK).alias("spans")))


@query("ovl_05_per_label", recursive("s, e - s DESC", _KEEP, "doc_id, label"))
def ovl_05(spark, d):
    return _flat(fx.arrays(fx.pred(spark, d)).select("doc_id", overlap.per_label(F.col("spans")).alias("spans")))


@query("ovl_06_cursor", recursive("s, e, label", _CURSOR))
def ovl_06(spark, d):
    return _flat(fx.arrays(fx.pred(spark, d)).select("doc_id", overlap.cursor(F.col("spans")).alias("spans")))


_CONF = recursive("confidence DESC, e - s DESC, s, label", _KEEP, only="WHERE source = 'model'")


@query("ovl_07_decoded_confidence", _CONF)
def ovl_07(spark, d):
    return _flat(fx.arrays(fx.pred(spark, d).filter("source = 'model'")).select("doc_id", overlap.confident_first(F.col("spans")).alias("spans")))


_ISLES = """isles AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle
  FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pred)),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e, count(*) AS n FROM isles GROUP BY doc_id, isle)"""


@query("ovl_08_merged_intervals", f"""WITH {fx.SQL}, {_ISLES} SELECT doc_id, s AS "start", e AS "end", n FROM merged""")
def ovl_08(spark, d):
    return overlap.merged_intervals(fx.pred(spark, d).select("doc_id", "start", "end"), "doc_id")


@query("ovl_09_covered_length", f"""WITH {fx.SQL}, {_ISLES} SELECT g.doc_id, g.n, g.s AS "start", g.e AS "end", g.label,
  CAST(coalesce(sum(greatest(0, least(g.e, m.e) - greatest(g.s, m.s))), 0) AS BIGINT) AS covered FROM gold g LEFT JOIN merged m ON m.doc_id = g.doc_id AND g.s < m.e AND m.s < g.e GROUP BY 1, 2, 3, 4, 5""")
def ovl_09(spark, d):
    return overlap.covered_length(fx.gold(spark, d), fx.pred(spark, d))


@query("ovl_10_overlap_counts", f"""WITH {fx.SQL} SELECT a.doc_id, count(*) AS n_overlaps FROM pred a JOIN pred b ON a.doc_id = b.doc_id AND a.n < b.n AND a.s < b.e AND b.s < a.e GROUP BY a.doc_id""")
def ovl_10(spark, d):
    a = fx.pred(spark, d).select("doc_id", "n", "start", "end")
    b = a.select(F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, (F.col("doc_id") == F.col("d2")) & (F.col("n") < F.col("n2")) & (F.col("start") < F.col("e2")) & (F.col("s2") < F.col("end"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_overlaps"))


@query("det_01_candidates", f'WITH {fx.SQL_DETECTED} SELECT doc_id, s AS "start", e AS "end", type, value FROM found')
def det_01(spark, d):
    return fx.detected(spark, d).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.start", "x.end", "x.type", "x.value")


@query("det_02_fallback", f"WITH {fx.SQL_DETECTED} SELECT doc_id, CAST(0 AS INT) AS \"start\", CAST(length(text) AS INT) AS \"end\", 'full_input' AS source FROM documents d WHERE text IS NOT NULL AND trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id)")
def det_02(spark, d):
    return fx.detected(spark, d).filter((F.size("spans") == 0) & (F.trim("text") != "")).select("doc_id", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("full_input").alias("source"))


@query("ctx_14_checked_candidates", f"""WITH {fx.SQL_DETECTED},
  card AS (SELECT *, list_sum(list_transform(generate_series(1, length(value)), lambda i: CASE WHEN (length(value) - i) % 2 = 0 THEN CAST(value[i] AS INT) WHEN CAST(value[i] AS INT) < 5 THEN 2*CAST(value[i] AS INT) ELSE 2*CAST(value[i] AS INT) - 9 END)) AS luhn FROM found WHERE type = 'CARD')
  SELECT doc_id, s AS "start", type, luhn % 10 = 0 AS valid FROM card
  UNION ALL SELECT doc_id, s, type, list_max(list_transform(string_split(value, '.'), lambda x: TRY_CAST(x AS INT))) <= 255 AND NOT regexp_matches(value, '(^|[.])0[0-9]') FROM found WHERE type = 'IP'
  UNION ALL SELECT doc_id, s, type, true FROM found WHERE type = 'EMAIL'""")
def ctx_14(spark, d):
    x = fx.detected(spark, d).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")
    valid = F.when(F.col("type") == "CARD", checks.is_card(F.col("value"))).when(F.col("type") == "IP", checks.is_ipv4(F.col("value"))).otherwise(checks.is_email(F.col("value")))
    return x.select("doc_id", "start", "type", valid.alias("valid"))


@query("ctx_01_left_context", f"""WITH {fx.SQL_DETECTED} SELECT f.doc_id, f.s AS "start", lower(substr(text, greatest(0, s - 48) + 1, s - greatest(0, s - 48))) AS left_context,
  lower(substr(text, greatest(0, s - 72) + 1, e + 72 - greatest(0, s - 72))) AS window_context FROM found f JOIN documents d ON f.doc_id = d.doc_id""")
def ctx_01(spark, d):
    x = fx.detected(spark, d).select("doc_id", "text", F.explode("spans").alias("x"))
    return x.select("doc_id", "x.start", text.left_context(F.col("text"), F.col("x.start"), 48).alias("left_context"), text.window_context(F.col("text"), F.col("x.start"), F.col("x.end"), 72).alias("window_context"))


@query("ctx_02_line_context", f"""WITH {fx.SQL_DETECTED} SELECT f.doc_id, f.s AS "start", lower(list_last(string_split(substr(text, 1, s), chr(10))) || value || string_split(substr(text, e + 1), chr(10))[1]) AS line_context,
  contains(lower(list_last(string_split(substr(text, 1, s), chr(10)))), 'the') AS has_marker FROM found f JOIN documents d ON f.doc_id = d.doc_id""")
def ctx_02(spark, d):
    x = fx.detected(spark, d).select("doc_id", "text", F.explode("spans").alias("x"))
    prefix = F.lower(text.line_prefix(F.col("text"), F.col("x.start")))
    return x.select("doc_id", "x.start", text.line_context(F.col("text"), F.col("x.start"), F.col("x.end")).alias("line_context"), text.contains_any(prefix, ["the"]).alias("has_marker"))


@query("det_14_offset_repair", f"""WITH {fx.SQL_DETECTED}, claims AS (SELECT f.doc_id, f.value, f.s + f.doc_id % 3 AS claimed, text FROM found f JOIN documents d ON f.doc_id = d.doc_id),
  counted AS (SELECT *, (length(text) - length(replace(text, value, ''))) / length(value) AS k FROM claims)
  SELECT doc_id, value, CAST(claimed AS BIGINT) AS claimed, CAST(CASE WHEN k = 1 THEN strpos(text, value) - 1 WHEN substr(text, claimed + 1, length(value)) = value THEN claimed END AS BIGINT) AS "start",
  CASE WHEN k = 1 THEN 'unique' WHEN substr(text, claimed + 1, length(value)) = value THEN 'kept' ELSE 'dropped' END AS how FROM counted""")
def det_14(spark, d):
    x = fx.detected(spark, d).select("doc_id", "text", F.explode("spans").alias("x")).select("doc_id", "text", "x.value", (F.col("x.start") + F.col("doc_id") % 3).alias("claimed"))
    times = (F.length("text") - F.length(F.replace("text", "value", F.lit("")))) / F.length("value")
    still = F.substring(F.col("text"), (F.col("claimed") + 1).cast("int"), F.length("value")) == F.col("value")
    return x.select("doc_id", "value", "claimed", F.when(times == 1, (F.expr("locate(value, text)") - 1).cast("long")).when(still, F.col("claimed")).alias("start"), F.when(times == 1, "unique").when(still, "kept").otherwise("dropped").alias("how"))


@query("ctx_13_format_candidates", f"""WITH {fx.SQL_DETECTED} SELECT doc_id, s AS "start", value, CASE type WHEN 'EMAIL' THEN 'EMAIL_ADDRESS' WHEN 'IP' THEN 'IP_ADDRESS' ELSE 'PAYMENT_CARD_NUMBER' END AS shape FROM found
  WHERE type = 'EMAIL' OR (type = 'IP' AND list_max(list_transform(string_split(value, '.'), lambda x: TRY_CAST(x AS INT))) <= 255 AND NOT regexp_matches(value, '(^|[.])0[0-9]'))""")
def ctx_13(spark, d):
    x = fx.detected(spark, d).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.start", "x.value", "x.type")
    return x.filter("type <> 'CARD'").withColumn("shapes", checks.format_candidates(F.col("value"))).select("doc_id", "start", "value", F.explode(F.filter("shapes", lambda c: c.isin("EMAIL_ADDRESS", "IP_ADDRESS"))).alias("shape"))


THRESHOLDS = {"EMAIL": (0.9, 0.5), "CARD": (0.95, 0.6), "IP": (0.4, 0.85)}  # the last pair stands inverted on purpose


def _decided(spark, d):
    docs = fx.detected(spark, d).select("doc_id", "text", overlap.serving(F.col("spans")).alias("spans"))

    def one(s):
        pick = lambda k: F.when(s["type"] == "EMAIL", THRESHOLDS["EMAIL"][k]).when(s["type"] == "CARD", THRESHOLDS["CARD"][k]).otherwise(THRESHOLDS["IP"][k])
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "type", "value", "confidence")], redact.decision(s["confidence"], pick(0), pick(1)).alias("decision"))

    return docs.withColumn("spans", F.transform("spans", one))


@query("flagship_redact")
def flagship(spark, d):
    """Detection, overlap, policy and redaction in one narrow stage."""
    x = _decided(spark, d)
    gone = F.filter("spans", lambda s: redact.is_redacted(s["decision"]))
    return x.select("doc_id", redact.redacted(F.col("text"), gone, "tag").alias("redacted_text"), F.size("spans").alias("n_spans"), F.size(gone).alias("n_redacted"))


@query("pol_04_decisions", f"""WITH {fx.SQL_DETECTED} SELECT doc_id, s AS "start", type, CASE WHEN type = 'EMAIL' THEN 'AUTO_REDACT' ELSE 'REVIEW' END AS decision FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.s < f.e AND f.s < g.e AND (g.s, g.type) <> (f.s, f.type))""")
def pol_04(spark, d):
    """Of spans that overlap no other."""
    x = _decided(spark, d)
    raw = fx.detected(spark, d).select("doc_id", F.col("spans").alias("raw"))
    lone = F.filter("spans", lambda s: F.size(F.filter("raw", lambda r: overlap.overlaps(r, s))) == 1)
    return x.join(raw, "doc_id").select("doc_id", F.explode(lone).alias("x")).select("doc_id", "x.start", "x.type", "x.decision")


@query("red_01_mask_cards", f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{fx.CARD}', '****************', 'g') AS masked FROM documents")
def red_01(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = F.transform(text.matches(F.col("text"), fx.CARD), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("CARD").alias("type")))
    return docs.select("doc_id", redact.redacted(F.col("text"), spans, "mask").alias("masked"))


@query("red_02_label_placeholder", f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{fx.EMAIL}', '<EMAIL>', 'g') AS labelled, regexp_replace(coalesce(text, ''), '{fx.EMAIL}', '', 'g') AS removed FROM documents")
def red_02(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = F.transform(text.matches(F.col("text"), fx.EMAIL), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("EMAIL").alias("type")))
    return docs.select("doc_id", redact.redacted(F.col("text"), spans, "label").alias("labelled"), redact.redacted(F.col("text"), spans, "remove").alias("removed"))


@query("rsp_01_payload")
def rsp_01(spark, d):
    x = _decided(spark, d)
    return redact.response(x.withColumn("red", redact.redacted(F.col("text"), F.col("spans"))), "doc_id", "red", "spans")


@query("rsp_02_summary", f"WITH {fx.SQL_DETECTED} SELECT type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY type")
def rsp_02(spark, d):
    return fx.detected(spark, d).select("doc_id", F.explode("spans").alias("x")).groupBy("x.type").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))




@query("typ_03_safety_decision", """WITH x AS (SELECT o_orderkey AS id, o_orderkey%29=0 AS line_neg, CASE o_orderkey%11 WHEN 0 THEN 'full_input' WHEN 1 THEN 'broad_regex' ELSE 'model' END AS source,
  (o_custkey%100)/100.0::DOUBLE AS top1, least(1.0::DOUBLE, (o_custkey%100)/100.0::DOUBLE + (o_orderkey%30)/100.0::DOUBLE) AS top3, (o_orderkey*7%100)/100.0::DOUBLE AS non_pii, o_orderkey%5=0 AS window_neg, o_orderkey%3=0 AS positive,
  (o_orderkey*3%40)/100.0::DOUBLE AS risk, CASE WHEN o_orderkey%4=0 THEN 0.45::DOUBLE END AS thr FROM orders)
  SELECT id, CASE WHEN line_neg THEN 'line_local_negative_context' WHEN source='full_input' THEN 'fallback_analysis_review' WHEN non_pii>=0.85 THEN 'non_pii_high'
   WHEN source='broad_regex' AND NOT positive AND top1<0.2 THEN 'broad_regex_without_positive_context' WHEN window_neg AND NOT positive AND top1<0.7 THEN 'negative_context_without_positive_context'
   WHEN NOT positive AND top1<0.2 THEN 'low_evidence_without_positive_context' WHEN non_pii>=0.5 THEN 'safety_review_non_pii_uncertain' WHEN thr IS NOT NULL AND top1<thr THEN 'low_pii_evidence_per_label'
   WHEN top1<0.2 AND top3<0.4 THEN 'low_pii_evidence' WHEN window_neg AND top1<0.7 THEN 'negative_context_uncertain' WHEN risk>=0.25 THEN 'high_top3_uncertainty_risk' ELSE 'low_top3_uncertainty_risk' END AS reason,
   CASE WHEN line_neg THEN 0 WHEN source='full_input' THEN greatest(risk,0.25) WHEN non_pii>=0.85 THEN 0 WHEN source='broad_regex' AND NOT positive AND top1<0.2 THEN 0 WHEN window_neg AND NOT positive AND top1<0.7 THEN 0
   WHEN NOT positive AND top1<0.2 THEN 0 WHEN non_pii>=0.5 OR (thr IS NOT NULL AND top1<thr) OR (top1<0.2 AND top3<0.4) OR (window_neg AND top1<0.7) THEN greatest(risk,0.25) ELSE risk END::DOUBLE AS risk FROM x""")
def typ_03(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    out = redact.safety_decision(o % 29 == 0, F.when(o % 11 == 0, "full_input").when(o % 11 == 1, "broad_regex").otherwise("model"), (c % 100) / 100.0, F.least(F.lit(1.0), (c % 100) / 100.0 + (o % 30) / 100.0), (o * 7 % 100) / 100.0, o % 5 == 0, o % 3 == 0, (o * 3 % 40) / 100.0, F.when(o % 4 == 0, 0.45))
    return fx.read(spark, d, "orders").select(o.alias("id"), out.alias("x")).select("id", "x.reason", "x.risk")


@query("pol_05_precedence", """WITH x AS (SELECT o_orderkey AS id, o_orderkey%13=0 AS sup, CASE WHEN o_orderkey%7=0 THEN 'why' END AS reason, CASE o_orderkey%4 WHEN 0 THEN 'redact' WHEN 1 THEN 'review' WHEN 2 THEN 'ignore' END AS own,
  CASE WHEN o_custkey%2=0 THEN (o_custkey%100)/100.0::DOUBLE END AS conf, CASE WHEN o_orderpriority LIKE '1%' THEN 'redact' WHEN o_orderpriority LIKE '2%' THEN 'review' END AS act FROM orders)
  SELECT id, CASE WHEN sup THEN 'ignore' WHEN reason IS NOT NULL AND own IS NOT NULL THEN own WHEN own IN ('redact','review') THEN own WHEN conf>=0.8 THEN 'AUTO_REDACT' WHEN conf>=0.3 THEN 'REVIEW' WHEN conf IS NOT NULL THEN 'PASS' ELSE coalesce(act,'review') END AS decision FROM x""")
def pol_05(spark, d):
    o, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    own = F.when(o % 4 == 0, "redact").when(o % 4 == 1, "review").when(o % 4 == 2, "ignore")
    by = redact.decision(F.when(c % 2 == 0, (c % 100) / 100.0), F.lit(0.3), F.lit(0.8))
    action = F.when(p.startswith("1"), "redact").when(p.startswith("2"), "review")
    return fx.read(spark, d, "orders").select(o.alias("id"), redact.applied_policy(o % 13 == 0, F.when(o % 7 == 0, "why"), own, by, action, "review").alias("decision"))


def _pipeline(spark, d):
    from quillspan.operators import rules

    x = fx.detected(spark, d)
    full = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["value"].alias("value"), s["confidence"].alias("confidence"), F.lit(None).cast("string").alias("decision"), s["source"].alias("source"), F.array().cast("array<string>").alias("notes")))
    return rules.postprocessed(x.withColumn("spans", full))


@query("pol_01_pipeline")
def pol_01(spark, d):
    """Detection, rules, false positives, overlap and redaction of all documents."""
    x = _pipeline(spark, d)
    return x.select("doc_id", redact.redacted(F.col("text"), F.col("spans")).alias("redacted_text"), F.size("spans").alias("n_spans"))


@query("ctx_07_false_positives", f"""WITH {fx.SQL_DETECTED} SELECT doc_id, s AS "start", type FROM found f WHERE NOT (type='IP' AND list_max(list_transform(string_split(value, '.'), lambda x: TRY_CAST(x AS INT))) <= 255
  AND regexp_matches(value, '^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|127[.]|169[.]254[.])'))""")
def ctx_07(spark, d):
    """What the drop leaves; no driver document has one of the marker contexts, so private addresses go only."""
    from quillspan.operators import rules

    kept = F.filter("spans", lambda s: ~rules.is_false_positive(F.col("text"), s))
    return fx.detected(spark, d).select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.start", "x.type")


@query("det_04_rescue_rules")
def det_04(spark, d):
    from quillspan.operators import rules

    docs = fx.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.explode(rules.contextual(F.col("text"))).alias("x")).select("doc_id", "x.*")
