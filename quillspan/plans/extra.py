"""Queries of matching strategies, token metrics, offsets, label dimensions and training targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import align
from quillspan.plans import fixtures as fx
from quillspan.sources import writers

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


@query("jn_04_auto_by_text", """WITH g AS (SELECT doc_id, coalesce(text,'') AS t, row_number() OVER (PARTITION BY coalesce(text,'') ORDER BY doc_id) AS k FROM documents),
  p AS (SELECT doc_id - 900000000 AS doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k FROM g)
  SELECT 'text' AS strategy, g.doc_id AS gold_id, p.doc_id AS pred_id FROM g FULL JOIN p ON g.t = p.t AND g.k = p.k""")
def jn_04_text(spark, d):
    """Files whose ids have nothing in common match by text and occurrence."""
    docs = fx.read(spark, d, "documents").select("doc_id", "text")
    return align.auto_matched(docs, docs.withColumn("doc_id", F.col("doc_id") - 900000000))


@query("jn_04_auto_by_id", "SELECT 'id' AS strategy, d.doc_id AS gold_id, p.doc_id AS pred_id FROM documents d FULL JOIN (SELECT doc_id FROM documents UNION ALL SELECT -1 - doc_id FROM labels) p USING (doc_id)")
def jn_04_id(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", "text")
    more = fx.read(spark, d, "labels").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("").alias("text"))
    return align.auto_matched(docs, docs.unionByName(more))


@query("jn_06_case_verdicts", "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def jn_06(spark, d):
    return align.case_verdicts(fx.read(spark, d, "documents").select("doc_id", "lang", "source"), fx.read(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", "quality", "toxic")


@query("jn_07_missing_predictions", "SELECT d.doc_id, toxic, CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_07(spark, d):
    return align.with_predictions(fx.read(spark, d, "documents").select("doc_id"), fx.read(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


_TOKENS = "t AS (SELECT CAST(l_partkey % 5 AS INT) AS g, CAST(CASE WHEN l_suppkey % 4 = 0 THEN (l_partkey + 1) % 5 ELSE l_partkey % 5 END AS INT) AS p, ((l_partkey * 13 + l_linenumber) % 97 + 1) / 98.0::DOUBLE AS prob FROM lineitem)"


@query("ag_07_token_metrics", f"""WITH {_TOKENS}, a AS (SELECT round(avg(CASE WHEN g=p THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS accuracy, round(avg(-ln(prob)), 9) AS loss FROM t), c AS (
  SELECT k AS label, count(*) FILTER (g=k AND p=k) AS tp, count(*) FILTER (g<>k AND p=k) AS fp, count(*) FILTER (g=k AND p<>k) AS fn FROM t, range(1,5) r(k) WHERE g=k OR p=k GROUP BY k
  UNION ALL SELECT -1, count(*) FILTER (g<>0 AND p<>0), count(*) FILTER (g=0 AND p<>0), count(*) FILTER (g<>0 AND p=0) FROM t WHERE g<>0 OR p<>0)
  SELECT CAST(label AS INT) AS label, tp, fp, fn, accuracy, loss FROM c, a""")
def ag_07(spark, d):
    li, k = fx.read(spark, d, "lineitem"), F.col("l_partkey")
    t = li.select((k % 5).cast("int").alias("gold"), F.when(F.col("l_suppkey") % 4 == 0, (k + 1) % 5).otherwise(k % 5).cast("int").alias("pred"), (((k * 13 + F.col("l_linenumber")) % 97 + 1) / 98.0).alias("prob"))
    return align.token_metrics(t).withColumn("accuracy", F.round("accuracy", 9)).withColumn("loss", F.round("loss", 9))


@query("ag_12_void_round_trips", f"""WITH {fx.SQL}, k AS (SELECT * FROM pred WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')),
  hit AS (SELECT g.label, count(*) AS exact FROM gold g JOIN k ON g.doc_id=k.doc_id AND g.s=k.s AND g.e=k.e AND g.label=k.label GROUP BY g.label),
  n AS (SELECT label, count(*) AS n_pred FROM k GROUP BY label) SELECT label, n_pred, coalesce(exact, 0) AS exact FROM n LEFT JOIN hit USING (label)""")
def ag_12(spark, d):
    """Answers of orders in state P didn't come back as they were: their spans are void."""
    docs = fx.arrays(fx.pred(spark, d)).join(fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus"), "doc_id")
    kept = docs.select("doc_id", F.explode(align.voided(F.col("spans"), F.col("o_orderstatus") != "P")).alias("s")).select("doc_id", "s.start", "s.end", F.col("s.type").alias("label"))
    hit = fx.gold(spark, d).drop("n").join(kept, ["doc_id", "start", "end", "label"]).groupBy("label").agg(F.count(F.lit(1)).alias("exact"))
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n_pred")).join(hit, "label", "left").select("label", "n_pred", F.coalesce("exact", F.lit(0)).alias("exact"))


@query("ag_33_soft_targets", """WITH x AS (SELECT o_orderkey AS id, (o_orderkey%4)::DOUBLE AS a, (o_custkey%3)::DOUBLE AS b, CASE o_orderstatus WHEN 'F' THEN 0.5 ELSE 1.0 END::DOUBLE AS f FROM orders)
  SELECT id, round(a/(a+b)*f, 9) AS first, round(b/(a+b)*f, 9) AS second FROM x WHERE a+b > 0""")
def ag_33(spark, d):
    o = fx.read(spark, d, "orders")
    pair = lambda name, c: F.struct(F.lit(name).alias("label"), c.cast("double").alias("weight"))
    t = align.soft_targets(F.array(pair("a", F.col("o_orderkey") % 4), pair("b", F.col("o_custkey") % 3)), F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(1.0))
    return o.select(F.col("o_orderkey").alias("id"), t.alias("t")).filter("t IS NOT NULL").select("id", F.round(F.col("t")[0]["weight"], 9).alias("first"), F.round(F.col("t")[1]["weight"], 9).alias("second"))


@query("det_22_bytes_to_chars", f"""WITH {fx.SQL_DETECTED} SELECT doc_id, s AS "start", e AS "end" FROM found""")
def det_22(spark, d):
    """Offsets in bytes and back are the offsets in characters."""
    x = fx.detected(spark, d).select("doc_id", "text", F.explode("spans").alias("s"))
    b = lambda c: align.byte_offset(F.col("text"), F.col(c))
    return x.select("doc_id", align.char_span(F.col("text"), b("s.start"), b("s.end")).alias("c")).select("doc_id", "c.start", "c.end")


@query("det_23_token_range", f"""WITH {fx.SQL} SELECT doc_id, n, CAST(s // 5 AS INT) AS first_token, CAST((e - 1) // 5 AS INT) AS last_token FROM gold""")
def det_23(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.struct((k * 5).alias("start"), (k * 5 + 5).alias("end")))
    r = align.token_range(tokens, F.col("start"), F.col("end"))
    return fx.gold(spark, d).select("doc_id", "n", r.alias("r")).select("doc_id", "n", F.col("r.first").alias("first_token"), F.col("r.last").alias("last_token"))


@query("det_25_windows", """WITH x AS (SELECT doc_id, length(coalesce(text,'')) AS n FROM documents),
  w AS (SELECT doc_id, n, unnest(range(0, greatest(0, CAST(ceil((n - 4096) / 3584.0) AS BIGINT)) + 1)) AS k FROM x WHERE n > 0)
  SELECT doc_id, CAST(k * 3584 AS INT) AS "start", CAST(least(n, k * 3584 + 4096) AS INT) AS "end" FROM w""")
def det_25(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return docs.select("doc_id", F.explode(align.windows(F.col("n"), 4096, 512)).alias("w")).select("doc_id", "w.start", "w.end")


@query("det_26_line_pieces", r"""WITH x AS (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations WHERE text IS NOT NULL),
  y AS (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM x),
  z AS (SELECT conv_id, turn, p[i] AS v, coalesce(list_sum(list_transform(p[1:i-1], lambda q: length(q))), 0) + i - 1 AS pos FROM y)
  SELECT conv_id, turn, CAST(pos + length(v) - length(ltrim(v)) AS INT) AS "start", CAST(pos + length(rtrim(v)) AS INT) AS "end", trim(v) AS value FROM z WHERE trim(v) <> ''""")
def det_26(spark, d):
    c = fx.read(spark, d, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", F.explode(align.line_pieces(F.col("text"), F.lit(0))).alias("x")).select("conv_id", "turn", "x.start", "x.end", "x.value")


@query("pol_02_aliases", f"WITH {fx.SQL} SELECT doc_id, n, CASE label WHEN 'TFN' THEN 'AU_TFN' WHEN 'PERSON' THEN 'NAME' ELSE label END AS label, CASE WHEN label IN ('TFN','PERSON') THEN 'alias_of:' || label END AS note FROM gold")
def pol_02(spark, d):
    return align.aliased(fx.gold(spark, d), {"TFN": "AU_TFN", "PERSON": "NAME"}).select("doc_id", "n", "label", "note")


@query("pol_03_classification", f"""WITH {fx.SQL}, x AS (SELECT doc_id, n, label, CASE WHEN n = 1 THEN 'Public' END AS own FROM gold),
  y AS (SELECT doc_id, n, coalesce(lower(own), CASE label WHEN 'TFN' THEN 'restricted' WHEN 'EMAIL' THEN 'sensitive' END, 'sensitive') AS data_classification FROM x)
  SELECT *, CASE data_classification WHEN 'restricted' THEN 1.0 WHEN 'public' THEN 0.0 ELSE 0.5 END::DOUBLE AS class_weight FROM y""")
def pol_03(spark, d):
    classes = spark.createDataFrame([("TFN", "Restricted"), ("EMAIL", "Sensitive")], "label string, data_classification string")
    x = fx.gold(spark, d).withColumn("data_classification", F.when(F.col("n") == 1, "Public"))
    return align.classified(x, classes).select("doc_id", "n", "data_classification", "class_weight")


@query("prj_06_source_key", "SELECT doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'unknown') AS source_key FROM documents")
def prj_06(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", align.source_key(F.col("source"), F.col("lang")).alias("source_key"))


@query("prj_13_stable_id", "SELECT doc_id, sha256(coalesce(length(text) || ':' || text, '-') || coalesce(length(lang) || ':' || lang, '-')) AS id FROM documents")
def prj_13(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", align.stable_id(F.col("text"), F.col("lang")).alias("id"))


@query("flt_04_target_types", f"WITH {fx.SQL} SELECT doc_id, n, label FROM gold WHERE label IN ('EMAIL','TFN')")
def flt_04(spark, d):
    return align.of_targets(fx.gold(spark, d), ["EMAIL", "TFN"]).select("doc_id", "n", "label")


@query("srt_01_total_order", f"WITH {fx.SQL} SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY s, e DESC, label, n) AS ns FROM gold GROUP BY doc_id")
def srt_01(spark, d):
    spans = fx.gold(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "n")).alias("spans"))
    return spans.select("doc_id", F.array_join(F.transform(align.in_order(F.col("spans")), lambda s: s["n"].cast("string")), ",").alias("ns"))


@query("rsp_03_buckets", f"""WITH {fx.SQL} SELECT doc_id, count(*) FILTER (confidence >= 0.8) AS n_redact, count(*) FILTER (confidence >= 0.3 AND confidence < 0.8) AS n_review, count(*) FILTER (confidence < 0.3) AS n_ignore FROM pred GROUP BY doc_id""")
def rsp_03(spark, d):
    b = fx.arrays(fx.pred(spark, d)).select("doc_id", align.buckets(F.col("spans"), 0.3, 0.8).alias("b"))
    return b.select("doc_id", *[F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in ("redact", "review", "ignore")])


@query("typ_08_entity_scores", """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS span, ['B-A','I-A','E-A','S-B','O'][CAST(l_partkey%5+1 AS INT)] AS tag, (l_suppkey % 8) / 8.0::DOUBLE AS prob FROM lineitem),
  m AS (SELECT doc_id, span, tag, avg(prob) AS p FROM t WHERE tag <> 'O' GROUP BY ALL), e AS (SELECT doc_id, span, tag[3:] AS entity, round(sum(p), 9) AS score FROM m GROUP BY ALL)
  SELECT doc_id, CAST(span AS INT) AS span, entity, score, CAST(row_number() OVER (PARTITION BY doc_id, span ORDER BY score DESC, entity) AS INT) AS rank FROM e""")
def typ_08(spark, d):
    tag = F.element_at(F.array(*map(F.lit, ("B-A", "I-A", "E-A", "S-B", "O"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    t = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("span"), tag.alias("tag"), (F.col("l_suppkey") % 8 / 8.0).alias("prob"))
    return align.entity_scores(t)


@query("snk_05_prediction_map", f"""WITH {fx.SQL}, k AS (SELECT doc_id, label || ': ' || (n % 2) AS key, list([s, e] ORDER BY s, e) AS places FROM gold GROUP BY ALL)
  SELECT doc_id, string_agg(key || '=' || list_aggregate(list_transform(places, lambda x: x[1] || '-' || x[2]), 'string_agg', '+'), ';' ORDER BY key) AS spans FROM k GROUP BY doc_id""")
def snk_05(spark, d):
    spans = fx.gold(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("label", (F.col("n") % 2).cast("string").alias("value"), "start", "end")).alias("spans"))
    m = F.map_entries(writers.prediction_map(F.col("spans")))
    places = lambda e: F.array_join(F.transform(e["value"], lambda x: F.concat(x[0].cast("string"), F.lit("-"), x[1].cast("string"))), "+")
    return spans.select("doc_id", F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), places(e))), ";").alias("spans"))


#: Texts with the values that the contextual rules find in them: (label, value, confidence).
RULE_CASES = [
    ("Student ID: 123456789 and UAC ID: 123 456 789", [("STUDENT_ID", "123456789", 1.0), ("UAC_ID", "123 456 789", 1.0)]),
    ("UAC123456789 is a lot code", []),
    ("Passport number N1234567, passport held, expires 03/27", [("AU_PASSPORT", "N1234567", 1.0), ("PASSPORT_EXPIRY", "03/27", 1.0)]),
    ("TFN 123 456 782; BSB is 062-000", [("AU_TFN", "123 456 782", 1.0), ("AU_BANK_ACCOUNT", "062-000", 1.0)]),
    ("Medicare: 2123 45670 1", [("MEDICARE_NUMBER", "2123 45670 1", 1.0)]),
    ("Staff ID E123456 / Personal email ann@x.org", [("EMPLOYEE_NUMBER", "E123456", 1.0), ("EMAIL", "ann@x.org", 1.0)]),
    ("Placeholder email a@b.cd", []),
    ("Mobile: 0412 345 678", [("PHONE", "0412 345 678", 1.0)]),
    ("Expected salary $90k pa", [("SALARY_WAGE_EXPECTATION", "$90k pa", 0.6), ("SALARY", "$90k pa", 0.6)]),
    ("Card: **** **** **** 1234", [("PAYMENT_CARD_NUMBER", "**** **** **** 1234", 0.6)]),
    ("had grief therapy (weekly)", [("COUNSELLING_RECORDS", "grief therapy (weekly)", 0.6)]),
    ("Face: face ID on file", [("FACIAL_RECOGNITION", "face ID on file", 0.6)]),
    ("Full name: Ann Mary Lee", [("PERSON", "Ann Mary Lee", 1.0)]),
    ("D.O.B. 1/2/1999", [("DATE_OF_BIRTH", "1/2/1999", 1.0)]),
    ("Contract: casual", [("CONTRACT_TYPE", "casual", 0.6)]),
]
_EXPECTED = ", ".join(f"({k}, '{label}', '{value}', {confidence}, {text.index(value)})" for k, (text, found) in enumerate(RULE_CASES) for label, value, confidence in found)


@query("det_04_05_rule_cases", f"""SELECT CAST(k AS INT) AS case_id, label, value, confidence::DOUBLE AS confidence, CAST(s AS INT) AS "start" FROM (VALUES {_EXPECTED}) v(k, label, value, confidence, s)""")
def det_04_05_cases(spark, d):
    from quillspan.operators import rules

    cases = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(RULE_CASES)], "case_id int, text string")
    return cases.select("case_id", F.explode(rules.contextual(F.col("text"))).alias("x")).select("case_id", F.col("x.type").alias("label"), "x.value", "x.confidence", "x.start")


#: Texts with one span (type, value) and whether its context makes it a false positive.
DROP_CASES = [
    ("Switchboard phone: 0412 345 678", "PHONE", "0412 345 678", True), ("mobile: 0499 888 777", "PHONE", "0499 888 777", False),
    ("server ip 203.0.113.7", "IP", "203.0.113.7", True), ("login from 8.8.8.8", "IP", "8.8.8.8", False), ("host 169.254.1.2", "IP", "169.254.1.2", True),
    ("write to ops@x.org (internal-crm)", "EMAIL", "ops@x.org", True), ("write to ann@x.org", "EMAIL", "ann@x.org", False),
    ("loyalty card 4111 1111 1111 1111", "PAYMENT_CARD_NUMBER", "4111 1111 1111 1111", True), ("card used 4111 1111 1111 1111", "PAYMENT_CARD_NUMBER", "4111 1111 1111 1111", False),
    ("class average ABCD1234: D 70", "SUBJECT_RESULTS", "ABCD1234: D 70", True), ("work order 123 456 782", "AU_TFN", "123 456 782", True), ("tfn 123 456 782 on work order", "AU_TFN", "123 456 782", False),
    ("sample plate ABC-123", "VEHICLE_ID", "ABC-123", True), ("branch code 062-000", "AU_BANK_ACCOUNT", "062-000", True), ("bsb: 062-000", "AU_BANK_ACCOUNT", "062-000", False),
    ("created: 1/2/2020", "PASSPORT_EXPIRY", "1/2/2020", True), ("postcode 2600", "ADDRESS", "2600", True),
]


@query("ctx_07_drop_cases", "SELECT CAST(k AS INT) AS case_id, dropped FROM (VALUES " + ", ".join(f"({k}, {str(c[3]).lower()})" for k, c in enumerate(DROP_CASES)) + ") v(k, dropped)")
def ctx_07_cases(spark, d):
    from quillspan.operators import rules

    rows = [(k, t, (t.index(v), t.index(v) + len(v), kind, v, 0.9, None, "model", [])) for k, (t, kind, v, _) in enumerate(DROP_CASES)]
    cases = spark.createDataFrame(rows, f"case_id int, text string, s {rules.SPANS[6:-1]}")
    return cases.select("case_id", rules.is_false_positive(F.col("text"), F.col("s")).alias("dropped"))
