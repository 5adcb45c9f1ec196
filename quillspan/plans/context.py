"""Queries of contexts, fallback candidates and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import context, evaluate
from quillspan.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _spans(spark, d):
    return fx.detected(spark, d).select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", "text", "s.*")


def _words(phrases: list[str]) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + "]"


def _any(text: str, phrases: list[str]) -> str:
    return f"len(list_filter({_words(phrases)}, lambda w: contains({text}, w))) > 0"


_AROUND = "lower(substr(text, greatest(s-{0},0)+1, e+20-greatest(s-{0},0)))"
#: Words that make a window speak for a type.
MARKERS = {"CARD": ["card", "visa", "pay"], "EMAIL": ["mail", "write", "contact"], "IP": ["host", "login", "server"]}


@query("ctx_05_window_phrases", f"""WITH {fx.SQL_DETECTED}, w AS (SELECT doc_id, s, e, type, {_AROUND.format(80)} AS near, {_AROUND.format(120)} AS far FROM found JOIN documents USING (doc_id))
  SELECT doc_id, s AS start, e AS "end", type, {_any('near', context.WINDOW_PHRASES)} AS negative,
  CASE type {' '.join(f"WHEN '{k}' THEN {_any('far', v)}" for k, v in MARKERS.items())} ELSE false END AS positive FROM w""")
def ctx_05(spark, d):
    at = F.col("text"), F.col("start"), F.col("end")
    return _spans(spark, d).select("doc_id", "start", "end", "type", context.window_negative(*at).alias("negative"), context.positive(*at, F.col("type"), MARKERS).alias("positive"))


_MASK = context.LITERALS.replace("'", "''")


@query("ctx_06_line_phrases", f"""WITH {fx.SQL_DETECTED}, w AS (
  SELECT doc_id, s, e, type, lower(value) AS own, lower(string_split(substr(text, greatest(s-120,0)+1, s-greatest(s-120,0)), chr(10))[-1]) AS lead, lower(string_split(substr(text, e+1, 20), chr(10))[1]) AS behind
  FROM found JOIN documents USING (doc_id)),
  m AS (SELECT doc_id, s, e, type, regexp_replace(CASE WHEN instr(lead, own) > 0 THEN substr(lead, 1, instr(lead, own)-1) || substr(lead, instr(lead, own)+length(own)) ELSE lead END, '{_MASK}', ' ', 'g') AS lead,
  regexp_replace(behind, '{_MASK}', ' ', 'g') AS behind FROM w)
  SELECT doc_id, s AS start, e AS "end", type, {_any('behind', context.LINE_PHRASES)} OR len(list_filter({_words(context.LINE_PHRASES)},
  lambda p: contains(lead, p) AND len(list_filter({_words(context.TAKEN_BACK)}, lambda t: contains(string_split(lead, p)[-1], t))) = 0)) > 0 AS negative FROM m""")
def ctx_06(spark, d):
    return _spans(spark, d).select("doc_id", "start", "end", "type", context.line_negative(F.col("text"), F.col("start"), F.col("end")).alias("negative"))


#: Texts with one value and whether its line is negative.
LINE_CASES = [
    ("sample card 4111", "4111", True), ("a sample, but this card 4111", "4111", False), ("4111 (placeholder)", "4111", True), ("test\n4111", "4111", False),
    ("card 4111\nsample", "4111", False), ("see test.example.org 4111", "4111", False), ("ann@test.org", "ann@test.org", False), ("demo, however a dummy 4111", "4111", True),
]


@query("ctx_06_line_cases", "SELECT CAST(k AS INT) AS case_id, negative FROM (VALUES " + ", ".join(f"({k}, {str(c[2]).lower()})" for k, c in enumerate(LINE_CASES)) + ") v(k, negative)")
def ctx_06_cases(spark, d):
    cases = spark.createDataFrame([(k, t, t.index(v), t.index(v) + len(v)) for k, (t, v, _) in enumerate(LINE_CASES)], "case_id int, text string, start int, end int")
    return cases.select("case_id", context.line_negative(F.col("text"), F.col("start"), F.col("end")).alias("negative"))


@query("det_03_fallback_modes", rf"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(text, '^\s+', '') AS body FROM conversations WHERE text IS NOT NULL),
  f AS (SELECT conv_id, turn, length(text)-length(body) AS s, regexp_replace(body, '\s+$', '') AS v FROM t),
  m AS (SELECT conv_id, turn, regexp_extract_all(text, '{fx.EMAIL}') AS m, regexp_split_to_array(text, '{fx.EMAIL}') AS p FROM t),
  e AS (SELECT conv_id, turn, m[i] AS v, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))),0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))),0) AS s
        FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m WHERE len(m) > 0)),
  a AS (SELECT conv_id, turn, CAST(s AS INT) AS start, CAST(s+length(v) AS INT) AS "end", v AS value, 'fallback_full_input' AS source, 0 AS k FROM f WHERE v <> ''
        UNION ALL SELECT conv_id, turn, CAST(s AS INT), CAST(s+length(v) AS INT), v, 'regex_candidate:email', 1 FROM e)
  SELECT conv_id, turn, start, "end", value, source FROM a QUALIFY row_number() OVER (PARTITION BY conv_id, turn, start, "end" ORDER BY k) = 1""")
def det_03(spark, d):
    turns = fx.read(spark, d, "conversations").filter("text IS NOT NULL")
    return turns.select("conv_id", "turn", F.explode(context.fallback(F.col("text"), {"email": fx.EMAIL})).alias("s")).select("conv_id", "turn", "s.*")


_KIND = ["hard_negative_context", "reverse_negative_context", "strong_positive_context", "plain"]


@query("prj_05_context_weights", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey%4=0 THEN 0.8 WHEN l_partkey%4=1 THEN 0.5 WHEN l_suppkey%3=0 THEN 0.6 WHEN l_partkey%4=2 THEN 0.7 ELSE 0.5 END::DOUBLE AS weight FROM lineitem""")
def prj_05(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KIND)), (F.col("l_partkey") % 4 + 1).cast("int"))
    group = F.when(F.col("l_suppkey") % 3 == 0, "zero_example_a").when(F.col("l_suppkey") % 3 == 1, "common")
    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", context.context_weight(kind, group).alias("weight"))


@query("typ_13_sampling_weights", f"""WITH {fx.SQL}, g AS (SELECT DISTINCT doc_id, s, e, label FROM gold), p AS (SELECT DISTINCT doc_id, s, e, label FROM pred),
  c AS (SELECT label, count(*) FILTER (a=1 AND b=1) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn
        FROM (SELECT *, 1 AS a FROM g) FULL JOIN (SELECT *, 1 AS b FROM p) USING (doc_id, s, e, label) GROUP BY label),
  f AS (SELECT label, 2.0*tp/(2*tp+fp+fn) AS f FROM c)
  SELECT label, CASE WHEN f<0.2 THEN 8.0 WHEN f<0.4 THEN 5.0 WHEN f<0.6 THEN 3.0 WHEN f<0.8 THEN 1.5 ELSE 0.5 END::DOUBLE AS weight FROM f""")
def typ_13(spark, d):
    scores = evaluate.exact(fx.gold(spark, d), fx.pred(spark, d)).filter("label IS NOT NULL")
    return scores.select("label", context.sampling_weight(F.col("f")).alias("weight"))
