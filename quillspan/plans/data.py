"""Preparation, statistics, sources, decoding and streaming-shaped queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import distributions, text
from quillspan.operators import codec, decode, prep
from quillspan.plans import fixtures as fx
from quillspan.sources import readers

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("sp_01_group_split", "SELECT doc_id, CASE WHEN b<80 THEN 'train' WHEN b<90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)),1,8))::BIGINT % 100 AS b FROM documents)")
def sp_01(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", prep.group_split(F.col("doc_id")).alias("split"))


@query("sp_02_negative_sample")
def sp_02(spark, d):
    return prep.hash_sample(fx.read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 50, seed=7)


@query("sp_03_near_duplicate_key", "SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*)>1")
def sp_03(spark, d):
    return fx.read(spark, d, "documents").groupBy(text.collapsed(F.col("text")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("prj_04_training_weight", "SELECT o_orderkey AS id, least(1.0, CASE WHEN c>=0.85 THEN 0.8 ELSE 0.4+0.4*c/0.85 END + CASE WHEN o_orderkey%3=0 THEN 0.2 ELSE 0 END)::DOUBLE AS weight FROM (SELECT o_orderkey, (o_custkey%100)/100.0::DOUBLE AS c FROM orders)")
def prj_04(spark, d):
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), prep.training_weight((F.col("o_custkey") % 100) / 100.0, F.col("o_orderkey") % 3 == 0).alias("weight"))


@query("prj_07_span_examples", f"WITH {fx.SQL} SELECT doc_id || '::span-' || (row_number() OVER (PARTITION BY doc_id ORDER BY s, e, label, n) - 1) AS id, s AS \"start\", e AS \"end\", label FROM gold")
def prj_07(spark, d):
    rows = fx.gold(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "n"))).alias("spans"))
    x = rows.select("doc_id", F.posexplode("spans").alias("i", "s"))
    return x.select(F.concat(F.col("doc_id").cast("string"), F.lit("::span-"), F.col("i").cast("string")).alias("id"), "s.start", "s.end", "s.label")


@query("prj_08_hard_labels", f"WITH {fx.SQL} SELECT o_orderkey AS doc_id, count(s) FILTER (label<>'TFN') AS n_spans FROM orders LEFT JOIN gold ON doc_id=o_orderkey GROUP BY 1")
def prj_08(spark, d):
    spans = fx.gold(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("start", "label")).alias("s"))
    x = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).join(spans, "doc_id", "left")
    kept = F.filter(F.coalesce("s", F.array().cast("array<struct<start:int,label:string>>")), lambda s: s["label"] != "TFN")
    return x.select("doc_id", F.size(kept).cast("long").alias("n_spans"))


@query("prj_09_span_map", f"WITH {fx.SQL} SELECT doc_id, label, list_sort(list([s, e])) AS offsets FROM gold GROUP BY doc_id, label")
def prj_09(spark, d):
    rows = fx.gold(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("s"))
    m = rows.select("doc_id", F.explode(readers.to_span_map(F.col("s"))).alias("label", "offsets"))
    return m.select("doc_id", "label", F.array_sort("offsets").alias("offsets"))


_ALIAS = [("EMAIL", "EMAIL_ADDRESS"), ("PHONE", "CONTACT"), ("ADDRESS", "CONTACT")]


@query("prj_10_label_remap", f"WITH {fx.SQL}, a AS (SELECT * FROM (VALUES ('EMAIL','EMAIL_ADDRESS'),('PHONE','CONTACT'),('ADDRESS','CONTACT')) t(raw, canonical)) SELECT doc_id, coalesce(canonical, label) AS label, sum(confidence) AS p FROM pred LEFT JOIN a ON label=raw GROUP BY ALL")
def prj_10(spark, d):
    return prep.remap(fx.pred(spark, d).select("doc_id", "label", F.col("confidence").alias("p")), spark.createDataFrame(_ALIAS, "raw string, canonical string"), "doc_id")


@query("prj_11_strict_remap", f"WITH {fx.SQL} SELECT doc_id, count(*) AS n FROM gold WHERE label IN ('EMAIL','TFN') GROUP BY doc_id")
def prj_11(spark, d):
    allowed = spark.createDataFrame([("EMAIL",), ("TFN",)], "label string")
    return fx.gold(spark, d).join(F.broadcast(allowed), "label", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt_01_long_or_foreign", "SELECT doc_id, length(text)>3000 AS too_long, regexp_matches(text, '[^\\x00-\\x7F]') AS has_non_ascii FROM documents WHERE text IS NOT NULL")
def flt_01(spark, d):
    docs = fx.read(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", (F.length("text") > 3000).alias("too_long"), F.col("text").rlike(r"[^\x00-\x7F]").alias("has_non_ascii"))


@query("flt_03_span_validity", f"WITH {fx.SQL_DETECTED}, c AS (SELECT f.doc_id, f.s + f.doc_id%2 AS s, f.e, value, text FROM found f JOIN documents d ON d.doc_id=f.doc_id) SELECT doc_id, s::BIGINT AS \"start\", CASE WHEN substr(text, s+1, e-s)<>value THEN 'value' ELSE '' END AS error FROM c")
def flt_03(spark, d):
    x = fx.detected(spark, d).select("doc_id", "text", F.explode("spans").alias("x")).withColumn("s", (F.col("x.start") + F.col("doc_id") % 2).cast("int"))
    return x.select("doc_id", F.col("s").cast("long").alias("start"), F.array_join(prep.span_errors(F.col("text"), F.col("s"), F.col("x.end"), F.col("x.value")), ",").alias("error"))


@query("flt_05_candidate_filter", "SELECT p_partkey, list_sort(list_distinct(list_append(list_filter([p_brand, p_type, p_brand], lambda x: x LIKE 'B%'), 'NON_PII'))) AS candidates FROM part")
def flt_05(spark, d):
    c = F.array_append(F.filter(F.array("p_brand", "p_type", "p_brand"), lambda x: x.startswith("B")), "NON_PII")
    return fx.read(spark, d, "part").select("p_partkey", F.array_sort(F.array_distinct(c)).alias("candidates"))


@query("typ_10_entropy", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, n/sum(n) OVER (PARTITION BY o_custkey) AS p FROM c) SELECT o_custkey, round(-sum(p*log2(p)), 9) AS entropy, round(max(p), 9) AS top1 FROM p GROUP BY 1")
def typ_10(spark, d):
    c = fx.read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").count()
    m = c.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.col("count").cast("double")))).alias("m")).withColumn("m", distributions.normalised(F.col("m")))
    return m.select("o_custkey", F.round(distributions.entropy_bits(F.col("m")), 9).alias("entropy"), F.round(distributions.top_mass(F.col("m"), 1), 9).alias("top1"))


@query("typ_09_verdicts", "WITH v AS (SELECT o_orderkey AS id, ['A','B','C'] AS l, list_transform([o_orderkey%5, o_custkey%5, (o_orderkey+o_custkey)%5], lambda k: [3.0,1.5,1.0,0.5,0.1][k+1]) AS w FROM orders) SELECT id, round((w[1]/list_sum(w))::DOUBLE, 9) AS a, round((w[2]/list_sum(w))::DOUBLE, 9) AS b, round((w[3]/list_sum(w))::DOUBLE, 9) AS c FROM v")
def typ_09(spark, d):
    names = F.array(*map(F.lit, distributions.VERDICT_WEIGHTS))
    pick = lambda x: F.element_at(names, (x % 5 + 1).cast("int"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    m = fx.read(spark, d, "orders").select(o.alias("id"), distributions.from_verdicts(F.create_map(F.lit("A"), pick(o), F.lit("B"), pick(c), F.lit("C"), pick(o + c))).alias("m"))
    return m.select("id", *[F.round(F.col("m")[k], 9).alias(k.lower()) for k in "ABC"])


@query("pol_07_composite_risk", "WITH c AS (SELECT o_custkey, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, k, n/sum(n) OVER (PARTITION BY o_custkey) AS p FROM c) SELECT o_custkey, round(sum(p*CASE k WHEN '1-URGENT' THEN 1.0 WHEN '5-LOW' THEN 0.0 ELSE 0.5 END), 9)::DOUBLE AS risk FROM p GROUP BY 1")
def pol_07(spark, d):
    c = fx.read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").count()
    m = c.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.col("count").cast("double")))).alias("m"))
    return m.select("o_custkey", F.round(distributions.composite_risk(distributions.normalised(F.col("m")), {"1-URGENT": 1.0, "5-LOW": 0.0}), 9).alias("risk"))


@query("typ_12_label_code", "SELECT p_partkey, trim(regexp_replace(upper(p_name || ' / ' || p_type), '[^A-Z0-9]+', '_', 'g'), '_') AS code FROM part")
def typ_12(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", text.label_code(F.concat("p_name", F.lit(" / "), "p_type")).alias("code"))


@query("ag_16_value_normalisation", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[‐‑‒–—−]', '-', 'g'), '\\s+', ' ', 'g')) AS plain, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM conversations")
def ag_16(spark, d):
    return fx.read(spark, d, "conversations").select("conv_id", "turn", text.normalised_value(F.lit("PERSON"), F.col("text")).alias("plain"), text.normalised_value(F.lit("PHONE"), F.col("text")).alias("digits"))


@query("ag_34_corpus_statistics", "SELECT lang, source, count(*) AS docs, sum(length(text))::BIGINT AS chars, count(DISTINCT md5(text)) AS distinct_texts FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def ag_34(spark, d):
    docs = fx.read(spark, d, "documents").select("lang", "source", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("h"))
    docs.createOrReplaceTempView("quillspan_docs")
    return spark.sql("SELECT lang, source, count(*) AS docs, sum(chars) AS chars, count(DISTINCT h) AS distinct_texts FROM quillspan_docs GROUP BY GROUPING SETS ((lang), (source), ())")


@query("ag_36_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1")
def ag_36(spark, d):
    return fx.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("ag_37_alias_map", "WITH r AS (SELECT DISTINCT p_type AS raw FROM part), c AS (SELECT DISTINCT upper(p_type) AS label FROM part WHERE p_size%2=0) SELECT raw, CASE WHEN e.label IS NOT NULL THEN e.label WHEN k.norm IS NOT NULL THEN k.norm END AS canonical, CASE WHEN e.label IS NOT NULL THEN 'exact' WHEN k.norm IS NOT NULL THEN 'normalised' ELSE 'unmapped' END AS how FROM r LEFT JOIN c e ON e.label=raw LEFT JOIN (SELECT regexp_replace(label,'[^A-Z0-9]','','g') AS k, min(label) AS norm FROM c GROUP BY 1) k ON k.k=regexp_replace(upper(raw),'[^A-Z0-9]','','g')")
def ag_37(spark, d):
    part = fx.read(spark, d, "part")
    none = spark.createDataFrame([], "raw string, label string")
    return prep.alias_map(part.select(F.col("p_type").alias("raw")).distinct(), part.filter("p_size % 2 = 0").select(F.upper("p_type").alias("label")).distinct(), none)


@query("ag_38_group_quality", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice),4) AS mean, round(median(o_totalprice),4) AS median, max(o_totalprice) AS top FROM orders GROUP BY 1")
def ag_38(spark, d):
    return fx.read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.max("o_totalprice").alias("top"))


@query("ag_39_run_metrics", "SELECT event_type, count(*) AS n, sum(CASE WHEN value>50 THEN 1 ELSE 0 END)::BIGINT AS high, round(count(*)/(epoch(max(ts))-epoch(min(ts)))*60, 6) AS per_minute FROM events GROUP BY 1")
def ag_39(spark, d):
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return fx.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("high"), F.round(F.count(F.lit(1)) / (seconds / 1e6) * 60, 6).alias("per_minute"))


@query("ag_42_label_set_recall", f"WITH {fx.SQL}, g AS (SELECT doc_id, list(DISTINCT label) AS g FROM gold GROUP BY 1), p AS (SELECT doc_id, list(DISTINCT label) AS p FROM pred GROUP BY 1) SELECT doc_id, len(list_intersect(g, coalesce(p, []))) AS found, len(g) AS wanted FROM g LEFT JOIN p USING (doc_id)")
def ag_42(spark, d):
    g, p = fx.gold(spark, d).groupBy("doc_id").agg(F.collect_set("label").alias("g")), fx.pred(spark, d).groupBy("doc_id").agg(F.collect_set("label").alias("p"))
    hit = F.array_intersect("g", F.coalesce("p", F.array().cast("array<string>")))
    return g.join(p, "doc_id", "left").select("doc_id", F.size(hit).cast("long").alias("found"), F.size("g").cast("long").alias("wanted"))


@query("ag_43_run_deltas", "WITH a AS (SELECT l_returnflag AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber%2=0 GROUP BY 1), b AS (SELECT l_returnflag AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber%2=1 GROUP BY 1) SELECT k, b.v-a.v AS delta FROM a JOIN b USING (k)")
def ag_43(spark, d):
    x = fx.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"))
    return x.agg((F.sum(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity"))) - F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")))).alias("delta"))


@query("ag_44_model_choice", "SELECT s_suppkey AS model FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 1")
def ag_44(spark, d):
    return fx.read(spark, d, "supplier").orderBy("s_nationkey", F.col("s_acctbal").desc(), "s_suppkey").limit(1).select(F.col("s_suppkey").alias("model"))


@query("ag_45_pooled_embeddings", "WITH x AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) SELECT label, round(v, 6) AS v, i::INT AS i FROM x")
def ag_45(spark, d):
    parts = fx.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return parts.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))


@query("srt_03_bucket_top_k", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn<=3")
def srt_03(spark, d):
    return prep.top_k(fx.read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@query("srt_02_most_common", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 10")
def srt_02(spark, d):
    return fx.read(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("f")).orderBy(F.col("n").desc(), "f").limit(10).drop("f")


@query("set_01_union_stages", "SELECT doc_id, 'toxic' AS stage FROM labels WHERE toxic=1 UNION ALL SELECT doc_id, 'poor' FROM labels WHERE quality=0")
def set_01(spark, d):
    x = fx.read(spark, d, "labels")
    return x.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("stage")).unionByName(x.filter("quality = 0").select("doc_id", F.lit("poor").alias("stage")))


@query("set_02_set_difference", f"WITH {fx.SQL} SELECT doc_id, label FROM gold EXCEPT SELECT doc_id, label FROM pred")
def set_02(spark, d):
    return fx.gold(spark, d).select("doc_id", "label").subtract(fx.pred(spark, d).select("doc_id", "label"))


@query("set_03_multiset_difference", f"WITH {fx.SQL} SELECT doc_id, label FROM gold EXCEPT ALL SELECT doc_id, label FROM pred")
def set_03(spark, d):
    return fx.gold(spark, d).select("doc_id", "label").exceptAll(fx.pred(spark, d).select("doc_id", "label"))


@query("set_04_first_of_key", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn=1")
def set_04(spark, d):
    return prep.first_of(fx.read(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query("src_10_clean_lines")
def src_10(spark, d):
    return fx.read(spark, d, "pages").select("page_id", text.cleaned_lines(F.col("html")).alias("cleaned"))


@query("src_01_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value FROM events")
def src_01(spark, d):
    m = F.from_json("props", "map<string,string>")
    return fx.read(spark, d, "events").select("event_id", F.try_element_at(F.map_values(m), F.lit(1)).alias("first_value"))


@query("src_14_transcripts", "SELECT conv_id, role, text FROM conversations WHERE role IN ('user','assistant') AND NOT contains(text, chr(10)) AND text<>''")
def src_14(spark, d):
    """Turns joined to a transcript and cut again."""
    c = fx.read(spark, d, "conversations").filter("role IN ('user', 'assistant') AND NOT contains(text, '\n') AND text <> ''")
    joined = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("t"))
    return joined.select("conv_id", F.explode(readers.transcript(F.col("t"))).alias("x")).select("conv_id", "x.role", "x.text")


@query("det_12_tag_encode", f"SELECT doc_id, regexp_replace(coalesce(text,''), '({fx.EMAIL})', '<pii type=\"EMAIL\">\\1</pii>', 'g') AS tagged FROM documents")
def det_12(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = F.transform(text.matches(F.col("text"), fx.EMAIL), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("EMAIL").alias("type")))
    return docs.select("doc_id", codec.tagged(F.col("text"), spans).alias("tagged"))


@query("det_10_tag_round_trip", f"WITH {fx.SQL_DETECTED} SELECT doc_id AS id, s AS \"start\", e AS \"end\", type, value FROM found WHERE type='EMAIL'")
def det_10(spark, d):
    """Encoded and parsed again: the same spans. Only documents without markup characters."""
    x = codec.parsed(det_12(spark, d), "doc_id", "tagged").select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end", "s.type", "s.value")
    return x


@query("det_18_viterbi")
def det_18(spark, d):
    """Embeddings as scores of 7 tokens x 9 labels (two classes)."""
    s = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.slice(F.col("embedding").cast("array<float>"), i * 9 + 1, 9))
    return decode.decoded(fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), s.alias("scores")), 2, {"o_start": -0.5})


_TOKENS = "tok AS (SELECT l_orderkey AS id, l_linenumber AS pos, ['O','B','I','E','S'][CAST(l_partkey%5+1 AS INT)] AS tag, CASE WHEN l_suppkey%2=0 THEN 'A' ELSE 'B' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r=1)"


@query("det_21_labels_to_spans", f"""WITH {_TOKENS}, i AS (SELECT *, lag(pos) OVER w AS pp, lag(tag) OVER w AS pt, lag(label) OVER w AS pl FROM tok WHERE tag<>'O' WINDOW w AS (PARTITION BY id ORDER BY pos)),
  k AS (SELECT *, sum(CASE WHEN pp IS NULL OR pp<>pos-1 OR pl<>label OR tag IN ('B','S') OR pt IN ('E','S') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS isle FROM i)
  SELECT id, min(pos) AS "start", max(pos)+1 AS "end", min(label) AS label FROM k GROUP BY id, isle""")
def det_21(spark, d):
    li = prep.first_of(fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    tag = F.element_at(F.array(*map(F.lit, "OBIES")), (F.col("l_partkey") % 5 + 1).cast("int"))
    return decode.token_spans(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), tag.alias("tag"), F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("label")))


@query("det_24_spans_to_labels")
def det_24(spark, d):
    tokens = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos")).withColumn("start", F.col("pos") * 6).withColumn("end", F.col("pos") * 6 + 5)
    return decode.token_labels(tokens, fx.gold(spark, d).withColumnRenamed("doc_id", "id"))


@query("win_events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def win_events(spark, d):
    """Beyond the reference: the streaming windows of events, here over the table."""
    from quillspan.streaming.redaction import windowed_counts

    return windowed_counts(fx.read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("win_running_total", "SELECT c_custkey, c_nationkey, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS running FROM customer")
def win_running(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, 0)
    return fx.read(spark, d, "customer").select("c_custkey", "c_nationkey", F.sum("c_acctbal").over(w).alias("running"))
