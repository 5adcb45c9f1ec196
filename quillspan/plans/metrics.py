"""Join, matching, metric and calibration queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import calibrate, evaluate
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


_PRF = "CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END::DOUBLE AS recall, CASE WHEN 2*tp+fp+fn>0 AND tp>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END::DOUBLE AS f"
_PAIRS = "pairs AS (SELECT g.doc_id, g.n AS gn, g.s AS gs, g.e AS ge, g.label AS gl, p.n AS pn, p.s AS ps, p.e AS pe, p.label AS pl, least(g.e,p.e)-greatest(g.s,p.s) AS shared FROM gold g JOIN pred p ON g.doc_id=p.doc_id AND g.s<p.e AND p.s<g.e)"


@query("ag_02_exact_typed", f"""WITH {fx.SQL}, x AS (SELECT coalesce(g.label, p.label) AS label, g.s IS NOT NULL AS g, p.s IS NOT NULL AS p FROM (SELECT DISTINCT doc_id, s, e, label FROM gold) g FULL JOIN (SELECT DISTINCT doc_id, s, e, label FROM pred) p
  ON g.doc_id=p.doc_id AND g.s=p.s AND g.e=p.e AND g.label=p.label), c AS (SELECT label, sum(CASE WHEN g AND p THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN NOT g THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN NOT p THEN 1 ELSE 0 END)::BIGINT AS fn FROM x GROUP BY ROLLUP(label))
  SELECT label, tp, fp, fn, {_PRF} FROM c""")
def ag_02(spark, d):
    return evaluate.exact(fx.gold(spark, d), fx.pred(spark, d))


@query("ag_05_near_misses", f"WITH {fx.SQL}, {_PAIRS}, fp AS (SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id=p.doc_id AND g.s=p.s AND g.e=p.e AND g.label=p.label)), fn AS (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE g.doc_id=p.doc_id AND g.s=p.s AND g.e=p.e AND g.label=p.label)) SELECT label, count(*) AS near_misses FROM fp WHERE EXISTS (SELECT 1 FROM fn WHERE fn.doc_id=fp.doc_id AND fn.s<fp.e AND fp.s<fn.e) GROUP BY label")
def ag_05(spark, d):
    keys = ["doc_id", "start", "end", "label"]
    g, p = fx.gold(spark, d), fx.pred(spark, d)
    fp, fn = p.join(g.select(keys), keys, "left_anti"), g.join(p.select(keys), keys, "left_anti").select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    return fp.join(fn, (F.col("doc_id") == F.col("d")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("near_misses"))


@query("ag_06_containment", f"WITH {fx.SQL}, {_PAIRS}, x AS (SELECT (SELECT count(*) FROM gold) AS n_gold, (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM (SELECT DISTINCT doc_id, pn FROM pairs WHERE gl=pl AND gs<=ps AND pe<=ge)) AS pred_right, (SELECT count(*) FROM (SELECT DISTINCT doc_id, gn FROM pairs WHERE gl=pl AND ps<=gs AND ge<=pe)) AS gold_found) SELECT *, pred_right/n_pred AS precision, gold_found/n_gold AS recall FROM x")
def ag_06(spark, d):
    return evaluate.contained(fx.gold(spark, d), fx.pred(spark, d))


@query("jn_09_range_join", f"WITH {fx.SQL}, {_PAIRS} SELECT doc_id, gn, pn, shared FROM pairs")
def jn_09(spark, d):
    return evaluate.pairs(fx.gold(spark, d), fx.pred(spark, d)).select("doc_id", "gn", "pn", "shared")


@query("ag_10_best_match", f"WITH {fx.SQL}, {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gn ORDER BY shared DESC, ps, pn, pl, gl) AS rn FROM pairs) SELECT doc_id, gn AS n, pn, shared, gl=pl AS same_label FROM r WHERE rn=1")
def ag_10(spark, d):
    return evaluate.best_match(fx.gold(spark, d), fx.pred(spark, d))


@query("ag_11_greedy_iou", f"""WITH RECURSIVE {fx.SQL}, {_PAIRS}, c AS (SELECT *, shared::DOUBLE/(greatest(ge,pe)-least(gs,ps)) AS iou FROM pairs WHERE gl=pl), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY iou DESC, gn, pn) AS rn FROM c WHERE iou>=0.5),
  fold(doc_id, rn, kept) AS (SELECT doc_id, rn, [struct_pack(gn:=gn, pn:=pn, iou:=iou)] FROM k WHERE rn=1 UNION ALL SELECT f.doc_id, k.rn, CASE WHEN len(list_filter(f.kept, lambda x: x.gn=k.gn OR x.pn=k.pn))=0 THEN list_append(f.kept, struct_pack(gn:=k.gn, pn:=k.pn, iou:=k.iou)) ELSE f.kept END FROM fold f JOIN k ON k.doc_id=f.doc_id AND k.rn=f.rn+1)
  SELECT doc_id, x.gn AS gn, x.pn AS pn, x.iou AS iou FROM (SELECT doc_id, unnest(kept) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn DESC) AS last FROM fold) WHERE last=1)""")
def ag_11(spark, d):
    return evaluate.greedy_match(fx.gold(spark, d), fx.pred(spark, d), 0.5)


@query("ag_14_multiset", f"WITH {fx.SQL}, g AS (SELECT doc_id, label, count(*) AS g FROM gold GROUP BY ALL), p AS (SELECT doc_id, label, count(*) AS p FROM pred GROUP BY ALL), x AS (SELECT coalesce(g,0) AS g, coalesce(p,0) AS p FROM g FULL JOIN p USING (doc_id, label)), c AS (SELECT sum(least(g,p))::BIGINT AS tp, sum(greatest(0,p-g))::BIGINT AS fp, sum(greatest(0,g-p))::BIGINT AS fn FROM x) SELECT tp, fp, fn, {_PRF} FROM c")
def ag_14(spark, d):
    return evaluate.multiset(fx.gold(spark, d), fx.pred(spark, d), "doc_id", "label")


_W = {"TFN": 3.0, "EMAIL": 2.0, "PERSON": 1.5}


@query("ag_04_redaction_cost", f"WITH {fx.SQL}, w AS (SELECT * FROM (VALUES ('TFN',3.0::DOUBLE),('EMAIL',2.0),('PERSON',1.5)) t(label, w)), o AS (SELECT label, sum((e-s)*coalesce(w,1)) AS c FROM (SELECT DISTINCT doc_id, s, e, label FROM pred EXCEPT SELECT doc_id, s, e, label FROM gold) LEFT JOIN w USING (label) GROUP BY label), u AS (SELECT label, sum((e-s)*coalesce(w,1)) AS c FROM (SELECT DISTINCT doc_id, s, e, label FROM gold EXCEPT SELECT doc_id, s, e, label FROM pred) LEFT JOIN w USING (label) GROUP BY label) SELECT label, coalesce(o.c,0)::DOUBLE AS over_cost, coalesce(u.c,0)::DOUBLE AS under_cost FROM o FULL JOIN u USING (label)")
def ag_04(spark, d):
    return evaluate.redaction_cost(fx.gold(spark, d), fx.pred(spark, d), _W)


@query("ag_18_audit", f"""WITH {fx.SQL}, {_PAIRS}, f AS (SELECT doc_id, pn, max(CASE WHEN gs=ps AND ge=pe AND gl=pl THEN 1 ELSE 0 END) AS a, max(CASE WHEN gs=ps AND ge=pe THEN 1 ELSE 0 END) AS b, max(CASE WHEN gl=pl THEN 1 ELSE 0 END) AS c FROM pairs GROUP BY 1,2),
  k AS (SELECT CASE WHEN a=1 THEN 'right' WHEN b=1 THEN 'type_mismatch' WHEN c=1 THEN 'boundary' ELSE 'false_positive' END AS kind FROM pred p LEFT JOIN f ON f.doc_id=p.doc_id AND f.pn=p.n UNION ALL SELECT 'false_negative' FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pairs x WHERE x.doc_id=g.doc_id AND x.gn=g.n))
  SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def ag_18(spark, d):
    return evaluate.errors(fx.gold(spark, d), fx.pred(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("ag_19_confusion_pivot", f"WITH {fx.SQL}, {_PAIRS} SELECT gl AS gold_label, " + ", ".join(f"sum(CASE WHEN pl='{x}' THEN 1 ELSE 0 END)::BIGINT AS \"{x}\"" for x in fx.LABELS) + " FROM pairs GROUP BY gl")
def ag_19(spark, d):
    return evaluate.pairs(fx.gold(spark, d), fx.pred(spark, d)).groupBy(F.col("gl").alias("gold_label")).pivot("pl", list(fx.LABELS)).count().fillna(0)


def _scored(spark, d):
    p, g = fx.pred(spark, d), fx.gold(spark, d).select("doc_id", "start", "end", "label", F.lit(1).alias("g"))
    return p.join(g, ["doc_id", "start", "end", "label"], "left").select("label", F.col("confidence").alias("score"), F.coalesce("g", F.lit(0)).alias("hit"))


_SCORED = "scored AS (SELECT p.label, p.confidence AS score, CASE WHEN g.s IS NULL THEN 0 ELSE 1 END AS hit FROM pred p LEFT JOIN gold g ON g.doc_id=p.doc_id AND g.s=p.s AND g.e=p.e AND g.label=p.label)"


@query("ag_21_reliability", f"WITH {fx.SQL}, {_SCORED} SELECT least(floor(score*10),9)::BIGINT AS bin, count(*) AS n, avg(score) AS mean_score, avg(hit) AS accuracy FROM scored GROUP BY 1")
def ag_21(spark, d):
    return calibrate.reliability(_scored(spark, d))


@query("ag_22_ece_half_open", f"WITH {fx.SQL}, {_SCORED}, b AS (SELECT ceil(score*10)-1 AS bin, count(*) AS n, avg(score) AS m, avg(hit) AS a FROM scored WHERE score>0 GROUP BY 1) SELECT sum(n/(SELECT count(*) FROM scored)*abs(m-a)) AS ece FROM b")
def ag_22(spark, d):
    return calibrate.ece(_scored(spark, d), half_open_left=True)


_SWEEP = "points AS (SELECT score AS threshold, sum(h) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS seen FROM (SELECT score, sum(hit) AS h, count(*) AS n FROM scored GROUP BY score)), sweep AS (SELECT threshold, tp, seen-tp AS fp, tp/seen AS precision, tp/(SELECT sum(hit) FROM scored) AS recall FROM points)"


@query("ag_23_threshold_sweep", f"WITH {fx.SQL}, {_SCORED}, {_SWEEP} SELECT * FROM sweep")
def ag_23(spark, d):
    return calibrate.sweep(_scored(spark, d))


@query("ag_24_operating_point", f"WITH {fx.SQL}, {_SCORED}, {_SWEEP} SELECT * FROM sweep WHERE precision>=0.5 ORDER BY recall DESC, threshold DESC LIMIT 1")
def ag_24(spark, d):
    return calibrate.operating_point(calibrate.sweep(_scored(spark, d)), "recall", "precision", 0.5)


@query("ag_27_label_grid", f"WITH {fx.SQL}, {_SCORED}, t AS (SELECT unnest(generate_series(5,85,5)) AS tau) SELECT label, tau::INT AS tau, sum(CASE WHEN floor(score*100)>=tau THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN floor(score*100)>=tau THEN hit ELSE 0 END)::BIGINT AS tp FROM scored CROSS JOIN t GROUP BY ALL")
def ag_27(spark, d):
    return calibrate.grid(_scored(spark, d), "label", range(5, 86, 5))


@query("ag_26_applied_thresholds", f"WITH {fx.SQL}, {_SCORED}, t AS (SELECT * FROM (VALUES ('EMAIL',0.3::DOUBLE),('PHONE',0.6)) v(label, thr)) SELECT label, count(*) AS n_before, sum(CASE WHEN score>=coalesce(thr,0.5) THEN 1 ELSE 0 END)::BIGINT AS n_after, sum(CASE WHEN score>=coalesce(thr,0.5) THEN hit ELSE 0 END)::BIGINT AS tp FROM scored LEFT JOIN t USING (label) GROUP BY label")
def ag_26(spark, d):
    t = spark.createDataFrame([("EMAIL", 0.3), ("PHONE", 0.6)], "label string, thr double")
    keep = F.col("score") >= F.coalesce("thr", F.lit(0.5))
    return _scored(spark, d).join(F.broadcast(t), "label", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n_before"), F.sum(keep.cast("int")).alias("n_after"), F.sum(F.when(keep, F.col("hit")).otherwise(0)).alias("tp"))


@query("ag_28_policy_grid", f"WITH {fx.SQL}, {_SCORED}, a AS (SELECT unnest([60,70,80,90]) AS hi), b AS (SELECT unnest([10,20,30,40]) AS lo) SELECT hi, lo, sum(CASE WHEN floor(score*100)>=hi THEN 1 ELSE 0 END)::BIGINT AS redacted, sum(CASE WHEN floor(score*100)<hi AND floor(score*100)>=lo THEN 1 ELSE 0 END)::BIGINT AS reviewed, sum(CASE WHEN floor(score*100)<lo THEN hit ELSE 0 END)::BIGINT AS missed FROM scored CROSS JOIN a CROSS JOIN b GROUP BY hi, lo")
def ag_28(spark, d):
    small = _scored(spark, d).groupBy(F.floor(F.col("score") * 100).alias("pc")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    x = small.withColumn("hi", F.explode(F.array(*map(F.lit, (60, 70, 80, 90))))).withColumn("lo", F.explode(F.array(*map(F.lit, (10, 20, 30, 40)))))
    s = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    return x.groupBy("hi", "lo").agg(s(F.col("pc") >= F.col("hi"), "n").alias("redacted"), s((F.col("pc") < F.col("hi")) & (F.col("pc") >= F.col("lo")), "n").alias("reviewed"), s(F.col("pc") < F.col("lo"), "h").alias("missed"))


@query("ag_40_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 1) AS p50, round(quantile_cont(o_totalprice, 0.95), 1) AS p95, round(quantile_cont(o_totalprice, 0.99), 1) AS p99 FROM orders GROUP BY 1")
def ag_40(spark, d):
    return fx.read(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.round(calibrate.percentile(F.col("o_totalprice"), p / 100), 1).alias(f"p{p}") for p in (50, 95, 99)])


@query("jn_01_outer_by_id", f"WITH {fx.SQL}, g AS (SELECT doc_id, count(*) AS n_gold FROM gold GROUP BY 1), p AS (SELECT doc_id, count(*) AS n_pred FROM pred GROUP BY 1) SELECT doc_id, coalesce(n_gold,0) AS n_gold, coalesce(n_pred,0) AS n_pred FROM g FULL JOIN p USING (doc_id)")
def jn_01(spark, d):
    g, p = fx.gold(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold")), fx.pred(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pred"))
    return g.join(p, "doc_id", "full_outer").fillna(0)


_OCC = "SELECT doc_id, sha1(text) AS h, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS occ FROM documents"


@query("jn_02_text_occurrence", f"WITH a AS ({_OCC} WHERE doc_id%3<>0), b AS ({_OCC} WHERE doc_id%2=0) SELECT a.doc_id AS left_id, b.doc_id AS right_id, occ FROM a FULL JOIN b USING (h, occ)")
def jn_02(spark, d):
    docs = fx.read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"))
    w = Window.partitionBy("h").orderBy("doc_id")
    a = docs.filter("doc_id % 3 <> 0").withColumn("occ", F.row_number().over(w)).withColumnRenamed("doc_id", "left_id")
    b = docs.filter("doc_id % 2 = 0").withColumn("occ", F.row_number().over(w)).withColumnRenamed("doc_id", "right_id")
    return a.join(b, ["h", "occ"], "full_outer").select("left_id", "right_id", "occ")


@query("jn_05_last_duplicate", "SELECT a.doc_id, b.last_id FROM documents a JOIN (SELECT text, max(doc_id) AS last_id FROM documents GROUP BY text) b USING (text)")
def jn_05(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).filter("h IS NOT NULL")
    return docs.join(docs.groupBy("h").agg(F.max("doc_id").alias("last_id")), "h").select("doc_id", "last_id")


@query("jn_08_dimension_lookup", "SELECT n_name, r_name, count(*) AS customers, avg(c_acctbal) AS mean_balance FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL")
def jn_08(spark, d):
    n, r = fx.read(spark, d, "nation"), fx.read(spark, d, "region")
    dims = n.join(r, n.n_regionkey == r.r_regionkey)
    c = fx.read(spark, d, "customer")
    return c.join(dims, c.c_nationkey == dims.n_nationkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("mean_balance"))


@query("jn_11_pending", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)")
def jn_11(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", "lang").join(fx.read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("jn_12_label_semi", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang='en')")
def jn_12(spark, d):
    return fx.read(spark, d, "labels").select("doc_id", "quality").join(fx.read(spark, d, "documents").filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi")


@query("jn_13_prompt_grid", "SELECT r_name, l.lang, k::INT AS rep FROM region CROSS JOIN (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT unnest(generate_series(1,4)) AS k)")
def jn_13(spark, d):
    langs = fx.read(spark, d, "documents").select("lang").distinct()
    return fx.read(spark, d, "region").select("r_name").crossJoin(langs).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(4))))


@query("jn_14_leakage", "WITH s AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, CASE WHEN doc_id%10<8 THEN 'train' WHEN doc_id%10=8 THEN 'dev' ELSE 'test' END AS split FROM documents) SELECT md5(k) AS h, count(DISTINCT split) AS n_splits, count(*) AS n FROM s GROUP BY k HAVING count(DISTINCT split)>1")
def jn_14(spark, d):
    from quillspan.functions.text import collapsed

    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "dev").otherwise("test")
    rows = fx.read(spark, d, "documents").select(F.md5(collapsed(F.col("text")).cast("binary")).alias("h"), split.alias("split"))
    return rows.groupBy("h").agg(F.countDistinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n")).filter("n_splits > 1")


@query("ag_01_prf_by_label", f"WITH {fx.SQL}, {_SCORED}, g AS (SELECT label, count(*) AS g FROM gold GROUP BY 1), c AS (SELECT label, sum(hit)::BIGINT AS tp, (count(*)-sum(hit))::BIGINT AS fp, any_value(g)-sum(hit)::BIGINT AS fn FROM scored JOIN g USING (label) GROUP BY label) SELECT label, tp, fp, fn, {_PRF} FROM c")
def ag_01(spark, d):
    g = fx.gold(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("g"))
    c = _scored(spark, d).groupBy("label").agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("n"))
    return evaluate.prf(c.join(g, "label").select("label", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn")))


@query("ag_20_prediction_class", f"WITH {fx.SQL}, {_PAIRS}, f AS (SELECT doc_id, pn, max(CASE WHEN gs=ps AND ge=pe AND gl=pl THEN 3 WHEN gl=pl THEN 2 ELSE 1 END) AS best FROM pairs GROUP BY 1,2) SELECT p.label, CASE best WHEN 3 THEN 'tp' WHEN 2 THEN 'fp_boundary' WHEN 1 THEN 'fp_type' ELSE 'fp' END AS class, count(*) AS n FROM pred p LEFT JOIN f ON f.doc_id=p.doc_id AND f.pn=p.n GROUP BY ALL")
def ag_20(spark, d):
    p = fx.pred(spark, d)
    best = F.max(F.when((F.col("gs") == F.col("ps")) & (F.col("ge") == F.col("pe")) & (F.col("gl") == F.col("pl")), 3).when(F.col("gl") == F.col("pl"), 2).otherwise(1))
    f = evaluate.pairs(fx.gold(spark, d), p).groupBy("doc_id", F.col("pn").alias("n")).agg(best.alias("best"))
    kind = F.when(F.col("best") == 3, "tp").when(F.col("best") == 2, "fp_boundary").when(F.col("best") == 1, "fp_type").otherwise("fp")
    return p.join(f, ["doc_id", "n"], "left").groupBy("label", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("ag_08_label_recall_chars", f"""WITH {fx.SQL}, i AS (SELECT *, sum(CASE WHEN b IS NULL OR s>b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM pred)),
  m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, isle), c AS (SELECT g.label, g.e-g.s AS len, coalesce(sum(greatest(0, least(g.e,m.e)-greatest(g.s,m.s))),0) AS cov FROM gold g LEFT JOIN m ON m.doc_id=g.doc_id AND g.s<m.e AND m.s<g.e GROUP BY g.doc_id, g.n, g.label, g.s, g.e)
  SELECT label, sum(len)::BIGINT AS chars, sum(cov)::BIGINT AS covered, sum(cov)/sum(len) AS recall FROM c GROUP BY label""")
def ag_08(spark, d):
    from quillspan.operators.overlap import covered_length

    c = covered_length(fx.gold(spark, d), fx.pred(spark, d)).groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum("covered").alias("covered"))
    return c.withColumn("recall", F.col("covered") / F.col("chars"))
