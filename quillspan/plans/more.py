"""Further matching, taxonomy and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import distributions
from quillspan.operators import calibrate, evaluate, overlap
from quillspan.plans import fixtures as fx
from quillspan.plans.metrics import _PAIRS, _SCORED, _scored

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _greedy_sql(where: str, order: str, out: str) -> str:
    return f"""WITH RECURSIVE {fx.SQL}, {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rn FROM pairs {where}),
  fold(doc_id, rn, kept) AS (SELECT doc_id, rn, [struct_pack(gn:=gn, pn:=pn, gl:=gl, pl:=pl)] FROM k WHERE rn=1 UNION ALL SELECT f.doc_id, k.rn, CASE WHEN len(list_filter(f.kept, lambda x: x.gn=k.gn OR x.pn=k.pn))=0 THEN list_append(f.kept, struct_pack(gn:=k.gn, pn:=k.pn, gl:=k.gl, pl:=k.pl)) ELSE f.kept END FROM fold f JOIN k ON k.doc_id=f.doc_id AND k.rn=f.rn+1),
  m AS (SELECT doc_id, x.gn AS gn, x.pn AS pn, x.gl AS gl, x.pl AS pl FROM (SELECT doc_id, unnest(kept) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn DESC) AS last FROM fold) WHERE last=1))
  {out}"""


def _greedy(pairs, *order: str):
    """One-to-one matches of a document's pairs in the given order."""
    rows = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("gl").alias("g_label"), F.col("pl").alias("p_label"), F.col("gn").alias("g_n"), F.col("pn").alias("p_n")))).alias("c"))
    none = F.filter("c", lambda _: F.lit(False))
    kept = F.aggregate("c", none, lambda acc, x: F.when(F.exists(acc, lambda k: (k["g_n"] == x["g_n"]) | (k["p_n"] == x["p_n"])), acc).otherwise(F.array_append(acc, x)))
    return rows.select("doc_id", F.explode(kept).alias("x")).select("doc_id", F.col("x.g_n").alias("gn"), F.col("x.p_n").alias("pn"), F.col("x.g_label").alias("gl"), F.col("x.p_label").alias("pl"))


@query("ag_03_partial_greedy", _greedy_sql("WHERE gl=pl", "gs, ge, gn, ps, pe, pn, gl, pl", "SELECT doc_id, gn, pn FROM m"))
def ag_03(spark, d):
    p = evaluate.pairs(fx.gold(spark, d), fx.pred(spark, d)).filter("gl = pl")
    return _greedy(p, "gs", "ge", "gn", "ps", "pe", "pn").select("doc_id", "gn", "pn")


@query("ag_09_type_accuracy", _greedy_sql("", "gs, ge, gn, ps, pe, pn, gl, pl", "SELECT gl AS label, count(*) AS matched, sum(CASE WHEN gl=pl THEN 1 ELSE 0 END)::BIGINT AS same_type, avg(CASE WHEN gl=pl THEN 1.0 ELSE 0 END)::DOUBLE AS accuracy FROM m GROUP BY gl"))
def ag_09(spark, d):
    m = _greedy(evaluate.pairs(fx.gold(spark, d), fx.pred(spark, d)), "gs", "ge", "gn", "ps", "pe", "pn")
    same = (F.col("gl") == F.col("pl")).cast("int")
    return m.groupBy(F.col("gl").alias("label")).agg(F.count(F.lit(1)).alias("matched"), F.sum(same).alias("same_type"), F.avg(same.cast("double")).alias("accuracy"))


def _isles(of: str) -> str:
    return f"""SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN b IS NULL OR s>b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle
  FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {of})) GROUP BY doc_id, isle"""


@query("ag_13_char_costs", f"""WITH {fx.SQL}, mg AS ({_isles("gold")}), mp AS ({_isles("pred")}), o AS (SELECT p.e-p.s AS len, coalesce(sum(greatest(0, least(p.e,m.e)-greatest(p.s,m.s))),0) AS cov FROM mp p LEFT JOIN mg m ON m.doc_id=p.doc_id AND p.s<m.e AND m.s<p.e GROUP BY p.doc_id, p.s, p.e),
  u AS (SELECT g.e-g.s AS len, coalesce(sum(greatest(0, least(g.e,m.e)-greatest(g.s,m.s))),0) AS cov FROM mg g LEFT JOIN mp m ON m.doc_id=g.doc_id AND g.s<m.e AND m.s<g.e GROUP BY g.doc_id, g.s, g.e)
  SELECT (SELECT sum(len-cov)/sum(len) FROM o) AS over_rate, (SELECT sum(len-cov)/sum(len) FROM u) AS under_rate""")
def ag_13(spark, d):
    g, p = (overlap.merged_intervals(x(spark, d).select("doc_id", "start", "end"), "doc_id").drop("n") for x in (fx.gold, fx.pred))
    rate = lambda t, c, name: overlap.covered_length(t, c).agg((F.sum(F.col("end") - F.col("start") - F.col("covered")) / F.sum(F.col("end") - F.col("start"))).alias(name))
    return rate(p, g, "over_rate").crossJoin(rate(g, p, "under_rate"))


@query("ag_15_exact_samples", f"WITH {fx.SQL}, g AS (SELECT doc_id, list_sort(list(DISTINCT label || s)) AS g FROM gold GROUP BY 1), p AS (SELECT doc_id, list_sort(list(DISTINCT label || s)) AS p FROM pred GROUP BY 1) SELECT count(*) AS docs, sum(CASE WHEN coalesce(g,[])=coalesce(p,[]) THEN 1 ELSE 0 END)::BIGINT AS exact FROM g FULL JOIN p USING (doc_id)")
def ag_15(spark, d):
    own = lambda x, c: x.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.concat("label", F.col("start").cast("string")))).alias(c))
    both = own(fx.gold(spark, d), "g").join(own(fx.pred(spark, d), "p"), "doc_id", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce((F.col("g") == F.col("p")).cast("int"), F.lit(0))).alias("exact"))


@query("ag_17_error_taxonomy", f"""WITH {fx.SQL}, g AS (SELECT DISTINCT doc_id, label, 'v' || s AS v FROM gold), p AS (SELECT DISTINCT doc_id, label, 'v' || s AS v FROM pred), fp AS (SELECT * FROM p EXCEPT SELECT * FROM g),
  r AS (SELECT fp.doc_id, fp.label, fp.v, min(CASE WHEN g.v=fp.v THEN 1 WHEN g.label=fp.label AND starts_with(fp.v, g.v) THEN 2 WHEN g.label=fp.label THEN 3 ELSE 4 END) AS k FROM fp JOIN g ON g.doc_id=fp.doc_id AND (contains(g.v, fp.v) OR contains(fp.v, g.v)) GROUP BY 1,2,3)
  SELECT CASE k WHEN 1 THEN 'same_value_other_type' WHEN 2 THEN 'same_type_prefix' WHEN 3 THEN 'same_type_related' WHEN 4 THEN 'other_type_related' ELSE 'extra' END AS kind, count(*) AS n FROM fp LEFT JOIN r USING (doc_id, label, v) GROUP BY 1""")
def ag_17(spark, d):
    """False positives by their nearest relation to a gold value; related: one holds the other."""
    pair = lambda x: x.select("doc_id", "label", F.concat(F.lit("v"), F.col("start").cast("string")).alias("v")).distinct()
    g, p = pair(fx.gold(spark, d)), pair(fx.pred(spark, d))
    fp = p.join(g, ["doc_id", "label", "v"], "left_anti")
    g = g.select(F.col("doc_id").alias("d"), F.col("label").alias("gl"), F.col("v").alias("gv"))
    rank = F.when(F.col("gv") == F.col("v"), 1).when((F.col("gl") == F.col("label")) & F.startswith("v", "gv"), 2).when(F.col("gl") == F.col("label"), 3).otherwise(4)
    r = fp.join(g, (F.col("doc_id") == F.col("d")) & (F.contains("gv", "v") | F.contains("v", "gv"))).groupBy("doc_id", "label", "v").agg(F.min(rank).alias("k"))
    kind = F.when(F.col("k") == 1, "same_value_other_type").when(F.col("k") == 2, "same_type_prefix").when(F.col("k") == 3, "same_type_related").when(F.col("k") == 4, "other_type_related").otherwise("extra")
    return fp.join(r, ["doc_id", "label", "v"], "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("ag_25_type_thresholds", f"WITH {fx.SQL}, {_SCORED}, c AS (SELECT label, count(*) AS n, sum(hit) AS h, min(CASE WHEN hit=1 THEN score END) AS lowest FROM scored GROUP BY label), g AS (SELECT min(CASE WHEN hit=1 THEN score END) AS lowest FROM scored) SELECT label, CASE WHEN h<700 THEN g.lowest ELSE c.lowest END AS threshold, h<700 AS fallback FROM c, g")
def ag_25(spark, d):
    """Lowest right score by type; types with fewer than 700 right spans take the global one."""
    s = _scored(spark, d)
    low = F.min(F.when(F.col("hit") == 1, F.col("score")))
    c, g = s.groupBy("label").agg(F.sum("hit").alias("h"), low.alias("own")), s.agg(low.alias("all"))
    few = F.col("h") < 700
    return c.crossJoin(F.broadcast(g)).select("label", F.when(few, F.col("all")).otherwise(F.col("own")).alias("threshold"), few.alias("fallback"))


@query("ag_30_classification", """WITH x AS (SELECT vec_id, label, embedding[1:10]::DOUBLE[] AS z FROM embeddings), s AS (SELECT *, list_transform(z, lambda v: exp(v)) AS e FROM x), p AS (SELECT vec_id, label, list_transform(e, lambda v: v/list_sum(e)) AS p FROM s)
  SELECT label, count(*) AS n, round(avg(CASE WHEN list_position(p, list_max(p))-1=label THEN 1.0 ELSE 0 END), 6)::DOUBLE AS accuracy, round(avg(-ln(p[label+1])), 6) AS nll, round(avg(list_sum(list_transform(p, lambda v: v*v)) - 2*p[label+1] + 1), 6) AS brier FROM p GROUP BY label""")
def ag_30(spark, d):
    x = fx.read(spark, d, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda v: F.exp(v.cast("double"))).alias("e"))
    p = x.withColumn("t", distributions.total(F.col("e"))).select("label", F.transform("e", lambda v: v / F.col("t")).alias("p"))
    own = F.element_at("p", F.col("label") + 1)
    right = (F.array_position("p", F.array_max("p")) - 1 == F.col("label")).cast("double")
    brier = distributions.total(F.transform("p", lambda v: v * v)) - 2 * own + 1
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(-F.log(own)), 6).alias("nll"), F.round(F.avg(brier), 6).alias("brier"))


@query("ag_35_validation_report", f"WITH {fx.SQL}, e AS (SELECT doc_id, n, unnest(list_filter([CASE WHEN e-s>14 THEN 'long' END, CASE WHEN s%5=0 THEN 'aligned' END], lambda x: x IS NOT NULL)) AS error FROM gold) SELECT error, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY error")
def ag_35(spark, d):
    g = fx.gold(spark, d)
    errors = F.filter(F.array(F.when(F.col("end") - F.col("start") > 14, "long"), F.when(F.col("start") % 5 == 0, "aligned")), lambda x: x.isNotNull())
    return g.select("doc_id", F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("ag_41_severity", "SELECT event_type, count(*) AS n, avg(CASE WHEN value>40 THEN 1.0 ELSE 0 END)::DOUBLE AS pass_rate, CASE WHEN avg(CASE WHEN value>40 THEN 1.0 ELSE 0 END)<0.3 THEN 'severe' ELSE 'normal' END AS severity FROM events GROUP BY 1")
def ag_41(spark, d):
    rate = F.avg((F.col("value") > 40).cast("double"))
    return fx.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rate.alias("pass_rate"), F.when(rate < 0.3, "severe").otherwise("normal").alias("severity"))


@query("typ_02_risk", "WITH c AS (SELECT o_custkey, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, k, n/sum(n) OVER (PARTITION BY o_custkey) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, k) AS rn FROM c) SELECT o_custkey, max(CASE WHEN rn=1 THEN k END) AS top_label, round(greatest(0, 1-sum(CASE WHEN rn<=3 THEN p ELSE 0 END)), 9)::DOUBLE AS uncertainty FROM p GROUP BY 1")
def typ_02(spark, d):
    c = fx.read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").count()
    m = c.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.col("count").cast("double")))).alias("m")).withColumn("m", distributions.normalised(F.col("m")))
    return m.select("o_custkey", distributions.ranked(F.col("m"))[0]["key"].alias("top_label"), F.round(distributions.uncertainty(F.col("m")), 9).alias("uncertainty"))


@query("typ_11_high_value_mask", "WITH q AS (SELECT quantile_disc(o_totalprice, 0.9) AS q FROM orders) SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice>q")
def typ_11(spark, d):
    """Rows above an order statistic, found by an exact percentile and a broadcast of one row."""
    o = fx.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    q = o.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice)").alias("q"))
    return o.join(F.broadcast(q), F.col("o_totalprice") > F.col("q")).drop("q")


@query("det_07_encoded_emails", "SELECT doc_id, unnest(regexp_extract_all(replace(text, '@', '%40'), '[A-Za-z0-9._%+-]+%40[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS value FROM documents")
def det_07(spark, d):
    t = F.replace(F.col("text"), F.lit("@"), F.lit("%40"))
    return fx.read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9._%+-]+%40[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), F.lit(0))).alias("value"))


@query("det_15_nearest_occurrence", f"""WITH {fx.SQL_DETECTED}, c AS (SELECT f.doc_id, f.value, f.s + 3 AS claimed, text FROM found f JOIN documents d ON d.doc_id=f.doc_id), o AS (SELECT doc_id, value, claimed, unnest(list_filter(generate_series(0, length(text)-length(value)), lambda i: substr(text, i+1, length(value))=value)) AS pos FROM c)
  SELECT doc_id, value, claimed::BIGINT AS claimed, arg_min(pos, abs(pos-claimed)*10000000 + pos)::BIGINT AS "start" FROM o GROUP BY doc_id, value, claimed""")
def det_15(spark, d):
    """The occurrence nearest to a claimed place; ties go to the earlier one."""
    x = fx.detected(spark, d).select("doc_id", "text", F.explode("spans").alias("x")).select("doc_id", "text", F.col("x.value").alias("value"), (F.col("x.start") + 3).alias("claimed"))
    places = F.filter(F.sequence(F.lit(0), F.length("text") - F.length("value")), lambda i: F.substring(F.col("text"), i + 1, F.length("value")) == F.col("value"))
    best = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - F.col("claimed")).alias("d"), i.alias("at"))))["at"]
    return x.select("doc_id", "value", F.col("claimed").cast("long").alias("claimed"), best.cast("long").alias("start")).distinct()


@query("ag_31_breakdown", f"WITH {fx.SQL}, {_SCORED} SELECT label, CASE WHEN score>=0.5 THEN 'high' ELSE 'low' END AS band, count(*) AS n, avg(hit) AS accuracy FROM scored GROUP BY GROUPING SETS ((label), (label, band), ())")
def ag_31(spark, d):
    s = _scored(spark, d).withColumn("band", F.when(F.col("score") >= 0.5, "high").otherwise("low"))
    s.createOrReplaceTempView("quillspan_scored")
    return spark.sql("SELECT label, band, count(*) AS n, avg(hit) AS accuracy FROM quillspan_scored GROUP BY GROUPING SETS ((label), (label, band), ())")


@query("jn_03_positional", "WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id FROM labels), b AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id FROM documents WHERE lang='en') SELECT count(*) AS pairs, sum(CASE WHEN a.doc_id IS DISTINCT FROM b.doc_id THEN 1 ELSE 0 END)::BIGINT AS mismatches FROM a FULL JOIN b USING (i)")
def jn_03(spark, d):
    """Rows paired by rank. Ranks come from range partitions' counts and places within them, not from one sorted task."""
    def ranked(df, name):
        p = df.select("doc_id").repartitionByRange("doc_id").withColumn("r", F.spark_partition_id())
        sizes = p.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
        place = F.row_number().over(Window.partitionBy("r").orderBy("doc_id"))
        return p.join(F.broadcast(before), "r").select((F.col("b") + place).alias("i"), F.col("doc_id").alias(name))

    a, b = ranked(fx.read(spark, d, "labels"), "x"), ranked(fx.read(spark, d, "documents").filter("lang = 'en'"), "y")
    return a.join(b, "i", "full_outer").agg(F.count(F.lit(1)).alias("pairs"), F.sum((~F.col("x").eqNullSafe(F.col("y"))).cast("int")).alias("mismatches"))


@query("ag_24_precise_point", f"WITH {fx.SQL}, {_SCORED}, p AS (SELECT score AS threshold, sum(h) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS seen FROM (SELECT score, sum(hit) AS h, count(*) AS n FROM scored GROUP BY score)), s AS (SELECT threshold, tp, seen-tp AS fp, tp/seen AS precision, tp/(SELECT sum(hit) FROM scored) AS recall FROM p) SELECT * FROM s WHERE recall>=0.5 ORDER BY precision DESC, threshold DESC LIMIT 1")
def ag_24b(spark, d):
    return calibrate.operating_point(calibrate.sweep(_scored(spark, d)), "precision", "recall", 0.5)
