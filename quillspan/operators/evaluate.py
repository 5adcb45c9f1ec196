"""Matching of gold and predicted spans, and the metrics on top. Inputs: doc_id, n, start, end, label (pred: confidence too).

Joins are equi-joins on the document with a range predicate on top, never a product of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """df with precision, recall and f of its columns tp, fp, fn; 0 where undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumn("precision", p).withColumn("recall", r)
    b = beta * beta
    return df.withColumn("f", ratio((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")))


def exact(gold: DataFrame, pred: DataFrame, typed: bool = True) -> DataFrame:
    """Set metrics of identical spans, overall (label null) and by label, in one grouping-sets aggregate."""
    keys = ["doc_id", "start", "end", "label"] if typed else ["doc_id", "start", "end"]
    g, p = gold.select(keys).distinct().withColumn("g", F.lit(1)), pred.select(keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full_outer").withColumn("label", F.col("label") if typed else F.lit("any"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = both.rollup("label").agg(one(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), one(F.col("g").isNull()).alias("fp"), one(F.col("p").isNull()).alias("fn"))
    return prf(out)


def pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Overlapping (gold, pred) of a document: doc_id, gn, gs, ge, gl, pn, ps, pe, pl, shared."""
    g = gold.select("doc_id", F.col("n").alias("gn"), F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("label").alias("gl"))
    p = pred.select(F.col("doc_id").alias("d"), F.col("n").alias("pn"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("label").alias("pl"))
    both = g.join(p, (F.col("doc_id") == F.col("d")) & (F.col("gs") < F.col("pe")) & (F.col("ps") < F.col("ge"))).drop("d")
    return both.withColumn("shared", F.least("ge", "pe") - F.greatest("gs", "ps"))


def contained(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Containment: a prediction is right inside a gold span of its label, a gold span is found inside a prediction. The two
    sides are different matchings."""
    p = pairs(gold, pred).filter("gl = pl")
    good_p = p.filter("gs <= ps AND pe <= ge").agg(F.countDistinct("doc_id", "pn").alias("pred_right"))
    good_g = p.filter("ps <= gs AND ge <= pe").agg(F.countDistinct("doc_id", "gn").alias("gold_found"))
    n = gold.agg(F.count(F.lit(1)).alias("n_gold")).crossJoin(pred.agg(F.count(F.lit(1)).alias("n_pred")))
    out = n.crossJoin(good_p).crossJoin(good_g)
    return out.withColumn("precision", ratio(F.col("pred_right"), F.col("n_pred"))).withColumn("recall", ratio(F.col("gold_found"), F.col("n_gold")))


def best_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each gold span with the prediction that shares most with it (ties: earlier, then smaller n, then by label); predictions can serve several."""
    w = Window.partitionBy("doc_id", "gn").orderBy(F.col("shared").desc(), "ps", "pn", "pl", "gl")
    best = pairs(gold, pred).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return best.select("doc_id", F.col("gn").alias("n"), "pn", "shared", (F.col("gl") == F.col("pl")).alias("same_label"))


def greedy_match(gold: DataFrame, pred: DataFrame, min_iou: float = 0.0) -> DataFrame:
    """One-to-one matches by falling IoU (ties by place), as a fold over a document's candidate pairs."""
    iou = F.col("shared") / (F.greatest("ge", "pe") - F.least("gs", "ps"))
    cand = pairs(gold, pred).filter("gl = pl").withColumn("iou", iou).filter(F.col("iou") >= min_iou)
    rows = cand.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "gn", "pn", "iou"))).alias("c"))
    none = F.filter("c", lambda _: F.lit(False))
    taken = F.aggregate("c", none, lambda kept, x: F.when(F.exists(kept, lambda k: (k["gn"] == x["gn"]) | (k["pn"] == x["pn"])), kept).otherwise(F.array_append(kept, x)))
    return rows.select("doc_id", F.explode(taken).alias("x")).select("doc_id", "x.gn", "x.pn", "x.iou")


def errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Audit of predictions and misses: type_mismatch, boundary, false_positive, false_negative (in this order)."""
    g, p = gold.select("doc_id", "n", "start", "end", "label"), pred.select("doc_id", "n", "start", "end", "label")
    cover = pairs(g, p)
    same = F.col("gs").eqNullSafe(F.col("ps")) & F.col("ge").eqNullSafe(F.col("pe"))
    flags = cover.groupBy("doc_id", F.col("pn").alias("n")).agg(F.max(same & (F.col("gl") == F.col("pl"))).alias("right"), F.max(same).alias("span"), F.max(F.col("gl") == F.col("pl")).alias("touch"))
    kind = F.when(F.col("right"), "right").when(F.col("span"), "type_mismatch").when(F.col("touch"), "boundary").otherwise("false_positive")
    out_p = p.join(flags, ["doc_id", "n"], "left").select("doc_id", kind.alias("kind"))
    missed = g.join(cover.select("doc_id", F.col("gn").alias("n")).distinct(), ["doc_id", "n"], "left_anti").select("doc_id", F.lit("false_negative").alias("kind"))
    return out_p.unionByName(missed)


def multiset(gold: DataFrame, pred: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn of multisets of keys: the counts' minimum and what is over on either side."""
    g, p = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g")), pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    both = g.join(p, list(keys), "full_outer").fillna(0, ["g", "p"])
    return prf(both.agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.lit(0), F.col("p") - F.col("g"))).alias("fp"), F.sum(F.greatest(F.lit(0), F.col("g") - F.col("p"))).alias("fn")))


def redaction_cost(gold: DataFrame, pred: DataFrame, weights: dict[str, float]) -> DataFrame:
    """By label: characters of wrong and of missed spans times the label's weight."""
    keys = ["doc_id", "start", "end", "label"]
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    cost = F.sum((F.col("end") - F.col("start")) * F.coalesce(F.try_element_at(w, F.col("label")), F.lit(1.0)))
    over = pred.select(keys).distinct().join(gold.select(keys), keys, "left_anti").groupBy("label").agg(cost.alias("over_cost"))
    under = gold.select(keys).distinct().join(pred.select(keys), keys, "left_anti").groupBy("label").agg(cost.alias("under_cost"))
    return over.join(under, "label", "full_outer").fillna(0.0)
