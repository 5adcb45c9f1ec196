"""Row matching between files, token metrics, offset conversion, label dimensions and training targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least share of common ids for matching by id.
ID_OVERLAP = 0.80


def occurrence(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """df with __hash of the text and __nth, the number of the row among those of equal text."""
    x = df.withColumn("__hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return x.withColumn("__nth", F.row_number().over(Window.partitionBy("__hash").orderBy(order_col)))


def strategy(gold: DataFrame, pred: DataFrame, id_col: str, text_col: str) -> str:
    """How two files match: by id if 80 % of the gold ids are predicted, else by text if any text is common, else by order.
    Two small aggregates decide; no rows come to the driver."""
    ids, keys = gold.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), pred.select(F.col(id_col)).distinct().withColumn("__here", F.lit(1))
    n, both = ids.join(keys, id_col, "left").agg(F.count(F.lit(1)), F.count("__here")).collect()[0]
    if n and both >= ID_OVERLAP * n:
        return "id"
    return "order" if gold.select(text_col).join(pred.select(text_col), text_col, "left_semi").isEmpty() else "text"


def auto_matched(gold: DataFrame, pred: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """strategy, gold id and pred id of the full outer match by the strategy that suits; equal texts pair up in id order."""
    how = strategy(gold, pred, id_col, text_col)
    if how == "id":
        a, b, on = gold.withColumn("__k", F.col(id_col)), pred.withColumn("__k", F.col(id_col)), ["__k"]
    elif how == "text":
        a, b, on = occurrence(gold, text_col, id_col), occurrence(pred, text_col, id_col), ["__hash", "__nth"]
    else:
        a, b = (x.withColumn("__hash", F.lit("")).withColumn("__nth", F.row_number().over(Window.orderBy(id_col))) for x in (gold, pred))
        on = ["__hash", "__nth"]
    a, b = a.select(*on, F.col(id_col).alias("gold_id")), b.select(*on, F.col(id_col).alias("pred_id"))
    return a.join(b, on, "full").select(F.lit(how).alias("strategy"), "gold_id", "pred_id")


def case_verdicts(cases: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Cases that have a verdict, with its columns."""
    return cases.join(verdicts, key)


def with_predictions(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """All rows with their prediction's columns and status: ok, or failed where there is none."""
    return rows.join(predictions.withColumn("__there", F.lit(True)), key, "left").withColumn("status", F.when(F.col("__there"), "ok").otherwise("failed")).drop("__there")


def token_metrics(tokens: DataFrame, gold: str = "gold", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """One row for each label of tokens (-1: any label but 0, where only detection counts): tp, fp, fn, and over all tokens
    accuracy and loss (mean negative log of the probability given to the gold label). One pass; counts are added map-side."""
    g, p = F.col(gold), F.col(pred)
    either = F.array_distinct(F.array(g, p, F.when((g != 0) | (p != 0), F.lit(-1)).otherwise(0)))
    x = tokens.select(g.alias("g"), p.alias("p"), F.explode(F.filter(either, lambda c: c != 0)).alias("label"))
    on = lambda c: F.when(F.col("label") == -1, F.col(c) != 0).otherwise(F.col(c) == F.col("label"))
    count = lambda cond: F.sum(cond.cast("long"))
    counts = x.groupBy("label").agg(count(on("g") & on("p")).alias("tp"), count(~on("g") & on("p")).alias("fp"), count(on("g") & ~on("p")).alias("fn"))
    overall = tokens.agg(F.avg((g == p).cast("double")).alias("accuracy"), F.avg(-F.log(F.col(prob))).alias("loss"))
    return counts.crossJoin(F.broadcast(overall))


def voided(spans: Column, round_trip_ok: Column) -> Column:
    """Spans of an answer; none if the answer's text didn't come back as it was."""
    return F.when(round_trip_ok, spans).otherwise(F.filter(spans, lambda _: F.lit(False)))


def soft_targets(weights: Column, factor: Column) -> Column:
    """array<struct<label,weight>> with weights that add up to factor; none if they add up to 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x["weight"])
    return F.when(total > 0, F.transform(weights, lambda x: F.struct(x["label"].alias("label"), (x["weight"] / total * factor).alias("weight"))))


def char_offset(text: Column, byte_offset: Column) -> Column:
    """Code points before a byte offset of the text's UTF-8."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_offset), "UTF-8"))


def byte_offset(text: Column, offset: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), offset))


def char_span(text: Column, byte_start: Column, byte_end: Column) -> Column:
    """struct<start,end> in code points of a span in bytes, without white space at its ends."""
    start, end = char_offset(text, byte_start), char_offset(text, byte_end)
    own = F.substring(text, start + 1, end - start)
    left = F.length(own) - F.length(F.regexp_replace(own, r"^\s+", ""))
    right = F.length(own) - F.length(F.regexp_replace(own, r"\s+$", ""))
    return F.struct((start + left).cast("int").alias("start"), (end - right).cast("int").alias("end"))


def token_range(tokens: Column, start: Column, end: Column) -> Column:
    """struct<first,last> of the tokens (array<struct<start,end>>) that a span of characters touches; nulls if none."""
    hit = F.filter(F.transform(tokens, lambda t, k: F.when((t["start"] < end) & (t["end"] > start), k)), lambda k: k.isNotNull())
    return F.struct(F.array_min(hit).alias("first"), F.array_max(hit).alias("last"))


def windows(length: Column, size: int, overlap: int) -> Column:
    """array<struct<start,end>> of windows of `size` that overlap by `overlap` and cover the length; none for length 0."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - size) / F.lit(step)).cast("int")))
    out = F.transform(starts, lambda k: F.struct((k * step).cast("int").alias("start"), F.least(length, k * step + size).cast("int").alias("end")))
    return F.when(length > 0, out).otherwise(F.filter(out, lambda _: F.lit(False)))


def line_pieces(value: Column, start: Column) -> Column:
    """array<struct<start,end,value>>: a span's value cut at line ends, without spaces at the pieces' ends and without empty ones."""
    lines = F.split(value, "\n")
    joined = F.aggregate(
        lines, F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x) + 1).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x) - F.length(F.ltrim(x))).cast("int").alias("start"), (acc["at"] + F.length(F.rtrim(x))).cast("int").alias("end"), F.trim(x).alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.filter(joined, lambda s: s["value"] != "")


def aliased(spans: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """spans with the label's canonical name and a note of the old one; the alias table is a literal map, so nothing is joined."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.lit(None).cast("map<string,string>")
    new = F.try_element_at(table, F.col("label"))
    return spans.withColumn("note", F.when(new.isNotNull(), F.concat(F.lit("alias_of:"), "label"))).withColumn("label", F.coalesce(new, "label"))


#: Weights of data classifications.
CLASS_WEIGHTS = {"restricted": 1.0, "sensitive": 0.5, "public": 0.0}


def classified(spans: DataFrame, classes: DataFrame, default: str = "sensitive") -> DataFrame:
    """spans with classification (their own, else their label's in classes (label, data_classification), else the default) and its weight."""
    x = spans.join(classes.select("label", F.col("data_classification").alias("__of")), "label", "left")
    own = F.coalesce(F.lower("data_classification"), F.lower("__of"), F.lit(default))
    weight = F.coalesce(*[F.when(F.col("data_classification") == k, v) for k, v in CLASS_WEIGHTS.items()], F.lit(CLASS_WEIGHTS[default]))
    return x.withColumn("data_classification", own).withColumn("class_weight", weight).drop("__of")


def source_key(record: Column, span: Column, default: str = "unknown") -> Column:
    """Where a training span comes from: its own source counts before its record's."""
    return F.coalesce(F.nullif(F.trim(span), F.lit("")), F.nullif(F.trim(record), F.lit("")), F.lit(default))


def stable_id(*parts: Column) -> Column:
    """SHA-256 over the parts with their lengths, so that no two lists of parts run together; nulls differ from empty parts."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def of_targets(spans: DataFrame, targets: list[str]) -> DataFrame:
    return spans.filter(F.col("label").isin(targets))


def in_order(spans: Column) -> Column:
    """Spans by start, longer ones first, then by label."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["label"].alias("c"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def buckets(spans: Column, low: float, high: float) -> Column:
    """struct of the spans to redact (confidence of at least high), to review (at least low) and to ignore."""
    c = lambda s: F.coalesce(s["confidence"], F.lit(0.0))
    return F.struct(F.filter(spans, lambda s: c(s) >= high).alias("redact"), F.filter(spans, lambda s: (c(s) >= low) & (c(s) < high)).alias("review"), F.filter(spans, lambda s: c(s) < low).alias("ignore"))


def entity_scores(tokens: DataFrame, top: int = 3, digits: int = 9) -> DataFrame:
    """Of tokens (doc_id, span, tag, prob, tags as B-X, I-X, E-X, S-X): for each span the entities with the greatest sum of their
    tags' mean probabilities, by rank. Sums are rounded before they are ranked: equal ones that the order of adding parts are ties, which go by name."""
    mean = tokens.filter(F.col("tag").rlike("^[BIES]-")).groupBy("doc_id", "span", "tag").agg(F.avg("prob").alias("p"))
    entity = mean.groupBy("doc_id", "span", F.substring("tag", 3, 1000).alias("entity")).agg(F.round(F.sum("p"), digits).alias("score"))
    w = Window.partitionBy("doc_id", "span").orderBy(F.desc("score"), "entity")
    return entity.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
