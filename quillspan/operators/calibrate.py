"""Calibration: reliability, threshold sweeps, operating points. Input rows: score, hit (0 or 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reliability(rows: DataFrame, bins: int = 10, half_open_left: bool = False) -> DataFrame:
    """Bins of scores: floor(score x bins), the last closed, or (lo, hi] without 0: bin, n, mean_score, accuracy."""
    b = F.ceil(F.col("score") * bins) - 1 if half_open_left else F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    rows = rows.filter("score > 0") if half_open_left else rows
    return rows.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("hit").alias("accuracy"))


def ece(rows: DataFrame, bins: int = 10, half_open_left: bool = False) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return reliability(rows, bins, half_open_left).crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("mean_score") - F.col("accuracy"))).alias("ece"))


def sweep(rows: DataFrame) -> DataFrame:
    """For each distinct score as threshold: tp, fp, precision, recall. Counts are summed by score first, and the running sum
    goes over the distinct scores in ranges: sums of each range, then within it, so no task sorts all rows."""
    points = rows.groupBy("score").agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    ranged = points.withColumn("r", F.floor(F.col("score") * 64))
    before = ranged.groupBy("r").agg(F.sum("h").alias("rh"), F.sum("n").alias("rn"))
    w = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("r", F.coalesce(F.sum("rh").over(w), F.lit(0)).alias("bh"), F.coalesce(F.sum("rn").over(w), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("r").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    gold = rows.agg(F.sum("hit").alias("gold"))
    out = ranged.join(F.broadcast(before), "r").select("score", (F.col("bh") + F.sum("h").over(inside)).alias("tp"), (F.col("bn") + F.sum("n").over(inside)).alias("seen"))
    return out.crossJoin(F.broadcast(gold)).select(F.col("score").alias("threshold"), "tp", (F.col("seen") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("seen")).alias("precision"), F.when(F.col("gold") > 0, F.col("tp") / F.col("gold")).otherwise(0.0).alias("recall"))


def operating_point(points: DataFrame, maximise: str, floor_of: str, floor: float) -> DataFrame:
    """The point with the largest `maximise` among those whose `floor_of` is high enough; the highest threshold wins ties."""
    return points.filter(F.col(floor_of) >= floor).orderBy(F.col(maximise).desc(), F.col("threshold").desc()).limit(1)


def grid(rows: DataFrame, key: str, percents: range) -> DataFrame:
    """key, tau (percent), kept, tp for each threshold of a grid. Rows are counted by key and whole percent first, so the
    grid meets a table of at most 101 rows for each key."""
    small = rows.groupBy(key, F.floor(F.col("score") * 100).alias("pc")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    taus = F.explode(F.sequence(F.lit(percents.start), F.lit(percents.stop - 1), F.lit(percents.step)))
    return small.withColumn("tau", taus).groupBy(key, "tau").agg(F.sum(F.when(F.col("pc") >= F.col("tau"), F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("pc") >= F.col("tau"), F.col("h")).otherwise(0)).alias("tp"))


def coordinate_descent(score, start: dict[str, float], steps: tuple[float, ...] = (-1.0, -0.5, 0.5, 1.0), gain: float = 0.001, rounds: int = 10) -> tuple[dict[str, float], float]:
    """Best values of named parameters by changing one at a time; score(dict) -> float runs on Spark, and its results are kept."""
    seen: dict[tuple, float] = {}

    def value(p: dict[str, float]) -> float:
        k = tuple(sorted(p.items()))
        if k not in seen:
            seen[k] = score(p)
        return seen[k]

    best, at = dict(start), value(start)
    for _ in range(rounds):
        before = at
        for name in start:
            for step in steps:
                trial = {**best, name: best[name] + step}
                if value(trial) >= at + gain:
                    best, at = trial, value(trial)
        if at == before:
            break
    return best, at


def fit_temperature(nll, low: float = 0.05, high: float = 20.0, rounds: int = 40) -> float:
    """Temperature with the least nll(t), a Spark aggregate, by golden-section search on its logarithm."""
    import math

    g = (math.sqrt(5) - 1) / 2
    a, b = math.log(low), math.log(high)
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = nll(math.exp(c)), nll(math.exp(d))
    for _ in range(rounds):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = nll(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = nll(math.exp(d))
    return math.exp((a + b) / 2)


def percentile(col: Column, p: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(col, p)
