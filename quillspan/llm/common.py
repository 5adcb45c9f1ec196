"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch. Batches bounded by rows alone would hold thousands of whole texts.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors.
    The files go when the driver ends. Without a codec they have the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    if _scratch:
        _scratch[-1].append(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside it go when it ends, but for those that `kept` names; so a long job doesn't fill the shared folder."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def kept(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df stored so that it outlives the innermost scratch."""
    inner = _scratch.pop() if _scratch else None
    try:
        return stored(df, codec)
    finally:
        if inner is not None:
            _scratch.append(inner)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to Python workers by bytes, unless the session has a smaller bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: file bytes for a plain scan. Only for choosing numbers of buckets."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def unique_join(left: DataFrame, right: DataFrame, key: str, row: str, how: str = "left") -> DataFrame:
    """left joined with right, which has one row for each value of key. Values with more than half a partition's share of
    left's rows, at most 2 x partitions of them, are spread by a salt from the column row, with a copy of right's row for each salt."""
    p = partitions(left.sparkSession)
    counts = left.groupBy(key).count()
    total = left.agg(F.count(F.lit(1)).alias("__total"))
    hot = counts.join(F.broadcast(total), F.col("count") * (2 * p) > F.col("__total")).filter(F.col("count") > 64).select(key, F.lit(True).alias("__hot"))
    a = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(row, F.lit(3)), F.lit(p)).cast("int")).otherwise(0)).drop("__hot")
    b = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(p - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a.join(b, [key, "__salt"], how).drop("__salt")


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


#: Stands for a null id inside pandas code, where a null would turn all ids of a batch to floats.
NO_ID = -(1 << 63)


def id_in(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def id_out(col: str = "id") -> Column:
    return F.when(F.col(col) != F.lit(NO_ID), F.col(col))


_held: dict[str, object] = {}


def worker_cache(name: str, make: Callable):
    """A cache of pure functions that the tasks of a Python worker share. A worker holds one at a time: another name's goes first."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def drop_caches() -> None:
    """For tasks without a cache of their own: frees what an earlier operator's tasks left in this worker."""
    _held.clear()


class WordCache(dict):
    """Values of words, made by `make` and kept up to a bounded number, in two generations: when the young one is full it
    becomes the old one, and words that are met again move on, so that frequent words stay. Words over LONGEST characters
    are not kept, so the bound is one of bytes as well (about 200 for a word of usual length)."""

    WORDS, LONGEST = 300_000, 64

    def __init__(self, make: Callable | None = None):
        super().__init__()
        self.make, self.old = make, {}

    def age(self) -> None:
        """Makes room if the young generation is full."""
        if 2 * len(self) >= self.WORDS:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.LONGEST:
            self.age()
            self[word] = value
        return value
