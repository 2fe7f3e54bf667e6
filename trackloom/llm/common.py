"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import inspect
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``spark.sql.sources.bucketing.maxBuckets`` allows by default.
MOST_BUCKETS = 100_000
#: What empties the caches that a Python worker keeps from task to task.
_KEPT: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; sessions without one (tests) get one under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _kept_at(df: DataFrame, path: str) -> DataFrame:
    df.scratch_path = path
    return df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return _kept_at(spark.read.schema(schema).parquet(path), path)


def materialise_by(df: DataFrame, name: str, *key: str, deal: bool = False) -> DataFrame:
    """As ``materialise``, bucketed by ``key`` (one column or several), so that grouping by it later moves only the other side of a join. With
    ``deal`` the rows are shuffled by it before, else a task writes a file for each bucket that it has."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table_name = f"scratch_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    df = df.repartition(buckets, *key) if deal else df
    df.write.format("parquet").bucketBy(buckets, *key).option("path", path).saveAsTable(table_name)
    found = spark.table(table_name)
    found.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table_name}")
    return _kept_at(found, path)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``frames``, once everything made from them is written itself."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if frames:
        drop_shuffles(frames[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished steps when the driver collects garbage: ask for that."""
    spark._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside comes to Python by Arrow batches of ``rows`` at most; afterwards the session's own size holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept_by_worker(cached):
    """Mark a function with a cache as one whose results stay while a worker goes on with the same operator."""
    _KEPT.append(cached.cache_clear)
    return cached


def forget_kept() -> None:
    for clear in _KEPT:
        clear()


def give_back() -> None:
    """Return freed memory to the system: the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def _collected(phase: str, info: dict) -> None:
    """After a whole collection of garbage, what was freed goes back."""
    if phase == "stop" and info["generation"] == 2:
        give_back()


def give_back_when_collected() -> None:
    """A worker collects its garbage between tasks: only then are the last group and its result free."""
    if _collected not in gc.callbacks:
        gc.callbacks.append(_collected)


def lean(work: Callable, keeps: bool = False) -> Callable:
    """``work``, for a task's batches (a generator) or for one group, after which the Python worker gives free memory
    back, and again when the task has ended. Workers are used again and again beside the JVM, so what they hold counts
    in steps without Python as well. Unless it ``keeps`` them, other operators' caches are emptied first."""

    def ready() -> None:
        give_back_when_collected()
        if not keeps:
            forget_kept()

    def task(batches):
        ready()
        yield from work(batches)
        give_back()

    def group(rows):
        ready()
        made = work(rows)
        give_back()
        return made

    def group_of_two(left, right):  # a key and its rows, or both sides of a cogroup
        ready()
        made = work(left, right)
        give_back()
        return made

    return task if inspect.isgeneratorfunction(work) else [group, group_of_two][len(inspect.signature(work).parameters) - 1]


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_row_each(docs: DataFrame, mark: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``doc_id`` and ``mark`` (a binary column of theirs) are in ``keys``
    (doc_id, mark, copies: how many rows have both). Of several rows with one key, one with the smallest text stays."""
    name = {k: fresh_name(docs, f"_{k}_") for k in ("id", "mark", "copies")}
    keys = keys.select(F.col("doc_id").alias(name["id"]), F.col("mark").alias(name["mark"]), F.col("copies").alias(name["copies"]))
    marked = fresh_name(docs, "_own_mark_")
    own = docs.withColumn(marked, mark)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name["id"])) & (F.col(marked) == F.col(name["mark"]))
    found = own.join(keys, same)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = found.filter(F.col(name["copies"]) == 1).select(*columns)
    several = found.filter(F.col(name["copies"]) > 1).groupBy(name["id"], name["mark"]).agg(F.min_by(F.struct(*columns), F.coalesce("text", F.lit(""))).alias("row"))
    return single.unionByName(several.select("row.*"))


def broadcast_if(df: DataFrame, rows: int, row_bytes: int, most_bytes: int = 32_000_000) -> DataFrame:
    """``df`` marked for a broadcast if its counted ``rows`` are small enough, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def buckets_for(amount: int | None, per_bucket: int, least: int = 16) -> int:
    """How many buckets of about ``per_bucket`` units hold ``amount``: grows with the data."""
    return max(least, -(-int(amount or 0) // per_bucket))
