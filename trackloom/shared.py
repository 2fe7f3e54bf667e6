"""What many steps share: written results, and row numbers without one task that sees all rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of ``monotonically_increasing_id`` that count within a task.
_TASK_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; sessions without one (tests) get one under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, and is computed once."""
    path, schema = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], number: str) -> DataFrame:
    """``df`` with its rows' places in ``order``, from 0, over all rows.

    Rows are dealt out by ranges of the order and counted within their range, and the counts of the ranges before are
    added: one shuffle, and nothing but one count a range in one place. Rows that are equal in the order may be dealt to
    several ranges, so no key makes a large task; their places among each other are any, but settled once.
    """
    spread = "_spread_"
    while spread in df.columns:
        spread += "_"
    dealt = df.withColumn(spread, F.monotonically_increasing_id())
    ranges = dealt.repartitionByRange(*order, F.col(spread)).sortWithinPartitions(*order, F.col(spread)).drop(spread)
    rows = written(ranges.withColumn(number, F.monotonically_increasing_id()), "numbered")
    task = F.shiftright(F.col(number), _TASK_BITS)
    sizes = rows.groupBy(task.alias("_task_")).agg(F.count("*").alias("_rows_"))
    before = sizes.select("_task_", (F.sum("_rows_").over(Window.orderBy("_task_")) - F.col("_rows_")).alias("_before_"))
    within = F.col(number).bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    # One row for each task of the shuffle.
    return rows.join(F.broadcast(before), task == F.col("_task_")).withColumn(number, F.col("_before_") + within).drop("_task_", "_before_")
