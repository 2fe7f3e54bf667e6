"""Ranks and rows before, over a half of any length: counted within ranges of the order, and carried from range to range.

A half's rows are cut into ranges of ``size`` units of the value that orders them. Within a range a window does the work;
of each range only one row (how many rows it has, and its last one) goes on to the ranges after it. So a window
task has a range, and what stands together for a whole half is one row for each of its ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames, and seconds, of a range.
FRAMES, SECONDS = 4096, 160.0
_RANGE = "_range_"


def _ranged(df: DataFrame, by: str, size: float) -> DataFrame:
    return df.withColumn(_RANGE, F.floor(F.col(by) / size).cast("long"))


def ranked(df: DataFrame, key: Sequence[str], by: str, order: Sequence[str], name: str, size: float = FRAMES) -> DataFrame:
    """``df`` with the row number, from 1, of each row among its key's rows in ``order``, which begins with ``by``."""
    rows = _ranged(df, by, size)
    counts = rows.groupBy(*key, _RANGE).agg(F.count("*").alias("_n_"))
    before = F.coalesce(F.sum("_n_").over(Window.partitionBy(*key).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*key, _RANGE).orderBy(*order))
    return rows.withColumn(name, own).join(counts.select(*key, _RANGE, before.alias("_before_")), [*key, _RANGE]).withColumn(name, F.col(name) + F.col("_before_")).drop(_RANGE, "_before_")


def with_previous(df: DataFrame, key: Sequence[str], by: str, order: Sequence[str], values: dict[str, str], size: float = SECONDS) -> DataFrame:
    """``df`` with columns named by ``values`` that have another column's value in the row before, in ``order`` (which
    begins with ``by``) among the key's rows; null in the first one."""
    rows = _ranged(df, by, size)
    held = F.struct(*(F.col(c).alias(name) for name, c in values.items()))
    last = rows.groupBy(*key, _RANGE).agg(F.max_by(held, F.struct(*order)).alias("_last_"))
    carried = last.select(*key, _RANGE, F.lag("_last_").over(Window.partitionBy(*key).orderBy(_RANGE)).alias("_carried_"))
    w = Window.partitionBy(*key, _RANGE).orderBy(*order)
    place = F.row_number().over(w)
    own = rows.withColumns({"_place_": place, "_own_": F.lag(held).over(w)})
    before: Column = F.when(F.col("_place_") == 1, F.col("_carried_")).otherwise(F.col("_own_"))
    found = own.join(carried, [*key, _RANGE]).withColumn("_before_", before)
    return found.select(*df.columns, *(F.col(f"_before_.{name}").alias(name) for name in values))
