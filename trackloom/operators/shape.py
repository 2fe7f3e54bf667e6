"""Team shape of every frame in play: line height, width, length, hull area, centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FRAME, HALF

TEAM_FRAME = [*FRAME, "timestamp", "team"]
DEEPEST = 4
LEAST_OUTFIELD = 8


def outfield(df: DataFrame) -> DataFrame:
    return df.filter("NOT is_ball AND NOT is_gk").select(*TEAM_FRAME, "track_id", F.col("x_pitch").alias("x"), F.col("y_pitch").alias("y"))


def alive(df: DataFrame) -> DataFrame:
    return df.filter("ball_state = 'alive'")


def attacking_direction(df: DataFrame) -> DataFrame:
    """match, period, team, direction: the team whose keeper (or else its others) is farther to -x attacks +x. All
    frames count, dead ones too."""
    ref = df.filter("NOT is_ball").groupBy(*HALF, "team").agg(F.coalesce(F.avg(F.when(F.col("is_gk"), F.col("x_pitch"))), F.avg(F.when(~F.col("is_gk"), F.col("x_pitch")))).alias("ref"))
    w = Window.partitionBy(*HALF)
    place = F.row_number().over(w.orderBy("ref", "team"))
    both = F.count("*").over(w) == 2
    return ref.select(*HALF, "team", F.when(F.when(both, place == 1).otherwise(F.col("ref") <= 0), 1).otherwise(-1).alias("direction"))


def direction_table(df: DataFrame, given: dict) -> DataFrame:
    """match, period, team, direction (1 or -1) of every team and half of ``df``: ``given`` has (team, period) or team as
    keys, the former counting first. A side without any is an error."""
    if bad := {k: v for k, v in given.items() if v not in (1, -1)}:
        raise ValueError(f"a direction is 1 or -1: {bad}")
    rows = [(k, None, v) if isinstance(k, str) else (*k, v) for k, v in given.items()]
    known = df.sparkSession.createDataFrame(rows, "team string, period tinyint, direction int")  # as many rows as given
    sides = df.filter("NOT is_ball").select(*HALF, "team").distinct()
    own = known.filter("period IS NOT NULL").withColumnRenamed("direction", "own")
    whole = known.filter("period IS NULL").select("team", F.col("direction").alias("whole"))
    missing = F.raise_error(F.concat(F.lit("no direction for "), F.col("team"), F.lit(", half "), F.col("period").cast("string"))).cast("int")
    return sides.join(own, ["period", "team"], "left").join(whole, "team", "left").select(*HALF, "team", F.coalesce("own", "whole", missing).alias("direction"))


def line_height(df: DataFrame, direction: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Mean of the deepest players' x, seen in the direction of attack; fewer players than asked for: all of them."""
    if deepest < 1:
        raise ValueError("deepest must be at least 1")
    rows = outfield(df).join(direction, [*HALF, "team"])
    w = Window.partitionBy(*TEAM_FRAME).orderBy("dx", "track_id")
    return rows.withColumn("dx", F.col("x") * F.col("direction")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= deepest).groupBy(*TEAM_FRAME).agg(F.avg("dx").alias("line_height_m"))


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _chain(points: Column) -> Column:
    """Half of the hull of points in order: a stack, of which a new point leaves what lies before its tangent. The chain is
    convex, so the turns that stay are those at its beginning."""

    def add(stack: Column, p: Column) -> Column:
        turns = F.filter(F.sequence(F.lit(1), F.size(stack) - 1), lambda k: _cross(F.get(stack, k - 1), F.get(stack, k), p) > 0)
        kept = F.when(F.size(stack) < 2, F.size(stack)).otherwise(1 + F.size(turns))
        return F.concat(F.slice(stack, F.lit(1), kept), F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), add)


def hull_area(points: Column) -> Column:
    """Area of the convex hull of an array of (x, y): both chains around the sorted points."""

    def twice(chain: Column) -> Column:
        steps = F.arrays_zip(F.slice(chain, F.lit(1), F.size(chain) - 1).alias("a"), F.slice(chain, F.lit(2), F.size(chain) - 1).alias("b"))
        return F.aggregate(steps, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])

    let = lambda value, use: F.transform(F.array(value), use)[0]
    both = lambda p: let(_chain(p), twice) + let(_chain(F.reverse(p)), twice)
    area = let(F.sort_array(F.array_distinct(points)), lambda p: F.when(F.size(p) >= 3, both(p) / 2))
    return F.when(area > 1e-9, area)


def team_shape(df: DataFrame, direction: DataFrame | None = None, deepest: int = DEEPEST, hull: bool = True, least: int = LEAST_OUTFIELD) -> DataFrame:
    """One grouping for all of it: eleven players at most make a group."""
    direction = attacking_direction(df) if direction is None else direction
    rows = outfield(alive(df)).join(direction, [*HALF, "team"])
    deep = F.slice(F.array_sort(F.collect_list(F.col("x") * F.col("direction"))), 1, deepest)
    mean = F.aggregate(deep, F.lit(0.0), lambda a, x: a + x) / F.size(deep)
    points = F.collect_list(F.struct("x", "y"))
    found = rows.groupBy(*TEAM_FRAME).agg(
        mean.alias("line_height_m"), (F.max("y") - F.min("y")).alias("width_m"), (F.max("x") - F.min("x")).alias("length_m"), points.alias("points"),
        F.avg("x").alias("cx_m"), F.avg("y").alias("cy_m"), F.count("*").alias("n_outfield"))
    area = hull_area(F.col("points")) if hull else F.lit(None).cast("double")
    return found.withColumns({"hull_area_m2": area, "low_outfield_count": F.col("n_outfield") < least}).drop("points")


def compactness_median(shape: DataFrame) -> DataFrame:
    return shape.filter("NOT low_outfield_count").groupBy("match_id", "team").agg(F.median("hull_area_m2").alias("hull_median_m2"))
