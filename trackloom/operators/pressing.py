"""Pressing: who has the ball, and how many opponents are near."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FRAME
from .shape import alive

SEARCH_RADIUS, PRESS_RADIUS = 3.0, 5.0


def _away(a: str, b: str):
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return F.sqrt(dx * dx + dy * dy)


def players_and_ball(df: DataFrame) -> DataFrame:
    """Outfield players of live frames with the ball's place. A window carries the ball, so a frame is shuffled once."""
    w = Window.partitionBy(*FRAME)
    ball = {"ball_x": F.max(F.when(F.col("is_ball"), F.col("x_pitch"))).over(w), "ball_y": F.max(F.when(F.col("is_ball"), F.col("y_pitch"))).over(w)}
    rows = alive(df).withColumns(ball).filter("NOT is_ball")
    return rows.select(*FRAME, "timestamp", "track_id", "team", "is_gk", F.col("x_pitch").alias("x"), F.col("y_pitch").alias("y"), "ball_x", "ball_y")


def _frames(df: DataFrame, radius: float, press: float) -> DataFrame:
    """Every live frame with its carrier, and what the carrier's opponents' distances give: one grouping of the frame's
    rows, two teams and the ball."""
    rows = alive(df).withColumns({"x": F.col("x_pitch"), "y": F.col("y_pitch")})
    player = F.struct("track_id", "team", "is_gk", "x", "y")
    found = rows.groupBy(*FRAME, "timestamp").agg(
        F.collect_list(F.when(~F.col("is_ball"), player)).alias("players"), F.max(F.when(F.col("is_ball"), F.col("x"))).alias("ball_x"), F.max(F.when(F.col("is_ball"), F.col("y"))).alias("ball_y"))
    off = lambda p, x, y: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y))
    field = F.filter("players", lambda p: ~p["is_gk"])
    near = F.array_min(F.transform(field, lambda p: F.struct(off(p, F.col("ball_x"), F.col("ball_y")).alias("d"), p["track_id"].alias("track_id"), p["team"].alias("team"), p["x"].alias("x"), p["y"].alias("y"))))
    found = found.withColumn("b", F.when(F.col("ball_x").isNotNull(), near)).withColumn("b", F.when(F.col("b.d") <= radius, F.col("b")))
    others = F.transform(F.filter("players", lambda p: p["team"] != F.col("b.team")), lambda p: off(p, F.col("b.x"), F.col("b.y")))
    found = found.withColumn("others", F.when(F.col("b").isNotNull(), others))
    names = {"track_id": "carrier_track_id", "team": "carrier_team", "d": "ball_to_carrier_m", "x": "carrier_x", "y": "carrier_y"}
    pressers = F.when(F.col("b").isNotNull(), F.size(F.filter("others", lambda d: d <= press)).cast("long"))
    return found.select(*FRAME, "timestamp", *(F.col(f"b.{k}").alias(v) for k, v in names.items()), pressers.alias("n_pressers"), F.array_min("others").alias("nearest_opponent_m"), "others")


def ball_carrier(df: DataFrame, radius: float = SEARCH_RADIUS) -> DataFrame:
    """Every live frame; the carrier is the outfield player nearest the ball, if within the radius."""
    return _frames(df, radius, PRESS_RADIUS).drop("n_pressers", "nearest_opponent_m", "others")


def pressing(df: DataFrame, search: float = SEARCH_RADIUS, radius: float = PRESS_RADIUS) -> DataFrame:
    """Opponents, keepers too, within the radius of the carrier, and the nearest one's distance."""
    return _frames(df, search, radius).drop("carrier_x", "carrier_y", "others")


def pressure_pairs(df: DataFrame, search: float = SEARCH_RADIUS) -> DataFrame:
    """A row for each opponent of a frame's carrier, with the distance."""
    return _frames(df, search, PRESS_RADIUS).select(*FRAME, "carrier_track_id", "carrier_team", F.explode("others").alias("distance_m"))


def pressing_summary(per_frame: DataFrame, several: int = 2) -> DataFrame:
    held = per_frame.filter("n_pressers IS NOT NULL").withColumnRenamed("carrier_team", "team")
    return held.groupBy("match_id", "team").agg(F.count("*").alias("n_frames"), F.avg("n_pressers").alias("mean_pressers"), F.avg((F.col("n_pressers") >= several).cast("double")).alias("several_share"))
