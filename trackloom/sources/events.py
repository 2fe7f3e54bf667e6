"""A deterministic match from the ``events`` table: 22 players and a ball, 25 frames a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 25.0


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    frame, slot = F.floor(F.col("event_id") / 23).cast("long"), F.col("event_id") % 23
    half = F.expr("half")
    first = F.col("frame_id") < half
    k, ball = F.when(F.col("slot") == 22, 0).otherwise(F.col("slot") % 11), F.col("slot") == 22
    keeper = (F.col("k") == 0) & ~ball
    t, d = F.col("timestamp"), F.when(F.col("team") == "home", 1.0).otherwise(-1.0)
    nz = (F.col("value") - F.floor("value").cast("double") - 0.5) * 0.06
    v = F.when(F.col("k") == 0, 0.25).otherwise(3.0 + 0.55 * F.col("k").cast("double"))
    kd = F.col("k").cast("double")
    run = d * (F.abs((t * v + 3.0 * kd) % 80.0 - 40.0) - 28.0) + nz
    spike = F.when((F.col("event_type") == "signup") & (F.col("value") > 200), 5.0).otherwise(0.0)
    middle = events.agg(((F.max(frame) + 1) / 2).cast("long")).scalar()
    laid = events.select("value", "event_type", frame.alias("frame_id"), slot.alias("slot")).withColumn("half", middle)
    laid = laid.withColumns({"k": k, "period": F.when(first, 1).otherwise(2).cast("tinyint"), "timestamp": (F.col("frame_id") - F.when(first, 0).otherwise(half)).cast("double") / RATE, "team": F.when(ball, "ball").when(F.col("slot") < 11, "home").otherwise("away")})
    lost = ((F.col("team") == "away") & (F.col("k") > 0) & (F.col("event_type") == "error")) | ((F.col("team") == "home") & (F.col("k") == 5) & (F.col("frame_id") % 120).between(60, 92))
    return laid.filter(~lost).select(
        F.lit("events").alias("match_id"), "period", "frame_id", "timestamp",
        F.when(ball, "ball").otherwise(F.concat(F.substring("team", 1, 1), F.lit("_"), F.col("k").cast("string"))).alias("track_id"), "team",
        F.when(~ball & (F.col("k") % 4 != 3), F.col("k") + 1).cast("smallint").alias("jersey_number"),
        F.when(ball, F.abs((t * 6.0) % 80.0 - 40.0) - 20.0).when(keeper, d * -48.0 + nz).otherwise(run).alias("x_pitch"),
        F.when(ball | keeper, nz).otherwise(d * (-30.0 + 5.5 * kd) + nz + spike).alias("y_pitch"),
        ball.alias("is_ball"), keeper.alias("is_gk"),
        F.when(F.col("frame_id") % 50 >= 42, "dead").otherwise("alive").alias("ball_state"))
