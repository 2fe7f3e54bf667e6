"""Steps that sources share: roster, ball state, keepers, unpivoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HALF, PITCH_LENGTH, PITCH_WIDTH

#: A track shorter than this share of its team's longest one isn't taken for a keeper.
CAMEO = 0.1


def ball_state(x: Column, y: Column, x_most: float = PITCH_LENGTH / 2, y_most: float = PITCH_WIDTH / 2) -> Column:
    """alive while the ball is tracked on the pitch, its lines included."""
    return F.when(x.between(-x_most, x_most) & y.between(-y_most, y_most), "alive").otherwise("dead")


def infer_keepers(df: DataFrame) -> DataFrame:
    """``df`` with is_gk: of each team and half, the track whose mean place is nearest the goal that the others defend."""
    key = [*HALF, "team"]
    w = Window.partitionBy(*key)
    means = df.filter("NOT is_ball").groupBy(*key, "track_id").agg(F.avg("x_pitch").alias("x"), F.count("*").alias("n"))
    long_ = means.withColumn("most", F.max("n").over(w)).filter(F.col("n") >= CAMEO * F.col("most"))
    side = long_.withColumn("side", F.when(F.avg("x").over(w) < 0, 1.0).otherwise(-1.0))
    keepers = side.groupBy(*key).agg(F.min_by("track_id", F.struct(F.col("side") * F.col("x"), "track_id")).alias("track_id")).withColumn("keeps", F.lit(True))
    return df.drop("is_gk").join(keepers, [*key, "track_id"], "left").withColumn("is_gk", F.coalesce("keeps", F.lit(False))).drop("keeps")


def static_ends(df: DataFrame) -> DataFrame:
    """``df`` with both halves turned so that the home side attacks +x: a half is turned where that side's mean place
    (its keeper's, if it has one) isn't to -x of the others'."""
    home, away = F.col("team") == "home", F.col("team") == "away"
    side = lambda whose: F.coalesce(F.avg(F.when(whose & F.col("is_gk"), F.col("x_pitch"))), F.avg(F.when(whose, F.col("x_pitch"))), F.lit(0.0))
    turned = df.groupBy(*HALF).agg(F.when(side(home) > side(away), -1.0).otherwise(1.0).alias("turned"))
    both = {c: F.col(c) * F.col("turned") + F.lit(0.0) for c in ("x_pitch", "y_pitch")}
    return df.join(turned, HALF).withColumns(both).drop("turned")


def wide_to_long(wide: DataFrame, players: list[str], keys: list[str]) -> DataFrame:
    """keys, track_id, x, y: columns ``<player>_x`` and ``<player>_y`` become rows; rows without a place go."""
    rows = F.array(*(F.struct(F.lit(p).alias("track_id"), F.col(f"`{p}_x`").cast("double").alias("x"), F.col(f"`{p}_y`").cast("double").alias("y")) for p in players))
    long_ = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return long_.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def detected_pairs(records: DataFrame) -> DataFrame:
    """(the key columns, track_id) of what a tracker really saw. ``records`` has key columns, period, ball (x, y,
    is_detected) and players (track_id, is_detected): a missing mark counts as seen, a record without a period not."""
    keys = [c for c in records.columns if c not in ("ball", "players")]
    held = records.filter("period IS NOT NULL")
    players = held.select(*keys, F.explode("players").alias("p")).filter(F.coalesce("p.is_detected", F.lit(True))).select(*keys, F.col("p.track_id").cast("string").alias("track_id"))
    ball = held.filter("ball.x IS NOT NULL").filter(F.coalesce("ball.is_detected", F.lit(True))).select(*keys, F.lit("ball").alias("track_id"))
    return players.unionByName(ball)


def keep_detected(long_: DataFrame, detected: DataFrame) -> DataFrame:
    """The rows of ``long_`` that ``detected`` has, by all the key columns that it has."""
    return long_.join(detected, detected.columns, "left_semi")
