"""Known answers: made-up tracks and formations, through the operators, against what geometry says."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..operators import motion, physical, sampling, shape, space

RATE = 25.0
#: A formation and its mirror image: line, width, length, centroid and hull by hand (trapezoids of 780 and 600 m2).
FORMATION = {"k": (-47.0, 0.0), "d1": (-32.0, 18.0), "d2": (-32.0, 6.0), "d3": (-32.0, -6.0), "d4": (-32.0, -18.0), "m1": (-12.0, 21.0), "m2": (-12.0, 7.0), "m3": (-12.0, -7.0), "m4": (-12.0, -21.0), "f1": (8.0, 9.0), "f2": (8.0, -9.0)}
FORMATION_HOME = {"width_m": 42.0, "length_m": 40.0, "hull_area_m2": 1380.0, "cx_m": -16.0, "cy_m": 0.0}


def _track(spark: SparkSession, name: str, n: int, x: Column, y: Column) -> DataFrame:
    """One player, ``n`` frames; ``x`` and ``y`` of the time t."""
    t = spark.range(n).withColumn("t", F.col("id") / RATE)
    return t.select(
        F.lit(name).alias("match_id"), F.lit(1).cast("tinyint").alias("period"), F.col("id").alias("frame_id"), F.col("t").alias("timestamp"), F.lit("p").alias("track_id"), F.lit("home").alias("team"), F.lit(None).cast("smallint").alias("jersey_number"),
        x.cast("double").alias("x_pitch"), y.cast("double").alias("y_pitch"), F.lit(False).alias("is_ball"), F.lit(False).alias("is_gk"), F.lit("alive").alias("ball_state"))


def formation(spark: SparkSession) -> DataFrame:
    """One live frame of both teams."""
    rows = [("formation", 1, 0, 0.0, f"{team}_{k}", team, None, x * d, y * d, False, k == "k", "alive") for team, d in (("home", 1.0), ("away", -1.0)) for k, (x, y) in FORMATION.items()]
    return spark.createDataFrame(rows, model.SCHEMA)


def tracks(spark: SparkSession) -> DataFrame:
    t, zero = F.col("t"), F.lit(0.0)
    seconds = int(10 * RATE) + 1
    circle = round(2 * math.pi * 9.15 / 4 * RATE) + 1
    angle = t * (4 / 9.15)
    noise = [F.randn(seed) * 0.05 for seed in (1, 2)]
    spike = F.when(F.col("id") == seconds // 2, 5.0).otherwise(0.0)
    parts = [
        _track(spark, "line", seconds, t * 5.0 - 25.0, zero), _track(spark, "noise", seconds, *noise), _track(spark, "circle", circle, F.cos(angle) * 9.15, F.sin(angle) * 9.15),
        _track(spark, "sprint", seconds, t * 9.5 - 50.0, zero), _track(spark, "fast", seconds, t * 6.25 - 30.0, zero), _track(spark, "spike", seconds, t * 5.0 - 25.0, spike),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def synthetic_checks(spark: SparkSession, cfg: motion.Motion = motion.Motion(), widest: int = 31) -> DataFrame:
    """name, metric, expected, actual, tolerance, passed: 22 rows."""
    kin = motion.kinematics_by_window(tracks(spark), cfg, (cfg.window, widest))
    w = Window.partitionBy("match_id", "window").orderBy("frame_id")
    path = F.sqrt(F.pow(F.col("x_pitch") - F.lag("x_pitch").over(w), 2) + F.pow(F.col("y_pitch") - F.lag("y_pitch").over(w), 2))
    kin = kin.withColumn("raw_step", path)
    own = kin.filter(F.col("window") == cfg.window)
    facts = own.groupBy("match_id").agg(F.sum("step_dist").alias("distance"), F.max("speed").alias("top"), F.max(F.abs(F.col("speed") - 5.0)).alias("off"), F.sum("raw_step").alias("naive"), F.sum(F.when(F.col("speed") >= physical.FAST, F.col("step_dist")).otherwise(0.0)).alias("hsr"))
    wide = kin.filter((F.col("window") == widest) & (F.col("match_id") == "noise")).groupBy("match_id").agg(F.sum("step_dist").alias("wide"))
    sprints = physical.sprints(own, rate=cfg.rate).groupBy("match_id").agg(F.count("*").alias("n_sprints"))
    zones = physical.open_zones(own).groupBy("match_id").agg(F.sum("distance_m").alias("zones"))
    held = facts.join(wide, "match_id", "left").join(sprints, "match_id", "left").join(zones, "match_id", "left").withColumn("n_sprints", F.coalesce("n_sprints", F.lit(0)).cast("double"))

    def check(metric: str, expected, actual, tolerance: float) -> Column:
        expected, actual = (F.lit(v) if isinstance(v, (int, float)) else F.col(v) for v in (expected, actual))
        return F.struct(F.lit(metric).alias("metric"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"), F.lit(float(tolerance)).alias("tolerance"))

    lap = 2 * math.pi * 9.15
    by_case = {
        "line": [check("distance_m", 50.0, "distance", 1.0), check("speed_error", 0.0, "off", 0.01)],
        "noise": [check("share_of_path", 0.0, "share", 0.2), check("distance_wide_m", 0.0, "wide", 2.0)],
        "circle": [check("distance_m", lap, "distance", 0.01 * lap), check("zones_m", "distance", "zones", 1e-6)],
        "sprint": [check("n_sprints", 1.0, "n_sprints", 0.0)],
        "fast": [check("n_sprints", 0.0, "n_sprints", 0.0), check("hsr_m", "distance", "hsr", 0.5)],
        "spike": [check("top_mps", 5.0, "top", 0.01)],
    }
    rows = None
    for case, found in by_case.items():
        rows = F.when(F.col("match_id") == case, F.array(*found)) if rows is None else rows.when(F.col("match_id") == case, F.array(*found))
    out = held.withColumn("share", F.col("distance") / F.col("naive")).select(F.col("match_id").alias("name"), F.inline(rows))

    unlimited = motion.Motion(cfg.rate, cfg.window, cfg.max_speed, cfg.max_gap, None, cfg.order)
    limited = motion.kinematics(_track(spark, "limit", int(5 * RATE), F.col("t") * 18.0 - 50.0, F.lit(0.0)), unlimited).groupBy("match_id").agg(F.max("speed").alias("top"))
    out = out.unionByName(limited.select(F.col("match_id").alias("name"), F.inline(F.array(check("top_mps", cfg.max_speed, "top", 1e-6)))))

    frame = formation(spark)
    teams = shape.team_shape(frame)
    home = F.array(check("line_height_m", -32.0, "line_height_m", 1e-6), *(check(k, v, k, 1e-6) for k, v in FORMATION_HOME.items()))
    out = out.unionByName(teams.select(F.concat(F.lit("formation_"), "team").alias("name"), F.inline(F.when(F.col("team") == "home", home).otherwise(F.array(check("line_height_m", -32.0, "line_height_m", 1e-6))))))
    areas = space.team_space(space.player_space(frame, with_cells=False)).groupBy("match_id").agg(F.sum("area_m2").alias("total"), F.max(F.when(F.col("team") == "home", F.col("area_share"))).alias("share"))
    out = out.unionByName(areas.select(F.lit("formation_space").alias("name"), F.inline(F.array(check("total_m2", model.PITCH_LENGTH * model.PITCH_WIDTH, "total", 1e-6), check("home_share", 0.5, "share", 1e-6)))))

    line = _track(spark, "coverage", int(10 * RATE) + 1, F.col("t") * 5.0 - 25.0, F.lit(0.0))
    both = line.unionByName(line.filter(F.col("frame_id") < 100).withColumn("track_id", F.lit("q")))
    table = physical.physical_table(motion.kinematics(both, cfg), sampling.coverage_by_match(both), cfg.rate)
    refused = F.when(F.col("below_coverage") & F.col("distance_m").isNull(), 1.0).otherwise(0.0)
    table = table.withColumn("refused", refused)
    out = out.unionByName(table.select(F.lit("coverage").alias("name"), F.inline(F.when(F.col("track_id") == "q", F.array(check("refused", 1.0, "refused", 0.0))).otherwise(F.array(check("distance_m", 50.0, "distance_m", 1.0))))))
    return out.withColumn("passed", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance"), F.lit(False)))
