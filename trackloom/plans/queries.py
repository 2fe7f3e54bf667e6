"""The operators as queries over the match in the ``events`` table. Doubles are rounded to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import motion, physical, pressing, reports, sampling, shape, space
from ..sources import frames
from ..sources.events import tracking
from . import checks

#: Bands that the short match of the test data straddles.
BANDS = {"distance_km": (0.05, 0.12), "top_speed_mps": (4.0, 9.0), "hsr_share_pct": (5.0, 90.0), "n_sprints": (0.0, 1.0), "hull_median_m2": (500.0, 900.0)}
TRACKS = ["ball", *(f"{side}_{k}" for side in "ha" for k in range(11))]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _coverage(t: DataFrame) -> DataFrame:
    return sampling.coverage_by_match(sampling.downsample(t, 25.0, 5.0))


def _table(t: DataFrame) -> DataFrame:
    return physical.physical_table(motion.kinematics(t), _coverage(t))


def _unsided(t: DataFrame) -> DataFrame:
    return frames.infer_keepers(t)


def _wide(t: DataFrame) -> DataFrame:
    keys = ["match_id", "period", "frame_id"]
    own = lambda p, c: F.max(F.when(F.col("track_id") == p, F.col(c))).alias(f"{p}_{c[0]}")
    return frames.wide_to_long(t.groupBy(*keys).agg(*(own(p, c) for p in TRACKS for c in ("x_pitch", "y_pitch"))), TRACKS, keys)


def _records(t: DataFrame) -> DataFrame:
    """A record for each frame with marks of every kind, some of them and some periods missing."""
    turn = (F.col("frame_id") + F.coalesce("jersey_number", F.lit(0))) % 4
    seen = F.when(turn == 0, False).when(turn > 1, True)
    ball, player = F.struct(F.col("x_pitch").alias("x"), seen.alias("is_detected")), F.struct("track_id", seen.alias("is_detected"))
    held = t.groupBy("match_id", "period", "frame_id").agg(F.max(F.when(F.col("is_ball"), ball)).alias("ball"), F.collect_list(F.when(~F.col("is_ball"), player)).alias("players"))
    return held.withColumn("period", F.when(F.col("frame_id") % 11 > 0, F.col("period")))


def _seen(t: DataFrame) -> DataFrame:
    return frames.detected_pairs(_records(t))


def _measured(kin: DataFrame) -> DataFrame:
    """Fast running, distance and sprints of each track, from their own operators."""
    key = ["match_id", "track_id", "team"]
    sprints = physical.sprint_counts(physical.sprints(kin)).select(*key, "n_sprints")
    distance = physical.distance_covered(kin).filter("period IS NULL").select(*key, "distance_m")
    return physical.fast_running(kin).join(distance, key).join(sprints, key, "left").fillna(0, ["n_sprints"])


def _checks(t: DataFrame) -> DataFrame:
    return reports.range_checks(_table(t), sampling.full_match_tracks(t), sampling.goalkeepers(t), shape.team_shape(t), BANDS)


def _swept_grid(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    swept, tracks = reports.by_window(t), reports.outfield_full_match(t)
    return physical.sprint_grid(swept, players=tracks), reports.sensitivity_distance(swept, tracks)


def _areas(space_: DataFrame) -> DataFrame:
    return space_.drop("cell_wkt").withColumn("area_m2", F.round("area_m2", 3))


def _two(t: DataFrame) -> DataFrame:
    """The match, and another one in which the sides of the pitch are changed and the first frames are missing."""
    return t.unionByName(t.filter("frame_id >= 7").withColumns({"match_id": F.lit("again"), "x_pitch": -F.col("x_pitch")}))


DIRECTIONS = {"home": 1, ("home", 2): -1, "away": -1}
KIN = ["match_id", "period", "track_id", "frame_id"]
TEAM = ["match_id", "period", "frame_id", "team"]
QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "scan_tracking": lambda t: t,
    "empty_canonical": lambda t: model.empty_frame(t.sparkSession),
    "coerce_types": lambda t: model.coerce(t.withColumns({"period": F.col("period").cast("string"), "frame_id": F.when(F.col("frame_id") % 9 == 0, "none").otherwise(F.col("frame_id").cast("string")), "x_pitch": F.when(F.col("is_gk"), float("nan")).otherwise(F.col("x_pitch"))})),
    "validate_counts": lambda t: model.rule_counts(t.withColumn("x_pitch", F.col("x_pitch") * 1.25)),
    "dup_keys": lambda t: model.duplicate_keys(t.unionByName(t.filter("frame_id % 7 = 0"))),
    "monotonic_violations": lambda t: model.monotonic_violations(t.withColumn("frame_id", F.when(F.col("frame_id") % 50 == 0, F.col("frame_id") + 2).otherwise(F.col("frame_id")))),
    "drop_off_pitch": lambda t: model.drop_off_pitch(t.withColumn("x_pitch", F.col("x_pitch") * 1.25)).select(*KIN, "x_pitch"),
    "outfield_rows": shape.outfield,
    "alive_frames": lambda t: shape.alive(t).select("match_id", "period", "frame_id").distinct(),
    "derive_ball_state": lambda t: t.filter("is_ball").select("match_id", "period", "frame_id", frames.ball_state(F.col("x_pitch") * 3.0, F.col("y_pitch")).alias("state")),
    "infer_gk": lambda t: _unsided(t).filter("is_gk").select("match_id", "period", "team", "track_id").distinct(),
    "wide_to_long": _wide,
    "detected_pairs": _seen,
    "keep_detected": lambda t: frames.keep_detected(t, _seen(t)).select(*KIN),
    "match_meta": sampling.match_meta,
    "downsample": lambda t: sampling.downsample(t, 25.0, 5.0).select(*KIN),
    "goalkeeper_ids": sampling.goalkeepers,
    "full_match_tracks": sampling.full_match_tracks,
    "outfield_full_match": reports.outfield_full_match,
    "elapsed_time": sampling.elapsed,
    "elapsed_label": lambda t: sampling.elapsed(t).select("match_id", "period", "frame_id", sampling.clock_label(F.round(F.col("elapsed_s") * 7, 3)).alias("label")),
    "window_slice": lambda t: t.filter(F.col("timestamp").between(1.0, 3.0)).select(*KIN),
    "gap_breaks": lambda t: sampling.gap_breaks(t, ["match_id", "period", "track_id"], "x_pitch"),
    "period_ranges": sampling.period_ranges,
    "nearest_frame": lambda t: sampling.nearest_frame(t, 1, 2.019),
    "nearest_frame_rows": lambda t: sampling.nearest_frame_rows(t, 2, 3.33).select(*KIN, "x_pitch", "y_pitch"),
    "match_summary": reports.match_summary,
    "join_players_ball": pressing.players_and_ball,
    "ball_carrier": lambda t: pressing.ball_carrier(t).drop("carrier_x", "carrier_y"),
    "carrier_left": lambda t: pressing.ball_carrier(t, 1.5),
    "pressing": pressing.pressing,
    "pressure_pairs": pressing.pressure_pairs,
    "pressure_count": lambda t: pressing.pressing(t, 5.0, 8.0).filter("n_pressers IS NOT NULL").select("match_id", "period", "frame_id", "n_pressers"),
    "pressing_summary": lambda t: pressing.pressing_summary(pressing.pressing(t)),
    "attacking_direction": shape.attacking_direction,
    "direction_lookup": lambda t: shape.direction_table(t, DIRECTIONS),
    "line_height": lambda t: shape.line_height(shape.alive(t), shape.attacking_direction(t)),
    "team_width": lambda t: shape.team_shape(t, hull=False).select(*TEAM, "width_m"),
    "team_length": lambda t: shape.team_shape(t, hull=False).select(*TEAM, "length_m"),
    "team_centroid": lambda t: shape.team_shape(t, hull=False).select(*TEAM, "cx_m", "cy_m"),
    "hull_area": lambda t: shape.team_shape(t).select(*TEAM, "hull_area_m2"),
    "team_shape": shape.team_shape,
    "compactness_median": lambda t: shape.compactness_median(shape.team_shape(t)),
    "coverage_by_period": sampling.coverage_by_period,
    "coverage_by_match": sampling.coverage_by_match,
    "coverage_summary": lambda t: sampling.coverage_summary(sampling.coverage_by_match(t)),
    "coverage_ranked": lambda t: reports.coverage_ranked(sampling.coverage_by_match(t)),
    "coverage_full_outer": lambda t: _coverage(t).withColumnRenamed("coverage_pct", "thin_pct").join(sampling.coverage_by_match(t.filter("track_id <> 'h_1'")), ["match_id", "track_id", "team"], "full"),
    "coverage_union": lambda t: sampling.coverage_by_match(t).withColumn("rate", F.lit("full")).unionByName(_coverage(t).withColumn("rate", F.lit("thin"))),
    "subtracks": lambda t: motion.segments(t).select(*KIN, F.col("seg").cast("long").alias("seg"), "breaks"),
    "glitch_steps": lambda t: motion.segments(t).filter("impossible").select(*KIN, "jump", "step_s", "glitch"),
    "resample_uniform": lambda t: motion.uniform_grid(motion.segments(t))[1].withColumn("seg", F.col("seg").cast("long")).select("match_id", "period", "track_id", "seg", "g", "gx", "gy"),
    "savgol_velocity": lambda t: motion.kinematics(t).filter("NOT is_ball").select(*KIN, "raw_speed"),
    "speed_clip": lambda t: motion.kinematics(t).filter("NOT is_ball").select(*KIN, "vx", "vy", "speed"),
    "step_distance": lambda t: motion.kinematics(t).filter("NOT is_ball").select(*KIN, "step_dist"),
    "kinematics": lambda t: motion.kinematics(t).select(*KIN, "vx", "vy", "speed", "step_dist", "glitch"),
    "kinematics_cubic": lambda t: motion.kinematics(t, motion.Motion(order=3)).filter("NOT is_ball").select(*KIN, "vx", "vy", "raw_speed"),
    "kinematics_two_matches": lambda t: motion.kinematics(_two(t)).filter("NOT is_ball").select(*KIN, "speed"),
    "thinned_two_matches": lambda t: sampling.downsample(_two(t), 25.0, 5.0).select(*KIN),
    "glitch_report": lambda t: motion.segments(t).groupBy("match_id", "team").agg(F.count_if("impossible").alias("glitch_steps"), F.count_if("glitch").alias("glitch_frames")),
    "clip_report": lambda t: motion.clip_report(motion.kinematics(t)),
    "total_distance": lambda t: motion.total_distance(motion.kinematics(t)),
    "total_distance_by_period": lambda t: motion.total_distance(motion.kinematics(t), True),
    "distance_by_zone_closed": lambda t: physical.closed_zones(motion.kinematics(t)),
    "speed_zones": lambda t: physical.open_zones(motion.kinematics(t)),
    "zone_cross_fill": lambda t: physical.open_zones(motion.kinematics(t), ((0.0, 3.0), (3.0, 6.0), (6.0, 11.0), (11.0, 99.0))),
    "distance_covered": lambda t: physical.distance_covered(motion.kinematics(t)),
    "high_speed_running": lambda t: physical.fast_running(motion.kinematics(t)),
    "top_speed": lambda t: reports.top_speed(motion.kinematics(t)),
    "sprints": lambda t: physical.sprints(motion.kinematics(t)),
    "sprint_counts": lambda t: physical.sprint_counts(physical.sprints(motion.kinematics(t))),
    "sprint_grid": lambda t: physical.sprint_grid(motion.kinematics(t)),
    "sprint_spread": lambda t: physical.spread_percent(physical.sprint_grid(motion.kinematics(t))),
    "physical_table": _table,
    "physical_join": lambda t: physical.apply_coverage(_measured(motion.kinematics(t)), _coverage(t), 80.0),
    "hsr_share": lambda t: reports.hsr_share(_table(t)),
    "player_table": lambda t: reports.player_table(_table(t), _coverage(t)),
    "range_checks": _checks,
    "range_excluded": lambda t: reports.excluded(_table(t), sampling.full_match_tracks(t)),
    "check_summary": lambda t: reports.check_summary(_checks(t)),
    "sensitivity_distance": lambda t: reports.sensitivity_distance(reports.by_window(t), reports.outfield_full_match(t)),
    "sensitivity_spreads": lambda t: reports.sensitivity_spreads(*_swept_grid(t)),
    "sprint_heatmap_pivot": lambda t: reports.grid_pivot(physical.sprint_grid(reports.by_window(t))),
    "synthetic_checks": lambda t: checks.synthetic_checks(t.sparkSession).select("name", "metric", "passed"),
    "voronoi_player_area": lambda t: _areas(space.frame_space(sampling.nearest_frame_rows(t, 1, 1.0), False, False)),
    "player_space": lambda t: _areas(space.player_space(t, with_cells=False)),
    "team_space": lambda t: space.team_space(space.player_space(t, with_cells=False)).withColumn("area_m2", F.round("area_m2", 3)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: _rounded(f(tracking(spark, sf_dir))) for name, f in QUERIES.items()}
