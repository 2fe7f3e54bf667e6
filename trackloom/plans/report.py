"""Reports over written matches: plausibility and sensitivity, as tables and as JSON objects."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Run, settings_hash
from ..operators import physical, reports, sampling
from .checks import synthetic_checks
from .match import number, read_table, write_json


def stamp() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def _joint(df: DataFrame) -> DataFrame:
    """Provider and match as one key, so that the operators, which know matches only, take all of them at once."""
    return df.withColumn("match_id", F.concat_ws("/", "provider", "match_id")).drop("provider")


def match_checks(spark: SparkSession, run: Run) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checks, what isn't checked for want of coverage, coverage by match) of all written matches in one job."""
    tables = {n: _joint(read_table(spark, run.path, n)) for n in ("tracking", "physical", "shape", "coverage")}
    full = sampling.full_match_tracks(tables["tracking"])
    keepers = sampling.goalkeepers(tables["tracking"])
    table = tables["physical"].drop("top_speed_mps").join(reports.top_speed(tables["tracking"]), reports.PLAYER, "left")
    checks = reports.range_checks(table, full, keepers, tables["shape"], run.bands(), run.settings["kinematics"]["max_speed_mps"])
    return checks, reports.excluded(tables["physical"], full, run.settings["physical"]["min_coverage_pct"]), sampling.coverage_summary(tables["coverage"])


def validation_report(spark: SparkSession, run: Run, path: str) -> dict:
    """Writes all checks as a table, and an object with the counts, every check that failed, what was left out or couldn't
    be made, and each match's coverage; returns the latter. It grows with the matches, not with their frames."""
    cfg = run.motion(25.0)
    windows = run.settings["physical"]["sensitivity"]["savgol_window_frames_grid"]
    synthetic = synthetic_checks(spark, cfg, max(windows)).collect()  # 22 rows
    checks, refused, coverage = match_checks(spark, run)
    for name, df in (("checks", checks), ("excluded", refused), ("coverage", coverage)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    made = spark.read.parquet(f"{path}/checks")
    plain = lambda df: [{k: number(v) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()]
    failures = plain(made.filter("NOT passed").select("match_id", "track_id", "team", "check", "value", "low", "high").orderBy("match_id", "check", "team", "track_id"))
    kinds = F.explode(F.array(*map(F.lit, (*reports.PLAYER_CHECKS, "gk_top_speed_mps", "hull_median_m2"))))
    held = spark.read.parquet(f"{path}/coverage")
    not_checked = plain(held.select("match_id", kinds.alias("check")).join(made, ["match_id", "check"], "left_anti").orderBy("match_id", "check"))
    rows = reports.check_summary(spark.read.parquet(f"{path}/checks")).collect()  # a row a kind of check
    n_pass, n = sum(r["passed"] for r in synthetic) + sum(r["n_passed"] for r in rows), len(synthetic) + sum(r["n"] for r in rows)
    report = {
        "generated_at": stamp(), "config_hash": settings_hash(run.settings), "synthetic": [{k: number(v) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in synthetic],
        "checks": {r["check"]: {"n": r["n"], "n_passed": r["n_passed"], "median": number(r["median"])} for r in rows},
        "failures": failures, "excluded": plain(spark.read.parquet(f"{path}/excluded").orderBy("match_id", "check")), "not_checked": not_checked, "coverage": plain(held.orderBy("match_id")),
        "summary": {
            "n_checks": n, "n_pass": n_pass, "n_fail": n - n_pass, "synthetic_all_pass": all(r["passed"] for r in synthetic), "physiological_all_pass": all(r["n"] == r["n_passed"] for r in rows),
            "all_pass": bool(n) and n == n_pass, "n_top_speed_at_clip_ceiling": sum(r["n_at_clip_ceiling"] for r in rows),
        },
    }
    write_json(spark, f"{path}/validation", report)
    return report


def sensitivity_report(df: DataFrame, run: Run, rate: float, path: str, baseline: tuple[int, float] | None = None) -> dict:
    """The sweep over windows and sprint thresholds of one match's frame at its full rate, written as an object. Spreads
    are relative to ``baseline`` (window, threshold), or else to the settings' own if the grids have them."""
    ph, cfg = run.settings["physical"], run.motion(rate)
    windows, thresholds = tuple(ph["sensitivity"]["savgol_window_frames_grid"]), tuple(map(float, ph["sensitivity"]["sprint_threshold_mps_grid"]))
    tracks = reports.outfield_full_match(df)
    swept = reports.by_window(df, cfg, windows)
    grid = physical.sprint_grid(swept, thresholds, rate, tracks, ph["sprint_min_duration_s"], ph["sprint_min_recovery_s"])
    distances = reports.sensitivity_distance(swept, tracks, ph["hsr_threshold_mps"])
    clipped = swept.groupBy("window").agg(F.count_if(F.col("raw_speed") > cfg.max_speed).alias("n")).collect()  # a row a window
    default = baseline or (cfg.window, float(ph["sprint_threshold_mps"]))
    if baseline and not (baseline[0] in windows and baseline[1] in thresholds):
        raise ValueError(f"the baseline {baseline} is not in the grids")
    inside = default[0] in windows and default[1] in thresholds
    spread = reports.sensitivity_spreads(grid, distances, default if inside else None).first().asDict()  # one match
    spread.pop("match_id")
    report = {
        "generated_at": stamp(), "config_hash": settings_hash(run.settings), "frame_rate_hz": rate, "grids": {"savgol_window_frames": windows, "sprint_threshold_mps": thresholds},
        "sprint_count": [{"window": r["window"], "threshold": r["threshold"], "total": r["total_sprints"], "per_player_mean": number(r["sprints_per_player_mean"])} for r in grid.orderBy("window", "threshold").collect()],
        "distance_vs_window": [{"window": r["window"], "mean_km": number(r["mean_distance_m"] / 1000), "mean_hsr_km": number(r["mean_hsr_m"] / 1000)} for r in distances.orderBy("window").collect()],
        "n_clipped": {str(r["window"]): r["n"] for r in clipped}, "headline": {k: number(v) for k, v in spread.items()},
    }
    report["headline"]["sentence"] = (
        f"Windows of {min(windows)} to {max(windows)} frames move the number of sprints by {spread['window_only_pct']:.0f} % and the distance by {spread['distance_pct']:.0f} %; "
        f"thresholds of {min(thresholds):g} to {max(thresholds):g} m/s move it by {spread['threshold_only_pct']:.0f} %, and both together by {spread['spread_pct']:.0f} %."
    )
    write_json(df.sparkSession, f"{path}/sensitivity", report)
    return report


def exit_status(report: dict) -> int:
    """0 if every check passed, else 1."""
    return 0 if report["summary"]["all_pass"] else 1


