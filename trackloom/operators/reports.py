"""Plausibility checks, sensitivity to the window, and tables for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import motion, physical, sampling, shape

PLAYER = ["match_id", "track_id", "team"]
#: check: lowest and highest plausible value.
BANDS = {"distance_km": (9.0, 12.0), "top_speed_mps": (8.0, 11.0), "hsr_share_pct": (5.0, 15.0), "n_sprints": (2.0, 25.0), "hull_median_m2": (300.0, 1500.0)}
PLAYER_CHECKS = ("distance_km", "top_speed_mps", "hsr_share_pct", "n_sprints")
WINDOWS = (11, 15, 21, 25, 31)


def top_speed(kin: DataFrame) -> DataFrame:
    return kin.filter("NOT is_ball").groupBy(*PLAYER).agg(F.max("speed").alias("top_speed_mps"))


def hsr_share(table: DataFrame) -> DataFrame:
    return table.select(*PLAYER, (F.try_divide("hsr_distance_m", "distance_m") * 100).alias("hsr_share_pct"))


def outfield_full_match(df: DataFrame) -> DataFrame:
    return sampling.full_match_tracks(df).exceptAll(sampling.goalkeepers(df))


def range_checks(table: DataFrame, full: DataFrame, keepers: DataFrame, team_shape: DataFrame, bands: dict | None = None, ceiling: float = 12.0) -> DataFrame:
    """A row for each check: four of every full-match outfield track, the top speed of keepers (which has no lower bound),
    and each team's median hull. Tracks under the coverage aren't checked; a missing value fails. A top speed at the
    speed limit is marked: it is a glitch of tracking rather than a run."""
    bands = bands or BANDS
    key = ["match_id", "track_id"]
    known = table.filter("NOT below_coverage")
    values = {"distance_km": F.col("distance_m") / 1000, "top_speed_mps": F.col("top_speed_mps"), "hsr_share_pct": F.try_divide("hsr_distance_m", "distance_m") * 100, "n_sprints": F.col("n_sprints").cast("double")}
    rows = F.array(*(F.struct(F.lit(k).alias("check"), values[k].alias("value"), F.lit(bands[k][0]).alias("low"), F.lit(bands[k][1]).alias("high")) for k in PLAYER_CHECKS))
    goal = F.array(F.struct(F.lit("gk_top_speed_mps").alias("check"), F.col("top_speed_mps").alias("value"), F.lit(None).cast("double").alias("low"), F.lit(bands["top_speed_mps"][1]).alias("high")))
    # The table is costly and read once: its tracks are marked and give the rows of their kind.
    marked = known.join(full.select(*key).distinct().withColumn("_full_", F.lit(True)), key, "left").join(keepers.select(*key).distinct().withColumn("_keeper_", F.lit(True)), key, "left")
    own = F.when(F.col("_keeper_"), F.when(F.col("top_speed_mps").isNotNull(), goal)).when(F.col("_full_"), rows)
    tracks = marked.select(*PLAYER, F.inline(own))
    low, high = bands["hull_median_m2"]
    hulls = shape.compactness_median(team_shape).select("match_id", F.lit(None).cast("string").alias("track_id"), "team", F.lit("hull_median_m2").alias("check"), F.col("hull_median_m2").alias("value"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    fits = F.col("value").isNotNull() & F.coalesce(F.col("value") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("high"), F.lit(True))
    at_limit = F.when(F.col("check").endswith("top_speed_mps") & F.col("value").isNotNull(), F.abs(F.col("value") - ceiling) <= 1e-9 * ceiling)
    return tracks.unionByName(hulls).withColumns({"passed": fits, "at_clip_ceiling": at_limit})


def excluded(table: DataFrame, full: DataFrame, least: float = 95.0) -> DataFrame:
    """How many full-match tracks are under the coverage, for each check that isn't made of them, and why."""
    refused = table.filter("below_coverage").join(full, ["match_id", "track_id"], "left_semi").groupBy("match_id").agg(F.count("*").alias("n_tracks"))
    reason = F.concat(F.col("n_tracks").cast("string"), F.lit(f" of the full-match tracks have under {least:g}% coverage and no physical values"))
    return refused.select("match_id", F.explode(F.array(*map(F.lit, PLAYER_CHECKS))).alias("check"), "n_tracks", reason.alias("reason"))


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.median("value").alias("median"), F.count_if(F.coalesce("at_clip_ceiling", F.lit(False))).alias("n_at_clip_ceiling"))


def by_window(df: DataFrame, cfg: motion.Motion = motion.Motion(), windows=WINDOWS) -> DataFrame:
    """Kinematics for each smoothing window, with the window as a column."""
    return motion.kinematics_by_window(df, cfg, tuple(windows))


def sensitivity_distance(swept: DataFrame, tracks: DataFrame, fast: float = physical.FAST) -> DataFrame:
    """Mean distance and fast running by window, over the tracks asked for."""
    held = swept.join(tracks, ["match_id", "track_id"], "left_semi").withColumn("step", F.coalesce("step_dist", F.lit(0.0)))
    quick = F.sum(F.when(F.coalesce(F.col("speed"), F.lit(0.0)) >= fast, F.col("step")).otherwise(0.0))
    own = held.groupBy("window", "match_id", "track_id").agg(F.sum("step").alias("d"), quick.alias("h"))
    return own.groupBy("match_id", "window").agg(F.avg("d").alias("mean_distance_m"), F.avg("h").alias("mean_hsr_m"))


def sensitivity_spreads(grid: DataFrame, distances: DataFrame, default: tuple[int, float] | None = (21, physical.SPRINT)) -> DataFrame:
    """By match: the spread of the number of sprints over the whole grid, over thresholds and over windows alone (the
    other at its lower median), that of the mean distance over windows, and that of sprints against the default cell."""
    cells, means = F.col("cells"), F.col("means")
    held = grid.groupBy("match_id").agg(F.collect_list(F.struct("window", "threshold", F.col("total_sprints").alias("v"))).alias("cells"))
    held = held.join(distances.groupBy("match_id").agg(F.collect_list(F.struct("window", F.col("mean_distance_m").alias("v"))).alias("means")), "match_id")
    reference = {k: physical.middle(cells, k) for k in ("window", "threshold")}
    found = {
        "spread_pct": physical.cell_spread(cells, reference), "threshold_only_pct": physical.cell_spread(cells, reference, ("window",)), "window_only_pct": physical.cell_spread(cells, reference, ("threshold",)),
        "distance_pct": physical.cell_spread(means, {"window": reference["window"]}),
    }
    if default is not None:
        found["vs_default_pct"] = physical.cell_spread(cells, {"window": F.lit(default[0]), "threshold": F.lit(default[1])})
    return held.select("match_id", *(c.alias(n) for n, c in found.items()))


def grid_pivot(grid: DataFrame, thresholds=(6.5, 7.0, 7.5, 8.0)) -> DataFrame:
    named = grid.withColumn("cell", F.concat(F.lit("t"), F.regexp_replace(F.format_number("threshold", 1), r"\.", "_")))
    return named.groupBy("match_id", "window").pivot("cell", [f"t{t:.1f}".replace(".", "_") for t in thresholds]).agg(F.first("total_sprints"))


def player_table(table: DataFrame, coverage: DataFrame) -> DataFrame:
    """For display: every track of either side, its distance with the coverage beside it, or why there is none."""
    joined = coverage.select(*PLAYER, "coverage_pct").join(table.select(*PLAYER, "distance_m", "below_coverage"), PLAYER, "full")
    share = F.concat(F.lit(" ("), F.format_number("coverage_pct", 0), F.lit("% cov)"))
    text = F.when(F.col("below_coverage"), "n/a (low coverage)").when(F.col("distance_m").isNull(), "—").otherwise(F.concat(F.format_number("distance_m", 0), F.coalesce(share, F.lit(""))))
    return joined.select(*PLAYER, "coverage_pct", text.alias("distance_text"))


def display_order(shown: DataFrame) -> DataFrame:
    """By match, the home team first, the best covered tracks on top."""
    return shown.orderBy("match_id", F.desc("team"), F.desc_nulls_last("coverage_pct"), "track_id")


def coverage_ranked(coverage: DataFrame) -> DataFrame:
    """For a chart: tracks of each match by coverage, with the match's mean."""
    w = Window.partitionBy("match_id")
    ranked = F.row_number().over(w.orderBy(F.desc("coverage_pct"), "track_id"))
    return coverage.withColumns({"place": ranked, "mean_pct": F.avg("coverage_pct").over(w)})


def match_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("match_id").agg(F.count("*").alias("n_rows"), F.count_distinct(F.when(~F.col("is_ball"), F.col("track_id"))).alias("n_tracks"))
