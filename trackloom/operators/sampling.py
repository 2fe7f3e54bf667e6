"""Thinning of frames, coverage of tracks, and facts about frames and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FRAME, HALF
from .ranges import ranked, with_previous

PLAYER = ["match_id", "track_id", "team"]


def downsample(df: DataFrame, from_hz: float, to_hz: float) -> DataFrame:
    """Every n-th frame that has players, of each half, from its first; n is rounded half to even."""
    if from_hz <= 0 or to_hz <= 0 or to_hz > from_hz:
        raise ValueError("rates must be positive, and the new one no higher")
    n = round(from_hz / to_hz)
    if n <= 1:
        return df
    frames = df.filter("NOT is_ball").select(*FRAME).distinct()
    kept = ranked(frames, HALF, "frame_id", ["frame_id"], "k").filter((F.col("k") - 1) % n == 0).select(*FRAME)
    return df.join(kept, FRAME, "left_semi")


def coverage_by_period(df: DataFrame) -> DataFrame:
    """Share of a half's frames with players in which a track is."""
    players = df.filter("NOT is_ball")
    frames = players.groupBy(*HALF).agg(F.count_distinct("frame_id").alias("n_total"))
    own = players.groupBy(*PLAYER, "period").agg(F.count_distinct("frame_id").alias("n_frames"))
    return own.join(frames, HALF).withColumn("coverage_pct", F.col("n_frames") * 100.0 / F.col("n_total"))


def coverage_by_match(df: DataFrame) -> DataFrame:
    """Over all halves of the match, those without the track as well."""
    halves = coverage_by_period(df)
    totals = halves.select(*HALF, "n_total").distinct().groupBy("match_id").agg(F.sum("n_total").alias("n_total"))
    own = halves.groupBy(*PLAYER).agg(F.sum("n_frames").alias("n_frames"))
    return own.join(totals, "match_id").select(*PLAYER, (F.col("n_frames") * 100.0 / F.col("n_total")).alias("coverage_pct"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("match_id").agg(F.count("*").alias("n_tracks"), F.avg("coverage_pct").alias("mean_pct"), F.min("coverage_pct").alias("min_pct"))


def full_match_tracks(df: DataFrame) -> DataFrame:
    """Tracks in the first and last frame with players of every half."""
    ends = df.filter("NOT is_ball").groupBy(*HALF, "track_id").agg(F.min("frame_id").alias("low"), F.max("frame_id").alias("high"))
    half, match = Window.partitionBy(*HALF), Window.partitionBy("match_id")  # over a row for each track of a half
    ends = ends.withColumns({"first": F.min("low").over(half), "final": F.max("high").over(half), "halves": F.size(F.collect_set("period").over(match))})
    own = ends.filter("low = first AND high = final").groupBy("match_id", "track_id").agg(F.count("*").alias("n"), F.max("halves").alias("halves"))
    return own.filter("n = halves").select("match_id", "track_id")


def goalkeepers(df: DataFrame) -> DataFrame:
    return df.filter("is_gk").select("match_id", "track_id").distinct()


def period_ranges(df: DataFrame) -> DataFrame:
    return df.groupBy(*HALF).agg(F.min("timestamp").alias("start_s"), F.max("timestamp").alias("end_s"))


def _steps(df: DataFrame) -> DataFrame:
    """Frames with their time and ``step``, the seconds since the frame before."""
    frames = with_previous(df.select(*FRAME, "timestamp").distinct(), HALF, "timestamp", ["timestamp", "frame_id"], {"before": "timestamp"})
    return frames.select(*FRAME, "timestamp", (F.col("timestamp") - F.col("before")).alias("step"))


def match_meta(df: DataFrame) -> DataFrame:
    """Frame rate (one over the median step, 6 places), and the number of halves and frames."""
    frames = _steps(df)
    return frames.groupBy("match_id").agg(F.round(1.0 / F.median("step"), 6).alias("frame_rate"), F.count_distinct("period").alias("n_periods"), F.count("*").alias("n_frames"))


def nearest_frame(df: DataFrame, period: int, seconds: float) -> DataFrame:
    frames = df.filter(F.col("period") == period)
    return frames.groupBy(*HALF).agg(F.min_by("frame_id", F.struct(F.abs(F.col("timestamp") - seconds), "frame_id")).alias("frame_id"))


def nearest_frame_rows(df: DataFrame, period: int, seconds: float) -> DataFrame:
    """All rows of the frame nearest the time, of each match."""
    return df.join(nearest_frame(df, period, seconds), FRAME, "left_semi")


def frame_cells(space: DataFrame, period: int, frame_id: int) -> DataFrame:
    """Players' areas of one frame."""
    return space.filter((F.col("period") == period) & (F.col("frame_id") == frame_id))


def elapsed(df: DataFrame) -> DataFrame:
    """Frames with seconds since the match began: halves before count as long as their last time and one median step."""
    frames = _steps(df)
    halves = frames.groupBy(*HALF).agg((F.max("timestamp") + F.median("step")).alias("long"))
    before = F.coalesce(F.sum("long").over(Window.partitionBy("match_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return frames.join(halves.withColumn("before", before).drop("long"), HALF).select(*FRAME, (F.col("timestamp") + F.col("before")).alias("elapsed_s"))


def clock_label(seconds: Column) -> Column:
    """Minutes and seconds as ``mm:ss``, whole seconds rounded down."""
    whole = F.floor(seconds)
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat(two(F.floor(whole / 60)), F.lit(":"), two(whole % 60))


def gap_breaks(rows: DataFrame, key: list[str], value: str, longest: float = 1.0) -> DataFrame:
    """key, timestamp, value, with a null row in front of each row after too long a gap."""
    w = Window.partitionBy(*key).orderBy("timestamp")
    before = F.lag("timestamp").over(w)
    gap = F.coalesce(F.col("timestamp") - before > longest, F.lit(False))
    marked = rows.select(*key, "timestamp", value).withColumns({"gap": gap, "before": before})
    real = F.struct("timestamp", F.col(value).alias(value))
    blank = F.struct(((F.col("before") + F.col("timestamp")) / 2).alias("timestamp"), F.lit(None).cast("double").alias(value))
    return marked.select(*key, F.inline(F.when(F.col("gap"), F.array(blank, real)).otherwise(F.array(real))))
