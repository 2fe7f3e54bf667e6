"""Velocity, speed and distance of tracks, in window functions over slices of (match, half, track).

A track breaks into segments where a gap is too long or a step impossible. Each segment is resampled to the frame
rate if it isn't regular, differentiated by a Savitzky-Golay filter (polynomial fits at the ends), and read back at its own
times. Orders 1 and 2 have a closed form; higher ones are projections whose weights are literal arrays, one for the middle
and one for each place at the ends. The window is odd and shrinks for short segments; one that is too short for the order
has plain differences. Ball rows stay, without any of it.

No task has a whole track. Rows are cut into slices of time: what a slice needs of others is its neighbours' rows at its
ends and, for each piece of a segment, sums carried over the track's pieces (segments so far, rows so far, first and last
time). Grid points are cut into slices of points with a halo, in which every window is complete.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HALF

TRACK = [*HALF, "track_id"]
SEGMENT = [*TRACK, "seg"]
#: Seconds of a track, and grid points of a segment, that one group of a window has (the points without their halo).
SLICE_SECONDS, SLICE_POINTS = 160.0, 4096
_SLICE = "_slice_"


@dataclass(frozen=True)
class Motion:
    rate: float = 25.0
    window: int = 21
    max_speed: float = 12.0
    max_gap: float = 1.0
    glitch_speed: float | None = 12.0  # None: no step is impossible
    order: int = 2

    def __post_init__(self):
        if self.window % 2 == 0 or not 1 <= self.order < self.window:
            raise ValueError("window must be odd and larger than the order, which is at least 1")
        if min(self.rate, self.max_speed, self.max_gap) <= 0:
            raise ValueError("rate, max_speed and max_gap must be positive")

    @property
    def dt(self) -> float:
        return 1.0 / self.rate


def segments(df: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """Player rows with step_s (seconds since the row before), impossible, breaks, glitch and seg; and, for
    ``uniform_grid``, each row's place in its segment (i), the segment's t0, n_grid and regular, and the sample after it."""
    key, here = [*TRACK, _SLICE], F.struct("timestamp", "frame_id", F.col("x_pitch").alias("x"), F.col("y_pitch").alias("y"))
    # Rows without a time come first, as in the order.
    rows = df.filter("NOT is_ball").withColumn(_SLICE, F.coalesce(F.floor(F.col("timestamp") / SLICE_SECONDS), F.lit(-(1 << 62))))
    ends = rows.groupBy(*key).agg(F.min(here).alias("head"), F.max(here).alias("tail"))
    w = Window.partitionBy(*TRACK).orderBy(_SLICE)
    ends = ends.select(*key, F.lag("tail").over(w).alias("_tail_"), F.lead("head").over(w).alias("_head_"))

    w = Window.partitionBy(*key).orderBy("timestamp", "frame_id")
    laid = rows.join(ends, key).withColumns({"_before_": F.coalesce(F.lag(here).over(w), "_tail_"), "_after_": F.coalesce(F.lead(here).over(w), "_head_")})
    step = lambda a, b: b["timestamp"] - a["timestamp"]
    jump = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))

    def impossible(a: Column, b: Column) -> Column:
        return F.lit(False) if cfg.glitch_speed is None else F.coalesce((jump(a, b) > cfg.glitch_speed * step(a, b)) & (step(a, b) <= cfg.max_gap), F.lit(False))

    before, after = F.col("_before_"), F.col("_after_")
    laid = laid.withColumns({"step_s": step(before, here), "jump": jump(before, here), "impossible": impossible(before, here), "_next_": impossible(here, after)})
    laid = laid.withColumn("breaks", F.col("step_s").isNull() | (F.col("step_s") > cfg.max_gap) | F.col("impossible"))
    # Piece 0 of a slice goes on with the last segment of the slice before; every other begins a segment.
    laid = laid.withColumns({"glitch": F.col("impossible") & F.col("_next_"), "_piece_": F.sum(F.col("breaks").cast("int")).over(w)})
    own = Window.partitionBy(*key, "_piece_").orderBy("timestamp", "frame_id")
    laid = laid.withColumns({"_i_": (F.row_number().over(own) - 1).cast("long"), "_sample_": F.lead(here).over(own)}).drop("_before_", "_after_", "_tail_", "_head_", "_next_")
    return laid.join(_pieces(laid, cfg), [*key, "_piece_"]).withColumns({"i": F.col("_i_") + F.col("_done_"), "sample_after": F.coalesce("_sample_", "_first_")}).drop(_SLICE, "_piece_", "_i_", "_sample_", "_done_", "_first_")


def _pieces(laid: DataFrame, cfg: Motion) -> DataFrame:
    """One row for each piece of a segment in a slice: the segment and its facts, how many of its rows are before the piece
    (_done_) and its first one after it (_first_)."""
    here = F.struct("timestamp", "frame_id", F.col("x_pitch").alias("x"), F.col("y_pitch").alias("y"))
    late = F.col("timestamp") - F.col("_i_") * cfg.dt
    pieces = laid.groupBy(*TRACK, _SLICE, "_piece_").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.min(here).alias("head"), F.min(late).alias("least"), F.max(late).alias("most"))
    pieces = pieces.withColumn("seg", F.sum((F.col("_piece_") > 0).cast("int")).over(Window.partitionBy(*TRACK).orderBy(_SLICE, "_piece_")))
    whole, w = Window.partitionBy(*SEGMENT), Window.partitionBy(*SEGMENT).orderBy(_SLICE)
    done = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumns({"_done_": done, "_first_": F.lead("head").over(w), "t0": F.min("first").over(whole), "n": F.sum("n").over(whole), "last": F.max("last").over(whole)})
    # A regular segment has its rows where a grid from t0 would have them.
    start = F.col("t0") + F.col("_done_") * cfg.dt
    off = F.max(F.greatest(F.abs(F.col("least") - start), F.abs(F.col("most") - start))).over(whole)
    pieces = pieces.withColumns({"n_grid": F.bround((F.col("last") - F.col("t0")) / cfg.dt).cast("long") + 1, "off": off})
    regular = (F.col("n_grid") == F.col("n")) & (F.col("off") <= cfg.dt * 1e-3)
    return pieces.select(*TRACK, _SLICE, "_piece_", "seg", "_done_", "_first_", "t0", "n_grid", regular.alias("regular"))


def uniform_grid(laid: DataFrame, cfg: Motion = Motion()) -> tuple[DataFrame, DataFrame]:
    """(samples with i, t0, n_grid and regular; the segments' grid points with x and y)."""
    dt = cfg.dt
    s = laid.filter("NOT glitch")
    place = lambda t: F.ceil((t - F.col("t0")) / dt - 1e-6)
    after, regular = F.col("sample_after"), F.col("regular")
    first = F.when(regular, F.col("i")).otherwise(place(F.col("timestamp")))
    stop = F.when(after.isNull(), F.col("n_grid")).when(regular, F.col("i") + 1).otherwise(place(after["timestamp"])) - 1
    g = s.withColumns({"at": first, "to": stop}).filter("to >= at").withColumn("g", F.explode(F.sequence("at", "to")))
    part = F.when(regular | after.isNull(), 0.0).otherwise(F.try_divide(F.col("t0") + F.col("g") * dt - F.col("timestamp"), after["timestamp"] - F.col("timestamp")))
    part = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    ahead = lambda c: F.col(f"{c}_pitch") + (F.coalesce(after[c], F.col(f"{c}_pitch")) - F.col(f"{c}_pitch")) * part
    return s, g.select(*SEGMENT, "g", "n_grid", ahead("x").alias("gx"), ahead("y").alias("gy"))


def projection_weights(m: int, order: int) -> np.ndarray:
    """Row k, 0 to 2 m: the weights of 2 m + 1 values at unit steps whose sum is the derivative at value k of the polynomial
    that fits them best. The fit is a projection on an orthogonal basis, over places from -1 to 1."""
    places = np.arange(-m, m + 1) / m
    powers = np.vander(places, order + 1, increasing=True)
    basis, triangle = np.linalg.qr(powers)
    slopes = np.column_stack([np.zeros(2 * m + 1), *(k * places ** (k - 1) for k in range(1, order + 1))])
    return slopes @ np.linalg.solve(triangle, basis.T) / m


def _projected(c: str, cfg: Motion, reach: int) -> Column:
    """As ``_derivative``, for any order: the weights are looked up by half the window and the place within it."""
    half, dt = cfg.window // 2, cfg.dt
    g, n, around = F.col("g"), F.col("n_grid"), F.col(f"around_{c}")
    m = F.least(F.lit(half), F.floor((n - 1) / 2)).cast("int")
    own = F.least(g, F.lit(reach)).cast("int")
    least = cfg.order // 2 + 1  # the shortest window that is longer than the order
    tables = [projection_weights(k, cfg.order).tolist() if k >= least else [] for k in range(half + 1)]
    middle = F.from_json(F.lit(json.dumps(projection_weights(half, cfg.order)[half].tolist())), "array<double>")
    ends = F.from_json(F.lit(json.dumps(tables)), "array<array<array<double>>>")
    dot = lambda values, weights: F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) / dt
    inner = dot(F.slice(around, own - half + 1, 2 * half + 1), middle)
    # A window that lies inside the segment and as near to the point as it can.
    first = F.least(F.greatest(g - m, F.lit(0)), n - 1 - 2 * m)
    outer = dot(F.slice(around, (own + first - g + 1).cast("int"), 2 * m + 1), F.get(F.get(ends, m), (g - first).cast("int")))
    before, after = F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.size(around) - 1)
    plain = F.try_divide(F.get(around, after) - F.get(around, before), (after - before) * dt)
    return F.when(n == 1, 0.0).when(m < least, plain).when((n >= cfg.window) & g.between(half, n - 1 - half), inner).otherwise(outer)


def _derivative(c: str, cfg: Motion, reach: int) -> Column:
    """d/dt at a grid point of its segment, per the columns g, n_grid, around_<c>: the values of the points up to
    ``reach`` away, in order, and sum_<c>_<half> of ``_with_sums``. m is half the window that fits."""
    if cfg.order > 2:
        return _projected(c, cfg, reach)
    half, dt = cfg.window // 2, cfg.dt
    g, n, around = F.col("g"), F.col("n_grid"), F.col(f"around_{c}")
    # One row of sums would be divided by zero where there are one or two points: m is at least 1 there.
    m = F.greatest(F.least(F.lit(half), F.floor((n - 1) / 2)), F.lit(1)).cast("int")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    inner = F.col(f"sum_{c}_{half}") / (half * (half + 1) * (2 * half + 1) / 3 * dt)
    md = m.cast("double")
    s2 = md * (md + 1) * (2 * md + 1) / 3
    s4 = s2 * (3 * md * md + 3 * md - 1) / 5
    width = 2 * md + 1

    def fitted(first: Column, centre: Column) -> Column:
        values, k = F.slice(around, first, 2 * m + 1), (g - centre).cast("double")
        a1 = total(F.transform(values, lambda v, i: (i - m) * v)) / s2
        if cfg.order == 1:
            return a1 / dt
        a2 = (width * total(F.transform(values, lambda v, i: (i - m) * (i - m) * v)) - s2 * total(values)) / (width * s4 - s2 * s2)
        return (a1 + 2 * a2 * k) / dt

    head, tail = fitted(F.lit(1), m), fitted(F.greatest(F.size(around) - 2 * m, F.lit(1)), n - 1 - m)
    pair = (F.get(around, F.lit(1)) - F.get(around, F.lit(0))) / dt
    return F.when(n == 1, 0.0).when(n == 2, pair).when((n >= cfg.window) & g.between(half, n - 1 - half), inner).when(F.when(n >= cfg.window, g < half).otherwise(g <= m), head).otherwise(tail)


def _with_sums(wide: DataFrame, halves: list[int], reach: int) -> DataFrame:
    """sum_<c>_<half>: the steps from -k to k times k, added up for k from 1 to ``half``. A wider window goes on from the
    narrower one's sum; the terms are written out, as functions over arrays are not compiled."""
    own, done = F.least(F.col("g"), F.lit(reach)).cast("int"), 0
    sums = {c: F.lit(0.0) for c in "xy"}
    for half in halves:
        for c in "xy":
            around = F.col(f"around_{c}")
            for k in range(done + 1, half + 1):
                sums[c] = sums[c] + k * (F.get(around, own + k) - F.get(around, own - k))
        wide = wide.withColumns({f"sum_{c}_{half}": v for c, v in sums.items()})
        sums, done = {c: F.col(f"sum_{c}_{half}") for c in "xy"}, half
    return wide


def grid_velocity(grid: DataFrame, cfg: Motion = Motion(), windows: tuple[int, ...] | None = None) -> DataFrame:
    """Velocity at every grid point and at the next one of its segment (itself at the end), as columns gvx_<window>,
    gvy_<window> and next_...: all windows from the same values around."""
    windows = windows or (cfg.window,)
    reach = 2 * (max(windows) // 2)
    # A point goes to its own slice and to those within whose points' reach, or next point's reach, it is.
    slice_of = lambda g: F.floor(g / SLICE_POINTS)
    g, last = F.col("g"), F.col("n_grid") - 1
    dealt = grid.withColumn(_SLICE, F.explode(F.sequence(slice_of(F.greatest(g - reach - 1, F.lit(0))), slice_of(F.least(g + reach, last)))))
    w = Window.partitionBy(*SEGMENT, _SLICE).orderBy("g")
    wide = dealt.withColumns({f"around_{c}": F.collect_list(f"g{c}").over(w.rowsBetween(-reach, reach)) for c in "xy"})
    if cfg.order <= 2:
        wide = _with_sums(wide, sorted({k // 2 for k in windows}), reach)
    columns = {f"gv{c}_{k}": _derivative(c, replace(cfg, window=k), reach) for k in windows for c in "xy"}
    v = wide.select(*SEGMENT, _SLICE, "g", *(v.alias(k) for k, v in columns.items()))
    v = v.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(w), c) for c in columns})
    return v.filter(slice_of(g) == F.col(_SLICE)).drop(_SLICE)


def kinematics(df: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """All rows with vx, vy, speed and step_dist (null in a glitch and for the ball), speed before the limit as raw_speed."""
    return kinematics_by_window(df, cfg, (cfg.window,)).drop("window")


def kinematics_by_window(df: DataFrame, cfg: Motion = Motion(), windows: tuple[int, ...] = (21,)) -> DataFrame:
    """As ``kinematics``, for each smoothing window: only the derivative is made more than once."""
    laid = segments(df, cfg)
    v = grid_velocity(uniform_grid(laid, cfg)[1], cfg, windows)
    place = F.least((F.col("timestamp") - F.col("t0")) / cfg.dt, (F.col("n_grid") - 1).cast("double"))
    place = F.when(~F.col("glitch"), F.when(F.col("regular"), F.col("i").cast("double")).otherwise(place))
    between = lambda c: F.col(c) + (F.col(f"next_{c}") - F.col(c)) * F.col("_part_")
    both = F.array(*(F.struct(F.lit(k).alias("window"), between(f"gvx_{k}").alias("vx"), between(f"gvy_{k}").alias("vy")) for k in windows))
    none = F.lit(None).cast("double")
    blank = F.array(*(F.struct(F.lit(k).alias("window"), none.alias("vx"), none.alias("vy")) for k in windows))
    kept = [c for c in laid.columns if c not in ("i", "t0", "n_grid", "regular", "sample_after")]
    at = laid.withColumn("_part_", place).withColumn("g", F.floor("_part_")).withColumn("_part_", F.col("_part_") - F.col("g"))
    found = at.join(v, [*SEGMENT, "g"], "left").select(*kept, F.explode(F.when(F.col("gvx_%d" % windows[0]).isNull(), blank).otherwise(both)).alias("v"))
    out = found.select(*kept, "v.*")
    out = out.withColumn("raw_speed", F.round(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), 9))
    limit = F.when(F.col("raw_speed") > cfg.max_speed, cfg.max_speed / F.col("raw_speed")).otherwise(1.0)
    out = out.withColumns({"speed": F.when(F.col("raw_speed") > cfg.max_speed, cfg.max_speed).otherwise(F.col("raw_speed")), "vx": F.col("vx") * limit, "vy": F.col("vy") * limit})
    players = out.withColumn("step_dist", F.when(F.col("glitch"), None).when(F.col("breaks"), 0.0).otherwise(F.col("speed") * F.col("step_s")))
    ball = df.filter("is_ball").withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    return players.unionByName(ball, allowMissingColumns=True)


def clip_report(kin: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """By match: of all players' rows, those over the limit, and the steps and rows that were impossible."""
    over = F.count_if(F.col("raw_speed") > cfg.max_speed)
    usable = F.count("*")
    share, most = F.coalesce(F.try_divide(over, usable), F.lit(0.0)), F.coalesce(F.max("raw_speed"), F.lit(0.0))
    return kin.filter("NOT is_ball").groupBy("match_id").agg(over.alias("n_clipped"), usable.alias("n_total"), share.alias("clipped_share"), most.alias("max_raw_speed"), F.count_if("impossible").alias("glitch_steps"), F.count_if("glitch").alias("glitch_frames"))


def total_distance(kin: DataFrame, by_period: bool = False) -> DataFrame:
    """Tracks without any step are left out."""
    key = TRACK if by_period else ["match_id", "track_id"]
    return kin.filter("step_dist IS NOT NULL").groupBy(*key).agg(F.sum("step_dist").alias("distance_m"))
