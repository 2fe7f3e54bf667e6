"""Physical load: distance, speed zones, fast running, sprints, and the coverage rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .motion import TRACK

PLAYER = ["match_id", "track_id", "team"]
ZONES = ((0.0, 2.0), (2.0, 4.0), (4.0, 5.5), (5.5, 7.0), (7.0, 99.0))
FAST = 5.5
SPRINT = 7.0


def _checked(zones) -> None:
    if any(a >= b for a, b in zones) or any(x[1] != y[0] for x, y in zip(zones, zones[1:])):
        raise ValueError("zones must be ascending and without gaps")


def _label(low: float, high: float | None) -> str:
    return f"{low:g}+" if high is None else f"{low:g}-{high:g}"


def _by_zone(rows: DataFrame, key: list[str], zone: Column, labels: list[str]) -> DataFrame:
    """Every track with every zone, 0 where it has no row: conditional sums, then one row a zone."""
    sums = [F.sum(F.when(zone == i, F.col("step_dist")).otherwise(0.0)).alias(f"z{i}") for i in range(len(labels))]
    rows_of = F.array(*(F.struct(F.lit(x).alias("zone"), F.lit(i).alias("zone_no"), F.col(f"z{i}").alias("distance_m")) for i, x in enumerate(labels)))
    return rows.groupBy(*key).agg(*sums).select(*key, F.inline(rows_of))


def closed_zones(kin: DataFrame, zones=ZONES) -> DataFrame:
    """Distance by zone; a speed outside all of them is an error."""
    _checked(zones)
    zone = F.raise_error(F.concat(F.lit("speed outside the zones: "), F.col("speed").cast("string"))).cast("int")
    for i, (low, high) in reversed(list(enumerate(zones))):
        zone = F.when((F.col("speed") >= low) & (F.col("speed") < high), i).otherwise(zone)
    return _by_zone(kin.filter("step_dist IS NOT NULL"), ["match_id", "track_id"], zone, [_label(*z) for z in zones])


def open_zones(kin: DataFrame, zones=ZONES) -> DataFrame:
    """Distance by zone, the last one without an upper end and the first without a lower; missing speed counts as 0."""
    _checked(zones)
    zone = F.lit(0)
    for i, (low, _) in list(enumerate(zones))[1:]:
        zone = F.when(F.col("speed") >= low, i).otherwise(zone)
    return _by_zone(_players(kin), PLAYER, zone, [_label(a, None if k == len(zones) - 1 else b) for k, (a, b) in enumerate(zones)])


def _players(kin: DataFrame) -> DataFrame:
    return kin.filter("NOT is_ball").withColumns({"speed": F.coalesce("speed", F.lit(0.0)), "step_dist": F.coalesce("step_dist", F.lit(0.0))})


def distance_covered(kin: DataFrame) -> DataFrame:
    """By half, and for the match (period null), in one pass."""
    return _players(kin).groupingSets([[*map(F.col, PLAYER), F.col("period")], [*map(F.col, PLAYER)]], *PLAYER, "period").agg(F.sum("step_dist").alias("distance_m"))


def fast_running(kin: DataFrame, threshold: float = FAST) -> DataFrame:
    return _players(kin).groupBy(*PLAYER).agg(F.sum(F.when(F.col("speed") >= threshold, F.col("step_dist")).otherwise(0.0)).alias("hsr_distance_m"))


def _efforts(kin: DataFrame, limit: Column, min_recovery: float, rate: float, key: list[str]) -> DataFrame:
    """Players' rows in order (rn), with the effort that they would belong to, its last fast row, and the speed as top."""
    ordered = Window.partitionBy(*key).orderBy("timestamp", "frame_id")
    rows = _players(kin.withColumn("top", F.col("speed"))).withColumn("rn", F.row_number().over(ordered)).withColumn("fast", F.col("speed") >= limit)
    # Of the rows up to here the last fast one, and from here on the next: a gap lies between the two.
    before = F.last(F.when(F.col("fast"), F.col("rn")), True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("starts", F.col("fast") & (F.col("before").isNull() | (F.col("rn") - F.col("before") - 1 >= min_recovery * rate)))
    rows = rows.withColumn("effort", F.sum(F.col("starts").cast("int")).over(ordered)).withColumn("effort", F.when(F.col("effort") > 0, F.col("effort")))
    return rows.withColumn("last", F.max(F.when(F.col("fast"), F.col("rn"))).over(Window.partitionBy(*key, "effort")))


def sprints(kin: DataFrame, threshold: float = SPRINT, min_duration: float = 1.0, min_recovery: float = 1.0, rate: float = 25.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """Efforts: runs of fast rows, joined over fewer slow rows than the recovery has, of at least the duration.
    ``extra`` columns (a sweep's parameters) are part of every key; a column of them named threshold takes effect."""
    key = [*extra, *TRACK]
    rows = _efforts(kin, F.col("threshold") if "threshold" in extra else F.lit(threshold), min_recovery, rate, key).filter("effort IS NOT NULL AND rn <= last")
    out = rows.groupBy(*key, "effort").agg(
        F.min_by("team", "rn").alias("team"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), (F.count("*") / F.lit(rate)).alias("duration_s"),
        F.max("speed").alias("peak_speed_mps"), F.avg("speed").alias("mean_speed_mps"), F.sum("step_dist").alias("distance_m"))
    return out.filter(F.col("duration_s") >= min_duration).drop("effort")


def sprint_counts(efforts: DataFrame) -> DataFrame:
    return efforts.groupBy(*PLAYER).agg(F.count("*").alias("n_sprints"), F.sum("distance_m").alias("sprint_distance_m"))


def sprint_grid(kin: DataFrame, thresholds=(6.5, 7.0, 7.5, 8.0), rate: float = 25.0, players: DataFrame | None = None, min_duration: float = 1.0, min_recovery: float = 1.0) -> DataFrame:
    """Sprints for each threshold (and window, if ``kin`` has that column); the mean is over ``players`` or all tracks."""
    extra = ["window"] if "window" in kin.columns else []
    key = [*extra, *TRACK]
    limits = F.array(*map(F.lit, thresholds))
    numbered = _players(kin).withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("timestamp", "frame_id")))
    # Only fast rows go on, an effort being as long as its first and last one are apart; and each track's first row, without
    # a threshold: so tracks without efforts are found in the same reading.
    reached = F.filter(limits, lambda t: t <= F.col("speed"))
    mark = F.when(F.col("rn") == 1, F.array(F.lit(None).cast("double"))).otherwise(F.array().cast("array<double>"))
    quick = numbered.filter((F.col("speed") >= min(thresholds)) | (F.col("rn") == 1)).withColumn("threshold", F.explode(F.concat(mark, reached)))
    w = Window.partitionBy(*key, "threshold").orderBy("rn")
    gap = F.col("rn") - F.lag("rn").over(w) - 1
    efforts = quick.withColumn("starts", F.coalesce(gap >= min_recovery * rate, F.lit(True)).cast("int")).withColumn("effort", F.sum("starts").over(w))
    efforts = efforts.groupBy(*key, "threshold", "effort").agg((F.max("rn") - F.min("rn") + 1).alias("n"))
    long_ = F.col("n") / F.lit(rate) >= min_duration
    found = efforts.groupBy(*extra, "match_id", "track_id").agg(*(F.count_if(long_ & (F.col("threshold") == t)).alias(f"k{i}") for i, t in enumerate(thresholds)))
    counted = F.lit(1)
    if players is not None:
        found = found.join(players.select("match_id", "track_id").distinct().withColumn("counted", F.lit(1)), ["match_id", "track_id"], "left")
        counted = F.col("counted")
    by_limit = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("k")) for i, t in enumerate(thresholds)))
    joined = found.select(*extra, "match_id", counted.alias("counted"), F.inline(by_limit))
    return joined.groupBy("match_id", *extra, "threshold").agg(F.sum("k").alias("total_sprints"), F.avg(F.when(F.col("counted") == 1, F.col("k"))).alias("sprints_per_player_mean"))


def middle(cells: Column, key: str) -> Column:
    """The lower median of the distinct values of ``key``."""
    values = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c[key])))
    return F.element_at(values, F.floor((F.size(values) - 1) / 2).cast("int") + 1)


def cell_spread(cells: Column, reference: dict[str, Column], fixed: tuple[str, ...] = ()) -> Column:
    """(most - least) / reference * 100 of the values ``v`` of an array of cells, those alone that have the reference's
    ``fixed`` keys. A reference that is missing or zero is an error."""

    def at(keys):
        def same(cell: Column) -> Column:
            found = F.lit(True)
            for k in keys:
                found &= F.abs(cell[k] - reference[k]) < 1e-9
            return found

        return same

    values = F.transform(F.filter(cells, at(fixed)), lambda c: c["v"])
    own = F.get(F.filter(cells, at(tuple(reference))), 0)["v"]
    checked = F.when(F.coalesce(own, F.lit(0)) != 0, own).otherwise(F.raise_error(F.lit("the reference cell is missing or zero")).cast("double"))
    return (F.array_max(values) - F.array_min(values)) / checked * 100


def spread_percent(grid: DataFrame, keys: tuple[str, ...] = ("threshold",), value: str = "total_sprints", baseline: tuple | None = None) -> DataFrame:
    """By match (most - least) / reference * 100. The reference is the cell of ``baseline``, or that of the lower median of
    the distinct values of each key. Its absence, or a zero there, is an error."""
    held = grid.groupBy("match_id").agg(F.collect_list(F.struct(*keys, F.col(value).alias("v"))).alias("cells"))
    reference = {k: F.lit(baseline[i]) if baseline else middle(F.col("cells"), k) for i, k in enumerate(keys)}
    return held.select("match_id", cell_spread(F.col("cells"), reference).alias("spread_pct"))


def apply_coverage(physical: DataFrame, coverage: DataFrame, least: float = 95.0) -> DataFrame:
    """Three metrics become null under the coverage; a track without any has 0."""
    metrics = ["distance_m", "hsr_distance_m", "n_sprints"]
    if missing := [m for m in metrics if m not in physical.columns]:
        raise KeyError(f"missing metrics: {missing}")
    joined = physical.drop("coverage_pct", "below_coverage").join(coverage.select(*PLAYER, "coverage_pct"), PLAYER, "left").withColumn("coverage_pct", F.coalesce("coverage_pct", F.lit(0.0)))
    joined = joined.withColumn("below_coverage", F.col("coverage_pct") < least)
    return joined.withColumns({m: F.when(~F.col("below_coverage"), F.col(m)) for m in metrics})


def physical_table(kin: DataFrame, coverage: DataFrame, rate: float = 25.0, fast: float = FAST, sprint: float = SPRINT, min_duration: float = 1.0, min_recovery: float = 1.0, least: float = 95.0) -> DataFrame:
    """Distance, fast running, sprints and top speed, in one pass over the rows: a track's rows, with their effort if
    they belong to one, are summed by effort, and the efforts by player."""
    rows = _efforts(kin, F.lit(sprint), min_recovery, rate, TRACK)
    counted = F.col("effort").isNotNull() & (F.col("rn") <= F.col("last"))
    parts = rows.groupBy(*TRACK, "team", F.when(counted, F.col("effort")).alias("effort")).agg(
        F.count("*").alias("n"), F.sum("step_dist").alias("d"), F.sum(F.when(F.col("speed") >= fast, F.col("step_dist")).otherwise(0.0)).alias("h"), F.max("top").alias("top"))
    long_ = F.col("effort").isNotNull() & (F.col("n") / F.lit(rate) >= min_duration)
    table = parts.groupBy(*PLAYER).agg(F.sum("d").alias("distance_m"), F.sum("h").alias("hsr_distance_m"), F.count_if(long_).alias("n_sprints"), F.max("top").alias("top_speed_mps"))
    return apply_coverage(table, coverage, least)
