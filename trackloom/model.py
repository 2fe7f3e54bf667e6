"""The tracking frame: one row per match, period, frame and track, the ball being a track as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ranges import with_previous

#: Columns and types; only jersey_number may be null.
SCHEMA = (
    "match_id string, period tinyint, frame_id bigint, timestamp double, track_id string, team string, jersey_number smallint, "
    "x_pitch double, y_pitch double, is_ball boolean, is_gk boolean, ball_state string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0
#: Farthest a sample may be from the centre spot.
X_MOST, Y_MOST = 57.5, 39.0
HALF = ["match_id", "period"]
FRAME = [*HALF, "frame_id"]


class ContractError(ValueError):
    """A frame that breaks the rules of the tracking frame."""


def empty_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def coerce(df: DataFrame) -> DataFrame:
    """Casts to the frame's types; what doesn't cast becomes null. NaN becomes null."""
    out = []
    for field in SCHEMA.split(", "):
        name, kind = field.split()
        value = F.col(name).try_cast(kind)
        out.append((F.when(~F.isnan(value), value) if kind == "double" else value).alias(name))
    return df.select(*out)


def drop_off_pitch(df: DataFrame) -> DataFrame:
    return df.filter((F.abs("x_pitch") <= X_MOST) & (F.abs("y_pitch") <= Y_MOST))


def _rules() -> dict[str, Column]:
    """What a row must not be, by the rule's name."""
    ball = F.col("team") == "ball"
    null = [c for c in COLUMNS if c != "jersey_number"]
    return {
        "bad_team": ~F.col("team").isin("home", "away", "ball"),
        "bad_ball_state": ~F.col("ball_state").isin("alive", "dead"),
        "nulls": F.coalesce(*[F.when(F.col(c).isNull(), True) for c in null], F.lit(False)),
        "bad_period": ~F.col("period").isin(1, 2),
        "off_pitch": (F.abs("x_pitch") > X_MOST) | (F.abs("y_pitch") > Y_MOST),
        "ball_mismatch": F.col("is_ball") != ball,
        "keeper_ball": F.col("is_gk") & F.col("is_ball"),
    }


def _normalised() -> Column:
    return F.coalesce(F.bool_and(F.col("x_pitch").between(0.0, 1.0)), F.lit(False))


def rule_counts(df: DataFrame) -> DataFrame:
    """How many rows break each row rule, in one pass."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count_if(x).alias(k) for k, x in _rules().items()), _normalised().alias("normalised"))


def validation_counts(df: DataFrame) -> DataFrame:
    """match_id, n_rows, and how often each rule is broken, those about keys and order as well: one reading of ``df``, one
    grouping by frame, from which everything else comes."""
    sums = {"n_rows": F.count("*"), **{k: F.count_if(x) for k, x in _rules().items()}, "duplicates": F.count("*") - F.size(F.collect_set("track_id"))}
    frames = df.groupBy(*FRAME).agg(*(x.alias(k) for k, x in sums.items()), _normalised().alias("normalised"), F.collect_set("timestamp").alias("times"))
    rows = frames.groupBy("match_id").agg(*(F.sum(k).alias(k) for k in sums), F.bool_and("normalised").alias("normalised"))
    order = _falls(frames.select(*FRAME, F.explode("times").alias("timestamp"))).groupBy("match_id").agg(F.sum("violations").alias("monotonic"))
    return rows.join(order.withColumnRenamed("match_id", "_own_"), F.col("match_id").eqNullSafe(F.col("_own_")), "left").drop("_own_").fillna(0, ["monotonic"])


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*FRAME, "track_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def monotonic_violations(df: DataFrame) -> DataFrame:
    """Frame ids that fall while time rises, per half."""
    return _falls(df.select(*FRAME, "timestamp").distinct())


def _falls(frames: DataFrame) -> DataFrame:
    frames = with_previous(frames, HALF, "timestamp", ["timestamp", "frame_id"], {"before": "frame_id"})
    return frames.groupBy(*HALF).agg(F.count_if(F.col("frame_id") < F.col("before")).alias("violations"))


def validate(df: DataFrame, strict_ranges: bool = True) -> DataFrame:
    """``df`` with its columns in order, or a ContractError that names the first rule broken."""
    missing, extra = set(COLUMNS) - set(df.columns), set(df.columns) - set(COLUMNS)
    if missing or extra:
        raise ContractError(f"missing columns {sorted(missing)}" if missing else f"unknown columns {sorted(extra)}")
    kinds = dict(df.dtypes)
    for field in SCHEMA.split(", "):
        name, kind = field.split()
        if kinds[name] != kind:
            raise ContractError(f"{name} is {kinds[name]}, not {kind}")
    for r in validation_counts(df).collect():  # a row for each match
        if broken := broken_rule(r.asDict(), strict_ranges):
            raise ContractError(broken)
    return df.select(*COLUMNS)


def broken_rule(counts: dict, strict_ranges: bool = True) -> str | None:
    """The first rule that ``counts`` (a row of ``validation_counts``) has broken, in words."""
    for rule in ("bad_team", "bad_ball_state", "nulls", "bad_period", *(["off_pitch"] if strict_ranges else [])):
        if counts[rule]:
            return f"{rule}: {counts[rule]} rows"
    if strict_ranges and counts["normalised"]:
        return "normalised: x_pitch lies in 0..1, not in metres"
    for rule, what in (("duplicates", "rows"), ("ball_mismatch", "rows"), ("keeper_ball", "rows"), ("monotonic", "frames")):
        if counts[rule]:
            return f"{rule}: {counts[rule]} {what}"
    return None
