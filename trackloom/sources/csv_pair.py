"""Two delimited files of one match, a team each: three heading lines, then period, frame, time, x and y of every
player, and the ball last. Coordinates are shares of the pitch from its top left corner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, PITCH_LENGTH, PITCH_WIDTH
from ..operators.ranges import FRAMES, with_previous
from .frames import ball_state, infer_keepers


def _heading(spark: SparkSession, path: str) -> list[str]:
    return next(line[0] for line in spark.read.text(path).limit(3).collect()[2:3]).split(",")


def _rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Lines that have every field, all numbers or NaN; others are left out."""
    fields = F.split("value", ",")
    numbers = F.transform(fields, lambda x: x.try_cast("double"))
    lines = spark.read.text(path).select(numbers.alias("f"))
    whole = (F.size("f") == width) & F.forall("f", lambda x: x.isNotNull())
    clean = F.transform("f", lambda x: F.when(~F.isnan(x), x))
    return lines.filter(whole).select(F.col("f")[1].cast("long").alias("frame_id"), F.col("f")[0].cast("tinyint").alias("period"), F.col("f")[2].alias("time"), clean.alias("f"))


def _team(rows: DataFrame, heading: list[str], team: str) -> DataFrame:
    players = [(name, i) for i, name in enumerate(heading) if i >= 3 and name.strip() and name != "Ball"]
    cells = F.array(*(F.struct(F.lit(f"{team}_{n}").alias("track_id"), F.col("f")[i].alias("u"), F.col("f")[i + 1].alias("v")) for n, i in players))
    return rows.select("frame_id", "period", "time", F.explode(cells).alias("c")).select("frame_id", "period", "time", "c.*", F.lit(team).alias("team"))


def dropped_frames(spark: SparkSession, home: str, away: str) -> DataFrame:
    """n_lines, n_kept and n_dropped of the numbered frames that either file has."""
    heads = _heading(spark, home), _heading(spark, away)
    sides = [_rows(spark, path, len(head) + (head[-1] != "")) for path, head in zip((home, away), heads)]
    key = ["period", "frame_id"]
    ball = [s.select(*key, F.col("f")[F.size("f") - 2].alias(f"u{k}"), F.col("f")[F.size("f") - 1].alias(f"v{k}")) for k, s in enumerate(sides)]
    kept = ball[0].join(ball[1], key).filter("u0 <=> u1 AND v0 <=> v1").select(F.lit(True).alias("kept"))
    numbered = F.split("value", ",")[1].try_cast("long").isNotNull()
    lines = spark.read.text(home).unionByName(spark.read.text(away)).filter(numbered).select(F.split("value", ",")[1]).distinct().select(F.lit(False).alias("kept"))
    n_lines, n_kept = F.count_if(~F.col("kept")), F.count_if("kept")
    return lines.unionByName(kept).agg(n_lines.alias("n_lines"), n_kept.alias("n_kept"), (n_lines - n_kept).alias("n_dropped"))


def frame_meta(spark: SparkSession, path: str) -> DataFrame:
    """period, frame_rate (one over the median step, 6 places), start_s and end_s, from three columns of one file."""
    fields = F.split("value", ",", 4)
    rows = spark.read.text(path).select(*(fields[i].try_cast(k).alias(n) for i, (n, k) in enumerate((("period", "int"), ("frame", "long"), ("time", "double"))))).dropna()
    rate = F.round(1.0 / F.median("step"), 6)
    steps = with_previous(rows, ["period"], "frame", ["frame"], {"before": "time"}, FRAMES)
    found = steps.withColumn("step", F.col("time") - F.col("before")).groupBy("period").agg(rate.alias("frame_rate"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    return found.select("period", "frame_rate", ((F.col("a") - 1) / F.col("frame_rate")).alias("start_s"), (F.col("b") / F.col("frame_rate")).alias("end_s"))


def tracking(spark: SparkSession, home: str, away: str, match_id: str = "match", length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """A frame counts only if it is whole in both files and they agree on the ball. Frames go by period and number."""
    heads = _heading(spark, home), _heading(spark, away)
    key = ["period", "frame_id"]
    sides = [_rows(spark, path, len(head) + (head[-1] != "")) for path, head in zip((home, away), heads)]
    ball = [s.select(*key, F.col("f")[F.size("f") - 2].alias(f"u{k}"), F.col("f")[F.size("f") - 1].alias(f"v{k}")) for k, s in enumerate(sides)]
    agreed = ball[0].join(ball[1], key).filter("u0 <=> u1 AND v0 <=> v1").select(*key, F.col("u0").alias("bu"), F.col("v0").alias("bv"))
    shared = sides[0].join(agreed, key).select("frame_id", "period", "time", F.lit("ball").alias("track_id"), F.col("bu").alias("u"), F.col("bv").alias("v"), F.lit("ball").alias("team"))
    teams = [_team(s.join(agreed, key, "left_semi"), h, t) for s, h, t in zip(sides, heads, ("home", "away"))]
    long_ = shared.unionByName(teams[0]).unionByName(teams[1])
    place = {"x_pitch": (F.col("u") - 0.5) * length, "y_pitch": (0.5 - F.col("v")) * width}
    start = long_.groupBy("period").agg(F.min("time").alias("t0"))
    state = agreed.select(*key, ball_state((F.col("bu") - 0.5) * length, (0.5 - F.col("bv")) * width, length / 2, width / 2).alias("ball_state"))
    laid = long_.filter("u IS NOT NULL AND v IS NOT NULL AND period IN (1, 2)").withColumns(place).join(start, "period").join(state, key)
    laid = laid.withColumns({"match_id": F.lit(match_id), "timestamp": F.col("time") - F.col("t0"), "is_ball": F.col("team") == "ball", "jersey_number": F.lit(None).cast("smallint"), "is_gk": F.lit(False)})
    return infer_keepers(laid).select(*COLUMNS)
