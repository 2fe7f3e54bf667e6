"""Frames as JSON lines with a nested array of players, in metres from the centre spot, and one JSON document about the match.

The document is read by a schema that names what is used of it, everything else and every missing part being allowed: pitch,
rate, both teams with their ends by half, halves, and the squad with shirt numbers and roles. Without a document a roster
can be given. Keepers are the players whose role says so, or, where no role is known, inferred; the ball is alive while
someone has possession (where the records say nothing of it: while it is tracked on the pitch); only what the tracker
really saw stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, PITCH_LENGTH, PITCH_WIDTH
from .frames import ball_state, detected_pairs, infer_keepers, keep_detected, static_ends

#: The fields of a record and of a match document.
RAW = (
    "frame long, period int, timestamp string, ball_data struct<x: double, y: double, is_detected: boolean>, possession struct<player_id: long, group: string>, "
    "player_data array<struct<player_id: long, x: double, y: double, is_detected: boolean>>"
)
_TEAM = "struct<id: long, name: string, short_name: string>"
DOCUMENT = (
    f"id string, frame_rate double, pitch_length double, pitch_width double, home_team {_TEAM}, away_team {_TEAM}, home_team_side array<string>, "
    "match_periods array<struct<period: int, start_frame: long, end_frame: long>>, players array<struct<id: long, team_id: long, number: int, player_role: struct<name: string, acronym: string>>>"
)
KEEPER_ROLES, RIGHT_TO_LEFT = ("goalkeeper", "gk"), "right_to_left"
RATE, HALF_SECONDS = 10.0, 45 * 60


@dataclass(frozen=True)
class Player:
    track_id: str
    team: str
    jersey_number: int | None
    is_gk: bool | None


@dataclass(frozen=True)
class Document:
    match_id: str | None
    frame_rate: float | None
    length: float
    width: float
    teams: tuple[str, str]
    #: The halves in which the home side attacks -x; None: nothing is said about ends.
    turned: tuple[int, ...] | None
    #: (period, its first frame, its last frame)
    periods: tuple[tuple[int, int, int], ...]
    players: tuple[Player, ...]


def match_ids(spark: SparkSession, index: str) -> list[str]:
    """The ids of an index file: a JSON array of objects with an ``id``, a row for each match on offer."""
    return [r[0] for r in spark.read.schema("id string").json(index, multiLine=True).filter("id IS NOT NULL").collect()]


def read_document(spark: SparkSession, path: str) -> Document:
    """One match's document: one small file."""
    d = spark.read.schema(DOCUMENT).json(path, multiLine=True).first()
    if d is None or d["home_team"] is None or d["away_team"] is None:
        raise ValueError(f"{path} doesn't say which teams play")
    side = {d["home_team"]["id"]: "home", d["away_team"]["id"]: "away"}
    players = []
    for p in d["players"] or []:
        role = p["player_role"]
        names = [x.lower() for x in (role["name"], role["acronym"]) if x] if role else []
        if p["team_id"] in side and p["id"] is not None:
            players.append(Player(str(p["id"]), side[p["team_id"]], p["number"], any(x in KEEPER_ROLES for x in names) if names else None))
    ends = d["home_team_side"]
    turned = tuple(k for k, end in enumerate(ends, 1) if end == RIGHT_TO_LEFT) if ends else None
    periods = tuple((p["period"], p["start_frame"], p["end_frame"]) for p in d["match_periods"] or [] if None not in (p["period"], p["start_frame"], p["end_frame"]))
    teams = tuple(t["name"] or t["short_name"] or side for t, side in ((d["home_team"], "home"), (d["away_team"], "away")))
    return Document(d["id"], d["frame_rate"], d["pitch_length"] or PITCH_LENGTH, d["pitch_width"] or PITCH_WIDTH, teams, turned, periods, tuple(players))


def clock_seconds(clock: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or ``s``, with or without a fraction; null where it is none of these."""
    parts = F.transform(F.reverse(F.split(clock, ":")), lambda x, i: x.try_cast("double") * F.pow(F.lit(60.0), i))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def detected(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, period, track_id) that the tracker really saw."""
    players = F.transform("player_data", lambda p: F.struct(p["player_id"].alias("track_id"), p["is_detected"].alias("is_detected")))
    return detected_pairs(spark.read.schema(RAW).json(path).select(F.col("frame").alias("frame_id"), "period", F.col("ball_data").alias("ball"), players.alias("players")))


def _squad(spark: SparkSession, about: Document | None, roster: DataFrame | None) -> DataFrame:
    """track_id, team, jersey_number, is_gk (null: not known): as small as two squads."""
    if roster is None:
        if about is None:
            raise ValueError("a match document or a roster is needed")
        roster = spark.createDataFrame([(p.track_id, p.team, p.jersey_number, p.is_gk) for p in about.players], "track_id string, team string, jersey_number int, is_gk boolean")
    keeper = F.lower("position").isin(*KEEPER_ROLES) if "position" in roster.columns else F.col("is_gk") if "is_gk" in roster.columns else F.lit(None)
    return roster.select(F.col("track_id").cast("string").alias("track_id"), "team", F.col("jersey_number").cast("smallint").alias("jersey_number"), keeper.cast("boolean").alias("is_gk"))


def tracking(spark: SparkSession, path: str, roster: DataFrame | str | None = None, match: str | None = None, match_id: str = "match", rate: float | None = None) -> DataFrame:
    """``match`` is the path of the document; ``roster`` has track_id, team and jersey_number, and may have position (or
    is_gk), as a frame or as a JSON file of rows. ``rate`` counts only where records have no time."""
    about = read_document(spark, match) if match else None
    squad = _squad(spark, about, spark.read.json(roster, multiLine=True) if isinstance(roster, str) else roster)
    rate = rate or (about and about.frame_rate) or RATE
    length, width = (about.length, about.width) if about else (PITCH_LENGTH, PITCH_WIDTH)
    raw = spark.read.schema(RAW).json(path).filter("period IN (1, 2)")
    ball = F.struct(F.lit("ball").alias("track_id"), F.col("ball_data.x").alias("x"), F.col("ball_data.y").alias("y"))
    players = F.transform("player_data", lambda p: F.struct(p["player_id"].cast("string").alias("track_id"), p["x"].alias("x"), p["y"].alias("y")))
    held = F.col("possession.group").isNotNull() | F.col("possession.player_id").isNotNull()
    by_place = ball_state(F.col("ball_data.x"), F.col("ball_data.y"), length / 2, width / 2)
    state = F.when(F.col("possession").isNull(), by_place).when(held, "alive").otherwise("dead").alias("ball_state")
    time = (clock_seconds(F.col("timestamp")) - HALF_SECONDS * (F.col("period") - 1)).alias("time")
    long_ = raw.select("frame", "period", time, state, F.explode(F.concat(F.array(ball), F.coalesce(players, F.array().cast("array<struct<track_id: string, x: double, y: double>>")))).alias("p"))
    long_ = long_.select("frame", "period", "time", "ball_state", "p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    start = raw.groupBy("period").agg(F.min("frame").alias("f0"))
    laid = long_.join(start, "period").join(squad, "track_id", "left").withColumn("team", F.when(F.col("track_id") == "ball", "ball").otherwise(F.col("team"))).filter("team IS NOT NULL")
    turned = F.lit(1.0) if not (about and about.turned) else F.when(F.col("period").isin(*about.turned), -1.0).otherwise(1.0)
    place = {f"{c}_pitch": F.col(c) * turned + F.lit(0.0) for c in "xy"}
    seconds = F.coalesce("time", (F.col("frame") - F.col("f0")) / rate)
    laid = laid.withColumns({"match_id": F.lit(match_id), "frame_id": F.col("frame"), "period": F.col("period").cast("tinyint"), "timestamp": seconds, **place, "is_ball": F.col("team") == "ball", "is_gk": F.coalesce("is_gk", F.lit(False))})
    laid = keep_detected(laid, detected(spark, path))
    roles = any(p.is_gk for p in about.players) if roster is None else squad.filter("is_gk").limit(1).count() > 0
    laid = laid if roles else infer_keepers(laid)
    # With a document that says nothing of ends they are found from the places; a bare roster leaves the places as they are.
    return (static_ends(laid) if about and about.turned is None else laid).select(*COLUMNS)
