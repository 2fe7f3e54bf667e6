"""Tracking in the EPTS exchange layout: a text file of frames, and an XML file that says how its lines are laid out.

The description has the frame rate and the halves (first and last frame) among its global parameters, field size and sides
of the session, teams, players with shirt number and position, channels (a player's x, a player's y, the ball's x ...), and
one format specification for each block of frames: registers nested to any depth, each split register naming the separator
between its parts, down to strings and references to channels. The registers are walked once, in document order; the walk
gives a line's pattern and the channel of every value. Lines are then taken apart by Spark: separators of all levels
are made one, so a value's place in the line is its turn in the walk.

``normalized`` channels are shares of the pitch from its top left corner, others metres from there; ``NaN`` or nothing is no
place. Keepers are the players whose position says so, or, if none does, inferred. The frame has the home side
attacking +x in both halves.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, PITCH_LENGTH, PITCH_WIDTH
from .frames import ball_state, infer_keepers, static_ends

_NUMBER = r"(?:-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|NaN)?"
#: Names of the layout's elements, attributes and parameters.
HALVES = ("first_half", "second_half", "first_extra_half", "second_extra_half")
BLOCK, SPLIT, FRAME_REGISTER = "DataFormatSpecification", "SplitRegister", "frameCount"
PLAYER_REF, BALL_REF = ("PlayerChannelRef", "playerChannelId"), ("BallChannelRef", "channelId")
KEEPER = "goalkeeper"


@dataclass(frozen=True)
class Player:
    track_id: str
    team: str
    jersey_number: int | None
    is_gk: bool


@dataclass(frozen=True)
class Block:
    """Frames ``first`` to ``last``: what a line looks like, and where its values are."""

    first: int
    last: int
    pattern: str
    separators: str
    #: The frame number's place among the values of a line.
    frame_at: int
    #: (track_id or ball, channel, place): every channel that the lines have, in their order.
    channels: tuple[tuple[str, str, int], ...]

    def tracks(self) -> list[tuple[str, int, int]]:
        """(track_id, place of x, place of y) of what has both."""
        at = {(track, channel): place for track, channel, place in self.channels}
        return [(track, at[track, "x"], at[track, "y"]) for track in dict.fromkeys(t for t, _, _ in self.channels) if {(track, "x"), (track, "y")} <= at.keys()]


@dataclass(frozen=True)
class Description:
    frame_rate: float
    length: float
    width: float
    teams: tuple[str, str]
    #: (period, its first frame, its last frame)
    periods: tuple[tuple[int, int, int], ...]
    players: tuple[Player, ...]
    blocks: tuple[Block, ...]
    normalised: bool = True


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _all(element: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in element.iter() if _name(x) == name)


def _text(element: ET.Element | None, name: str) -> str | None:
    found = next(_all(element, name), None) if element is not None else None
    return found.text.strip() if found is not None and found.text and found.text.strip() else None


def _parameters(element: ET.Element | None) -> dict[str, str]:
    """The provider's own name and value pairs below an element."""
    return {_text(p, "Name") or "": _text(p, "Value") or "" for p in _all(element, "ProviderParameter")} if element is not None else {}


def read_block(specification: ET.Element, owner: dict[str, tuple[str, str]]) -> Block:
    """A format specification; ``owner`` has the player and channel of each player channel's id."""
    separators: list[str] = []
    leaves: list[tuple[str, str] | None] = []
    frame_at: list[int] = []

    def walk(register: ET.Element) -> str:
        if (separator := register.get("separator")) is not None:
            if len(separator) != 1 or re.match(r"[0-9A-Za-z.+-]", separator):
                raise ValueError(f"a separator is one character that no number has, not {separator!r}")
            separators.append(separator)
            return re.escape(separator).join(map(walk, register))
        kind = _name(register)
        if kind == SPLIT:
            raise ValueError(f"a {SPLIT} without separator")
        leaf = None
        if kind == PLAYER_REF[0]:
            leaf = owner.get(register.get(PLAYER_REF[1]))
            if leaf is None:
                raise ValueError(f"no player channel {register.get(PLAYER_REF[1])!r}")
        elif kind == BALL_REF[0]:
            leaf = ("ball", register.get(BALL_REF[1]))
        elif register.get("name") == FRAME_REGISTER:
            frame_at.append(len(leaves))
        leaves.append(leaf)
        return _NUMBER if leaf else "[0-9]+" if frame_at[-1:] == [len(leaves) - 1] else ANY

    pattern = walk(specification)
    every = "".join(dict.fromkeys(separators))
    if len(frame_at) != 1:
        raise ValueError(f"a {BLOCK} has one register {FRAME_REGISTER}, not {len(frame_at)}")
    free = "[^" + "".join(map(re.escape, every)) + "]*"
    channels = tuple((*leaf, place) for place, leaf in enumerate(leaves) if leaf)
    return Block(int(specification.get("startFrame")), int(specification.get("endFrame")), f"^{pattern.replace(ANY, free)}$", every, frame_at[0], channels)


ANY = "\0"  # stands for a value that may be anything, until all separators are known


def describe(spark: SparkSession, xml: str) -> Description:
    """The description file, which Spark reads as text from wherever it is: one small file."""
    root = ET.fromstring("\n".join(r[0] for r in spark.read.text(xml, wholetext=True).collect()).encode())
    config, session = next(_all(root, "GlobalConfig"), None), next(_all(root, "Session"), None)
    rate = _text(config, "FrameRate")
    if rate is None:
        raise ValueError(f"{xml} has no FrameRate")
    score, field = next(_all(root, "Score"), None), next(_all(session, "FieldSize"), None) if session is not None else None
    names = {t.get("id"): _text(t, "Name") for t in _all(root, "Team")}
    sides = (score.get("idLocalTeam"), score.get("idVisitingTeam")) if score is not None else tuple(names)[:2]
    if len(sides) != 2 or not set(sides) <= names.keys():
        raise ValueError(f"{xml} doesn't say which teams play")
    halves, side = _parameters(config), dict(zip(sides, ("home", "away")))
    periods = tuple((k, int(halves[f"{h}_start"]), int(halves[f"{h}_end"])) for k, h in enumerate(HALVES, 1) if halves.get(f"{h}_start") and halves.get(f"{h}_end"))
    if not periods:
        raise ValueError(f"{xml} has no {HALVES[0]}_start and {HALVES[0]}_end")
    players = []
    for p in (p for p in _all(root, "Player") if p.get("teamId") in side):
        number, own = _text(p, "ShirtNumber"), _parameters(p)
        players.append(Player(p.get("id"), side[p.get("teamId")], int(number) if number else None, own.get("position_type", "").lower() == KEEPER))
    owner = {c.get("id"): (c.get("playerId"), c.get("channelId")) for c in _all(root, "PlayerChannel")}
    units = {c.get("id"): (_text(c, "Unit") or "normalized").lower() for c in _all(root, "Channel")}
    blocks = tuple(read_block(s, owner) for s in _all(root, BLOCK))
    length, width = float(_text(field, "Width") or PITCH_LENGTH), float(_text(field, "Height") or PITCH_WIDTH)
    return Description(float(rate), length, width, tuple(names[i] or s for i, s in zip(sides, ("home", "away"))), periods, tuple(players), blocks, units.get("x", "normalized") in ("normalized", "normalised"))


def _values(value: Column, block: Block) -> Column:
    """All values of a line: the separators of every level are made one."""
    return F.split(F.translate(value, block.separators, block.separators[0] * len(block.separators)), re.escape(block.separators[0]))


def clean_lines(lines: DataFrame, blocks: tuple[Block, ...]) -> DataFrame:
    """(frame_id, block, value, kept) of the lines (column value) that aren't blank. A line stays if its number parses and
    it fits the block that covers it, or if none does (block null). The last line of a block must fit: the block ends
    there, and without it nothing says so."""
    value = F.trim("value")
    number = F.lit(None).cast("long")
    for frame_at in dict.fromkeys((b.separators, b.frame_at) for b in blocks):
        own = next(b for b in blocks if (b.separators, b.frame_at) == frame_at)
        found = F.when(value.rlike(f"[{re.escape(own.separators)}]"), F.get(_values(value, own), F.lit(own.frame_at)))
        number = F.coalesce(number, F.when(found.rlike("^[0-9]+$"), found.try_cast("long")))
    rows = lines.select(value.alias("value"), number.alias("frame_id")).filter("value <> ''")
    block, fits, last = F.lit(None).cast("int"), F.lit(True), F.lit(False)
    for k, b in reversed(list(enumerate(blocks))):
        here = F.col("frame_id").between(b.first, b.last)
        block, fits, last = F.when(here, k).otherwise(block), F.when(here, F.col("value").rlike(b.pattern)).otherwise(fits), F.when(here, F.col("frame_id") == b.last).otherwise(last)
    kept = F.col("frame_id").isNotNull() & fits
    broken = F.col("frame_id").isNotNull() & ~fits & last
    error = F.raise_error(F.concat(F.lit("the line of frame "), F.col("frame_id").cast("string"), F.lit(" ends its block and is malformed"))).cast("boolean")
    return rows.select("frame_id", block.alias("block"), "value", F.when(broken, error).otherwise(F.coalesce(kept, F.lit(False))).alias("kept"))


def line_counts(spark: SparkSession, text: str, found: Description) -> DataFrame:
    return clean_lines(spark.read.text(text), found.blocks).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))


def tracking(spark: SparkSession, xml: str, text: str, match_id: str = "match") -> DataFrame:
    about = describe(spark, xml)
    squad = {p.track_id: p for p in (*about.players, Player("ball", "ball", None, False))}
    lines = clean_lines(spark.read.text(text), about.blocks).filter("kept AND block IS NOT NULL")

    def spots_of(b: Block) -> Column:
        spot = lambda own: F.array(*(F.struct(F.lit(t).alias("track_id"), own[x].alias("u"), own[y].alias("v")) for t, x, y in b.tracks() if t in squad))
        return F.transform(F.array(_values(F.col("value"), b)), spot)[0]

    spots = F.lit(None)
    for k, b in enumerate(about.blocks):
        spots = F.when(F.col("block") == k, spots_of(b)).otherwise(spots)
    rows = lines.select("frame_id", F.explode(spots).alias("s")).select("frame_id", "s.track_id", F.col("s.u").try_cast("double").alias("u"), F.col("s.v").try_cast("double").alias("v"))
    rows = rows.filter("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v)")
    # As many entries as there are players.
    facts = F.create_map(*(x for p in squad.values() for x in (F.lit(p.track_id), F.struct(F.lit(p.team).alias("team"), F.lit(p.jersey_number).cast("smallint").alias("jersey_number"), F.lit(p.is_gk).alias("is_gk")))))
    period, start = F.lit(None).cast("tinyint"), F.lit(None).cast("long")
    for k, first, last in about.periods:
        here = F.col("frame_id").between(first, last)
        period, start = F.when(here, k).otherwise(period).cast("tinyint"), F.when(here, first).otherwise(start)
    wide, high = (about.length, about.width) if about.normalised else (1.0, 1.0)
    place = {"x_pitch": F.col("u") * wide - about.length / 2, "y_pitch": about.width / 2 - F.col("v") * high}
    laid = rows.withColumns({"period": period, **place, "timestamp": (F.col("frame_id") - start) / about.frame_rate, "who": facts[F.col("track_id")]}).filter("period IN (1, 2)").select("*", "who.*")
    ball = laid.filter("team = 'ball'").select("period", "frame_id", ball_state(F.col("x_pitch"), F.col("y_pitch"), about.length / 2, about.width / 2).alias("ball_state"))
    laid = laid.join(ball, ["period", "frame_id"], "left").withColumns({"ball_state": F.coalesce("ball_state", F.lit("dead")), "match_id": F.lit(match_id), "is_ball": F.col("team") == "ball"})
    laid = laid if any(p.is_gk for p in about.players) else infer_keepers(laid)
    return static_ends(laid).select(*COLUMNS)
