"""Where tracking frames come from. ``source(name)`` gives a reader by its name, ``provider`` a set of matches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PITCH_LENGTH, PITCH_WIDTH, coerce, drop_off_pitch, validate
from ..operators.sampling import match_meta, period_ranges
from . import csv_pair, epts, events, jsonl
from .memo import Memo

_SOURCES: dict[str, Callable] = {"events": events.tracking, "csv_pair": csv_pair.tracking, "epts": epts.tracking, "jsonl": jsonl.tracking}


def source(name: str) -> Callable:
    key = name.strip().lower()
    if key not in _SOURCES:
        raise KeyError(f"no source {name!r}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[key]


@dataclass(frozen=True)
class MatchMeta:
    """Facts about one match. The fields' names, which written match objects have."""

    match_id: str
    provider: str
    frame_rate: float
    pitch_length_m: float
    pitch_width_m: float
    home_team: str
    away_team: str
    #: period: (first second, last second)
    periods: dict[int, tuple[float, float]]
    notes: str = ""


#: Arguments that are about a match and not for its reader.
_ABOUT = ("home_team", "away_team", "notes")


@dataclass(frozen=True)
class Provider:
    """Matches of one kind of source: ``matches`` has the source's own arguments by match id. With a ``memo`` what has been
    read is kept as long as the memo holds it."""

    spark: SparkSession
    name: str
    matches: dict[str, dict] = field(default_factory=dict)
    memo: Memo | None = None

    @classmethod
    def of_catalogue(cls, spark: SparkSession, name: str, found: dict, memo: Memo | None = None) -> Provider:
        """From a catalogue's entry: arguments by match id, or ``index``, a file that lists the ids, beside arguments in
        which ``{id}`` stands for the id."""
        if not isinstance(found.get("index"), str):
            return cls(spark, name, found, memo)
        pattern = {k: v for k, v in found.items() if k != "index"}
        own = lambda i: {k: v.replace("{id}", i) if isinstance(v, str) else v for k, v in pattern.items()}
        return cls(spark, name, {i: own(i) for i in jsonl.match_ids(spark, found["index"])}, memo)

    def list_matches(self) -> list[str]:
        return list(self.matches)

    def _arguments(self, match_id: str) -> dict:
        if match_id not in self.matches:
            raise KeyError(f"no match {match_id!r} of {self.name}; there are {', '.join(self.matches)}")
        return self.matches[match_id]

    def _read(self, match_id: str) -> DataFrame:
        own = {k: v for k, v in self._arguments(match_id).items() if k not in _ABOUT}
        if self.name == "events":
            return drop_off_pitch(coerce(events.tracking(self.spark, **own).withColumn("match_id", F.lit(match_id))))
        return drop_off_pitch(coerce(source(self.name)(self.spark, **own, match_id=match_id)))

    def frames(self, match_id: str) -> DataFrame:
        """The match's frame as it is read, in the frame's types and on the pitch."""
        if self.memo is None:
            return self._read(match_id)
        return self.memo.get(self.spark, self.name, {"match_id": match_id, **self._arguments(match_id)}, lambda: self._read(match_id))

    def load(self, match_id: str) -> DataFrame:
        return validate(self.frames(match_id))

    def load_meta(self, match_id: str) -> MatchMeta:
        """Without the players' columns: from the description, or from frame numbers and times alone."""
        return self.load_metas([match_id])[match_id]

    def load_metas(self, match_ids: list[str]) -> dict[str, MatchMeta]:
        """Of many matches: what no description says comes from all their files in one job."""
        found, counted = {}, []
        for i in match_ids:
            own = self._arguments(i)
            about = {"teams": (own.get("home_team", "home"), own.get("away_team", "away")), "length": own.get("length", PITCH_LENGTH), "width": own.get("width", PITCH_WIDTH), "rate": None, "periods": {}}
            if self.name == "epts":
                d = epts.describe(self.spark, own["xml"])
                about = {"teams": d.teams, "length": d.length, "width": d.width, "rate": d.frame_rate, "periods": {k: ((a - d.periods[0][1]) / d.frame_rate, (b - d.periods[0][1]) / d.frame_rate) for k, a, b in d.periods}}
            elif self.name == "jsonl" and own.get("match"):
                j = jsonl.read_document(self.spark, own["match"])
                about = {"teams": j.teams, "length": j.length, "width": j.width, "rate": j.frame_rate, "periods": {k: (0.0, (b - a) / (j.frame_rate or jsonl.RATE)) for k, a, b in j.periods if k in (1, 2)}}
            if about["rate"] is None or not about["periods"]:
                if self.name == "csv_pair":
                    facts = csv_pair.frame_meta(self.spark, own["home"]).select(F.lit(i).alias("match_id"), "period", "frame_rate", "start_s", "end_s")
                else:
                    frames = self.frames(i).select("match_id", "period", "frame_id", "timestamp")
                    facts = period_ranges(frames).join(match_meta(frames), "match_id").select("match_id", F.col("period").cast("int").alias("period"), "frame_rate", "start_s", "end_s")
                counted.append(facts)
            found[i] = about
        rows = reduce(DataFrame.unionByName, counted).collect() if counted else []  # two halves of each match
        for r in sorted(rows, key=lambda r: (r["match_id"], r["period"])):
            about = found[r["match_id"]]
            about["rate"] = about["rate"] or r["frame_rate"]
            about.setdefault("counted", {})[r["period"]] = (r["start_s"], r["end_s"])
        return {i: MatchMeta(i, self.name, a["rate"], a["length"], a["width"], *a["teams"], a["periods"] or a.get("counted", {}), self._arguments(i).get("notes", "")) for i, a in found.items()}
