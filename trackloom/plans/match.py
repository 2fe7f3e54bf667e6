"""Runs over matches: the tables of a frame, all matches of all providers, and what has been written."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..config import Run
from ..operators import motion, physical, pressing, sampling, shape, space
from ..sources import MatchMeta, Provider

TABLES = ("tracking", "shape", "pressing", "space", "space_player", "physical", "coverage", "clip")


def match_tables(df: DataFrame, run: Run, rate: float = 25.0) -> dict[str, DataFrame]:
    """Kinematics at the full rate come first; shape, pressing, space and coverage see the thinned frame. ``df`` may hold
    many matches of one rate."""
    s, cfg, target = run.settings, run.motion(rate), run.rate(rate)
    ph = s["physical"]
    kin = motion.kinematics(df, cfg)
    thin = sampling.downsample(df, rate, target)
    coverage = sampling.coverage_by_match(thin)
    table = physical.physical_table(kin, coverage, rate, ph["hsr_threshold_mps"], ph["sprint_threshold_mps"], ph["sprint_min_duration_s"], ph["sprint_min_recovery_s"], ph["min_coverage_pct"])
    out = {
        "tracking": sampling.downsample(kin, rate, target), "shape": shape.team_shape(thin, deepest=int(s["shape"]["line_height_n_deepest"]), least=int(s["shape"]["min_outfield_players"])),
        "pressing": pressing.pressing(thin, s["pressing"]["carrier_search_radius_m"], s["pressing"]["press_radius_m"]),
        "coverage": coverage, "physical": table, "clip": motion.clip_report(kin, cfg),
    }
    pitch = s.get("pitch", {})
    area = space.player_space(thin, bool(s["space"]["include_gk"]), True, pitch.get("length_m", 105.0), pitch.get("width_m", 68.0))
    area = area if run.with_space else area.limit(0)
    return out | {"space_player": area, "space": space.team_space(area)}


#: Between provider and match in the key of a match among many.
_BETWEEN = "\x1f"
#: Matches that are one job: as many as one plan holds well.
MATCHES_AT_ONCE = 64


def write_tables(tables: dict[str, DataFrame], path: str, provider: str | None = None) -> None:
    """A folder for each table, by provider and match; writing a match again replaces it alone. Without ``provider`` the
    match ids have it in front."""
    parts = F.split("match_id", _BETWEEN)
    own = {"provider": F.lit(provider)} if provider is not None else {"provider": parts[0], "match_id": parts[1]}
    for name, df in tables.items():
        df.withColumns(own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "match_id").parquet(f"{path}/{name}")


def number(x: float | None) -> float | None:
    """For a report: 4 places, and null for what is no number."""
    return None if x is None or not math.isfinite(x) else round(float(x), 4)


def write_json(spark: SparkSession, path: str, found: dict) -> None:
    """One object, on one line, anywhere that Spark writes."""
    spark.createDataFrame([(json.dumps(found, allow_nan=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Artifacts:
    provider: str
    match_id: str
    path: str


def _said(e: Exception) -> str:
    """The kind of an error and what it says first."""
    told = [line.strip() for line in str(e).splitlines() if line.strip() and not line.lstrip().startswith("at ")]
    return f"{type(e).__name__}: {' '.join(told)[:500]}"


@dataclass(frozen=True)
class _Loaded:
    provider: Provider
    meta: MatchMeta
    frames: DataFrame

    @property
    def key(self) -> str:
        return f"{self.provider.name}{_BETWEEN}{self.meta.match_id}"


def _about(m: _Loaded, run: Run, clip: dict, below: tuple[int, int]) -> dict:
    """A written match's object. Its keys."""
    least, rate = run.settings["physical"]["min_coverage_pct"], m.meta.frame_rate
    note = f"tracks with too little coverage (under {least:g}%): {below[0]} of {below[1]}; their physical values are left out" if below[0] else ""
    names = ("n_clipped", "n_total", "clipped_share", "max_raw_speed", "glitch_steps", "glitch_frames")
    return {
        "match_meta": dataclasses.asdict(m.meta) | {"periods": {str(k): list(v) for k, v in m.meta.periods.items()}}, "source_frame_rate_hz": rate, "cached_frame_rate_hz": run.rate(rate),
        "target_hz_requested": run.target_hz, "clip_report": {n: number(clip[n]) for n in names} if clip else {}, "physical_note": note, "physical_min_coverage_pct": least,
        "physical_computed_at_hz": rate, "include_space": run.with_space,
    }


def _run_together(matches: list[_Loaded], run: Run) -> dict[str, str]:
    """The tables of all ``matches``: validated in one job, computed and written in one for each table and frame rate, and
    their objects in one. What is wrong with those that break the contract, by key; nothing of them is written."""
    spark = matches[0].provider.spark
    by_rate: dict[float, list[_Loaded]] = {}
    frames = {m.key: m.frames.withColumn("match_id", F.lit(m.key)) for m in matches}
    counts = {r["match_id"]: r.asDict() for r in model.validation_counts(reduce(DataFrame.unionByName, frames.values())).collect()}  # a row for each match
    wrong = {k: broken for k in frames if (broken := model.broken_rule(counts[k]) if k in counts else "no rows")}
    for m in matches:
        if m.key not in wrong:
            by_rate.setdefault(m.meta.frame_rate, []).append(m)
    for rate, own in by_rate.items():
        write_tables(match_tables(reduce(DataFrame.unionByName, (frames[m.key] for m in own)), run, rate), run.path)
    good = [m for own in by_rate.values() for m in own]
    if good:
        ids = spark.createDataFrame([(m.provider.name, m.meta.match_id) for m in good], "provider string, match_id string")
        mine = lambda name: read_table(spark, run.path, name).withColumn("match_id", F.col("match_id").cast("string")).join(F.broadcast(ids), ["provider", "match_id"])
        clips = {(r["provider"], r["match_id"]): r.asDict() for r in mine("clip").collect()}  # a row for each match
        below = {(r["provider"], r["match_id"]): (r["n"], r["of"]) for r in mine("physical").groupBy("provider", "match_id").agg(F.count_if("below_coverage").alias("n"), F.count("*").alias("of")).collect()}
        found = [(m.provider.name, m.meta.match_id, json.dumps(_about(m, run, clips.get(k, {}), below.get(k, (0, 0))), allow_nan=False, sort_keys=True)) for m in good for k in [(m.provider.name, m.meta.match_id)]]
        objects = spark.createDataFrame(found, "provider string, match_id string, value string").repartition(1)
        objects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "match_id").text(f"{run.path}/meta")
    return wrong


def _run_or_split(matches: list[_Loaded], run: Run) -> dict[str, str]:
    """As ``_run_together``; where a match stops the job, halves of the matches are tried until it stands alone."""
    try:
        return _run_together(matches, run)
    except Exception as e:  # noqa: BLE001 - raised by the caller, with its match
        if len(matches) == 1:
            return {matches[0].key: _said(e)}
        middle = len(matches) // 2
        return _run_or_split(matches[:middle], run) | _run_or_split(matches[middle:], run)


def _loaded(provider: Provider, ids: list[str]) -> tuple[list[_Loaded], dict[str, str]]:
    """The matches that can be read, and what is wrong with the others."""
    try:
        metas = provider.load_metas(ids)
        return [_Loaded(provider, metas[i], provider.frames(i)) for i in ids], {}
    except Exception as e:  # noqa: BLE001 - raised by the caller, with its match
        if len(ids) == 1:
            return [], {f"{provider.name}{_BETWEEN}{ids[0]}": _said(e)}
        middle = len(ids) // 2
        (a, x), (b, y) = _loaded(provider, ids[:middle]), _loaded(provider, ids[middle:])
        return a + b, x | y


def run_match(provider: Provider, match_id: str, run: Run) -> Artifacts:
    """All tables of one match, and a JSON object about it."""
    provider = dataclasses.replace(provider, matches={match_id: provider._arguments(match_id)})
    return run_all([provider], run)[0]


def run_all(providers: list[Provider], run: Run) -> list[Artifacts]:
    """Every match of every provider, ``MATCHES_AT_ONCE`` in a job. Those that fail are named together at the end; the
    others have been written."""
    ready, failed = [], {}
    for provider in providers:
        if ids := provider.list_matches():
            loaded, wrong = _loaded(provider, ids)
            ready += loaded
            failed |= wrong
    for start in range(0, len(ready), MATCHES_AT_ONCE):
        failed |= _run_or_split(ready[start : start + MATCHES_AT_ONCE], run)
    if failed:
        raise RuntimeError("matches that failed:\n" + "\n".join(f"{k.replace(_BETWEEN, '/')}: {v}" for k, v in sorted(failed.items())))
    return [Artifacts(m.provider.name, m.meta.match_id, run.path) for m in ready]


def read_table(spark: SparkSession, path: str, name: str, provider: str | None = None, match_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    df = df if provider is None else df.filter(F.col("provider") == provider)
    return df if match_id is None else df.filter(F.col("match_id") == match_id)


#: A match's object, as far as the index needs it.
_META = "match_meta struct<home_team: string, away_team: string, periods: map<string, array<double>>>, cached_frame_rate_hz double, physical_note string, physical_min_coverage_pct double"


def match_index(spark: SparkSession, path: str) -> DataFrame:
    """provider, match_id, teams, periods, rate, note and label of every written match; damaged objects are passed over."""
    rows = spark.read.text(f"{path}/meta").withColumn("m", F.from_json("value", _META, {"mode": "PERMISSIVE"}))
    team = lambda side: F.coalesce(F.when(F.col(f"m.match_meta.{side}_team") != "", F.col(f"m.match_meta.{side}_team")), F.lit(side))
    whole = F.map_filter("m.match_meta.periods", lambda k, v: k.try_cast("int").isNotNull() & (F.size(v) >= 2))
    label = F.concat_ws(" · ", "provider", F.col("match_id").cast("string"), F.concat(team("home"), F.lit(" vs "), team("away")))
    found = rows.filter("m.match_meta IS NOT NULL")
    return found.select("provider", F.col("match_id").cast("string").alias("match_id"), team("home").alias("home_team"), team("away").alias("away_team"), whole.alias("periods"), F.col("m.cached_frame_rate_hz").alias("target_hz"), F.col("m.physical_note").alias("physical_note"), F.col("m.physical_min_coverage_pct").alias("min_coverage_pct"), label.alias("label")).orderBy("provider", "match_id")


def run_summary(spark: SparkSession, path: str) -> DataFrame:
    """provider, match_id, rows and tracks, and the share of clipped speeds."""
    tracking = spark.read.parquet(f"{path}/tracking").groupBy("provider", "match_id").agg(F.count("*").alias("n_rows"), F.count_distinct(F.when(~F.col("is_ball"), F.col("track_id"))).alias("n_tracks"))
    return tracking.join(spark.read.parquet(f"{path}/clip").select("provider", "match_id", "clipped_share"), ["provider", "match_id"], "left")


def written_bytes(spark: SparkSession, path: str) -> int:
    """How many bytes the tables take."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(folder).getLength()


__all__ = ["Artifacts", "MatchMeta", "match_index", "match_tables", "read_table", "run_all", "run_match", "run_summary", "write_json", "write_tables", "written_bytes"]
