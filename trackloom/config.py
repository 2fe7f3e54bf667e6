"""Settings: every threshold in one nested mapping, from a JSON or YAML file, and what the operators take from it."""

from __future__ import annotations

import copy
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .operators.motion import Motion

#: Sections, keys and defaults of the settings file.
DEFAULTS: dict = {
    "pitch": {"length_m": 105.0, "width_m": 68.0},
    "kinematics": {"savgol_window_frames": 21, "savgol_polyorder": 2, "max_speed_mps": 12.0, "max_gap_s": 1.0, "glitch_speed_mps": 12.0},
    "shape": {"line_height_n_deepest": 4, "min_outfield_players": 8},
    "physical": {
        "hsr_threshold_mps": 5.5, "sprint_threshold_mps": 7.0, "sprint_min_duration_s": 1.0, "sprint_min_recovery_s": 1.0, "min_coverage_pct": 95.0,
        "speed_zones_mps": [[0.0, 2.0], [2.0, 4.0], [4.0, 5.5], [5.5, 7.0], [7.0, 99.0]],
        "sensitivity": {"savgol_window_frames_grid": [11, 15, 21, 25, 31], "sprint_threshold_mps_grid": [6.5, 7.0, 7.5, 8.0]},
    },
    "pressing": {"press_radius_m": 5.0, "carrier_search_radius_m": 3.0},
    "space": {"include_gk": True},
    "physiological_ranges": {"total_distance_km": [9.0, 12.0], "top_speed_mps": [8.0, 11.0], "hsr_share_of_distance_pct": [5.0, 15.0], "sprints_per_match": [2, 25], "team_compactness_m2": [300.0, 1500.0]},
    "cache": {"target_hz": 5.0},
}
#: Sections that a file must have, with all their keys but the nested ones.
REQUIRED = ("pitch", "kinematics", "shape", "physical", "pressing", "space")


def read_settings(spark: SparkSession, path: str) -> dict:
    """The settings of a file that Spark can reach; a missing section or key is a KeyError that names it."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is no JSON, and no YAML reader is installed") from e
        found = yaml.safe_load(text)
    return checked(found, path)


def checked(found: dict, name: str = "settings") -> dict:
    if not isinstance(found, dict):
        raise KeyError(f"{name}: a mapping of sections is needed, not {type(found).__name__}")
    for section in REQUIRED:
        if section not in found:
            raise KeyError(f"{name}: section {section!r} is missing")
        if missing := [k for k, v in DEFAULTS[section].items() if not isinstance(v, dict) and k not in found[section]]:
            raise KeyError(f"{name}: section {section!r} lacks {missing}")
    return found


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Run:
    """What a run over matches needs besides the matches."""

    path: str
    settings: dict = field(default_factory=lambda: copy.deepcopy(DEFAULTS))
    target_hz: float | None = None  # None: as the settings have it
    with_space: bool = True

    def motion(self, rate: float) -> Motion:
        k = self.settings["kinematics"]
        glitch = k["glitch_speed_mps"]
        return Motion(rate, int(k["savgol_window_frames"]), k["max_speed_mps"], k["max_gap_s"], None if glitch is None or glitch == float("inf") else glitch, int(k["savgol_polyorder"]))

    def rate(self, native: float) -> float:
        """The thinned frames' rate: no higher than the native one."""
        if self.target_hz is not None:
            return min(self.target_hz, native)
        if "target_hz" not in self.settings.get("cache", {}):
            raise KeyError("section 'cache' lacks ['target_hz'], and no rate is given")
        return min(float(self.settings["cache"]["target_hz"]), native)

    def bands(self) -> dict[str, tuple[float, float]]:
        r = self.settings["physiological_ranges"]
        names = {"distance_km": "total_distance_km", "top_speed_mps": "top_speed_mps", "hsr_share_pct": "hsr_share_of_distance_pct", "n_sprints": "sprints_per_match", "hull_median_m2": "team_compactness_m2"}
        return {k: tuple(map(float, r[v])) for k, v in names.items()}
