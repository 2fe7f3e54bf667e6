"""Space control: the area of the pitch nearest each player, by half-plane clipping of all cells of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FRAME, PITCH_LENGTH, PITCH_WIDTH
from .shape import alive

#: Players are moved at least so far inside the lines, in metres, and places have so many digits.
INSIDE = 1e-3
PLACES = 6
#: Frames whose cells are cut together.
FRAMES_AT_ONCE = 256


def _clip(polygon: np.ndarray, size: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons (m, v, 2) of ``size`` vertices each, without what lies where ``side`` (m, v) is over 0."""
    m, v = side.shape
    index = np.arange(v)
    there = index < size[:, None]
    after = np.where(index + 1 < size[:, None], index + 1, 0)
    ahead = np.take_along_axis(side, after, 1)
    crosses = there & ((side > 0) != (ahead > 0))
    part = np.where(crosses, side / np.where(crosses, side - ahead, 1.0), 0.0)
    following = np.take_along_axis(polygon, after[:, :, None], 1)
    points = np.stack([polygon, polygon + (following - polygon) * part[:, :, None]], axis=2).reshape(m, 2 * v, 2)
    stays = np.stack([there & (side <= 0), crosses], axis=2).reshape(m, 2 * v)
    place = np.cumsum(stays, axis=1) - 1
    row, column = np.nonzero(stays)
    out = np.zeros_like(polygon)
    out[row, place[row, column]] = points[row, column]
    return out, stays.sum(axis=1)


def batch_cells(xy: np.ndarray, there: np.ndarray, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(area, polygons, their sizes) of points ``xy`` (frames, sites, 2), those that are ``there``: the part of the pitch
    nearest to each. Points in one place share its area. Every step clips all cells of all frames by one site's side."""
    half = np.array([length / 2, width / 2])
    sites = np.round(np.clip(np.where(there[:, :, None], xy, 0.0), -half + INSIDE, half - INSIDE), PLACES)
    f, n = there.shape
    polygon = np.zeros((f * n, n + 4, 2))
    polygon[:, :4] = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * half
    size, times = np.full(f * n, 4), np.zeros((f, n))
    own, squares = sites.reshape(-1, 2), (sites * sites).sum(axis=2)
    for k in range(n):
        same = (sites == sites[:, k : k + 1]).all(axis=2) & there[:, k : k + 1]
        times += same
        rows = np.flatnonzero((there & there[:, k : k + 1] & ~same).reshape(-1))
        if not len(rows):
            continue
        other = sites[rows // n, k]
        apart = other - own[rows]
        beyond = (squares[rows // n, k] - squares.reshape(-1)[rows]) / 2
        side = (polygon[rows] * apart[:, None, :]).sum(axis=2) - beyond[:, None]  # over 0: nearer to the other
        polygon[rows], size[rows] = _clip(polygon[rows], size[rows], side)
    index = np.arange(n + 4)
    after = np.where(index + 1 < size[:, None], index + 1, 0)
    x, y = polygon[:, :, 0], polygon[:, :, 1]
    cross = x * np.take_along_axis(y, after, 1) - y * np.take_along_axis(x, after, 1)
    area = np.abs(np.where(index < size[:, None], cross, 0.0).sum(axis=1)) / 2
    return area.reshape(f, n) / np.maximum(times, 1), polygon.reshape(f, n, n + 4, 2), size.reshape(f, n)


def cells(xy: np.ndarray, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """(area, polygon) of each point of one frame."""
    area, polygons, sizes = batch_cells(xy[None], np.ones((1, len(xy)), bool), length, width)
    return area[0], [p[:k] for p, k in zip(polygons[0], sizes[0])]


def wkt(polygon: np.ndarray) -> str:
    ring = ", ".join(f"{x:.3f} {y:.3f}" for x, y in [*polygon, polygon[0]])
    return f"POLYGON (({ring}))"


def player_space(df: DataFrame, include_keepers: bool = True, with_cells: bool = True, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Live frames' players with their area. A group is a frame: two teams."""
    return frame_space(alive(df), include_keepers, with_cells, length, width)


def frame_space(df: DataFrame, include_keepers: bool = True, with_cells: bool = True, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """As ``player_space``, of all frames of ``df``, dead ones as well: of one frame, if it has one."""
    rows = df.filter("NOT is_ball" if include_keepers else "NOT is_ball AND NOT is_gk").select(*FRAME, "timestamp", "track_id", "team", "x_pitch", "y_pitch")
    # Cutting takes far longer than reading, so frames are dealt to all tasks whatever their size.
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frames = rows.repartition(parts, *FRAME).groupBy(*FRAME, "timestamp").agg(*(F.collect_list(c).alias(c) for c in ("track_id", "team", "x_pitch", "y_pitch")))

    def areas(batches):
        for batch in batches:
            for k in range(0, len(batch), FRAMES_AT_ONCE):
                part = batch.iloc[k : k + FRAMES_AT_ONCE]
                counts = part["x_pitch"].map(len).to_numpy()
                there = np.arange(counts.max()) < counts[:, None]
                xy = np.zeros((*there.shape, 2))
                xy[there] = np.stack([np.concatenate(part["x_pitch"].tolist()), np.concatenate(part["y_pitch"].tolist())], axis=1)
                area, polygons, sizes = batch_cells(xy, there, length, width)
                out = {c: np.repeat(part[c].to_numpy(), counts) for c in (*FRAME, "timestamp")}
                out |= {c: np.concatenate(part[c].tolist()) for c in ("track_id", "team")} | {"area_m2": area[there]}
                out["cell_wkt"] = [wkt(p[:n]) for p, n in zip(polygons[there], sizes[there])] if with_cells else None
                yield pd.DataFrame(out)

    return frames.mapInPandas(areas, "match_id string, period tinyint, frame_id long, timestamp double, track_id string, team string, area_m2 double, cell_wkt string")


def team_space(space: DataFrame) -> DataFrame:
    """Both teams of each frame, 0 for one without players."""
    sums = [F.sum(F.when(F.col("team") == t, F.col("area_m2")).otherwise(0.0)).alias(t) for t in ("home", "away")]
    wide = space.groupBy(*FRAME, "timestamp").agg(*sums)
    rows = F.array(*(F.struct(F.lit(t).alias("team"), F.col(t).alias("area_m2"), F.try_divide(F.col(t), F.col("home") + F.col("away")).alias("area_share")) for t in ("home", "away")))
    return wide.select(*FRAME, "timestamp", F.inline(rows))
