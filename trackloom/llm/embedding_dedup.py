"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one class. The classes are rotated to their principal axes (of the unit vectors, about the origin),
dealt in the order of the first axis into strips and these into runs, and runs whose ranges on that axis come near
enough are compared. In a run, vectors are cut by the widest of the leading axes into tiles; tiles whose boxes are too
far apart are passed over. In the others products of the leading dimensions are accumulated, what the rest can add is
bounded by the product of the suffix norms, and rows and columns of a tile that can't reach the threshold any more are
left out. What remains is decided by the cosine of the original vectors in double precision. A pair of runs returns each
class's number of links and its component among the two, never the links themselves.

The answer is exact, so where no axis tells vectors apart (as with random ones of many dimensions) the work is that of
all pairs of tiles, cut short by the bounds, and a run is sent once for each other run: shuffle and work grow with the
square of the number of distinct vectors, divided by ``RUN_COMPONENTS`` for the shuffle.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of different lengths don't link; rows that repeat a ``vec_id`` with another vector are one vertex of the components;
a null ``vec_id`` is its own component, named null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import components

THRESHOLD = 0.9
#: Vectors in a strip and in a tile, at most, and components of the vectors of a run, about: what a task holds of a side.
STRIP = 4_096
TILE = 512
RUN_COMPONENTS = 1 << 21
#: Leading axes by which tiles are cut and told apart.
BOX_AXES = 16
#: Leading dimensions after which a tile is looked at again.
STEPS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: For rounding in the bounds, which are of single precision.
SLACK = 1e-4
#: The PCA's tables are of so many dimensions squared at most; longer vectors are ordered by their leading ones.
PCA_DIMENSIONS = 512


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, data, size): key is null for vectors that link with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data, sizes = [], [], []
            for vector in batch.column(1).to_pylist():
                x = None if not vector or any(v is None for v in vector) else np.array(vector, np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    keys.append(None)
                    data.append(None)
                    sizes.append(None)
                    continue
                raw = (x + 0.0).tobytes()  # one zero
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                data.append((x + 0.0).astype("<f4").tobytes() if (x.astype("<f4") == x).all() else raw)
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary()), pa.array(sizes, pa.int32())], ["vec_id", "key", "data", "size"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(read, "vec_id long, key binary, data binary, size int")


def _matrix(data: list[bytes], sizes: list[int], width: int) -> np.ndarray:
    out = np.zeros((len(data), width))
    for row, raw, n in zip(out, data, sizes):
        row[:n] = np.frombuffer(raw, "<f4" if len(raw) == 4 * n else "<f8")
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Columns: the axes, longest first, of the first ``PCA_DIMENSIONS`` dimensions. Tasks add up second moments."""
    d = min(width, PCA_DIMENSIONS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((d, d))
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x = _unit(_matrix(part.column(0).to_pylist(), part.column(1).to_pylist(), width))[:, :d]
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"data": [sum(np.frombuffer(x).reshape(d, d) for x in rows["data"]).tobytes()]})

    parts = classes.select("data", "size").mapInArrow(moments, "part int, data binary").groupBy("part").applyInPandas(added, "data binary").collect()  # 8 at most
    values, axes = np.linalg.eigh(sum((np.frombuffer(r[0]).reshape(d, d) for r in parts), np.zeros((d, d))))
    return axes[:, np.argsort(-values)]


def _turned(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Dimensions beyond those of the axes stay as they are."""
    d = len(axes)
    return np.concatenate([unit[:, :d] @ axes, unit[:, d:]], axis=1)


def _strips(classes: DataFrame, axes: np.ndarray, width: int) -> DataFrame:
    """(run, low, high, data): classes in the order of the first axis; data holds id, members, size and vector."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.empty(0)]
            for k in range(0, batch.num_rows, STRIP):
                part = batch.slice(k, STRIP)
                first.append(_unit(_matrix(part.column(2).to_pylist(), part.column(3).to_pylist(), width))[:, : len(axes)] @ axes[:, 0])
            first = np.concatenate(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.float64())], [*batch.schema.names, "first"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, STRIP):
                part = pa.Table.from_batches([batch.slice(k, STRIP)])
                low, high = part.column("first")[0].as_py(), part.column("first")[-1].as_py()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([low]), pa.array([high]), pa.array([part.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["strip", "low", "high", "n", "data"])
                number += 1

    placed = classes.select("cls", "members", "data", "size").mapInArrow(place, "cls long, members long, data binary, size int, first double")
    parts = max(1, -(-classes.count() // STRIP))
    ordered = placed.repartitionByRange(parts, "first", "cls").sortWithinPartitions("first", "cls")
    strips = materialise(ordered.mapInArrow(cut, "strip long, low double, high double, n long, data binary"), "strips")
    # One row for each STRIP vectors, without the vectors: these are counted in order.
    before = F.sum("n").over(Window.orderBy("low", "strip")) - F.col("n")
    runs = strips.select("strip", F.floor(before / max(1, RUN_COMPONENTS // width)).cast("long").alias("run"), "low", "n")
    return materialise(strips.join(runs.select("strip", "run"), "strip").select("run", "low", "high", "data"), "runs")


def _near_runs(strips: DataFrame, reach: float) -> DataFrame:
    """(a, b) of runs whose ranges on the first axis are within ``reach``, met by cells of that width."""
    cell = lambda x: F.floor(x / F.lit(reach))
    ranges = strips.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    x = ranges.select(F.col("run").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    y = ranges.select(F.col("run").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.explode(F.sequence(cell(F.col("low")) - 1, cell(F.col("high")) + 1)).alias("cell"))
    near = (F.col("a") <= F.col("b")) & (F.col("b_low") - F.col("a_high") <= reach) & (F.col("a_low") - F.col("b_high") <= reach)
    return x.join(y, "cell").filter(near).select("a", "b").distinct()


def _tiles(turned: np.ndarray) -> list[np.ndarray]:
    """Rows by tile: halves by the widest of the leading axes, until they are small enough."""
    done, open_ = [], [np.arange(len(turned))]
    while open_:
        rows = open_.pop()
        if len(rows) <= TILE:
            done.append(rows)
            continue
        axis = int(np.ptp(turned[rows, :BOX_AXES], axis=0).argmax())
        order = rows[np.argpartition(turned[rows, axis], len(rows) // 2)]
        open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return done


class _Run:
    """Vectors of a run, tile after tile."""

    def __init__(self, data: list[bytes], axes: np.ndarray, width: int):
        rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in data])
        unit = _unit(_matrix(rows.column("data").to_pylist(), rows.column("size").to_pylist(), width))
        turned = _turned(unit, axes)
        tiles = _tiles(turned)
        order = np.concatenate(tiles)
        ends = np.cumsum([len(t) for t in tiles])
        self.tiles = [slice(e - len(t), e) for t, e in zip(tiles, ends.tolist())]
        self.cls, self.members, self.size = (rows.column(c).to_numpy()[order] for c in ("cls", "members", "size"))
        self.unit, turned = unit[order], turned[order]
        self.low, self.high = (np.array([f(turned[t, :BOX_AXES], axis=0) for t in self.tiles]) for f in (np.min, np.max))
        squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        self.turned = turned.astype(np.float32)
        self.suffix = np.sqrt(np.concatenate([squares, np.zeros((len(turned), 1))], axis=1)).astype(np.float32)
        self.links = np.zeros(len(self.cls), np.int64)


def _tile(x: _Run, i: slice, y: _Run, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rows, columns, which of them link) of a tile, or None if nothing can."""
    rows, cols = np.arange(*i.indices(len(x.cls))), np.arange(*j.indices(len(y.cls)))
    width, done, product = x.turned.shape[1], 0, np.zeros((len(rows), len(cols)), np.float32)
    for step in (*(s for s in STEPS if s < width), width):
        product += x.turned[rows, done:step] @ y.turned[cols, done:step].T
        done = step
        alive = product + x.suffix[rows, step][:, None] * y.suffix[cols, step] >= threshold - SLACK
        r, c = alive.any(axis=1), alive.any(axis=0)
        if not r.any():
            return None
        if not (r.all() and c.all()):
            rows, cols, product = rows[r], cols[c], product[np.ix_(r, c)]
    cosine = x.unit[rows] @ y.unit[cols].T
    return rows, cols, (cosine >= threshold) & (x.size[rows][:, None] == y.size[cols])


def _settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merges components: ``label`` (smallest member so far) takes in the links u - v."""
    while True:
        low = np.minimum(label[u], label[v])
        if (label[u] == low).all() and (label[v] == low).all():
            return
        for end in (label[u], label[v], u, v):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _compare(axes: np.ndarray, width: int, threshold: float, reach: float):
    kinds = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        same = left.column("a")[0].as_py() == left.column("b")[0].as_py()
        x = _Run(left.column("data").to_pylist(), axes, width)
        y = x if same else _Run(right.column("data").to_pylist(), axes, width)
        n = len(x.cls)
        cls = x.cls if same else np.concatenate([x.cls, y.cls])
        order = np.argsort(cls, kind="stable")
        rank = np.empty(len(cls), np.int64)
        rank[order] = np.arange(len(cls))
        label = np.arange(len(cls))
        for p, i in enumerate(x.tiles):
            gaps = np.maximum(np.maximum(y.low - x.high[p], x.low[p] - y.high), 0)
            near = (gaps * gaps).sum(axis=1) <= reach * reach
            for q in np.flatnonzero(near).tolist():
                if same and q < p:
                    continue
                j = y.tiles[q]
                if (found := _tile(x, i, y, j, threshold)) is None:
                    continue
                rows, cols, linked = found
                if same and p == q:
                    linked &= rows[:, None] != cols
                x.links[rows] += linked @ y.members[cols]
                if not (same and p == q):
                    y.links[cols] += x.members[rows] @ linked
                u, v = np.nonzero(linked)
                if len(u):
                    _settle(label, rank[rows[u]], rank[cols[v] + (0 if same else n)])
        links = x.links if same else np.concatenate([x.links, y.links])
        some = links > 0
        return pa.table([pa.array(cls[some]), pa.array(links[some]), pa.array(cls[order[label[rank[some]]]])], schema=kinds)

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and whether the row stays."""
    rows = materialise(_vectors(vectors), "vectors")
    first = F.first(F.struct("data", "size"))
    classes = rows.filter("key IS NOT NULL AND vec_id IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("cls"), F.count("*").alias("members"), first.alias("v"))
    classes = materialise(classes.select("key", "cls", "members", "v.data", "v.size"), "classes")
    width = classes.agg(F.max("size")).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes, reach = principal_axes(classes, width), math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    strips = _strips(classes, axes, width)
    pairs = materialise(_near_runs(strips, reach), "run-pairs")
    # Columns of its own for each side: cogroup mixes up those that both have from one relation.
    left = pairs.join(strips.select(F.col("run").alias("a"), "data"), "a").select("a", "b", "data")
    right = pairs.join(strips.select(F.col("run").alias("b"), F.concat("data", F.lit(b"")).alias("data")), "b").select((F.col("a") + 0).alias("a"), (F.col("b") + 0).alias("b"), "data")
    sides = left.groupBy("a", "b"), right.groupBy("a", "b")
    found = materialise(sides[0].cogroup(sides[1]).applyInArrow(_compare(axes, width, threshold, reach), "cls long, links long, other long"), "found")
    discard(strips, pairs)
    labels = components(found.filter("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("key", "cls", "members").join(links, "cls", "left").join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component_id", "cls").alias("label"))
    joined = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    component = F.coalesce("label", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT DISTINCT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, vec_id) AS component_id, coalesce(c.component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id
"""
