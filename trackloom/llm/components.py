"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, written to the shared folder; the number of steps grows with the logarithm
of the longest path, and nothing is collected but the number of edges that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MOST_STEPS = 60
SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex's neighbours move to the smallest among them and itself: the larger ones, or the others."""
    if large:
        links = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # A star's centre may have a large share of all links: its smallest neighbour goes out in copies.
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = links.withColumn("salt", F.pmod("b", F.lit(SALTS))).join(copies, ["a", "salt"])
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): every vertex of ``edges`` (columns a and b) with the smallest vertex it can reach."""
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MOST_STEPS):
        last, state = state, materialise(_star(_star(state, True), False), "edges")
        discard(last)
        # A forest of stars is a fixed point; these sums differ before that.
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark:
            return vertices.join(state.select(F.col("a").alias("id"), F.col("b").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component_id"))
        mark = now
    raise RuntimeError("components did not settle")
