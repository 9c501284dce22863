"""Scenes: unions, intersections and differences over tables of primitives.

A scene is a DataFrame (prim_id, kind, p array<double>, lox..hiz) of spheres (p = center, radius) and boxes (p = low,
high corner).  Points meet it in blocks of near primitives (``blocks.search``), each a hierarchy in arrays through which
whole batches of points run with pruning; the results of several blocks are combined by an aggregate on the point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feldspar.functions import algebra as m
from feldspar.functions.fields import TINY, smooth_max, smooth_min
from feldspar.plans.lineage import cut

from . import blocks
from .bvh import Bvh
from .spatial import HIGH, LOW

#: Primitives of a block (about 80 bytes each).
BLOCK = blocks.BLOCK


def spheres(df: DataFrame) -> DataFrame:
    """A scene of rows (prim_id, cx, cy, cz, r)."""
    low = [(F.col(c) - F.col("r")).alias(n) for c, n in zip(("cx", "cy", "cz"), LOW, strict=True)]
    high = [(F.col(c) + F.col("r")).alias(n) for c, n in zip(("cx", "cy", "cz"), HIGH, strict=True)]
    return df.select("prim_id", F.lit("sphere").alias("kind"), F.array("cx", "cy", "cz", "r", F.lit(0.0), F.lit(0.0)).alias("p"), *low, *high)


def boxes(df: DataFrame) -> DataFrame:
    """A scene of rows (prim_id, lox..hiz)."""
    return df.select("prim_id", F.lit("box").alias("kind"), F.array(*LOW, *HIGH).alias("p"), *LOW, *HIGH)


def primitive_distance(kind: np.ndarray, p: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(points, primitives) signed distances."""
    out = np.empty((len(points), len(p)))
    ball = kind == "sphere"
    if ball.any():
        d = points[:, None, :] - p[ball, :3]
        out[:, ball] = np.sqrt(np.einsum("ijk,ijk->ij", d, d)) - p[ball, 3]
    if not ball.all():
        d = np.maximum(p[~ball, :3] - points[:, None, :], points[:, None, :] - p[~ball, 3:])
        o = np.maximum(d, 0)
        out[:, ~ball] = np.minimum(d.max(2), 0) + np.sqrt(np.einsum("ijk,ijk->ij", o, o))
    return out


def _two_extremes(points: DataFrame, scene: DataFrame, farthest: bool = False, pruned: bool = True, build: str = "sah") -> DataFrame:
    """(qid, first, second, prim_id): each point's least value and the second (largest and second with ``farthest``),
    and the primitive of the first (ties: the least id).  Points with a null coordinate get nulls."""

    def index(table: pa.Table):
        low, high = blocks.coordinates(table, LOW), blocks.coordinates(table, HIGH)
        p = np.array(table.column("p").to_pylist(), float).reshape(-1, 6)
        kind = np.array(table.column("kind").to_pylist(), dtype=object)
        return table.column("prim_id").to_numpy().astype(np.int64), kind, p, Bvh(low, high, build if len(p) else "centroid")

    def look(index, qids, at):
        ids, kind, p, tree = index
        n = len(at)
        first, second, who = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1, np.int64)

        def leaf(rows, prims):
            d = primitive_distance(kind[prims], p[prims], at[rows])
            d = -d if farthest else d
            order = np.lexsort((np.broadcast_to(ids[prims], d.shape), d), axis=1)[:, :2]
            best = np.take_along_axis(d, order, 1)
            a, b, w = best[:, 0], best[:, 1] if best.shape[1] > 1 else np.full(len(rows), np.inf), ids[prims][order[:, 0]]
            f, s, o = first[rows], second[rows], who[rows]
            better = (a < f) | ((a == f) & ((o < 0) | (w < o)))
            second[rows] = np.where(better, np.minimum(f, b), np.minimum(s, a))
            first[rows], who[rows] = np.where(better, a, f), np.where(better, w, o)

        if farthest or not pruned:
            for a in range(0, len(ids), 256):
                leaf(np.arange(n), np.arange(a, min(a + 256, len(ids)))) if n else None
        else:
            # A box that is farther than the second best, or than 0 where that is negative, can't matter.
            tree.visit(at, lambda rows: np.maximum(second[rows], 0) ** 2, leaf)
        sign = -1.0 if farthest else 1.0
        return [qids, pa.array(sign * first), pa.array(sign * second), pa.array(who, mask=who < 0)]

    asked = points.select("qid", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    kind = points.schema["qid"].dataType.simpleString()
    prims = scene.select(F.col("prim_id").cast("long").alias("prim_id"), "kind", "p", *LOW, *HIGH)
    schema = f"qid {kind}, first double, second double, prim_id long"
    unknown = asked.where("not (" + " and ".join(f"{a} is not null and not isnan({a})" for a in "xyz") + ")")
    nothing = unknown.select("qid", *[F.lit(None).cast(t).alias(c) for c, t in (("first", "double"), ("second", "double"), ("prim_id", "long"))])
    found, whole = blocks.search(blocks.known(asked), prims, ("prim_id",), index, look, schema, 2, farthest, BLOCK, pruned)
    if not whole:
        sign = -1 if farthest else 1
        values = F.flatten(F.collect_list(F.array("first", "second")))
        ordered = F.array_sort(values) if not farthest else F.reverse(F.array_sort(values))
        found = found.groupBy("qid").agg(ordered.alias("v"), F.min_by("prim_id", F.struct(sign * F.col("first"), "prim_id")).alias("prim_id")).select("qid", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"), "prim_id")
    return found.unionByName(nothing)


def union(points: DataFrame, scene: DataFrame, pruned: bool = True, build: str = "sah") -> DataFrame:
    """(qid, d, prim_id): the least value over the scene and the primitive that has it; +infinity for an empty scene."""
    return _two_extremes(points, scene, pruned=pruned, build=build).select("qid", F.col("first").alias("d"), "prim_id")


def smooth_union(points: DataFrame, scene: DataFrame, length: float, blend=smooth_min, pruned: bool = True) -> DataFrame:
    """(qid, d): the two least values blended; a scene of one primitive has its value."""
    found = _two_extremes(points, scene, pruned=pruned)
    second = F.when(F.col("second") == float("inf"), F.lit(m.HUGE)).otherwise(F.col("second"))
    return found.select("qid", F.when(F.col("first") == float("inf"), F.col("first")).otherwise(blend(F.col("first"), second, max(length, TINY))).alias("d"))


def intersection(points: DataFrame, scene: DataFrame) -> DataFrame:
    """(qid, d): the largest value; -infinity for an empty scene."""
    return _two_extremes(points, scene, farthest=True).select("qid", F.col("first").alias("d"))


def smooth_intersection(points: DataFrame, scene: DataFrame, length: float, blend=smooth_max) -> DataFrame:
    found = _two_extremes(points, scene, farthest=True)
    second = F.when(F.col("second") == float("-inf"), F.lit(-m.HUGE)).otherwise(F.col("second"))
    return found.select("qid", F.when(F.col("first") == float("-inf"), F.lit(float("inf"))).otherwise(blend(F.col("first"), second, max(length, TINY))).alias("d"))


def difference(points: DataFrame, solid, scene: DataFrame) -> DataFrame:
    """(qid, d): a field without the scene's union."""
    return points.withColumn("_f", solid.column()).join(union(points, scene), "qid").select("qid", F.greatest("_f", -F.col("d")).alias("d"))


def inside_any(points: DataFrame, scene: DataFrame) -> DataFrame:
    """The points (all columns) inside some primitive."""
    return points.join(union(points, scene).where("d < 0").select("qid"), "qid", "left_semi")


def outside_all(points: DataFrame, scene: DataFrame) -> DataFrame:
    return points.join(union(points, scene).where("d < 0").select("qid"), "qid", "left_anti")


def bounding_box(scene: DataFrame) -> DataFrame:
    return scene.agg(*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH])


def grid(spark, low, high, n: int) -> DataFrame:
    """The n^3 cell centres of a box: (qid, x, y, z)."""
    out = spark.range(n**3).withColumnRenamed("id", "qid")
    for i, (axis, a, b) in enumerate(zip("xyz", low, high, strict=True)):
        k = F.floor(F.col("qid") / n**i) % n
        out = out.withColumn(axis, a + (k + 0.5) * ((b - a) / n))
    return out


def paint(points: DataFrame, values: DataFrame, half: float) -> DataFrame:
    """The cut cells (|d| at most ``half``) of ``values`` (qid, d, prim_id) with what they are painted by."""
    return points.join(values.where(F.abs("d") <= half), "qid")


def random_points(spark, n: int, seed: int) -> DataFrame:
    """n uniform points of the unit cube, made where they are needed."""
    return cut(spark.range(n).select(F.col("id").alias("pid"), *[F.rand(seed + i).alias(a) for i, a in enumerate("xyz")]))
