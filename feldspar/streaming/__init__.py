"""Geometry on streams.

Fields are stateless expressions, so they run unchanged on a streaming DataFrame; so do scenes and meshes, whose
hierarchies are sent once and through which each micro-batch runs.  Nearest neighbours need several rounds, which a
streaming plan can't hold, and run on each micro-batch by ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from feldspar.functions.fields import Field
from feldspar.operators import cloud, mesh, scene


def field(points: DataFrame, f: Field, name: str = "d") -> DataFrame:
    return f.evaluate(points, name)


def scene_union(points: DataFrame, prims: DataFrame) -> DataFrame:
    """(qid, d, prim_id) against a static scene of one block; larger scenes would need an aggregate over time."""
    if prims.count() > scene.BLOCK:
        raise ValueError("a streaming scene has at most one block of primitives")
    return scene.union(points, prims)


def mesh_distance(points: DataFrame, tris: DataFrame) -> DataFrame:
    if tris.count() > mesh.BLOCK:
        raise ValueError("a streaming mesh has at most one block of triangles")
    return mesh.distance(points, tris)


def nearest(points: DataFrame, points_of: DataFrame, k: int, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands (qid, rank, pid, d2) of each micro-batch to ``sink(batch, number)``."""
    return points.writeStream.foreachBatch(lambda batch, n: sink(cloud.nearest(batch, points_of, k), n))
