"""Exact nearest neighbours over point clouds (pid, x, y, z)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .bvh import Bvh
from .spatial import HIGH, LOW


def _distance2():
    return sum(((F.col(f"q{a}") - F.col(a)) * (F.col(f"q{a}") - F.col(a)) for a in "yz"), (F.col("qx") - F.col("x")) * (F.col("qx") - F.col("x")))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest (d2, then pid) of each query."""
    w = Window.partitionBy("qid").orderBy("d2", "pid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _index(table: pa.Table):
    at = blocks.coordinates(table)
    return table.column("pid").combine_chunks(), at, Bvh(at, at, "morton")


def nearest(queries: DataFrame, cloud: DataFrame, k: int = 1, exclude_self: bool = False) -> DataFrame:
    """(qid, rank, pid, d2): the at most ``k`` points nearest to each query (qid, x, y, z), ascending, ties by pid.

    The cloud is searched in blocks (``blocks.search``): a block has as many points as any other, wherever they lie, so
    neither far-off points nor dense spots make one task do more.  With ``exclude_self`` a query never finds the point
    of its own id.  Queries or points with a null coordinate find nothing and aren't found.
    """
    points = blocks.known(cloud).select("pid", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    asked = blocks.known(queries).select("qid", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    boxed = points.select("*", *[F.col(a).alias(c) for a, c in zip("xyzxyz", (*LOW, *HIGH), strict=True)])

    def look(index, qids, at):
        pids, cloud_at, tree = index
        own = np.full(len(at), -1)
        if exclude_self:  # the place of a query's own point
            place = pa.compute.index_in(qids.cast(pids.type), pids)
            own = place.fill_null(-1).to_numpy(zero_copy_only=False)
        best, who = np.full((len(at), k), np.inf), np.full((len(at), k), len(pids))

        def leaf(rows, prims):
            d = at[rows][:, None, :] - cloud_at[prims]
            d = d[:, :, 0] * d[:, :, 0] + d[:, :, 1] * d[:, :, 1] + d[:, :, 2] * d[:, :, 2]
            w = np.broadcast_to(prims, d.shape)
            d = np.concatenate([best[rows], np.where(w == own[rows][:, None], np.inf, d)], axis=1)
            w = np.concatenate([who[rows], np.where(w == own[rows][:, None], len(pids), w)], axis=1)
            order = np.lexsort((w, d), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)

        tree.visit(at, lambda rows: best[rows, -1], leaf)
        row, rank = np.nonzero(who < len(pids))
        return [qids.take(pa.array(row)), pa.array((rank + 1).astype(np.int32)), pids.take(pa.array(who[row, rank])), pa.array(best[row, rank])]

    schema = f"qid {dict(asked.dtypes)['qid']}, rank int, pid {dict(points.dtypes)['pid']}, d2 double"
    found, whole = blocks.search(asked, boxed, ("pid",), _index, look, schema, k + exclude_self)
    return found if whole else _ranked(found.drop("rank"), k).select("qid", F.col("rank").cast("int").alias("rank"), "pid", "d2")


def closest_point(queries: DataFrame, cloud: DataFrame) -> DataFrame:
    return nearest(queries, cloud, 1)


def graph(cloud: DataFrame, k: int = 1) -> DataFrame:
    """The k-nearest-neighbour graph of a cloud; its filters are the queries for single points."""
    return nearest(cloud.withColumnRenamed("pid", "qid"), cloud, k, exclude_self=True)


def scan(queries: DataFrame, cloud: DataFrame, k: int = 1, exclude_self: bool = False) -> DataFrame:
    """The same by comparing every query with every point: the plain form, for small clouds and for tests."""
    pairs = queries.select("qid", *[F.col(a).alias(f"q{a}") for a in "xyz"]).crossJoin(cloud.select("pid", "x", "y", "z"))
    if exclude_self:
        pairs = pairs.where("pid <> qid")
    return _ranked(pairs.select("qid", "pid", _distance2().alias("d2")), k).select("qid", F.col("rank").cast("int").alias("rank"), "pid", "d2")


def distances(queries: DataFrame, cloud: DataFrame) -> DataFrame:
    """(qid, least, largest): the distances of the nearest and the farthest point of a small cloud."""
    pairs = queries.select("qid", *[F.col(a).alias(f"q{a}") for a in "xyz"]).crossJoin(F.broadcast(cloud.select("x", "y", "z")))
    return pairs.groupBy("qid").agg(F.sqrt(F.min(_distance2())).alias("least"), F.sqrt(F.max(_distance2())).alias("largest"))
