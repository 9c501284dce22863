"""Searches of points over tables of primitives, block by block, on the executors.

A table of at most one block goes to the executors as one index, through which whole Arrow batches of points run without
a shuffle.  A larger one is sorted along a space-filling curve and dealt into blocks of near primitives; each block
becomes an index in the task that holds it.  The driver sees one row a block: its box and its count.  A point meets only
the blocks that can matter: those no farther than the distance within which its k nearest primitives must lie, by
the boxes' farthest corners.  Points and blocks meet by an equi-join on the block; a block that many points want is
read by several tasks, each with a bounded share of the points.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feldspar.plans.lineage import cut

from .spatial import HIGH, LOW, SPAN, morton

#: Primitives of a block; points that one task takes through a block.
BLOCK, SHARE = 100_000, 200_000
#: Distances are compared with this much room for rounding.
ROOM = 1 + 1e-9

Build = Callable[[pa.Table], Any]
Look = Callable[[Any, pa.Array, np.ndarray], list]


def coordinates(batch: pa.RecordBatch | pa.Table, names=("x", "y", "z")) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy().astype(float) for n in names], axis=1)


def known(df: DataFrame) -> DataFrame:
    """The rows whose coordinates are numbers."""
    return df.where(" and ".join(f"{a} is not null and not isnan({a})" for a in "xyz"))


def candidates(at: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, k: int, farthest: bool = False) -> np.ndarray:
    """(points, blocks): whether a block may hold one of the ``k`` nearest (or farthest) primitives of a point."""
    near = np.maximum(np.maximum(low - at[:, None], at[:, None] - high), 0)
    near = np.einsum("pbi,pbi->pb", near, near)
    far = np.maximum(np.abs(at[:, None] - low), np.abs(at[:, None] - high))
    far = np.einsum("pbi,pbi->pb", far, far)
    sure = -near if farthest else far
    if count.min() >= k:
        bound = sure.min(axis=1)
    else:
        order = np.argsort(sure, axis=1)
        reached = np.cumsum(count[order], axis=1) >= k
        at_k = np.where(reached.any(axis=1), reached.argmax(axis=1), -1)
        rows = np.arange(len(at))
        bound = np.where(at_k >= 0, sure[rows, order[rows, at_k]], np.inf)
    if farthest:
        return far * ROOM >= np.where(bound < 0, -bound, -1.0)[:, None]
    return near <= bound[:, None] * ROOM


def _sorted_by(table: pa.Table, key: tuple[str, ...]) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in key])


def search(
    points: DataFrame, prims: DataFrame, key: tuple[str, ...], build: Build, look: Look, schema: str, k: int = 1, farthest: bool = False, block: int | None = None, pruned: bool = True
) -> tuple[DataFrame, bool]:
    """(rows of ``schema``, whether they come from one block).

    ``points`` are (qid, x, y, z), all known; ``prims`` have ``key``, lox..hiz and what ``build`` needs to make an index of a
    table of them, sorted by ``key``.  ``look(index, qids, coordinates)`` gives the columns of ``schema``.  Of several
    blocks a point has a result from each that may matter (from all if not ``pruned``); the caller merges them.
    """
    block = block or BLOCK
    names = [part.split()[0] for part in schema.split(", ")]
    n = prims.count()

    def results(index, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(look(index, batch.column(0), coordinates(batch)), names=names)

    if n <= block:
        shared = points.sparkSession.sparkContext.broadcast(build(_sorted_by(prims.toArrow(), key)))
        return points.mapInArrow(lambda batches: results(shared.value, batches), schema), True

    middle = [((F.col(a) + F.col(b)) / 2) for a, b in zip(LOW, HIGH, strict=True)]
    span = prims.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(middle) for f in (F.min, F.max)]).first()
    cells = []
    for i, c in enumerate(middle):
        lo, hi = span[f"min{i}"], span[f"max{i}"]
        cells.append(F.least(F.floor((c - lo) / ((hi - lo) / (SPAN + 1) if hi > lo else 1.0)), F.lit(SPAN)).cast("long"))
    ranged = prims.withColumn("_code", morton(*cells)).repartitionByRange(-(-n // block), "_code", *key)
    placed = cut(ranged.withColumn("_block", F.spark_partition_id()).drop("_code"))
    boxes = placed.groupBy("_block").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH]).orderBy("_block").toPandas()
    number, count = boxes["_block"].to_numpy(), boxes["n"].to_numpy()
    low, high = boxes[list(LOW)].to_numpy(float), boxes[list(HIGH)].to_numpy(float)

    def indexed(batches) -> Iterator[pa.RecordBatch]:
        found = list(batches)  # one block
        if sum(b.num_rows for b in found):
            table = _sorted_by(pa.Table.from_batches(found), key)
            blob = pickle.dumps(build(table.drop_columns(["_block"])), protocol=pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays([pa.array([table.column("_block")[0].as_py()], pa.int32()), pa.array([blob], pa.large_binary())], names=["_block", "_index"])

    def met(batches) -> Iterator[pa.RecordBatch]:
        some = max(16, 2_000_000 // len(number))
        for batch in batches:
            for start in range(0, batch.num_rows, some):
                part = batch.slice(start, some)
                own = coordinates(part)
                row, at = np.nonzero(candidates(own, low, high, count, k, farthest) if pruned else np.ones((len(own), len(number)), bool))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(number[at].astype(np.int32))], names=["qid", "x", "y", "z", "_block"])

    kind = points.schema["qid"].dataType.simpleString()
    wanted = cut(points.select("qid", "x", "y", "z").mapInArrow(met, f"qid {kind}, x double, y double, z double, _block int"))
    shares = wanted.groupBy("_block").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("_shares"))
    shares = F.broadcast(shares)  # a row a block
    indexes = cut(placed.mapInArrow(indexed, "_block int, _index binary"))
    left = wanted.join(shares, "_block").withColumn("_share", F.pmod(F.xxhash64("qid"), "_shares").cast("int")).drop("_shares")
    right = indexes.join(shares, "_block").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")

    def both(asked: pa.Table, index: pa.Table) -> pa.Table:
        own = pickle.loads(index.column("_index")[0].as_py())
        return pa.Table.from_batches(list(results(own, asked.select(["qid", "x", "y", "z"]).combine_chunks().to_batches())))

    return left.groupBy("_block", "_share").cogroup(right.groupBy("_block", "_share")).applyInArrow(both, schema), False
