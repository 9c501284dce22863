"""Cutting lineage in the shared checkpoint folder, and broadcasts behind a size check."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its rows, measured first, fit in this many bytes.
BROADCAST_BYTES = 64 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in ``spark.checkpoint.dir``.  Where none is named, a local session gets one in
    its warehouse, which all of its threads share; on a cluster that is an error, as executors need a shared folder."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.  Spark removes the files with the DataFrame if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType):
            return F.coalesce(F.aggregate(column, F.lit(24), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(8))
        if not isinstance(kind.elementType, T.ArrayType | T.MapType | T.StructType):
            return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * 8 + 24
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2 + 24
    return F.lit(8)


def size_bytes(df: DataFrame) -> int:
    """The bytes of all rows, measured: fixed columns count eight, others what is in them."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, row_bytes: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a materialised ``df`` for broadcast if its rows fit in ``limit`` bytes; otherwise leaves the join to shuffle.
    Rows are measured; ``row_bytes`` may be given where every column is of a fixed size, so that a count will do."""
    total = size_bytes(df) if row_bytes is None else df.count() * row_bytes
    return F.broadcast(df) if total <= limit else df


def multiplied(df: DataFrame) -> DataFrame:
    """Marks a ``df`` whose rows came from fewer for a join by sorting, never for a broadcast.  After an explode Spark still
    takes it to be as large as before, also where it knows the size of a finished stage below, and would have the
    driver hash all of it."""
    return df.hint("merge")
