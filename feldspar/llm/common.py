"""Shared helpers: reading tables, folds, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.plans.lineage import BROADCAST_BYTES, broadcast_if_small, cut, ensure_checkpoint_dir, multiplied, size_bytes  # noqa: F401

#: Bytes of an Arrow batch of texts, unless the session sets a bound of its own below Spark's default.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", {"67108864b", "64m", "67108864"}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, of whose texts Python workers then get a few MB at a time, however long the texts are."""
    if df.sparkSession.conf.get(_BATCH_KEY, "64m").lower() in _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    return df


def give_back() -> None:
    """Returns freed memory of this process to the system: Python workers go on from task to task and would keep the
    peak of each."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows of the evaluation fold, from which no label is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows outside the evaluation fold, with columns ``text`` and ``label``: those whose
    doc_id has the smallest hash.  A classifier is fitted on them; nothing else is limited to them."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")


#: What a row takes in the relation that the driver hashes for a broadcast, besides its own bytes: its key, lengths,
#: a pointer and the places that are kept free.
HASHED_ROW = 100
#: Bytes of such a relation; the driver holds it plain, serialised, and as the rows that it was made of.
HASHED_BYTES = 32 << 20


def broadcast_hashed(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a materialised ``df`` of rows of ``row_bytes`` for broadcast if the relation hashed from it is small for a
    driver; otherwise leaves the join to shuffle."""
    return broadcast_if_small(df, row_bytes + HASHED_ROW, HASHED_BYTES)


def release(df: DataFrame) -> None:
    """Lets Spark remove the shuffle files and checkpoints of DataFrames that are gone, which it does when the driver
    collects its garbage; many small steps would leave them until then."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_clear(df: DataFrame) -> DataFrame:
    """``cut``, after which Spark removes the shuffle files that ``df`` was computed from, whether or not anything still
    refers to their plan; ``release`` only helps if nothing does.  ``df`` can be computed again, from its sources."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP_KEY, "false")
    conf.set(_CLEANUP_KEY, True)
    try:
        return cut(df.select("*"))  # a plan of its own, as the setting is read when a plan is made
    finally:
        conf.set(_CLEANUP_KEY, before)


#: Share of the driver's heap in use from which its garbage is collected between steps.
HEAP_SHARE = 0.3


def relieve(df: DataFrame) -> None:
    """``release``, if much of the driver's heap is in use: plans and broadcasts of finished steps would stay, and the heap
    grow to its bound, however little is still needed."""
    runtime = df.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > HEAP_SHARE * runtime.maxMemory():
        release(df)


#: Rows that a task of an iterative step has at least: steps on few rows run in few tasks and leave few files.
ROWS = 50_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, cut, in as many partitions as its counted rows need."""
    df = cut(df)
    relieve(df)
    return df.coalesce(max(1, -(-df.count() // ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, root) for each node of an edge, root
    being the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer change.  Minima are pre-aggregated
    before the shuffle and joined back, so that Spark can split a hub's rows; each round is checkpointed.
    """
    e = sized(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = sized(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
