"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; its high bits choose one of ``BINS`` bins, and each bin keeps the least of its
hashes.  Empty bins are filled by optimal densification: every empty bin draws bins from a random sequence of its own
until it meets one that isn't empty, and copies its value.  The low-order ``BITS`` bits of each bin's value, hashed once
more with the bin's number, are packed into the fingerprint.  Two fingerprints agree in a bin by chance with probability C = 2^-BITS, so their likeness is the share
P of equal bins corrected for that bias, (P - C) / (1 - C), and 0 at least: an estimate of the Jaccard similarity of
the shingle sets, with a standard error of about 0.02.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import shingles

BINS, BITS, WORDS = 512, 4, 5
_EMPTY = np.uint64(np.iinfo(np.uint64).max)
#: Draws made bin by bin; bins that are still empty go through all of their sequence's order at once.
_DRAWS = 32
_LEAST = -(1 << 63)
#: A bin's stored bits are those of its value mixed with its number, so that copies in other bins differ.
_BIN, _MIX = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _sequences() -> np.ndarray:
    """(BINS, BINS) ranks: row i orders all bins as bin i draws them."""
    h = np.array([[xxhash.xxh64_intdigest(f"{i}:{j}", 7) for j in range(BINS)] for i in range(BINS)], np.uint64)
    return np.argsort(np.argsort(h, axis=1), axis=1).astype(np.uint16)


_ORDER: np.ndarray | None = None


def densify(bins: np.ndarray) -> np.ndarray:
    """``bins`` (texts x BINS) with each empty bin filled; a text without shingles stays empty."""
    global _ORDER
    if _ORDER is None:
        _ORDER = _sequences()
    draws = np.argsort(_ORDER, axis=1)[:, :_DRAWS]
    full = bins != _EMPTY
    out = bins.copy()
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(_DRAWS):
        if not len(row):
            return out
        source = draws[col, t]
        met = full[row, source]
        out[row[met], col[met]] = bins[row[met], source[met]]
        row, col = row[~met], col[~met]
    for r in np.unique(row):
        empty, there = col[row == r], np.flatnonzero(full[r])
        out[r, empty] = bins[r, there[np.argmin(_ORDER[np.ix_(empty, there)], axis=1)]]
    return out


def low_bits(filled: np.ndarray) -> np.ndarray:
    """The low-order bits of each bin's value mixed with its number."""
    mixed = (filled + _BIN) * _MIX
    mixed ^= mixed >> np.uint64(32)
    return (mixed & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def signatures(texts: list[str | None], block: int = 1 << 16, full: bool = False):
    """Packed fingerprints, one row of BINS * BITS / 8 bytes a text; all zero for a text without words.  With ``full``
    the filled bins besides."""
    shift, digest = np.uint64(64 - BINS.bit_length() + 1), xxhash.xxh3_64_digest
    packed = np.zeros((len(texts), BINS * BITS // 8), np.uint8)
    whole = np.zeros((len(texts) if full else 0, BINS), np.uint64)
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        bins = np.full((len(part), BINS), _EMPTY)
        for i, text in enumerate(part):
            joined, bounds = shingles(text, WORDS)
            for b in range(0, len(bounds), block):
                h = np.frombuffer(b"".join([digest(joined[s:e]) for s, e in bounds[b : b + block]]), ">u8").astype(np.uint64)
                np.minimum.at(bins[i], (h >> shift).astype(np.int64), h)
        none = (bins == _EMPTY).all(axis=1)
        filled = densify(bins)
        if full:
            whole[at : at + len(part)] = filled
        low = low_bits(filled)
        low[none] = 0
        packed[at : at + len(part)] = low[:, 0::2] << 4 | low[:, 1::2]
    return (whole, packed) if full else packed


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed fingerprints, row by row: 1 if both have no words, 0 if only one has."""
    x = a ^ b
    equal = ((x >> 4) == 0).sum(axis=1) + ((x & 15) == 0).sum(axis=1)
    chance = 2.0**-BITS
    out = np.clip((equal / BINS - chance) / (1 - chance), 0, 1)
    none_a, none_b = ~a.any(axis=1), ~b.any(axis=1)
    return np.where(none_a & none_b, 1.0, np.where(none_a | none_b, 0.0, out))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint binary) for each row of ``docs``; a null text has no words, texts without words have the zero
    fingerprint, and equal texts equal ones.  A text of any length is read whole, its shingles in blocks."""

    def run(batches):
        for batch in batches:
            packed = signatures([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in packed], pa.binary())], names=["doc_id", "fingerprint"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, ahead, rank, doc_id, text), partitioned by part and sorted by descending doc_id within it.

    The row after the last one of a part is there too, marked ``ahead``: the first row of the part that follows, and
    after the last part the first row of all.  Parts are ranges of doc_id between quantiles over all rows; only one
    small row for each part reaches the driver.  A null doc_id sorts as the least; rows that share a doc_id are in the
    order of their texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = F.coalesce("doc_id", F.lit(_LEAST))
    shares = [i / parts for i in range(1, parts)]
    found = rows.select(F.percentile_approx(rank, F.array(*map(F.lit, shares)), 20 * parts).alias("q")).first()["q"] if shares else None
    bounds = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array((len(bounds) - np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), "left")).astype(np.int32))

    heads = rows.select(rank.alias("rank")).groupBy(part_of("rank").alias("part")).agg(F.max("rank").alias("head")).orderBy("part").collect()
    # Where a part's first row is wanted besides: in the part before it, the first part's in the last.
    wanted = {r["head"]: heads[i - 1]["part"] for i, r in enumerate(heads)}
    heads_at = np.array(sorted(wanted), np.int64)
    also_at = np.array([wanted[h] for h in heads_at.tolist()], np.int64)

    @F.arrow_udf("int")
    def also(ids: pa.Array) -> pa.Array:
        ids = ids.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(heads_at, ids), len(heads_at) - 1)
        return pa.array(np.where(heads_at[at] == ids, also_at[at], -1).astype(np.int32))

    placed = rows.withColumn("rank", rank).withColumn("part", part_of("rank")).withColumn("also", also("rank"))
    places = F.array_compact(F.array(F.struct("part", F.lit(False).alias("ahead")), F.when(F.col("also") >= 0, F.struct(F.col("also").alias("part"), F.lit(True).alias("ahead")))))
    sent = placed.select("rank", "doc_id", "text", F.explode(places).alias("p")).select("p.part", "p.ahead", "rank", "doc_id", "text")
    return sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", F.desc("rank"), F.col("doc_id").desc_nulls_last(), "text")


def compare_edited(docs: DataFrame, chunk_chars: int = 4 << 20) -> DataFrame:
    """For each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited,
    near_next.

    The edited text has the last third of the text (rounded down, in code points) replaced by as many first code
    points of the next document in descending doc_id (the first document follows the last).  Null texts are empty;
    ties and null ids are ordered as ``with_next`` says; a single row is its own next.  Texts of any length are read whole;
    other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(ids, texts, ahead):
        """ahead: the text after the last, or None if the last row only serves as the next of the one before it."""
        follow = [*texts[1:], *([ahead] if ahead is not None else [])]
        n = len(follow)
        edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, follow)]
        own = signatures(texts if ahead is None else [*texts, ahead])
        other = signatures(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:n], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([p.tobytes() for p in own[:n]], pa.binary()),
                pa.array([p.tobytes() for p in other], pa.binary()),
                pa.array(likeness(own[:n], other)),
                pa.array(likeness(own[:n], own[1 : n + 1])),
            ],
            names=names,
        )

    def run(batches):
        part, ids, texts, chars, ended = None, [], [], 0, True
        for batch in batches:
            columns = [batch.column(i) for i in (0, 1, 3, 4)]
            for p, ahead, doc_id, text in zip(*columns, strict=True):
                p, text = p.as_py(), text.as_py()
                if ahead.as_py():
                    if p == part and not ended:  # further rows ahead share the first one's doc_id
                        yield emit(ids, texts, text)
                        ids, texts, chars, ended = [], [], 0, True
                    continue
                if p != part:
                    part, ended = p, False
                ids.append(doc_id.as_py())
                texts.append(text)
                chars += len(text)
                if chars > chunk_chars and len(texts) > 1:
                    yield emit(ids, texts, None)
                    ids, texts, chars = ids[-1:], texts[-1:], len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    if not docs.limit(1).count():
        return docs.sparkSession.createDataFrame([], schema)
    return with_next(small_batches(docs)).mapInArrow(run, schema)
