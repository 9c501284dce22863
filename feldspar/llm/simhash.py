"""SimHash near-duplicate detection with pigeonring filtering.

A 64-bit fingerprint is read as a ring of eight segments of eight bits.  If two fingerprints differ in at most 3 bits,
then on that ring some start has *every* chain of l consecutive segments within its proportional budget
floor(3 l / 8): the first two segments are equal, chains of three to five hold at most 1 difference, of six and seven
at most 2, all eight at most 3.  So of the third to fifth segment at least two are equal, and the pair shares one of
8 x 3 keys of four equal segments (32 bits).  Candidates meet by an equi-join on those keys; the budgets of the longer
chains prune them inside the join, before and together with the full Hamming check.

Only distinct fingerprints are joined, each standing for its whole group of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import broadcast_hashed, components, cut, give_back, multiplied, release, sized, small_batches
from .words import shingles

RADIUS = 3
#: The exact segments of a chain's key besides its first two.
_PAIRS = ((2, 3), (2, 4), (3, 4))


def fingerprint(text: str | None, size: int = 3, block: int = 1 << 16) -> int:
    """The unsigned 64-bit SimHash; memory is bounded by ``block`` shingles besides the text itself."""
    joined, bounds = shingles(text, size)
    if not bounds:
        return 0
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(bounds), block):
        raw = b"".join([digest(joined[s:e], 42) for s, e in bounds[at : at + block]])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(bounds)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp is the fingerprint as a signed long.  A null text has no words."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def chain_keys(distinct: DataFrame) -> DataFrame:
    """24 rows (key, ring, fp) for each fingerprint; ring is the fingerprint turned so that the chain's start is
    its highest byte."""
    turned = [F.expr(f"shiftleft(fp, {8 * i}) | shiftrightunsigned(fp, {64 - 8 * i})") if i else F.col("fp") for i in range(8)]
    rows = distinct.select("fp", F.posexplode(F.array(*turned)).alias("start", "ring"))

    def byte(j: int):
        return F.shiftrightunsigned("ring", 56 - 8 * j).bitwiseAND(F.lit(255))

    head = F.shiftrightunsigned("ring", 48)
    keys = [
        F.struct(
            (F.col("start") * 3 + n).cast("long").alias("chain"),
            (F.shiftleft(head, 16).bitwiseOR(F.shiftleft(byte(p), 8)).bitwiseOR(byte(q))).alias("part"),
        )
        for n, (p, q) in enumerate(_PAIRS)
    ]
    packed = [F.shiftleft(k["chain"], 32).bitwiseOR(k["part"]) for k in keys]
    return rows.select("fp", "ring", F.explode(F.array(*packed)).alias("key"))


def _within(a: str, b: str):
    """Whether two rings keep the budgets of the longer chains, the last of which is the full Hamming check."""
    keeps = F.lit(True)
    for length in (5, 6, 7, 8):
        mask = F.lit(-1 << (64 - 8 * length)) if length < 8 else F.lit(-1)
        keeps = keeps & (F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(mask)) <= RADIUS * length // 8)
    return keeps


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most 3 bits.  For reports on pairs;
    groups come from ``similar_fingerprints``, which doesn't list them."""
    rows = chain_keys(distinct)
    a, b = (rows.select(*[F.col(c).alias(c + s) for c in rows.columns]) for s in "ab")
    met = multiplied(a).join(multiplied(b), (F.col("keya") == F.col("keyb")) & (F.col("fpa") < F.col("fpb")) & _within("ringa", "ringb"))
    return met.select(F.col("fpa").alias("a"), F.col("fpb").alias("b")).distinct()


def _hubs(met: DataFrame, key: list[str], node: str) -> DataFrame:
    """(key, p): of each bucket of ``met`` (key, node, n) the member that meets the most others in all its buckets."""
    degree = met.groupBy(node).agg(F.sum("n").alias("degree"))
    return met.join(degree, node).groupBy(*key).agg(F.max_by(node, F.struct("degree", node)).alias("p"))


def similar_fingerprints(distinct: DataFrame) -> DataFrame:
    """(node, root) for each of the ``distinct`` fingerprints (column fp) that another one is within 3 bits of, directly
    or through others; root is the least fingerprint of the component.

    In a key's bucket all are compared with one hub first; afterwards only those that are still in different components
    meet each other, so that a dense ball of fingerprints doesn't give all its pairs.
    """
    rows = chain_keys(distinct)
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = sized(multiplied(rows).join(shared, "key"))
    hub = _hubs(met, ["key"], "fp").withColumnRenamed("key", "hub_key")
    ring = met.select(F.col("key").alias("hub_key"), F.col("fp").alias("p"), F.col("ring").alias("hub_ring"))
    hub = sized(hub.join(ring, ["hub_key", "p"]))
    star = met.join(hub, (F.col("key") == F.col("hub_key")) & (F.col("fp") != F.col("p")) & _within("ring", "hub_ring"))
    found = sized(star.select(F.col("fp").alias("a"), F.col("p").alias("b")).distinct())
    roots = sized(components(found))
    grouped = met.where("n > 2").join(broadcast_hashed(roots, 32), F.col("fp") == F.col("node"), "left").select("key", "ring", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = grouped.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = sized(grouped.join(mixed, "key", "left_semi"))
    a, b = (left.select(*[F.col(c).alias(c + s) for c in left.columns]) for s in "ab")
    on = (F.col("keya") == F.col("keyb")) & (F.col("fpa") < F.col("fpb")) & (F.col("roota") != F.col("rootb")) & _within("ringa", "ringb")
    more = sized(a.join(b, on).select(F.col("fpa").alias("a"), F.col("fpb").alias("b")).distinct())
    return roots if more.isEmpty() else sized(components(found.union(more)))


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most 3 differing bits, the row's own included.
    Rows with equal or no text link like any others (no words: fingerprint zero); rows that share a doc_id are rows
    of their own; a null doc_id is never a component_id, and is null only if nothing reachable has a doc_id.  A text may be
    of any length: its shingles are hashed in blocks.  Only the columns doc_id and text are read.
    """
    rows = cut(fingerprints(docs, size))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = similar_fingerprints(least.select("fp"))
    named = least.join(broadcast_hashed(roots, 32), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(groups, "root").select(F.col("fp").alias("own"), "component_id"))
    return rows.join(broadcast_hashed(named, 32), F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def text_hash():
    """Tells texts apart, by 128 bits; null counts as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("h")


#: MinHash bands and bins of each: two texts with a similarity of 0.8 share no band with probability
#: (1 - 0.8^6)^40 = 5e-6, if bins agreed independently.
BANDS, ROWS = 40, 6


def sketches(docs: DataFrame, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, fp, sketch, keys) for each row of ``docs``: the text's hash, its SimHash over ``size`` words, its packed
    one-permutation MinHash, and ``bands`` keys of ``rows`` bins each."""

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            full, packed = minhash.signatures(texts, full=True)
            keys = [[xxhash.xxh3_64_intdigest(r[b * rows : (b + 1) * rows].tobytes(), b) - (1 << 63) for b in range(bands)] for r in full]
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps), pa.array(packed.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "h", "fp", "sketch", "keys"],
            )
        give_back()

    return small_batches(docs).select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(run, "doc_id long, h binary, fp long, sketch array<long>, keys array<long>")


#: Estimates this near to the threshold (four standard errors) are settled on the texts.
MARGIN = 0.08


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(h, s) for each text of ``docs`` whose hash is in ``wanted`` (column h): the set of its shingles' 64-bit hashes."""

    def run(batches):
        for batch in batches:
            sets = []
            for text in batch.column(1):
                joined, bounds = shingles(text.as_py(), size)
                digest = xxhash.xxh3_64_digest
                found = np.frombuffer(b"".join([digest(joined[s:e]) for s, e in bounds]), np.int64)
                sets.append(np.unique(found))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate([np.empty(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["h", "s"])
        give_back()

    texts = docs.select(text_hash(), F.coalesce("text", F.lit("")).alias("text")).join(broadcast_hashed(wanted, 48), "h", "left_semi")
    return small_batches(texts).mapInArrow(run, "h binary, s array<long>").groupBy("h").agg(F.first("s").alias("s"))


def _at_least(similarity: float, common, a, b):
    """Whether ``common`` shingles of sets of ``a`` and ``b`` shingles are enough for the similarity."""
    return common * (1 + similarity) >= (a + b) * similarity - 1e-9


def _settled(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have the Jaccard similarity."""
    x, y = (sets.select(F.col("h").alias(s), F.col("s").alias("s" + s)) for s in "ab")
    enough = _at_least(similarity, F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))
    return pairs.join(x, "a").join(y, "b").where(enough).select("a", "b")


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """The ``pairs`` (a, b) of text hashes with a Jaccard similarity of at least ``similarity``: by the sketches where
    their estimate is clear, else exactly, by the shingles of those texts alone."""

    def estimate(a: pa.Array, b: pa.Array) -> pa.Array:
        both = [c.flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(len(c), -1) for c in (a, b)]
        return pa.array(minhash.likeness(*both))

    estimate = F.arrow_udf(estimate, "double").asNondeterministic()  # once a row: no filter copies it

    def other(column: str, s: str) -> DataFrame:
        return nodes.select(F.col("h").alias(s), F.col(column).alias(column + s))

    half = sized(broadcast_hashed(sized(pairs.distinct()), 64).join(other("sketch", "a"), "a"))
    both = broadcast_hashed(half, 64 + minhash.BINS * minhash.BITS // 8).join(other("sketch", "b"), "b")
    judged = both.select("a", "b", estimate("sketcha", "sketchb").alias("s")).where(F.col("s") >= similarity - MARGIN)
    judged = sized(judged.select("a", "b", (F.col("s") >= similarity + MARGIN).alias("clear")))
    close = judged.where("not clear").select("a", "b")
    wanted = sized(close.select(F.col("a").alias("h")).union(close.select("b")).distinct())
    sets = cut(shingle_sets(docs, wanted, size))
    return judged.where("clear").select("a", "b").union(_settled(close, sets, similarity))


def similar_pairs(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of ``sets`` (h, s) with a Jaccard similarity of at least ``similarity`` and different roots in
    ``roots`` (h, root).

    An exact prefix-filtered join: shingles are ordered by rarity among the sets; two sets that are alike share one
    among the first few of each, and what follows that one in both must still hold enough of them.  So members of
    a group of near copies whose differences outnumber the threshold, as rare shingles, meet nobody.
    """
    rows = sets.join(roots, "h").select("h", "root", F.size("s").alias("n"), F.explode("s").alias("s"))
    shared = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("s", "_s")
    rows = multiplied(rows).join(shared, F.col("s") == F.col("_s"))
    # A shingle of one set only comes before all others, so the places from the end are those among the shared ones.
    rest = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("df"), F.desc("s")))
    rows = rows.withColumn("rest", rest).where(F.col("rest") >= F.ceil(F.col("n") * similarity - 1e-9)).select("s", "h", "root", "n", "rest")
    rows = cut(rows)
    a, b = (rows.select(*[F.col(c).alias(c + x) for c in rows.columns]) for x in "ab")
    on = (F.col("sa") == F.col("sb")) & (F.col("ha") < F.col("hb")) & (F.col("roota") != F.col("rootb"))
    on = on & _at_least(similarity, F.least("resta", "restb"), F.col("na"), F.col("nb"))
    pairs = sized(a.join(b, on).select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct())
    return _settled(pairs, sets, similarity)


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, group) for each row of ``docs``: documents whose ``size``-word shingle sets have a Jaccard similarity of
    ``similarity`` or more share a group, and so do those linked through others.

    Texts meet in buckets: those whose fingerprints are within 3 bits, directly or through others (pigeonring
    filtering), and, as at a similarity of 0.8 most pairs differ in more bits than an exact filter of 64 bits can
    afford, those that share a MinHash band.  In a bucket all are compared with its hub, the member that meets
    the most others; of the buckets that this leaves in several groups, all texts go through an exact join on their
    rarest shingles (``similar_pairs``).  So each pair of one bucket is found, but the work doesn't grow with the square of
    the bucket.  Equal texts count once; null texts are empty, and texts without words are alike.
    """
    rows = cut(sketches(docs, size))
    nodes = cut(rows.groupBy("h").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")))
    rings = similar_fingerprints(nodes.select("fp").distinct())
    ringed = nodes.select("h", "fp").join(broadcast_hashed(rings, 32), F.col("fp") == F.col("node"), "left").select("h", F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("key"))
    banded = nodes.select("h", F.posexplode("keys").alias("band", "key")).union(ringed)
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = sized(multiplied(banded).join(shared, ["band", "key"]))
    release(docs)
    hub = sized(_hubs(met, ["band", "key"], "h"))
    star = met.join(hub, ["band", "key"]).where("h <> p").select(F.col("p").alias("a"), F.col("h").alias("b"))
    found = sized(_alike(star, nodes, docs, similarity, size))
    release(docs)
    roots = sized(components(found))

    grouped = met.where("n > 2").join(broadcast_hashed(roots, 64), F.col("h") == F.col("node"), "left").select("band", "key", "h", F.coalesce("root", "h").alias("root"))
    mixed = grouped.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key")
    undecided = sized(grouped.join(mixed, ["band", "key"], "left_semi").select("h", "root").distinct())
    if not undecided.isEmpty():
        more = sized(similar_pairs(cut(shingle_sets(docs, undecided.select("h"), size)), undecided, similarity))
        if not more.isEmpty():
            release(docs)
            roots = sized(components(found.union(more)))
    named = roots.select(F.col("node").alias("_h"), "root")
    return rows.select("doc_id", "h").join(broadcast_hashed(named, 64), F.col("h") == F.col("_h"), "left").select("doc_id", "h", F.coalesce("root", "h").alias("group"))


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns kept, with one row of each group of ``near_copies``: that of the smallest doc_id
    (null ids last; of several texts under one doc_id the one with the least hash).  A text without words is like
    other such texts only."""
    groups = near_copies(docs, size, similarity)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("b")
    counted = groups.groupBy("group", "doc_id", "h").agg(F.count("*").alias("n"))
    kept = cut(counted.groupBy("group").agg(best, F.max("n").alias("n")).select(F.col("b.doc_id").alias("_id"), F.col("b.h").alias("_h"), "n"))

    def among(keys: DataFrame) -> DataFrame:
        keys = broadcast_hashed(keys.select("_id", "_h"), 64)
        return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_h")), "left_semi")

    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return among(kept)
    twice = among(repeated)
    return among(kept.where("n = 1")).union(twice.dropDuplicates(["doc_id", "text"]))
