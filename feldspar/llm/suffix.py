"""Removal of repeated byte strings by sparse distributed prefix doubling.

A byte is removed if a string of ``length`` (50) bytes that covers it also starts in a document with a smaller doc_id.

Doubling the prefixes of *every* position would send each byte of the corpus through several sorts.  Here only
synchronising positions are ranked: each window of ``length`` bytes is represented by the least rank among its
``SEED``-byte (16) substrings, which depends on the window's bytes alone, so equal windows have equal representatives.
Consecutive windows with one representative, the seed, form a run.  The rounds, at growing offsets:

1. rank 16: Spark sorts the runs by their seed; where all of a rank are in one document, it is unique and done (most
   of the corpus ends here);
2. rank pairs at offset 16: a window reaches at least 16 bytes beyond its seed on one side, so a run goes on only if
   another document shares the pair (rank at the seed, rank 16 bytes after it) or (rank 16 bytes before it, rank at
   it).  A run that stands, whole, in a smaller document is past the threshold and removed;
3. of the runs that are left, the bytes are fetched, Spark sorts them by seed, and their windows are ranked by doubling and
   compared, on the real bytes; those that have a smaller document are removed.

Rounds 1 and 2 share one exchange (the pairs of a seed lie in the seed's partition); a seed of very many rows is read
on without holding them, and its runs go to round 3 unless a smaller document has them whole.  Round 3 has an exchange
of the runs that are left, not of their windows; only the runs of a crowded seed are dealt out window by window, which
are counted before they move.  Runs that repeat within one Arrow batch are resolved there, so a passage that stands
in a third of all documents sends one row a batch, not one a document.

``double`` is the plain form, for any position: Spark sorts (rank, rank at the offset) pairs at offsets 1, 2, 4, ...,
reranks them, and drops positions whose rank only one document has.  It finds the same bytes; what it moves at each
offset is a multiple of the text (README), so it serves small inputs and the tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feldspar.operators.spatial import numbered

from .common import BROADCAST_BYTES, broadcast_if_small, cut, cut_clear, give_back, release, small_batches

LENGTH, SEED = 50, 16
#: Bytes hashed at once, which bounds the kernel's memory; a run that a border cuts is resolved in round 3.
BLOCK = 1 << 17
#: Bytes of text whose runs are held and resolved among themselves at once.
PART = 2 << 20
#: A run is sent as three longs: seed rank (48 bits) and a code of the rank before it (16), run hash (48) and a code of
#: the rank after the seed (16), and its place: start and number of windows (7).
_COUNT, _CODE = 7, 16
_COUNT_MAX, _CODE_MAX = (1 << _COUNT) - 1, (1 << _CODE) - 1
_HIGH = 16

#: Rows of one seed held in memory; what goes beyond is read on.
HELD = 1 << 20
#: A seed is crowded if it has more than this many times the runs that a partition of round 3 has on average.
CROWD = 1.0
#: Round 3 has this many times the session's shuffle partitions, as each run becomes some twenty windows after the exchange.
WINDOW_PARTS = 4

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A rank (a 64-bit hash) of two neighbouring substrings from their ranks."""
    h = a * _M1
    h += b
    h ^= h >> _S
    h *= _M2
    return h


def _slide(pick, h: np.ndarray, span: int) -> np.ndarray:
    """``pick`` over each ``span`` consecutive values."""
    size = 1
    while size < span:
        step = min(size, span - size)
        h = pick(h[:-step], h[step:])
        size += step
    return h


def ranks(data: np.ndarray, size: int) -> np.ndarray:
    """The rank of the ``size``-byte substring at each position, by doubling."""
    h, done = (data.astype(np.uint64) + np.uint64(1)) * _M2, 1
    while done < size:
        step = min(done, size - done)
        h = _join(h[:-step], h[step:])
        done += step
    h ^= h >> np.uint64(32)
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    """Seed ranks are least ranks, small ones; this spreads them over 64 bits again, one to one."""
    return h * _M1


def _codes(h: np.ndarray) -> np.ndarray:
    return (h * _M1 >> np.uint64(40)).astype(np.int64) % _CODE_MAX + 1


def _block_runs(part: np.ndarray, n: int, open_left: bool, open_right: bool, length: int, seed: int):
    """(seed rank, start, windows, code before, code after) of the runs of the ``n`` windows of a block; both codes 0
    mean that they aren't known, one 0 that the document ends there."""
    rank, span = ranks(part, seed), length - seed + 1
    least = _slide(np.minimum, rank, span)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    value = least[first]
    # A position is a seed if the largest of its windows' least ranks is its own.
    edge = np.zeros(span - 1, np.uint64)
    where = np.flatnonzero(_slide(np.maximum, np.concatenate((edge, least, edge)), span) == rank)
    at = rank[where]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    before, after = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    if len(new) == len(first) and (at[new] == value).all():
        single = np.diff(np.append(new, len(at))) == 1
        p = where[new]
        known = single & ~((p < seed) & open_left) & ~((p + 2 * seed > len(part)) & open_right)
        i = known & (p >= seed)
        before[i] = _codes(rank[p[i] - seed])
        i = known & (p + 2 * seed <= len(part))
        after[i] = _codes(rank[p[i] + seed])
    count = np.diff(np.append(first, n))
    if count.max() > _COUNT_MAX:  # cut long runs; the codes of their parts aren't known
        parts = np.unique(np.concatenate((first, *(np.arange(s, s + c, _COUNT_MAX) for s, c in zip(first, count, strict=True) if c > _COUNT_MAX))))
        own = np.searchsorted(first, parts, "right") - 1
        whole = count[own] <= _COUNT_MAX
        value, before, after = value[own], before[own] * whole, after[own] * whole
        first, count = parts, np.diff(np.append(parts, n))
    return value, first, count, before, after


def runs(text: bytes, length: int = LENGTH, seed: int = SEED):
    """Arrays (seed rank, start, windows, code before, code after) of a document's runs."""
    n = len(text) - length + 1
    found = []
    for at in range(0, max(n, 0), BLOCK):
        here = min(BLOCK, n - at)
        part = np.frombuffer(text, np.uint8, here + length - 1, at)
        value, first, *rest = _block_runs(part, here, at > 0, at + here < n, length, seed)
        found.append((value, first + at, *rest))
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


_ROWS = "seed long, run long, doc_id long, tag long, at long, until long"
_NAMES = ["seed", "run", "doc_id", "tag", "at", "until"]


def _pack(high: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (high >> np.uint64(_HIGH) << np.uint64(_HIGH)).view(np.int64) | code


def _start(at):
    return at >> _COUNT


def _until(at, length):
    return _start(at) + (at & _COUNT_MAX) + (length - 1)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _each(values: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(firsts, n)))


def _batch_rows(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], length: int):
    """Columns of ``_ROWS`` for the runs of a batch, without those that a smaller document of the batch has whole; and
    the merged spans (doc, tag, start, end) of the latter."""
    keys, places, marks, which = [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for i, text in enumerate(texts):
        h, start, count, before, after = runs(text, length)
        if len(h):
            ends = (start + count + (length - 1)).tolist()
            marked = np.array([digest(text[a:b]) for a, b in zip(start.tolist(), ends, strict=True)], np.uint64)
            keys.append(_pack(_spread(h), before))
            marks.append(_pack(marked, after))
            places.append(start << _COUNT | count)
            which.append(np.full(len(h), i))
    if not keys:
        return None
    keys, places, marks, which = map(np.concatenate, (keys, places, marks, which))
    docs = ids[which]
    order = np.lexsort((docs, marks >> _HIGH, keys >> _HIGH))
    first = _firsts(keys[order] >> _HIGH, marks[order] >> _HIGH)
    covered = np.zeros(len(docs), bool)
    covered[order] = docs[order] > _each(docs[order][first], first, len(docs))
    left, spans = ~covered, None
    if covered.any():
        w, start, end = which[covered], _start(places[covered]), _until(places[covered], length)
        first = np.concatenate(([True], (w[1:] != w[:-1]) | (start[1:] > end[:-1])))
        spans = ids[w[first]], tags[w[first]], start[first], end[np.append(first[1:], True)]
    return (keys[left], marks[left], docs[left], tags[which[left]], places[left]), spans


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """Rows of ``_ROWS``: a run to be ranked (until null), or a span already removed (at its start)."""

    def parts(batches):
        for batch in batches:
            sizes = np.cumsum([len(t.as_buffer() or b"") for t in batch.column(2)])
            bounds = np.flatnonzero(np.diff(sizes // PART, prepend=-1))
            for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(sizes)]):
                yield batch.slice(a, b - a)

    def scan(batches):
        for batch in parts(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            found = _batch_rows(ids, tags, [t.as_py() or b"" for t in batch.column(2)], length)
            if found is None:
                continue
            left, spans = found
            yield pa.RecordBatch.from_arrays([*map(pa.array, left), pa.nulls(len(left[0]), pa.int64())], names=_NAMES)
            if spans:
                doc, tag, start, end = spans
                # Any spread-out seed will do: a span has no partner.
                columns = (doc * 2654435761 + start, start, doc, tag, start, end)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=_NAMES)
        give_back()

    return docs.mapInArrow(scan, _ROWS)


def _rank(rows: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """(seed, doc_id, tag, start, until, out) of what rounds 1 and 2 leave of whole seeds' sorted rows."""
    seed, run, doc, tag, at = rows
    before, after, seed, run = seed & _CODE_MAX, run & _CODE_MAX, seed >> _HIGH, run >> _HIGH
    n = len(seed)
    first = _firsts(seed)
    several = _each(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), first, n)
    seed, run, doc, tag, at, before, after = (x[several] for x in (seed, run, doc, tag, at, before, after))
    order = np.lexsort((run, seed))
    seed, run, doc, tag, at, before, after = (x[order] for x in (seed, run, doc, tag, at, before, after))
    n = len(seed)
    if not n:
        return (*(np.empty(0, np.int64) for _ in range(5)), np.empty(0, bool))
    first = _firsts(seed, run)
    out = doc > _each(np.minimum.reduceat(doc, first), first, n)
    first = _firsts(seed)
    shared = _each(np.logical_or.reduceat((before == 0) & (after == 0), first), first, n)
    for code in (before, after):
        order = np.lexsort((code, seed))
        first = _firsts(seed[order], code[order])
        d = doc[order]
        many = _each(np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first), first, n)
        shared[order] |= many & (code[order] > 0)
    # Runs that are equal throughout need no look at their windows.
    first = _firsts(seed)
    alike = _each(np.minimum.reduceat(run, first) == np.maximum.reduceat(run, first), first, n)
    keep = out | (shared & ~alike)
    return tuple(x[keep] for x in (seed, doc, tag, _start(at), _until(at, length), out))


def _read_on(rows: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """What ``_rank`` gives, for some of a seed's rows without a look at the others: a run is out if these rows have it in a
    smaller document, and kept for round 3 otherwise."""
    seed, run, doc, tag, at = rows
    order = np.argsort(run >> _HIGH, kind="stable")
    seed, run, doc, tag, at = (x[order] for x in (seed >> _HIGH, run >> _HIGH, doc, tag, at))
    first = _firsts(run)
    out = doc > _each(np.minimum.reduceat(doc, first), first, len(doc))
    return seed, doc, tag, _start(at), _until(at, length), out


def _ranked(rows: DataFrame, length: int) -> DataFrame:
    """Rounds 1 and 2 over rows sorted by seed and run within partitions."""
    names = ["seed", "doc_id", "tag", "start", "until", "out"]

    def emit(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def join(parts):
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    def rank(batches):
        carried: list[list[np.ndarray]] = []
        giant = None  # the seed whose rows are read on
        for batch in batches:
            done = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if done.any():
                until = batch.column(5).drop_null().to_numpy(zero_copy_only=False)
                yield emit((columns[0][done], columns[2][done], columns[3][done], columns[4][done], until, np.ones(len(until), bool)))
            columns = [c[~done] for c in columns]
            if not len(columns[0]):
                continue
            if giant is not None:
                upto = np.searchsorted(columns[0] >> _HIGH, giant, "right")
                if upto:
                    yield emit(_read_on([c[:upto] for c in columns], length))
                columns = [c[upto:] for c in columns]
                if not len(columns[0]):
                    continue
                giant = None
            carried.append(columns)
            last = np.searchsorted(columns[0] >> _HIGH, columns[0][-1] >> _HIGH)
            if last:  # the last seed may go on in the next batch
                whole = join([*carried[:-1], [c[:last] for c in columns]])
                carried = [[c[last:] for c in columns]]
                yield emit(_rank(whole, length))
            if sum(len(c[0]) for c in carried) > HELD:
                whole = join(carried)
                mixed = np.searchsorted(whole[0] >> _HIGH, whole[0][-1] >> _HIGH)
                if mixed:
                    yield emit(_rank([c[:mixed] for c in whole], length))
                yield emit(_read_on([c[mixed:] for c in whole], length))
                carried, giant = [], whole[0][-1] >> _HIGH
        if carried:
            yield emit(_rank(join(carried), length))
        give_back()

    return rows.mapInArrow(rank, "seed long, doc_id long, tag long, start long, until long, out boolean")


def _tagged(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, tag, body): body is the text's bytes; tag tells apart different texts that share a doc_id.  ``columns`` of
    ``docs`` come along in the struct ``_row``."""
    row = [F.struct(*columns).alias("_row")] if columns else []
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("body"), *row)
    shared = cut_clear(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if shared.isEmpty():
        return rows.withColumn("tag", F.lit(0).cast("long"))
    texts = rows.join(broadcast_if_small(shared, 16), "doc_id", "left_semi").select("doc_id", F.xxhash64("body").alias("h")).distinct()
    tags = cut_clear(texts.select("doc_id", "h", (F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1).cast("long").alias("tag")))
    keyed = rows.withColumn("h", F.xxhash64("body"))
    return keyed.join(broadcast_if_small(tags, 32), ["doc_id", "h"], "left").withColumn("tag", F.coalesce("tag", F.lit(0))).drop("h")


def _late_windows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, text: pa.Array, length: int):
    """(doc_id, tag, start, until) of the windows in whole seeds' runs that a smaller document of these has, those that follow
    each other joined.  Windows are sorted by their hash and then compared byte by byte."""
    bounds = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset)
    data = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    at = (bounds[:-1] - bounds[0]).astype(np.int64)
    count = np.diff(bounds) - (length - 1)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    where = at[row] + place
    key = ranks(data, length)[where]
    order = np.argsort(key, kind="stable")
    first = _firsts(key[order])
    docs = doc[row[order]]
    least = np.minimum.reduceat(docs, first)
    several = _each(least < np.maximum.reduceat(docs, first), first, len(docs))
    out = docs > _each(least, first, len(docs))
    some, model = where[order][several], where[order][_each(first, first, len(docs))[several]]
    if any((data[some + i] != data[model + i]).any() for i in range(length)):  # two windows of one hash
        body, seen = data.tobytes(), {}
        windows = [body[a : a + length] for a in where[order].tolist()]
        for w, d in zip(windows, docs.tolist(), strict=True):
            seen[w] = min(d, seen.get(w, d))
        out = docs > np.array([seen[w] for w in windows])
    late = np.zeros(len(row), bool)
    late[order] = out
    late = np.flatnonzero(late)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(late) > 1) | (np.diff(row[late]) > 0)))) if len(late) else late
    begin, end = late[new], late[np.append(new[1:], len(late)) - 1] if len(late) else late
    own = row[begin]
    return doc[own], tag[own], start[own] + place[begin], start[own] + place[end] + length


def _late(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, tag, start, until): what ``_late_windows`` gives, over rows sorted by seed within partitions."""
    names = ["doc_id", "tag", "start", "until"]

    def late(batches):
        def found(part):
            columns = _late_windows(*(part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)), part.column(4), length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        carried = []
        for batch in batches:
            if not batch.num_rows:
                continue
            carried.append(batch)
            seed = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(seed, seed[-1]))
            if not last and (len(carried) == 1 or carried[-2].column(0)[-1].as_py() == seed[-1]):
                continue  # one seed so far, or one that goes on
            yield found(pa.concat_batches([*carried[:-1], batch.slice(0, last)]))
            carried = [batch.slice(last)]
        if carried:
            yield found(pa.concat_batches(carried))
        give_back()

    return rows.select("seed", "doc_id", "tag", "start", "bytes").mapInArrow(late, "doc_id long, tag long, start long, until long")


def _merged(spans: pa.Array) -> pa.Array:
    """``merge`` of each row's lists of spans."""
    parts = spans.flatten()
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
    row = np.repeat(row, parts.value_lengths().to_numpy(zero_copy_only=False))
    start, until = (c.to_numpy(zero_copy_only=False) for c in parts.flatten().flatten())
    order = np.lexsort((start, row))
    row, start, until = row[order], start[order], until[order]
    apart = row * (until.max(initial=0) + 2)  # spans of different rows don't touch
    end = np.maximum.accumulate(until + apart)
    first = np.flatnonzero(np.concatenate(([True], start[1:] + apart[1:] > end[:-1]))) if len(row) else row
    last = np.append(first[1:], len(row))[: len(first)] - 1
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(spans))))).astype(np.int32)
    merged = pa.StructArray.from_arrays([pa.array(start[first], pa.int64()), pa.array(end[last] - apart[last], pa.int64())], names=["start", "until"])
    return pa.ListArray.from_arrays(pa.array(offsets), merged)


def removed_spans(tagged: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, spans array<struct<start,until>>): the byte ranges to be removed, merged."""
    sorted_rows = _scan(tagged.where("doc_id is not null").select("doc_id", "tag", "body"), length)
    sorted_rows = sorted_rows.repartition(F.shiftright("seed", _HIGH)).sortWithinPartitions("seed", "run")
    # One row a document: the spans removed so far, and the runs that go on to round 3 with their seeds.
    by_doc = cut_clear(
        _ranked(sorted_rows, length)
        .groupBy("doc_id", "tag")
        .agg(
            F.collect_list(F.when(F.col("out"), F.struct("start", "until"))).alias("spans"),
            F.collect_list(F.when(~F.col("out"), F.struct("seed", (F.shiftleft("start", _COUNT).bitwiseOR(F.col("until") - F.col("start") - (length - 1))).alias("at")))).alias("open"),
        )
    )
    seeds, places = F.col("open.seed"), F.col("open.at")
    pending = by_doc.where(F.size("open") > 0).select("doc_id", "tag", seeds.alias("seeds"), places.alias("places"))
    fetched = (
        tagged.join(_by_size(pending, "seeds", 16), ["doc_id", "tag"])
        .select("doc_id", "tag", "body", "seeds", F.posexplode("places").alias("i", "at"))
        .select("doc_id", "tag", F.col("seeds")[F.col("i")].alias("seed"), F.shiftright("at", _COUNT).alias("start"), (F.col("at").bitwiseAND(F.lit(_COUNT_MAX)) + (length - 1)).alias("size"), "body")
        .select("doc_id", "tag", "seed", "start", F.expr("substring(body, cast(start + 1 as int), cast(size as int))").alias("bytes"))
    )
    release(tagged)
    places = f"transform(sequence(1, length(bytes) - {length - 1}), i -> struct(cast(start + i - 1 as long) as start, substring(bytes, i, {length}) as window))"
    parts = WINDOW_PARTS * int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = CROWD * (by_doc.agg(F.sum(F.size("open"))).first()[0] or 0) / parts
    crowded = cut_clear(by_doc.select(F.explode("open.seed").alias("_seed")).groupBy("_seed").agg(F.count("*").alias("n")).where(F.col("n") > share).select("_seed"))
    if not crowded.isEmpty():
        fetched = cut_clear(fetched)
    known = broadcast_if_small(crowded, 24)
    calm = fetched.join(known, F.col("seed") == F.col("_seed"), "left_anti").repartition(parts, "seed")
    late = _late(calm.sortWithinPartitions("seed"), length)
    if not crowded.isEmpty():
        # A window that very many runs hold is counted before the shuffle, and its rows are joined back.
        windows = fetched.join(known, F.col("seed") == F.col("_seed"), "left_semi").select("doc_id", "tag", F.explode(F.expr(places)).alias("p")).select("doc_id", "tag", "p.start", "p.window")
        first = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        late = late.union(windows.join(first, "window").where("doc_id > first").select("doc_id", "tag", "start", (F.col("start") + length).alias("until")))
    late = late.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "until")).alias("spans"))
    early = by_doc.where(F.size("spans") > 0).select("doc_id", "tag", "spans")

    def merged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _merged(batch.column(2))], names=["doc_id", "tag", "spans"])

    both = early.union(late).groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("spans"))
    return both.mapInArrow(merged, "doc_id long, tag long, spans array<struct<start: long, until: long>>")


def double(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start): the places of ``length``-byte strings that also start in a smaller document, by plain prefix doubling.

    Each position has the rank of its string of the size reached so far.  In a round, Spark sorts the distinct pairs
    (rank, rank at the offset) and numbers them anew; a position goes on only while at least two documents have its
    rank, and a pair only if both of its positions did, as a string that holds a unique one is unique itself.  Texts
    of one doc_id count as one document's; null ids and null texts have no strings.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("body")).distinct()
    rows = rows.withColumn("text_id", F.xxhash64("body"))
    bytes_of = F.transform(F.sequence(F.lit(1), F.length("body")), lambda i: F.ascii(F.substring(F.hex("body"), 2 * i - 1, 1)) * 256 + F.ascii(F.substring(F.hex("body"), 2 * i, 1)))
    rows = rows.where(F.length("body") >= length).select("doc_id", "text_id", F.posexplode(bytes_of).alias("at", "rank"))
    size = 1
    while size < length:
        step = min(size, length - size)
        later = F.max("rank").over(Window.partitionBy("doc_id", "text_id").orderBy("at").rangeBetween(step, step))
        paired = cut(rows.select("doc_id", "text_id", "at", "rank", later.alias("later")).where("later is not null"))
        shared = paired.groupBy("rank", "later").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        ranked = numbered(shared, "rank", "later").select(F.col("rank").alias("_rank"), F.col("later").alias("_later"), F.col("place"), "first")
        rows = paired.join(ranked, (F.col("rank") == F.col("_rank")) & (F.col("later") == F.col("_later"))).select("doc_id", "text_id", "at", F.col("place").alias("rank"), "first")
        size += step
    return rows.where("doc_id > first").select("doc_id", F.col("at").alias("start")).distinct()


def _by_size(df: DataFrame, array: str, item_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if it fits, counting ``item_bytes`` for each item of its array."""
    total = df.agg(F.coalesce(F.sum(F.size(array)), F.lit(0)) * item_bytes + F.count("*") * 48).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges; those that touch are joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row (doc_id, body binary, removed array<struct<start,until>>, kept binary) for each row of ``docs``.

    A null text is empty.  Rows with a null doc_id have no order: nothing is removed from them or because of them.
    Rows that share a doc_id don't remove from each other.  Texts of any length are read in blocks.  Only the columns
    doc_id and text are read.
    """
    tagged = _tagged(docs).select("doc_id", "tag", "body")
    spans = cut_clear(removed_spans(tagged, length))
    joined = tagged.join(_by_size(spans, "spans", 16), ["doc_id", "tag"], "left").select("doc_id", "body", "spans")

    def keep(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())]))
        for batch in batches:
            removed, kept = [], []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                body, at, parts = body.as_py(), 0, []
                cuts = [(s["start"], s["until"]) for s in spans.as_py() or ()]
                for s, e in cuts:
                    parts.append(body[at:s])
                    at = e
                kept.append(b"".join([*parts, body[at:]]))
                removed.append([{"start": s, "until": e} for s, e in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "body", "removed", "kept"],
            )

    return joined.mapInArrow(keep, "doc_id long, body binary, removed array<struct<start: long, until: long>>, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs``, all columns kept, with the repeated strings taken out of ``text`` and ``n_chars`` set to what is left (if
    there is such a column).  A character that a cut divides goes whole.  Rows of which nothing is left go; null and
    empty texts stay as they are."""
    tagged = _tagged(docs, *docs.columns)
    spans = cut_clear(removed_spans(tagged.select("doc_id", "tag", "body"), length))
    joined = tagged.join(_by_size(spans, "spans", 16).withColumnsRenamed({"doc_id": "_id", "tag": "_tag", "spans": "_spans"}), (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")

    def kept(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_cut_out(b.as_py(), s.as_py()) for b, s in zip(bodies, spans, strict=True)], pa.string())

    kept = F.arrow_udf(kept, "string").asNondeterministic()  # once a row: no filter copies it

    rows = joined.withColumn("_kept", F.when(F.col("_spans").isNotNull(), kept("body", "_spans")))
    rows = rows.where("_kept is null or _kept <> ''")
    own = F.col("_row.text")
    columns = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.coalesce("_kept", own)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_kept").isNotNull(), F.char_length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[v.alias(c) for c, v in columns.items()])


def _cut_out(body: bytes, spans) -> str:
    parts, at = [], 0
    for s in spans or ():
        parts.append(body[at : s["start"]])
        at = s["until"]
    return "".join(p.decode("utf-8", "ignore") for p in [*parts, body[at:]])
