"""Boxes, bounding spheres, space-filling curves, overlap joins and the octree bounding volume."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feldspar.functions import algebra as m
from feldspar.functions.fields import Field
from feldspar.plans.lineage import cut, multiplied

BITS = 21
SPAN = (1 << BITS) - 1
AXES = ("x", "y", "z")
LOW, HIGH = ("lox", "loy", "loz"), ("hix", "hiy", "hiz")


# Axis-aligned boxes: (lo, hi) triples of columns, SQL expressions or arrays.


def box_of_points(points: DataFrame, *keys: str) -> DataFrame:
    """lox..hiz of the points, by ``keys`` or of all."""
    return points.groupBy(*keys).agg(*[F.min(a).alias(n) for a, n in zip(AXES, LOW, strict=True)], *[F.max(a).alias(n) for a, n in zip(AXES, HIGH, strict=True)])


def box_of_boxes(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(*[F.min(n).alias(n) for n in LOW], *[F.max(n).alias(n) for n in HIGH])


def boxes_intersect(a, b):
    """True if the insides meet; boxes that only touch don't."""
    (al, ah), (bl, bh) = a, b
    return (al[0] < bh[0]) & (bl[0] < ah[0]) & (al[1] < bh[1]) & (bl[1] < ah[1]) & (al[2] < bh[2]) & (bl[2] < ah[2])


def box_overlap(a, b):
    """The volume in common."""
    (al, ah), (bl, bh) = a, b
    x, y, z = (m.greatest(m.least(ah[i], bh[i]) - m.greatest(al[i], bl[i]), 0.0) for i in range(3))
    return x * y * z


def box_distance2(box, p):
    """Squared distance of a point; 0 inside."""
    lo, hi = box
    d = [m.greatest(lo[i] - p[i], p[i] - hi[i], 0.0) for i in range(3)]
    return m.dot(d, d)


def box_distance(box, p):
    return m.sqrt(box_distance2(box, p))


def box_volume(box):
    x, y, z = (h - lo for lo, h in zip(*box, strict=True))
    return x * y * z


def box_area(box):
    x, y, z = (h - lo for lo, h in zip(*box, strict=True))
    return 2.0 * (x * y + y * z + z * x)


def box_centroid(box):
    return tuple(0.5 * (lo + h) for lo, h in zip(*box, strict=True))


# Bounding spheres: (center, radius).


def ritter(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Ritter's approximate bounding sphere of points in their order, its radius enlarged by one per cent.  Only points
    outside the sphere so far are looked at one by one."""
    ends = [(points[points[:, a].argmin()], points[points[:, a].argmax()]) for a in range(3)]
    p, q = max(ends, key=lambda e: ((e[1] - e[0]) ** 2).sum())
    center, radius = (p + q) / 2, float(np.linalg.norm(q - p)) / 2
    at = 0
    while at < len(points):
        far = np.linalg.norm(points[at : at + 4096] - center, axis=1)
        outside = np.flatnonzero(far > radius)
        if not len(outside):
            at += 4096
            continue
        at += int(outside[0]) + 1
        d = float(far[outside[0]])
        grown = (radius + d) / 2
        center = center + (points[at - 1] - center) * ((d - grown) / d)
        radius = grown
    return center, radius * 1.01


def bounding_spheres(points: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, cz, r) of each group's points, taken by pid."""

    def run(k, pdf):
        c, r = ritter(pdf.sort_values("pid")[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame([(*k, *c, r)], columns=[key, "cx", "cy", "cz", "r"])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "pid", *AXES).groupBy(key).applyInPandas(run, f"{key} {kind}, cx double, cy double, cz double, r double")


def sphere_of_spheres(spheres: np.ndarray) -> tuple[np.ndarray, float]:
    """Of rows (cx, cy, cz, r): Ritter's sphere over the two ends of each one's cube diagonal."""
    c, r = spheres[:, :3], spheres[:, 3:]
    return ritter(np.stack([c - r, c + r], axis=1).reshape(-1, 3))


def spheres_intersect(a, b):
    (c, r), (d, s) = a, b
    return m.norm([p - q for p, q in zip(c, d, strict=True)]) < r + s


def sphere_overlap(a, b, pi: float = np.pi):
    """The volume in common."""
    (c, r), (e, s) = a, b
    d = m.norm([p - q for p, q in zip(c, e, strict=True)])
    small = m.least(r, s)
    safe = m.where(d > 0.0, d, 1.0)
    gap = r + s - d
    lens = pi * gap * gap * (d * d + 2.0 * d * (r + s) - 3.0 * (r - s) * (r - s)) / (12.0 * safe)
    return m.where(d >= r + s, 0.0, m.where(d <= m.absolute(r - s), 4.0 / 3.0 * pi * small * small * small, lens))


def sphere_distance(sphere, p):
    c, r = sphere
    return m.greatest(m.norm([a - b for a, b in zip(p, c, strict=True)]) - r, 0.0)


def sphere_volume(r, pi: float = np.pi):
    return 4.0 / 3.0 * pi * r * r * r


def sphere_area(r, pi: float = np.pi):
    return 4.0 * pi * r * r


#: Levels of the grids that boxes of different sizes lie on, as powers of two.
LEVELS = 30
#: Grids at most; levels are rounded up to coarser ones until so many are left.
GRIDS = 12


def _fitting(cell: float) -> list[tuple[Column, Column]]:
    """Of a box, on each axis, its size and the least power of two by which ``cell`` is as wide."""
    sizes = [F.col(hi) - F.col(lo) for lo, hi in zip(LOW, HIGH, strict=True)]
    return [(s, F.ceil(F.log2(s / cell))) for s in sizes]


def _levels(cell: float, finest: list[int], step: int) -> list[Column]:
    """Of a box, on each axis, in steps from the finest level."""
    level = [F.ceil((F.least(f, F.lit(LEVELS)) - low) / step) for (_, f), low in zip(_fitting(cell), finest, strict=True)]
    return [F.coalesce(F.when(s > 0, F.greatest(n, F.lit(0))), F.lit(0)).cast("int") for (s, _), n in zip(_fitting(cell), level, strict=True)]


def _grids(left: DataFrame, right: DataFrame, cell: float) -> tuple[list[int], int, list[tuple[int, ...]]]:
    """The finest level of each axis, the step from level to level, and the levels of the grids on which a box of ``left`` and
    one of ``right`` can meet, in steps from the finest."""
    both = left.select(*LOW, *HIGH).union(right.select(*LOW, *HIGH))
    usual = both.agg(*[F.percentile_approx(F.when(s > 0, f), 0.5) for s, f in _fitting(cell)]).first()
    finest = [max(min(0, u if u is not None else 0), -LEVELS) for u in usual]
    found = [{tuple(r) for r in side.select(*_levels(cell, finest, 1)).distinct().collect()} for side in (left, right)]  # 61 levels an axis at most
    step = 0
    while True:
        step += 1
        own = [{tuple(-(-n // step) for n in t) for t in side} for side in found]
        if len(own[0]) * len(own[1]) <= 10_000:
            grids = {tuple(map(max, t, u)) for t in own[0] for u in own[1]}
            if len(grids) <= GRIDS:
                return finest, step, sorted(grids)


def overlap_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (id, lox..hiz) whose insides meet: (left_id, right_id).

    Grids with cells of ``cell`` times a power of two, a power for each axis, hold the boxes, each on the first grid whose
    cells are at least as wide as itself on every axis, so that it touches eight cells at most, however large, flat or
    long it is.  On an axis whose boxes are mostly smaller than ``cell``, cells are as small as half of them need.  Two
    boxes meet by an equi-join on the grid of the coarser level of each axis, to which both are carried up; only grids on
    which two boxes can meet count.  A pair that meets in several cells is kept only in the cell of its overlap's lower corner.
    """
    finest, step, grids = _grids(left, right, cell)
    at = _levels(cell, finest, step)

    def spread(boxes: DataFrame, side: str) -> DataFrame:
        out = boxes.select("id", *LOW, *HIGH, *[level.alias(f"o{a}") for level, a in zip(at, AXES, strict=True)])
        every = F.array(*[F.struct(F.lit(n).alias("grid"), *[F.lit(t).alias(a) for t, a in zip(g, AXES, strict=True)]) for n, g in enumerate(grids)])
        out = out.withColumn("_g", F.explode(F.filter(every, lambda g: (g["x"] >= F.col("ox")) & (g["y"] >= F.col("oy")) & (g["z"] >= F.col("oz")))))
        cells = zip("ijk", LOW, HIGH, map(width, AXES, finest), strict=True)
        for axis, lo, hi, w in cells:
            out = out.withColumn(axis, F.explode(F.sequence(F.floor(F.col(lo) / w), F.floor(F.col(hi) / w))))
        return out.select(F.col("_g.grid").alias("grid"), *"ijk", F.col("_g").alias(f"{side}_g"), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "ox", "oy", "oz", *LOW, *HIGH)])

    def width(axis: str, low: int, g: str = "_g") -> Column:
        return cell * F.pow(F.lit(2.0), F.col(f"{g}.{axis}") * step + low)

    if not grids:
        return left.crossJoin(right.select(F.col("id").alias("right_id"))).where("false").select(F.col("id").alias("left_id"), "right_id")
    pairs = multiplied(spread(left, "a")).join(spread(right, "b").drop("b_g"), ["grid", *"ijk"])
    same = [F.greatest(f"a_o{c}", f"b_o{c}") == F.col(f"a_g.{c}") for c in AXES]
    a, b = ((tuple(F.col(f"{s}_{c}") for c in LOW), tuple(F.col(f"{s}_{c}") for c in HIGH)) for s in "ab")
    corner = [F.floor(F.greatest(p, q) / width(x, low, "a_g")) == F.col(c) for p, q, c, x, low in zip(a[0], b[0], "ijk", AXES, finest, strict=True)]
    return pairs.where(boxes_intersect(a, b) & same[0] & same[1] & same[2] & corner[0] & corner[1] & corner[2]).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"))


# Space-filling curves of cells (ix, iy, iz), 21 bits an axis.


def _spread_bits(c: Column) -> Column:
    """Two zero bits after each of 21 bits."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _gather_bits(c: Column) -> Column:
    c = c.bitwiseAND(F.lit(0x1249249249249249))
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, SPAN)):
        c = c.bitwiseOR(F.shiftright(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(ix: Column, iy: Column, iz: Column) -> Column:
    x, y, z = (_spread_bits(c.cast("long")) for c in (ix, iy, iz))
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def morton_cell(code: Column) -> tuple[Column, Column, Column]:
    return tuple(_gather_bits(F.shiftright(code, i) if i else code) for i in range(3))


def nested(ix: Column, iy: Column, iz: Column) -> Column:
    return ix.cast("long") + F.shiftleft(iy.cast("long"), BITS) + F.shiftleft(iz.cast("long"), 2 * BITS)


def nested_cell(code: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(code, i * BITS).bitwiseAND(F.lit(SPAN)) for i in range(3))


def hilbert_codes(cells: np.ndarray) -> np.ndarray:
    """Hilbert codes of (n, 3) cells by Skilling's transpose (2004): consecutive codes are neighbouring cells."""
    x = [cells[:, i].astype(np.int64) for i in range(3)]
    for level in range(BITS - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(3):
            on = (x[i] >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    x[1] = x[1] ^ x[0]
    x[2] = x[2] ^ x[1]
    flip = np.zeros_like(x[2])
    for level in range(BITS - 1, 0, -1):
        flip ^= np.where(x[2] >> level & 1, (1 << level) - 1, 0)
    x = [c ^ flip for c in x]
    code = np.zeros_like(flip)
    for level in range(BITS - 1, -1, -1):
        for c in x:
            code = code << 1 | (c >> level & 1)
    return code


def hilbert_cells(codes: np.ndarray) -> np.ndarray:
    """The (n, 3) cells of Hilbert codes."""
    codes = codes.astype(np.int64)
    x = [np.zeros_like(codes) for _ in range(3)]
    for level in range(BITS):
        for i in range(3):
            x[i] |= (codes >> (3 * level + 2 - i) & 1) << level
    gray = x[2] >> 1
    x[2] = x[2] ^ x[1]
    x[1] = x[1] ^ x[0]
    x[0] = x[0] ^ gray
    for level in range(1, BITS):
        low = (1 << level) - 1
        for i in (2, 1, 0):
            on = (x[i] >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    return np.stack(x, axis=1)


@F.pandas_udf(T.LongType())
def hilbert(ix: pd.Series, iy: pd.Series, iz: pd.Series) -> pd.Series:
    return pd.Series(hilbert_codes(np.stack([ix, iy, iz], axis=1)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def hilbert_cell(code: pd.Series) -> pd.Series:
    return pd.Series(list(hilbert_cells(code.to_numpy())))


def bins(points: DataFrame) -> DataFrame:
    """``points`` (x, y, z) with cells ix, iy, iz in [0, 2^21 - 1] by the range of all points; an axis without extent
    counts as one wide.  The range is one row."""
    span = box_of_points(points)
    out = points.join(F.broadcast(span))
    for axis, lo, hi, name in zip(AXES, LOW, HIGH, ("ix", "iy", "iz"), strict=True):
        width = F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)) / float(1 << BITS)).otherwise(F.lit(1.0))
        out = out.withColumn(name, F.least(F.floor((F.col(axis) - F.col(lo)) / width), F.lit(SPAN)).cast("long"))
    return out.drop(*LOW, *HIGH)


def curve_order(points: DataFrame, curve: str = "morton") -> DataFrame:
    """``points`` (pid, x, y, z) with their code and their position along the curve (ties by pid).

    The position is a distributed sort: rows are ranged by code, counted by partition, and numbered within it.
    """
    codes = {"morton": morton, "nested": nested, "hilbert": hilbert}[curve]
    coded = bins(points).withColumn("code", codes(F.col("ix"), F.col("iy"), F.col("iz"))).drop("ix", "iy", "iz")
    return numbered(coded, "code", "pid")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their position (from 0) in an order, without bringing them into one partition."""
    sorted_rows = cut(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = sorted_rows.withColumn("_within", within).join(F.broadcast(before), "_part")
    return placed.withColumn("place", (F.coalesce("_before", F.lit(0)) + F.col("_within")).cast("long")).drop("_part", "_n", "_before", "_within")


# Octrees.


def octree(spark, low, high, depth: int, keep: Callable[[DataFrame], DataFrame], meta: tuple[str, ...] = (), children: Callable[[Column], Column] | None = None) -> DataFrame:
    """Cells (level, path, lox..hiz, meta) of an octree from one root; at each level ``keep`` marks the cells to split
    (column ``flag``), and may set the columns named in ``meta``, which children inherit; returns the flagged cells of the
    last level.

    ``path`` is the array of octants from the root, so that ordering by it visits cells depth first, and by (level, path)
    breadth first.  ``children`` gives an octant's place among its siblings in that order (its number by default).
    """
    cells = spark.createDataFrame([(0, [], *map(float, low), *map(float, high))], "level int, path array<int>, lox double, loy double, loz double, hix double, hiy double, hiz double")
    cells = keep(cells).where("flag").select("level", "path", *LOW, *HIGH, *meta)
    for level in range(depth):
        corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
        split = cells.withColumn("o", corner)
        place = F.col("o") if children is None else children(F.col("o"))
        out = [F.lit(level + 1).alias("level"), F.concat("path", F.array(place.cast("int"))).alias("path")]
        for i, (lo, hi) in enumerate(zip(LOW, HIGH, strict=True)):
            mid, upper = 0.5 * (F.col(lo) + F.col(hi)), F.shiftright("o", i).bitwiseAND(F.lit(1)) == 1
            out += [F.when(upper, mid).otherwise(F.col(lo)).alias(lo), F.when(upper, F.col(hi)).otherwise(mid).alias(hi)]
        cells = keep(split.select(*out, *meta)).where("flag").select("level", "path", *LOW, *HIGH, *meta)
        if level % 4 == 3:
            cells = cut(cells)
    return cells


def surface_cells(spark, field: Field, low, high, depth: int, safety: float = 0.0) -> DataFrame:
    """Cells that may hold the surface: |f| at the centre is at most (1 + safety) times half the diagonal."""

    def keep(cells: DataFrame) -> DataFrame:
        box = (tuple(F.col(c) for c in LOW), tuple(F.col(c) for c in HIGH))
        half = 0.5 * m.norm([h - lo for lo, h in zip(*box, strict=True)])
        return cells.withColumn("flag", F.abs(field.column(*box_centroid(box))) <= (1.0 + safety) * half)

    return octree(spark, low, high, depth, keep)


def octree_box(spark, field: Field, low, high, depth: int, safety: float = 0.0) -> DataFrame:
    """One row lox..hiz around the field's surface; the largest doubles (-max, max) for a bad box or no surface."""
    if not all(a < b for a, b in zip(low, high, strict=True)):
        low, high, depth = (0.0,) * 3, (1.0,) * 3, -1
    cells = surface_cells(spark, field, low, high, depth, safety) if depth >= 0 else None
    found = box_of_boxes(cells) if cells is not None else spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in (*LOW, *HIGH)])
    return found.select(*[F.coalesce(c, F.lit(-m.HUGE)).alias(c) for c in LOW], *[F.coalesce(c, F.lit(m.HUGE)).alias(c) for c in HIGH])
