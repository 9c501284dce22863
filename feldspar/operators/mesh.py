"""Polygon meshes as flat tables: soup, topology, normals, distances.

vertices: mesh_id, vid, x, y, z.  facets: mesh_id, fid, vids array<int>, meta.  Links between half-edges, faces and
vertices are integer keys; adjacency is an equi-join.  Tables of facets, edges and vertices meet by sorting: a caller's
mesh may come out of an explode, as edges and corners do here, and Spark would take it for a small table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feldspar.functions import algebra as m
from feldspar.plans.lineage import cut, multiplied

from . import blocks
from .bvh import Bvh
from .spatial import HIGH, LOW, numbered

#: Facets of a block; larger meshes are searched in several.
BLOCK = 50_000


def corners(vertices: DataFrame, facets: DataFrame) -> DataFrame:
    """One row for each corner of each facet: mesh_id, fid, place, size, vid, x, y, z."""
    rows = facets.select("mesh_id", "fid", F.size("vids").alias("size"), F.posexplode("vids").alias("place", "vid"))
    return multiplied(rows).join(vertices.select("mesh_id", "vid", "x", "y", "z"), ["mesh_id", "vid"])


def degenerate(vertices: DataFrame, facets: DataFrame) -> DataFrame:
    """(mesh_id, degenerate): whether a facet has fewer than three corners or two equal ones."""
    c = corners(vertices, facets).groupBy("mesh_id", "fid").agg(F.count("*").alias("n"), F.count_distinct("x", "y", "z").alias("different"))
    few = multiplied(facets.select("mesh_id", "fid", (F.size("vids") < 3).alias("few"))).join(c, ["mesh_id", "fid"], "left")
    return few.groupBy("mesh_id").agg(F.bool_or(F.col("few") | F.coalesce(F.col("different") < F.col("n"), F.lit(True))).alias("degenerate"))


def compress(vertices: DataFrame, facets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices without repeated positions (exact equality), numbered in the order of x, y, z, and facets over them.  The
    numbers come from a distributed sort, so a mesh isn't confined to one task."""
    places = numbered(vertices.select("mesh_id", "x", "y", "z").distinct(), "mesh_id", "x", "y", "z")
    first = places.groupBy("mesh_id").agg(F.min("place").alias("first"))
    kept = cut(places.join(first, "mesh_id").select("mesh_id", (F.col("place") - F.col("first")).cast("int").alias("vid"), "x", "y", "z"))
    new = kept.select(F.col("mesh_id").alias("m"), F.col("vid").alias("new"), *[F.col(c).alias("new_" + c) for c in "xyz"])
    same = [F.col(c).eqNullSafe(F.col("new_" + c)) for c in "xyz"]
    moved = multiplied(vertices).join(new, [F.col("mesh_id") == F.col("m"), *same]).select("mesh_id", "vid", "new")
    corner = multiplied(facets.select("mesh_id", "fid", "meta", F.posexplode("vids").alias("place", "vid"))).join(moved, ["mesh_id", "vid"])
    again = corner.groupBy("mesh_id", "fid", "meta").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda s: s["new"]).alias("vids"))
    return kept, again.select("mesh_id", "fid", "vids", "meta")


def half_edges(facets: DataFrame) -> DataFrame:
    """mesh_id, eid, fid, place, src, dst, next_eid, pair_eid: the edges of facets with three corners or more; a pair
    runs the other way (the least eid, if several do), null on a border.  An edge's id is its facet's times the largest
    number of corners, plus its place, so that no order over a mesh is needed."""
    kept = facets.where(F.size("vids") >= 3)
    most = kept.agg(F.max(F.size("vids"))).first()[0] or 3
    rows = kept.select("mesh_id", "fid", "vids", F.posexplode("vids").alias("place", "src"))
    first, nxt = F.col("fid").cast("long") * most, (F.col("place") + 1) % F.size("vids")
    e = rows.select(
        "mesh_id", (first + F.col("place")).alias("eid"), "fid", "place", "src", F.element_at("vids", nxt + 1).alias("dst"), (first + nxt).alias("next_eid")
    )
    back = e.groupBy("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.min("eid").alias("pair_eid"))
    return multiplied(e).join(back, ["mesh_id", "src", "dst"], "left").select("mesh_id", "eid", "fid", "place", "src", "dst", "next_eid", "pair_eid")


def _cross_terms(a, b, c):
    return m.cross(tuple(q - p for p, q in zip(a, b, strict=True)), tuple(q - p for p, q in zip(a, c, strict=True)))


def faces(vertices: DataFrame, facets: DataFrame) -> DataFrame:
    """mesh_id, fid, nx, ny, nz, cx, cy, cz, area: the unit normal of the first corner triple that isn't on a line, the mean
    corner, and the area in the normal's direction."""
    point = F.struct("place", "x", "y", "z")
    c = corners(vertices, facets.where(F.size("vids") >= 3)).groupBy("mesh_id", "fid").agg(F.array_sort(F.collect_list(point)).alias("p"))

    def at(i):
        q = F.element_at("p", (i % F.size("p")) + 1)
        return tuple(q[a] for a in "xyz")

    def normal(i):
        n = _cross_terms(at(i), at(i + 1), at(i + 2))
        return F.struct(m.norm(n).alias("l"), *(v.alias(a) for v, a in zip(n, "xyz", strict=True)))

    triples = F.transform(F.sequence(F.lit(0), F.size("p") - 1), normal)
    c = c.withColumn("n", F.element_at(F.concat(F.filter(triples, lambda t: t["l"] > 0), F.array(F.struct(F.lit(1.0).alias("l"), *(F.lit(0.0).alias(a) for a in "xyz")))), 1))
    unit = [(F.col("n")[a] / F.col("n")["l"]).alias(f"n{a}") for a in "xyz"]
    c = c.select("mesh_id", "fid", "p", *unit)

    def centre(a):
        return F.aggregate("p", F.lit(0.0), lambda s, q: s + q[a]) / F.size("p")

    mean = [centre(a).alias(f"c{a}") for a in "xyz"]

    def strip(s, i):
        u, v = at(i), at(i + 1)
        return s + m.dot(tuple(F.col(f"n{a}") for a in "xyz"), m.cross(u, v))

    area = F.abs(F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), F.lit(0.0), strip)) * 0.5
    return c.select("mesh_id", "fid", "nx", "ny", "nz", *mean, area.alias("area"))


def edge_normals(edges: DataFrame, face_rows: DataFrame) -> DataFrame:
    """``half_edges`` with nx, ny, nz: the unit sum of the two faces' normals, on a border the face's own, zero where
    they cancel."""
    own = face_rows.select("mesh_id", "fid", *[F.col(f"n{a}").alias(f"o{a}") for a in "xyz"])
    with_own = multiplied(edges).join(own, ["mesh_id", "fid"])
    other = with_own.select("mesh_id", F.col("eid").alias("pair_eid"), *[F.col(f"o{a}").alias(f"p{a}") for a in "xyz"])
    both = multiplied(with_own).join(other, ["mesh_id", "pair_eid"], "left")
    total = tuple(F.col(f"o{a}") + F.coalesce(f"p{a}", F.lit(0.0)) for a in "xyz")
    n = m.norm(total)
    return both.select(*edges.columns, *[m.divided(t, n).alias(f"n{a}") for t, a in zip(total, "xyz", strict=True)])


def vertex_normals(vertices: DataFrame, facets: DataFrame, face_rows: DataFrame, weight: str = "angle") -> DataFrame:
    """``vertices`` with nx, ny, nz: the unit sum of the faces' normals, weighted by the corner's angle or all alike."""
    if weight not in ("angle", "none"):
        raise ValueError("weight must be angle or none")
    edges = facets.where(F.size("vids") >= 3).select("mesh_id", "fid", "vids", F.posexplode("vids").alias("place", "vid"))
    size = F.size("vids")
    edges = edges.withColumn("a", F.element_at("vids", (F.col("place") + 1) % size + 1)).withColumn("b", F.element_at("vids", (F.col("place") + size - 1) % size + 1))

    def named(key: str, prefix: str) -> DataFrame:
        return multiplied(vertices.select("mesh_id", F.col("vid").alias(key), *[F.col(c).alias(prefix + c) for c in "xyz"]))

    rows = edges.join(named("vid", "v"), ["mesh_id", "vid"]).join(named("a", "a"), ["mesh_id", "a"]).join(named("b", "b"), ["mesh_id", "b"])
    rows = rows.join(multiplied(face_rows.select("mesh_id", "fid", "nx", "ny", "nz")), ["mesh_id", "fid"])
    u, v = (tuple(F.col(s + c) - F.col("v" + c) for c in "xyz") for s in "ab")
    cosine = m.clamp(m.divided(m.dot(u, v), m.norm(u) * m.norm(v)), -1.0, 1.0)
    w = m.arccos(cosine) if weight == "angle" else F.lit(1.0)
    total = rows.groupBy("mesh_id", "vid").agg(*[F.sum(w * F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"])
    t = tuple(F.col(f"n{c}") for c in "xyz")
    n = m.norm(t)
    return multiplied(vertices).join(total.select("mesh_id", "vid", *[m.divided(p, n).alias(f"n{c}") for p, c in zip(t, "xyz", strict=True)]), ["mesh_id", "vid"], "left")


def sanity(vertices: DataFrame, facets: DataFrame) -> DataFrame:
    """One row of counts for each mesh: its faces, vertices and edges; defects of faces (null, without edges as they have
    fewer than three corners, degenerate as a corner is repeated), of edges (without an origin, degenerate, border as
    there is no pair, repeated, without a next corner, with an origin that is no vertex, without a face) and of
    vertices (without coordinates, unused); and whether the mesh is watertight."""
    e = half_edges(facets)
    named = vertices.select("mesh_id", F.col("vid").alias("src"), F.lit(True).alias("there"))
    counts = multiplied(e).join(named, ["mesh_id", "src"], "left").groupBy("mesh_id").agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("src").isNull()).alias("null_edges"),
        F.count_if(F.col("src") == F.col("dst")).alias("degenerate_edges"),
        F.count_if(F.col("pair_eid").isNull()).alias("border_edges"),
        F.count_if(F.col("dst").isNull()).alias("edges_without_next"),
        F.count_if(F.col("src").isNotNull() & F.col("there").isNull()).alias("edges_without_vertex"),
        F.count_if(F.col("fid").isNull()).alias("edges_without_face"),
    )
    doubled = e.groupBy("mesh_id", "src", "dst").agg(F.count("*").alias("n")).groupBy("mesh_id").agg(F.sum(F.col("n") - 1).alias("repeated_edges"))
    f = facets.groupBy("mesh_id").agg(
        F.count_if(F.size("vids") >= 3).alias("faces"),
        F.count_if(F.col("vids").isNull()).alias("null_faces"),
        F.count_if(F.size("vids") < 3).alias("small_facets"),
        F.count_if(F.size(F.array_distinct("vids")) < F.size("vids")).alias("degenerate_faces"),
    )
    used = facets.select("mesh_id", F.explode("vids").alias("vid")).distinct()
    lone = multiplied(vertices).join(used, ["mesh_id", "vid"], "left_anti").groupBy("mesh_id").agg(F.count("*").alias("unused_vertices"))
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"), F.count_if(F.isnull("x") | F.isnull("y") | F.isnull("z")).alias("bad_vertices"))
    out = f.join(v, "mesh_id", "full").join(counts, "mesh_id", "left").join(doubled, "mesh_id", "left").join(lone, "mesh_id", "left").fillna(0)
    return out.withColumn("watertight", (F.col("border_edges") == 0) & (F.col("faces") > 0))


def triangulate(facets: DataFrame) -> DataFrame:
    """``facets`` with each convex polygon cut into the fan of its first corner; ids are numbered anew, as the facet's id
    times the largest number of triangles plus the triangle's place.  Facets below three corners go."""
    kept = facets.where(F.size("vids") >= 3)
    most = (kept.agg(F.max(F.size("vids"))).first()[0] or 3) - 2
    fans = F.transform(F.sequence(F.lit(2), F.size("vids") - 1), lambda i: F.array(F.col("vids")[0], F.element_at("vids", i), F.element_at("vids", i + 1)))
    cut_up = kept.select("mesh_id", "fid", "meta", F.posexplode(fans).alias("place", "vids"))
    return cut_up.select("mesh_id", (F.col("fid") * most + F.col("place")).cast("int").alias("fid"), "vids", "meta")


def triangles(vertices: DataFrame, facets: DataFrame, weight: str = "angle") -> DataFrame:
    """mesh_id, tid, meta and, as columns, face normal nx.., corners a.. b.. c.., vertex normals va.. vb.. vc.. and edge normals
    ea.. (a to b), eb.., ec...  Facets below three corners have no area and are left out; one of more corners is an
    error, to be cut up by ``triangulate`` or kept for ``polygon_distance``."""
    message = F.lit("a facet has more than three corners: use triangulate or polygon_distance")
    three = facets.where(F.size("vids") >= 3).withColumn("vids", F.when(F.size("vids") == 3, F.col("vids")).otherwise(F.raise_error(message)))
    face_rows = faces(vertices, three)
    vn = vertex_normals(vertices, three, face_rows, weight)
    en = edge_normals(half_edges(three), face_rows)
    out = three.select("mesh_id", F.col("fid").alias("tid"), "meta", *[F.col("vids")[i].alias(f"v{i}") for i in range(3)])
    out = multiplied(out).join(face_rows.select("mesh_id", F.col("fid").alias("tid"), "nx", "ny", "nz"), ["mesh_id", "tid"])
    for i, p in enumerate("abc"):
        own = [F.col(c).alias(p + c) for c in "xyz"] + [F.col("n" + c).alias(f"v{p}{c}") for c in "xyz"]
        out = multiplied(out).join(vn.select("mesh_id", F.col("vid").alias(f"v{i}"), *own), ["mesh_id", f"v{i}"])
        edge = en.where(F.col("place") == i).select("mesh_id", F.col("fid").alias("tid"), *[F.col("n" + c).alias(f"e{p}{c}") for c in "xyz"])
        out = multiplied(out).join(edge, ["mesh_id", "tid"])
    return out.select("mesh_id", "tid", "meta", *TRIANGLE)


TRIANGLE = [s + c for s in ("n", "a", "b", "c", "va", "vb", "vc", "ea", "eb", "ec") for c in "xyz"]


def flip(df: DataFrame) -> DataFrame:
    """All normals negated."""
    return df.withColumns({c: -F.col(c) for c in df.columns if c in TRIANGLE and c[:-1] in ("n", "va", "vb", "vc", "ea", "eb", "ec")})


def triangle_parts(t: dict[str, tuple], p):
    """What a point's signed distance to a triangle is made of: whether it lies in the prism over the triangle, the
    plane's distance, and squared distances and signs of three corners (last first) and three edges."""

    def sign(v):
        return m.where(v > 0.0, 1.0, -1.0)

    def minus(a, b):
        return tuple(x - y for x, y in zip(a, b, strict=True))

    n, corner = t["n"], (t["a"], t["b"], t["c"])
    side = [minus(corner[(i + 1) % 3], corner[i]) for i in range(3)]
    rel = [minus(p, c) for c in corner]
    outward = [sign(m.dot(m.cross(side[i], n), rel[i])) for i in range(3)]
    over = m.absolute(outward[0] + outward[1] + outward[2]) > 2.0
    squares, signs = [], []
    for i, name in ((2, "vc"), (1, "vb"), (0, "va")):
        squares.append(m.dot(rel[i], rel[i]))
        signs.append(sign(m.dot(t[name], rel[i])))
    for i, name in enumerate(("ea", "eb", "ec")):
        u = m.divided(m.dot(rel[i], side[i]), m.dot(side[i], side[i]))
        foot = tuple(r - u * c for r, c in zip(rel[i], side[i], strict=True))
        squares.append(m.where((u > 0.0) & (u < 1.0), m.dot(foot, foot), m.HUGE))
        signs.append(sign(m.dot(t[name], foot)))
    return over, m.dot(n, rel[0]), squares, signs


def from_parts(over, plane, squares, signs):
    """Within the prism the plane's distance, else that of the nearest corner or edge with its normal's sign; a sign of
    zero counts as negative."""
    near = m.least(*squares)
    value = signs[-1]
    for d, s in zip(squares[-2::-1], signs[-2::-1], strict=True):
        value = m.where(d == near, s, value)
    return m.where(over, plane, m.sqrt(near) * value)


def triangle_distance(t: dict[str, tuple], p):
    """Signed distance of a point to a triangle with pseudonormals, on columns, SQL or arrays."""
    return from_parts(*triangle_parts(t, p))


def triangle_columns(prefix: str = "") -> dict[str, tuple]:
    return {s: tuple(F.col(prefix + s + c) for c in "xyz") for s in ("n", "a", "b", "c", "va", "vb", "vc", "ea", "eb", "ec")}


def scan_distance(points: DataFrame, tris: DataFrame) -> DataFrame:
    """(qid, d, tid, meta) by comparing every point with every triangle: the plain form, for small meshes and for tests."""
    pairs = points.select("qid", "x", "y", "z").crossJoin(tris.select("tid", "meta", *TRIANGLE))
    over, plane, squares, signs = triangle_parts(triangle_columns(), tuple(F.col(c) for c in "xyz"))
    # One column for each part, so that the generated methods stay small.
    parts = pairs.select("qid", "tid", "meta", over.alias("over"), plane.alias("plane"), *[q.alias(f"q{i}") for i, q in enumerate(squares)], *[s.alias(f"s{i}") for i, s in enumerate(signs)])
    d = from_parts(F.col("over"), F.col("plane"), [F.col(f"q{i}") for i in range(6)], [F.col(f"s{i}") for i in range(6)])
    best = F.min_by(F.struct("d", "tid", "meta"), F.struct(F.abs("d"), "tid")).alias("b")
    return parts.select("qid", "tid", "meta", d.alias("d")).groupBy("qid").agg(best).select("qid", "b.d", "b.tid", "b.meta")


def vertex_distance(p, corner, normal):
    """Signed by the vertex normal."""
    d = tuple(a - b for a, b in zip(p, corner, strict=True))
    return m.norm(d) * m.where(m.dot(normal, d) > 0.0, 1.0, -1.0)


def edge_distance(p, a, b, edge_normal, normal_a, normal_b):
    """To a segment: of its nearer end beyond the ends, else perpendicular, signed by the edge normal."""
    side, rel = (tuple(y - x for x, y in zip(a, q, strict=True)) for q in (b, p))
    u = m.divided(m.dot(rel, side), m.dot(side, side))
    foot = tuple(r - u * c for r, c in zip(rel, side, strict=True))
    across = m.norm(foot) * m.where(m.dot(edge_normal, foot) > 0.0, 1.0, -1.0)
    return m.where(u <= 0.0, vertex_distance(p, a, normal_a), m.where(u >= 1.0, vertex_distance(p, b, normal_b), across))


_EDGE = [s + c for s in ("a", "b", "an", "bn", "e") for c in "xyz"]


def polygons(vertices: DataFrame, facets: DataFrame) -> DataFrame:
    """mesh_id, fid, meta, nx, ny, nz, lox..hiz and edges, in order, with their ends (a.., b..), the ends' normals (an.., bn..)
    and their own (e..), for each facet of three corners or more."""
    face_rows = faces(vertices, facets)
    en = edge_normals(half_edges(facets), face_rows)
    vn = vertex_normals(vertices, facets.where(F.size("vids") >= 3), face_rows, "angle")

    def end(key: str, pre: str) -> DataFrame:
        return vn.select("mesh_id", F.col("vid").alias(key), *[F.col(c).alias(pre + c) for c in "xyz"], *[F.col("n" + c).alias(pre + "n" + c) for c in "xyz"])

    rows = en.select("mesh_id", "fid", "place", "src", "dst", *[F.col("n" + c).alias("e" + c) for c in "xyz"])
    rows = rows.join(multiplied(end("src", "a")), ["mesh_id", "src"]).join(multiplied(end("dst", "b")), ["mesh_id", "dst"])
    boxes = [F.min("a" + c).alias(n) for c, n in zip("xyz", LOW, strict=True)] + [F.max("a" + c).alias(n) for c, n in zip("xyz", HIGH, strict=True)]
    grouped = rows.groupBy("mesh_id", "fid").agg(F.array_sort(F.collect_list(F.struct("place", *_EDGE))).alias("edges"), *boxes)
    own = face_rows.select("mesh_id", "fid", "nx", "ny", "nz")
    return multiplied(grouped).join(own, ["mesh_id", "fid"]).join(multiplied(facets.select("mesh_id", "fid", "meta")), ["mesh_id", "fid"]).select("mesh_id", "fid", "meta", "nx", "ny", "nz", *LOW, *HIGH, "edges")


class _Polygons:
    """The polygons of a block: edges of all facets one after another, and where each facet's begin."""

    def __init__(self, table: pa.Table, build: str):
        self.normal = blocks.coordinates(table, ("nx", "ny", "nz"))
        edges = table.column("edges").combine_chunks()
        flat = edges.flatten() if len(edges) else None
        self.begin = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(edges).to_numpy(zero_copy_only=False)))).astype(int)
        self.edge = {s: np.stack([flat.field(s + c).to_numpy() for c in "xyz"], axis=1) if flat is not None else np.empty((0, 3)) for s in ("a", "b", "an", "bn", "e")}
        self.tree = Bvh(blocks.coordinates(table, LOW), blocks.coordinates(table, HIGH), build if len(table) else "centroid")

    def distances(self, at: np.ndarray, prims: np.ndarray) -> np.ndarray:
        """(points, facets): over a face the plane's distance, else that of the nearest edge (ties: the first)."""
        out = np.empty((len(at), len(prims)))
        sizes = self.begin[prims + 1] - self.begin[prims]
        p = tuple(at[:, None, None, i] for i in range(3))
        for size in np.unique(sizes).tolist():  # facets of as many edges go together
            own = np.flatnonzero(sizes == size)
            f = prims[own]
            places = self.begin[f][:, None] + np.arange(size)
            e = {s: tuple(v[places, i][None] for i in range(3)) for s, v in self.edge.items()}
            edge = edge_distance(p, e["a"], e["b"], e["e"], e["an"], e["bn"])
            n = self.normal[f]
            plane = np.einsum("mfi,fi->mf", at[:, None, :] - self.edge["a"][self.begin[f]][None], n)
            foot = at[:, None, :] - plane[:, :, None] * n
            drop = np.abs(n).argmax(1)
            u, v, every = np.where(drop == 0, 1, 0), np.where(drop == 2, 1, 2), np.arange(len(f))
            fu, fv = foot[:, every, u][:, :, None], foot[:, every, v][:, :, None]
            au, av, bu, bv = (self.edge[s][places, axis[:, None]][None] for s in "ab" for axis in (u, v))
            left = (bu - au) * (fv - av) - (fu - au) * (bv - av)
            up, down = (av <= fv) & (bv > fv), (av > fv) & (bv <= fv)
            over = ((up & (left > 0)) | (down & (left < 0))).sum(2) % 2 == 1
            nearest = np.take_along_axis(edge, np.abs(edge).argmin(2)[:, :, None], 2)[:, :, 0]
            out[:, own] = np.where(over, plane, nearest)
        return out


class _Triangles:
    def __init__(self, table: pa.Table, build: str):
        self.parts = {s: blocks.coordinates(table, [s + c for c in "xyz"]) for s in ("n", "a", "b", "c", "va", "vb", "vc", "ea", "eb", "ec")}
        self.tree = Bvh(blocks.coordinates(table, LOW), blocks.coordinates(table, HIGH), build if len(table) else "centroid")

    def distances(self, at: np.ndarray, prims: np.ndarray) -> np.ndarray:
        t = {s: tuple(v[prims][None, :, i] for i in range(3)) for s, v in self.parts.items()}
        return triangle_distance(t, tuple(at[:, None, i] for i in range(3)))


def _nearest(points: DataFrame, rows: DataFrame, name: str, kind, k: int, build: str, pruned: bool) -> DataFrame:
    """(qid, rank, d, mesh_id, ``name``, meta) of the ``k`` facets of least magnitude, ties by mesh and id.  An empty mesh is
    infinitely far: one row without a facet."""
    key = ("mesh_id", name)

    def index(table: pa.Table):
        return table.select([*key, "meta"]).combine_chunks(), kind(table, build)

    def look(index, qids, at):
        ids, own = index
        none = len(ids)
        best, who = np.full((len(at), k), np.inf), np.full((len(at), k), none)

        def leaf(rows, prims):
            d = np.concatenate([best[rows], own.distances(at[rows], prims)], axis=1)
            w = np.concatenate([who[rows], np.broadcast_to(prims, (len(rows), len(prims)))], axis=1)
            order = np.lexsort((w, np.abs(d)), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)

        if pruned:
            own.tree.visit(at, lambda rows: best[rows, -1] ** 2 * (1 + 1e-12), leaf)
        else:
            for a in range(0, none, 64):
                leaf(np.arange(len(at)), np.arange(a, min(a + 64, none)))
        if not none:
            return [qids, pa.array(np.ones(len(at), np.int32)), pa.array(best[:, 0]), *(pa.nulls(len(at), t) for t in (pa.string(), pa.int64(), pa.int64()))]
        row, rank = np.nonzero(who < none)
        found = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids.take(pa.array(who[row, rank])).columns]
        return [qids.take(pa.array(row)), pa.array((rank + 1).astype(np.int32)), pa.array(best[row, rank]), *(c.cast(t) for c, t in zip(found, (pa.string(), pa.int64(), pa.int64()), strict=True))]

    asked = blocks.known(points).select("qid", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    schema = f"qid {dict(asked.dtypes)['qid']}, rank int, d double, mesh_id string, {name} long, meta long"
    # What a facet needs comes from several joins, which the search would go through again and again.
    found, whole = blocks.search(asked, cut(rows), key, index, look, schema, k, block=BLOCK, pruned=pruned)
    if whole:
        return found
    w = Window.partitionBy("qid").orderBy(F.abs("d"), *key)
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def polygon_distance(points: DataFrame, polys: DataFrame, k: int = 1, build: str = "sah", pruned: bool = True) -> DataFrame:
    """(qid, rank, d, mesh_id, fid, meta): the signed distances to the ``k`` nearest facets of ``polygons``, ties by mesh and
    facet: over a face the plane's distance, else that of its nearest edge.  Facets should be flat.  Points with a null
    coordinate find nothing; an empty mesh is infinitely far.  Without ``pruned`` every facet is looked at."""
    return _nearest(points, polys, "fid", _Polygons, k, build, pruned)


def polygon_scan_distance(points: DataFrame, vertices: DataFrame, facets: DataFrame, signed: bool = True) -> DataFrame:
    """(qid, d, fid) of a mesh of polygons, by looking at every facet; the face of the least magnitude wins (ties: the least
    fid).  Without ``signed`` d is the squared distance."""
    found = polygon_distance(points, polygons(vertices, facets), pruned=False)
    return found.select("qid", (F.col("d") if signed else F.col("d") * F.col("d")).alias("d"), "fid")


def distance(points: DataFrame, tris: DataFrame, k: int = 1, build: str = "sah", pruned: bool = True) -> DataFrame:
    """(qid, rank, d, mesh_id, tid, meta): the signed distances to the ``k`` nearest triangles of ``triangles``, ties by mesh
    and tid.

    The mesh is searched in blocks, each a hierarchy.  Points with a null coordinate find nothing; an empty mesh is
    infinitely far.  Without ``pruned`` every triangle is looked at.
    """
    corner = {c: [F.col(s + c) for s in "abc"] for c in "xyz"}
    boxes = [F.least(*corner[c]).alias(n) for c, n in zip("xyz", LOW, strict=True)] + [F.greatest(*corner[c]).alias(n) for c, n in zip("xyz", HIGH, strict=True)]
    return _nearest(points, tris.select("mesh_id", "tid", "meta", *TRIANGLE, *boxes), "tid", _Triangles, k, build, pruned)


def points_in_polygons(polygons: DataFrame, points: DataFrame, algorithm: str = "crossing") -> DataFrame:
    """(poly_id, qid, inside) for points (poly_id, qid, x, y, z) of polygons (poly_id, nx, ny, nz, pts): projected along the
    normal's largest axis, then tested by winding number, crossing number or subtended angle."""
    if algorithm not in ("winding", "crossing", "angle"):
        raise ValueError("algorithm must be winding, crossing or angle")
    big = [F.abs(F.col(f"n{a}")) for a in "xyz"]
    drop = F.when((big[0] >= big[1]) & (big[0] >= big[2]), 0).when(big[1] >= big[2], 1).otherwise(2)

    def pair(get):
        return F.when(drop == 0, get("y")).otherwise(get("x")), F.when(drop == 2, get("y")).otherwise(get("z"))

    u, v = pair(lambda a: F.col(a))
    joined = points.join(polygons, "poly_id")
    flat = F.transform("pts", lambda q: F.struct(pair(lambda a: q[a])[0].alias("u"), pair(lambda a: q[a])[1].alias("v")))
    rows = joined.select("poly_id", "qid", u.alias("u"), v.alias("v"), flat.alias("q"))
    rows = rows.select("poly_id", "qid", "u", "v", F.transform("q", lambda a, i: F.struct(a.alias("a"), F.element_at("q", (i + 1) % F.size("q") + 1).alias("b"))).alias("e"))

    def left(e):
        return (e["b"]["u"] - e["a"]["u"]) * (F.col("v") - e["a"]["v"]) - (F.col("u") - e["a"]["u"]) * (e["b"]["v"] - e["a"]["v"])

    up = lambda e: (e["a"]["v"] <= F.col("v")) & (e["b"]["v"] > F.col("v"))
    down = lambda e: (e["a"]["v"] > F.col("v")) & (e["b"]["v"] <= F.col("v"))
    if algorithm == "winding":
        turn = F.aggregate("e", F.lit(0), lambda s, e: s + F.when(up(e) & (left(e) > 0), 1).when(down(e) & (left(e) < 0), -1).otherwise(0))
        inside = turn != 0
    elif algorithm == "crossing":
        hits = F.aggregate("e", F.lit(0), lambda s, e: s + F.when((up(e) & (left(e) > 0)) | (down(e) & (left(e) < 0)), 1).otherwise(0))
        inside = hits % 2 == 1
    else:

        def angle(s, e):
            ax, ay, bx, by = e["a"]["u"] - F.col("u"), e["a"]["v"] - F.col("v"), e["b"]["u"] - F.col("u"), e["b"]["v"] - F.col("v")
            return s + F.atan2(ax * by - ay * bx, ax * bx + ay * by)

        inside = F.abs(F.aggregate("e", F.lit(0.0), angle)) > math.pi
    return rows.select("poly_id", "qid", inside.alias("inside"))
