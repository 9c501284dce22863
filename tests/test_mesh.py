import math
import struct

import numpy as np
import pytest

from feldspar.operators import mesh
from feldspar.plans import catalog, fixtures
from feldspar.sources import mesh_files as files

V, T = fixtures.MESHES["tetra"]
DV, DT = fixtures.MESHES["dodeca"]


def stl_text(v, t):
    return "solid t\n" + "".join("facet normal 0 0 0\n outer loop\n" + "".join("  vertex {} {} {}\n".format(*map(repr, map(float, v[i]))) for i in f) + " endloop\nendfacet\n" for f in t) + "endsolid t\nfacet junk"


def stl_binary(v, t, attributes=None):
    return b"\0" * 80 + struct.pack("<I", len(t)) + b"".join(struct.pack("<12fH", 0, 0, 0, *[c for i in f for c in v[i]], (attributes or [0] * len(t))[n]) for n, f in enumerate(t))


def obj(v, t):
    n = len(v)
    lines = ["v {} {} {}".format(*map(repr, map(float, p))) for p in v] + ["vn 0 0 1", "f 1 2"]
    return "\n".join(lines + [f"f {a + 1}/1/1 {b + 1}//1 {c - n}" for a, b, c in t]) + "\n# end"


def ply(v, t, fmt):
    head = f"ply\nformat {fmt} 1.0\ncomment x\nelement vertex {len(v)}\nproperty double x\nproperty double y\nproperty double z\nproperty float q\nelement face {len(t)}\nproperty list uchar int vertex_indices\nproperty short w\nend_header\n"
    if fmt == "ascii":
        return (head + "".join("{} {} {} {}\n".format(*map(repr, map(float, p)), i) for i, p in enumerate(v)) + "".join("3 {} {} {} 7\n".format(*f) for f in t)).encode()
    o = "<" if "little" in fmt else ">"
    return head.encode() + b"".join(struct.pack(o + "3df", *p, i) for i, p in enumerate(v)) + b"".join(struct.pack(o + "B3ih", 3, *f, 7) for f in t)


def vtk(v, t, binary, offsets):
    head = f"# vtk DataFile Version 3.0\nx\n{'BINARY' if binary else 'ASCII'}\nDATASET POLYDATA\nPOINTS {len(v)} double\n".encode()

    def numbers(values, kind):
        return struct.pack(f">{len(values)}{kind}", *values) + b"\n" if binary else (" ".join(map(repr, values)) + "\n").encode()

    out = head + numbers([float(c) for p in v for c in p], "d")
    if offsets:
        out += f"POLYGONS {len(t) + 1} {3 * len(t)}\nOFFSETS vtktypeint64\n".encode() + numbers(list(range(0, 3 * len(t) + 1, 3)), "q") + b"CONNECTIVITY vtktypeint64\n" + numbers([i for f in t for i in f], "q")
    else:
        out += f"POLYGONS {len(t)} {4 * len(t)}\n".encode() + numbers([x for f in t for x in (3, *f)], "i")
    out += f"POINT_DATA {len(v)}\nSCALARS s float 2\nLOOKUP_TABLE default\n".encode() + numbers([float(x) for i in range(len(v)) for x in (i, -1)], "f")
    out += b"FIELD f 1\n" + f"g 1 {len(v)} float\n".encode() + numbers([float(i * 2) for i in range(len(v))], "f")
    return out + f"CELL_DATA {len(t)}\nSCALARS c int 1\nLOOKUP_TABLE default\n".encode() + numbers([5] * len(t), "i")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("meshes")
    content = {"a.stl": stl_text(DV, DT).encode(), "b.STL": stl_binary(DV, DT), "c.obj": obj(DV, DT).encode()}
    content |= {f"{f[7:10]}.ply": ply(DV, DT, f) for f in ("binary_little_endian", "binary_big_endian")} | {"d.ply": ply(DV, DT, "ascii")}
    content |= {f"v{b}{o}.vtk": vtk(DV, DT, b, o) for b in (0, 1) for o in (0, 1)}
    for name, data in content.items():
        (top / name).write_bytes(data)
    return top


def soup(spark, v, t, name="m"):
    return (
        spark.createDataFrame([(name, i, *map(float, p)) for i, p in enumerate(v)], "mesh_id string, vid int, x double, y double, z double"),
        spark.createDataFrame([(name, i, list(f), 10 * i) for i, f in enumerate(t)], "mesh_id string, fid int, vids array<int>, meta long"),
    )


def points(spark, p):
    return spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "qid long, x double, y double, z double")


def test_all_formats_give_one_mesh(spark, folder):
    v, f = files.read_soup(spark, str(folder / "*"))
    found = mesh.sanity(v, f).collect()
    assert len(found) == 10 and {(r.vertices, r.faces, r.edges, r.watertight, r.border_edges, r.unused_vertices) for r in found} == {(20, 36, 108, True, 0, 0)}


def test_properties(spark, folder):
    rows = files.read(spark, str(folder))
    v, f = files.vertices(rows), files.facets(rows)
    assert [r.value for r in files.property_of(v.where("mesh_id like '%/d.ply'"), "q").orderBy("vid").collect()] == list(map(float, range(20)))
    assert {r.value for r in files.property_of(f.where("mesh_id like '%.ply'"), "w").where("value is not null").collect()} == {7.0}
    assert [r.value for r in files.property_of(v.where("mesh_id like '%v11.vtk'"), "s").orderBy("vid").collect()] == list(map(float, range(20)))
    assert [r.value for r in files.property_of(v.where("mesh_id like '%v10.vtk'"), "g").orderBy("vid").collect()][3] == 6.0
    assert {r.value for r in files.property_of(f.where("mesh_id like '%v01.vtk'"), "c").collect()} == {5.0}
    with pytest.raises(KeyError):
        files.property_of(v, "unknown")


def test_types_and_encodings():
    assert [files.file_type(n) for n in ("a.stl", "a.PLY", "a.Obj", "a", "x.vtk", "y.txt")] == ["STL", "PLY", "Unsupported", "Unsupported", "VTK", "Unsupported"]
    assert files.file_encoding("a.stl", stl_text(V, T).encode()) == "ASCII" and files.file_encoding("a.stl", stl_binary(V, T)) == "Binary"
    assert files.file_encoding("a.ply", ply(V, T, "ascii")) == "ASCII" and files.file_encoding("a.vtk", vtk(V, T, 1, 0)) == "Binary" and files.file_encoding("a.txt", b"") == "Unknown"
    s = files.parse("x.stl", stl_binary(V, T, [3, 1, 1, 2]))
    assert len(s["facets"]) == 2 and s["metas"] == [1, 1]  # the lowest attribute only
    assert len(files.parse("x.obj", obj(V, T).encode())["facets"]) == 4 and len(files.parse("x.stl", b"\0" * 84)["facets"]) == 0
    with pytest.raises(ValueError):
        files.parse("x.txt", b"")


def test_soup(spark):
    v, f = soup(spark, *fixtures.MESHES["soup"])
    cv, cf = mesh.compress(v, f)
    assert sorted((r.x, r.y, r.z) for r in cv.collect()) == sorted(tuple(map(float, p)) for p in V) and cf.count() == 4 and mesh.sanity(cv, cf).first().watertight
    assert not mesh.sanity(v, f).first().watertight
    flags = [mesh.degenerate(*soup(spark, V, t)).first().degenerate for t in (T, [*T, (0, 1)], [*T, (0, 1, 1)])]
    assert flags == [False, True, True]
    assert mesh.degenerate(*soup(spark, [*V, V[0]], [(0, 4, 1)])).first().degenerate


def test_topology_and_normals(spark):
    v, f = soup(spark, V, T)
    e = {r.eid: r for r in mesh.half_edges(f).collect()}
    assert len(e) == 12 and all(e[r.pair_eid].src == r.dst and e[r.pair_eid].dst == r.src and e[r.next_eid].src == r.dst for r in e.values())
    assert {r.pair_eid for r in mesh.half_edges(soup(spark, V, T[:1])[1]).collect()} == {None}
    faces = mesh.faces(v, f)
    rows = {r.fid: r for r in faces.collect()}
    assert (rows[0].nx, rows[0].ny, rows[0].nz) == (0, 0, -1) and rows[3].nx == pytest.approx(1 / math.sqrt(3)) and rows[0].area == pytest.approx(0.5) and rows[3].cx == pytest.approx(1 / 3)
    square = mesh.faces(*soup(spark, [(0, 0, 0), (0.5, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2, 3, 4)])).first()
    assert (square.nz, square.area) == (1, pytest.approx(1.0))  # the first three corners lie on a line
    n = {r.vid: r for r in mesh.vertex_normals(v, f, faces).collect()}
    assert n[0].nx == pytest.approx(-1 / math.sqrt(3)) and mesh.vertex_normals(v, f, faces, "none").count() == 4
    border = mesh.edge_normals(mesh.half_edges(soup(spark, V, T[:1])[1]), mesh.faces(*soup(spark, V, T[:1]))).collect()
    assert {(r.nx, r.ny, r.nz) for r in border} == {(0, 0, -1)}
    with pytest.raises(ValueError):
        mesh.vertex_normals(v, f, faces, "area")


def solid_distance(p):
    """Of a convex polyhedron: by dense points on its surface, signed by its planes."""
    tri = np.array([[DV[i] for i in t] for t in DT], float)
    g = np.array([(i, j, 60 - i - j) for i in range(61) for j in range(61 - i)]) / 60
    surface = np.einsum("gk,tkc->tgc", g, tri).reshape(-1, 3)
    n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    inside = (np.einsum("ptc,tc->pt", p[:, None] - tri[:, 0], n) < 0).all(1)
    d = np.array([np.linalg.norm(surface - q, axis=1).min() for q in p])
    return np.where(inside, -d, d)


def test_distances(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.uniform(-3, 3, (120, 3))
    tris = mesh.triangles(*soup(spark, DV, DT))
    expected = solid_distance(p)
    plain = sorted(mesh.scan_distance(points(spark, p), tris).collect())
    assert np.abs(np.array([r.d for r in plain]) - expected).max() < 0.03
    for build, block in (("sah", mesh.BLOCK), ("hilbert", 7)):
        monkeypatch.setattr(mesh, "BLOCK", block)
        found = sorted(mesh.distance(points(spark, p), tris, build=build).collect())
        assert np.allclose([r.d for r in found], [r.d for r in plain]) and all(r.meta == 10 * r.tid and r.rank == 1 for r in found)
    several = mesh.distance(points(spark, p[:10]), tris, 5).collect()
    assert len(several) == 50
    flipped = sorted(mesh.distance(points(spark, p), mesh.flip(tris)).collect())
    assert np.allclose([r.d for r in flipped], [-r.d for r in plain])


def test_tetrahedron_values(spark):
    tris = mesh.triangles(*soup(spark, V, T))
    d = {r.qid: r.d for r in mesh.distance(points(spark, [(0.25, 0.25, 0.25), (2, 2, 2), (1 / 3, 1 / 3, 0), (-1, -1, -1), (0.1, 0.1, 0.1)]), tris).collect()}
    assert d[0] < 0 < d[1] and d[2] == pytest.approx(0) and d[3] == pytest.approx(math.sqrt(3)) and d[4] == pytest.approx(-0.1)
    unknown = spark.createDataFrame([(1, None, 0.0, 0.0)], "qid long, x double, y double, z double")
    assert mesh.distance(unknown, tris).collect() == []
    (far,) = mesh.distance(points(spark, [(0, 0, 0)]), tris.where("false")).collect()  # an empty mesh is infinitely far
    assert far.d == math.inf and far.tid is None


@pytest.mark.parametrize("normal", [(0.0, 0.0, 1.0), (0.6, 0.0, 0.8), (0.0, -0.9, 0.1)])
def test_polygon_algorithms_agree(spark, normal):
    n = np.array(normal) / np.linalg.norm(normal)
    u = np.cross(n, [1.0, 0.0, 0.0] if abs(n[0]) < 0.5 else [0.0, 1.0, 0.0])
    u /= np.linalg.norm(u)
    w = np.cross(n, u)
    flat = np.random.default_rng(2).uniform(-0.3, 1.3, (150, 2))
    lift = lambda q: [tuple(map(float, a * u + b * w)) for a, b in q]
    poly = spark.createDataFrame([("p", *map(float, n), lift(fixtures.NOTCHED))], "poly_id string, nx double, ny double, nz double, pts array<struct<x: double, y: double, z: double>>")
    q = spark.createDataFrame([("p", i, *c) for i, c in enumerate(lift(flat))], "poly_id string, qid long, x double, y double, z double")
    expected = [(0 < a < 1 and 0 < b < 1 and not (a > 0.5 and b > 0.5)) for a, b in flat]
    for algorithm in ("winding", "crossing", "angle"):
        assert [r.inside for r in mesh.points_in_polygons(poly, q, algorithm).orderBy("qid").collect()] == expected
    with pytest.raises(ValueError):
        mesh.points_in_polygons(poly, q, "other")


def test_polygons_as_faces(spark):
    """The dodecahedron of twelve pentagons has the distances of its triangles."""
    p = np.random.default_rng(5).uniform(-3, 3, (60, 3))
    rings = []
    for i in range(0, 36, 3):
        a, b, c = DT[i : i + 3]
        rings.append((a[0], a[1], a[2], b[2], c[2]))
    v, f = soup(spark, DV, rings)
    assert mesh.sanity(v, f).first().watertight
    found = sorted(mesh.polygon_scan_distance(points(spark, p), v, f).collect())
    plain = sorted(mesh.scan_distance(points(spark, p), mesh.triangles(*soup(spark, DV, DT))).collect())
    assert np.allclose([r.d for r in found], [r.d for r in plain])
    squared = sorted(mesh.polygon_scan_distance(points(spark, p), v, f, signed=False).collect())
    assert np.allclose([r.d for r in squared], [r.d**2 for r in plain])


CUBE = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]


def box_distance(p):
    d = np.maximum(-p, p - 1)
    return np.minimum(d.max(1), 0) + np.linalg.norm(np.maximum(d, 0), axis=1)


def test_a_cube_of_quads(spark, monkeypatch):
    p = np.random.default_rng(6).uniform(-2, 3, (150, 3))
    v, f = soup(spark, CUBE, QUADS)
    for block in (mesh.BLOCK, 2):
        monkeypatch.setattr(mesh, "BLOCK", block)
        polys = mesh.polygons(v, f)
        found = sorted(mesh.polygon_distance(points(spark, p), polys).collect())
        assert np.allclose([r.d for r in found], box_distance(p)) and all(r.meta == 10 * r.fid and r.mesh_id == "m" for r in found)
        assert found == sorted(mesh.polygon_distance(points(spark, p), polys, pruned=False).collect())
        three = mesh.polygon_distance(points(spark, p), polys, 3).orderBy("qid", "rank").collect()
        assert [r.rank for r in three] == [1, 2, 3] * 150 and [r.d for r in three[::3]] == [r.d for r in found]
        assert all(abs(a.d) <= abs(b.d) for a, b in zip(three, three[1:]) if a.qid == b.qid)
    with pytest.raises(Exception, match="more than three corners"):
        mesh.distance(points(spark, p), mesh.triangles(v, f)).collect()
    cut = mesh.triangulate(f)
    assert cut.count() == 12 and mesh.sanity(v, cut).first().watertight
    assert np.allclose([r.d for r in sorted(mesh.distance(points(spark, p), mesh.triangles(v, cut)).collect())], box_distance(p))
    (far,) = mesh.polygon_distance(points(spark, p[:1]), mesh.polygons(v, f).where("false")).collect()
    assert far.d == math.inf and far.fid is None


def test_two_meshes_with_the_same_ids(spark):
    a, b = soup(spark, CUBE, QUADS, "a"), soup(spark, [(x + 5, y, z) for x, y, z in CUBE], QUADS, "b")
    polys = mesh.polygons(a[0].union(b[0]), a[1].union(b[1]))
    found = mesh.polygon_distance(points(spark, [(-1, 0.5, 0.5), (7, 0.5, 0.5)]), polys).orderBy("qid").collect()
    assert [(r.mesh_id, r.d) for r in found] == [("a", pytest.approx(1.0)), ("b", pytest.approx(1.0))]


def test_every_defect_is_counted(spark):
    v = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(V)] + [("m", 4, None, 0.0, 0.0), ("m", 5, 9.0, 9.0, 9.0)], "mesh_id string, vid int, x double, y double, z double")
    bad = [[*f] for f in T] + [[0, 1], None, [1, 2, 1], [0, 1, 99], [0, None, 2], [0, 0, 1], [4, 1, 2]]
    f = spark.createDataFrame([("m", i, ids, 0) for i, ids in enumerate(bad)], "mesh_id string, fid int, vids array<int>, meta long")
    r = mesh.sanity(v, f).first()
    assert (r.null_faces, r.small_facets, r.degenerate_faces) == (1, 1, 2)
    assert (r.null_edges, r.edges_without_next, r.edges_without_vertex, r.edges_without_face) == (1, 1, 1, 0)
    assert (r.degenerate_edges, r.bad_vertices, r.unused_vertices, r.watertight) == (2, 1, 1, False)


def test_malformed_files(spark, tmp_path):
    (tmp_path / "good.obj").write_bytes(obj(V, T).encode())
    for name, content in (("a.ply", b"ply\nformat ascii 1.0\nelement vertex 3"), ("b.vtk", b"# vtk"), ("c.ply", b"ply\nformat ascii 1.0\nelement vertex 3\nproperty double x\nend_header\n1"), ("d.obj", b"v 1 x 2\n")):
        (tmp_path / name).write_bytes(content)
    assert files.read(spark, str(tmp_path), malformed="skip").count() == 1
    with pytest.raises(Exception, match="not a readable mesh file"):
        files.read(spark, str(tmp_path)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.type, r.encoding) for r in files.types(spark, str(tmp_path)).collect()} >= {("good.obj", "OBJ", "ASCII"), ("a.ply", "PLY", "ASCII")}


def test_exploded_meshes_are_never_broadcast(spark):
    """The city's vertices and facets come out of an explode, after which Spark takes them to be as small as ``part``."""
    vertices, facets = catalog.city(spark, "/root/testdata/sf0.001")
    three = mesh.triangulate(facets)
    for made in (mesh.polygons(vertices, facets), mesh.triangles(vertices, three), mesh.degenerate(vertices, facets), mesh.half_edges(facets)):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    plan = mesh.sanity(vertices, facets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and not any("vid" in line or "src" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
