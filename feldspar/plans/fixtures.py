"""Small meshes and polygons that the mesh queries and tests share."""

from __future__ import annotations

import itertools
import struct

import numpy as np

#: An L: the unit square without its upper right quarter.
NOTCHED = ((0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0))

_TETRA = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
_TETRA_FACETS = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]


def _dodecahedron() -> tuple[list, list]:
    """Twenty corners; each of the twelve faces is the set of corners farthest along its axis, cut in three triangles."""
    g = (1 + 5**0.5) / 2
    corners = [tuple(map(float, p)) for p in itertools.product((-1, 1), repeat=3)]
    for a, b in itertools.product((-1, 1), repeat=2):
        corners += [(0.0, a * g, b / g), (a * g, b / g, 0.0), (b / g, 0.0, a * g)]
    p = np.array(corners)
    facets = []
    for a, b in itertools.product((-1, 1), repeat=2):
        for axis in ((0.0, a, b * g), (a, b * g, 0.0), (b * g, 0.0, a)):
            n = np.array(axis) / np.linalg.norm(axis)
            along = p @ n
            own = np.flatnonzero(along > along.max() - 1e-9)
            u = p[own[0]] - n * along[own[0]]
            u /= np.linalg.norm(u)
            w = np.cross(n, u)
            ring = own[np.argsort(np.arctan2(p[own] @ w, p[own] @ u))]
            facets += [(int(ring[0]), int(ring[i]), int(ring[i + 1])) for i in (1, 2, 3)]
    return corners, facets


_SOUP = [_TETRA[i] for facet in _TETRA_FACETS for i in facet], [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(4)]
MESHES: dict[str, tuple[list, list]] = {
    "tetra": (_TETRA, _TETRA_FACETS),
    "dodeca": _dodecahedron(),
    "soup": _SOUP,
    "bad": (_TETRA, [*_TETRA_FACETS, (0, 1), (1, 2, 1)]),
}


def triangle_rows(which: str) -> list[tuple]:
    """(tid, meta, face normal, corners, vertex normals, edge normals) of a closed triangle mesh, in plain NumPy."""
    vertices, facets = MESHES[which]
    p = np.array(vertices, float)

    def unit(x):
        return x / np.linalg.norm(x)

    normal = [unit(np.cross(p[b] - p[a], p[c] - p[a])) for a, b, c in facets]
    at_edge, at_vertex = {}, np.zeros((len(p), 3))
    for n, ids in zip(normal, facets, strict=True):
        for i in range(3):
            a, b, c = ids[i], ids[(i + 1) % 3], ids[(i + 2) % 3]
            at_edge[a, b] = n
            at_vertex[a] += np.arccos(np.clip(unit(p[b] - p[a]) @ unit(p[c] - p[a]), -1, 1)) * n
    rows = []
    for tid, (n, ids) in enumerate(zip(normal, facets, strict=True)):
        edges = [unit(n + at_edge[ids[(i + 1) % 3], ids[i]]) for i in range(3)]
        values = [n, *(p[i] for i in ids), *(unit(at_vertex[i]) for i in ids), *edges]
        rows.append((tid, 7 * tid + 3, *[float(x) for part in values for x in part]))
    return rows


def _pentagons() -> tuple[list, list]:
    """The dodecahedron by its twelve faces instead of their triangles."""
    corners, cut = MESHES["dodeca"]
    return corners, [(*cut[i], cut[i + 1][2], cut[i + 2][2]) for i in range(0, len(cut), 3)]


MESHES["pentagons"] = _pentagons()


def mesh_files(which: str = "dodeca") -> dict[str, bytes]:
    """One mesh as a file of each format that can hold it, by name; PLY files have a value q for each vertex and w for each
    face."""
    v, t = MESHES[which]
    rows = [tuple(map(float, p)) for p in v]
    loops = "".join("facet normal 0 0 0\nouter loop\n" + "".join("vertex {!r} {!r} {!r}\n".format(*rows[i]) for i in f) + "endloop\nendfacet\n" for f in t)
    out = {}
    if all(len(f) == 3 for f in t):
        out["ascii.stl"] = f"solid made\n{loops}endsolid made\n".encode()
        out["binary.stl"] = bytes(80) + struct.pack("<I", len(t)) + b"".join(struct.pack("<12fH", 0, 0, 0, *(c for i in f for c in rows[i]), 0) for f in t)
    out["text.obj"] = ("# made\n" + "".join("v {!r} {!r} {!r}\n".format(*p) for p in rows) + "".join("f " + " ".join(f"{i + 1}/1/1" if n % 2 else str(i - len(v)) for i in f) + "\n" for n, f in enumerate(t))).encode()
    for name, kind, order in (("ascii", "ascii", ""), ("little", "binary_little_endian", "<"), ("big", "binary_big_endian", ">")):
        head = f"ply\nformat {kind} 1.0\nelement vertex {len(v)}\nproperty double x\nproperty double y\nproperty double z\nproperty float q\nelement face {len(t)}\nproperty list uchar int vertex_indices\nproperty short w\nend_header\n"
        if order:
            body = b"".join(struct.pack(order + "3df", *p, 2 * i) for i, p in enumerate(rows)) + b"".join(struct.pack(f"{order}B{len(f)}ih", len(f), *f, 5 - i) for i, f in enumerate(t))
        else:
            body = ("".join("{!r} {!r} {!r} {}\n".format(*p, 2 * i) for i, p in enumerate(rows)) + "".join(f"{len(f)} {' '.join(map(str, f))} {5 - i}\n" for i, f in enumerate(t))).encode()
        out[f"{name}.ply"] = head.encode() + body
    flat, ids = [c for p in rows for c in p], [x for f in t for x in (len(f), *f)]
    for name in ("ascii", "binary"):
        head = f"# vtk DataFile Version 3.0\nmade\n{name.upper()}\nDATASET POLYDATA\nPOINTS {len(v)} double\n"
        numbers = (lambda x, c: " ".join(map(repr, x)).encode()) if name == "ascii" else (lambda x, c: struct.pack(f">{len(x)}{c}", *x))
        out[f"{name}.vtk"] = head.encode() + numbers(flat, "d") + f"\nPOLYGONS {len(t)} {len(ids)}\n".encode() + numbers(ids, "i") + b"\n"
    return out
