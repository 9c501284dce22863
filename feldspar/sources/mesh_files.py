"""Mesh files (STL, PLY, OBJ, legacy VTK) as DataFrames.

``read`` lists files with Spark's ``binaryFile`` source, so any path that Spark reads will do, and parses each file in one
Arrow batch on an executor into one nested row; ``vertices`` and ``facets`` flatten it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.operators import mesh

FORMATS = {"stl": "STL", "ply": "PLY", "vtk": "VTK", "obj": "OBJ"}
_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_VTK_TYPES = {"char": "i1", "unsigned_char": "u1", "short": "i2", "unsigned_short": "u2", "int": "i4", "unsigned_int": "u4", "long": "i8", "unsigned_long": "u8", "vtktypeint64": "i8", "vtkidtype": "i8", "float": "f4", "double": "f8"}


def file_type(name: str) -> str:
    """STL, PLY, VTK, OBJ or Unsupported by the extension, which is all lower or all upper case."""
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    return FORMATS.get(ext.lower(), "Unsupported") if ext in (ext.lower(), ext.upper()) else "Unsupported"


def file_encoding(name: str, content: bytes) -> str:
    """ASCII, Binary or Unknown by the header."""
    kind, head = file_type(name), content[:256]
    if kind == "STL":
        return "ASCII" if all(w in head for w in (b"solid", b"\n", b"facet", b"normal")) else "Binary"
    if kind == "PLY":
        m = re.search(rb"format\s+(\w+)", content[:4096])
        return "Unknown" if not m else "ASCII" if m[1] == b"ascii" else "Binary"
    if kind == "VTK":
        line = (content.split(b"\n", 3) + [b"", b"", b""])[2].strip().upper()
        return {b"ASCII": "ASCII", b"BINARY": "Binary"}.get(line, "Unknown")
    return "ASCII" if kind == "OBJ" else "Unknown"


def _soup(points: np.ndarray, facets: list[list[int]], metas=None, vertex_props=None, face_props=None) -> dict:
    return {"points": np.asarray(points, float).reshape(-1, 3), "facets": facets, "metas": metas or [0] * len(facets), "vertex_props": vertex_props or {}, "face_props": face_props or {}}


def parse_stl(content: bytes) -> dict:
    """ASCII up to the first ``endsolid``; of a binary file the triangles of the lowest attribute.  Every facet has its own
    three vertices; the file's normals are ignored."""
    if file_encoding("x.stl", content) == "ASCII":
        body = re.split(rb"\bendsolid\b", content, maxsplit=1)[0].decode("utf-8", "replace")
        facets, points = [], []
        for loop in re.findall(r"outer\s+loop(.*?)endloop", body, re.S):
            own = [tuple(map(float, v)) for v in re.findall(r"vertex\s+(\S+)\s+(\S+)\s+(\S+)", loop)]
            facets.append(list(range(len(points), len(points) + len(own))))
            points += own
        return _soup(points, facets)
    n = int.from_bytes(content[80:84], "little") if len(content) >= 84 else 0
    record = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
    rows = np.frombuffer(content, record, min(n, (len(content) - 84) // record.itemsize) if n else 0, 84 if n else 0)
    if len(rows):
        rows = rows[rows["a"] == rows["a"].min()]
    return _soup(rows["v"].reshape(-1, 3), np.arange(3 * len(rows)).reshape(-1, 3).tolist(), rows["a"].tolist())


def parse_ply(content: bytes) -> dict:
    """ASCII, little and big endian; other scalar properties become named vertex and face values."""
    head_end = re.search(rb"end_header\r?\n", content)
    if not head_end:
        raise ValueError("a PLY header without its end")
    lines = content[: head_end.start()].decode("ascii", "replace").splitlines()
    fmt, elements = "ascii", []
    for line in lines:
        w = line.split()
        if w[:1] == ["format"]:
            fmt = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[2:4] if w[1] == "list" else w[1]))
    body, at, tables = content[head_end.end() :], 0, {}
    text = iter(body.split()) if fmt == "ascii" else None
    order = ">" if fmt == "binary_big_endian" else "<"

    def number(kind: str):
        nonlocal at
        if text is not None:
            v = float(next(text))
            return v if _PLY_TYPES[kind][0] == "f" else int(v)
        d = np.dtype(order + _PLY_TYPES[kind])
        at += d.itemsize
        return np.frombuffer(body, d, 1, at - d.itemsize)[0].item()

    for name, count, props in elements:
        if text is None and all(isinstance(k, str) for _, k in props):
            d = np.dtype([(n, order + _PLY_TYPES[k]) for n, k in props])
            rows = np.frombuffer(body, d, count, at)
            at += d.itemsize * count
            tables[name] = {n: rows[n].tolist() for n, _ in props}
            continue
        columns: dict[str, list] = {n: [] for n, _ in props}
        for _ in range(count):
            for n, k in props:
                columns[n].append(number(k) if isinstance(k, str) else [number(k[1]) for _ in range(number(k[0]))])
        tables[name] = columns
    v, f = tables.get("vertex", {}), tables.get("face", {})
    ids = next((f[n] for n in ("vertex_indices", "vertex_index") if n in f), [])
    scalar = lambda t, skip: {n: list(map(float, c)) for n, c in t.items() if n not in skip and not (c and isinstance(c[0], list))}
    return _soup(np.array([v.get(a, []) for a in "xyz"], float).T, ids, None, scalar(v, "xyz"), scalar(f, ("vertex_indices", "vertex_index")))


def parse_obj(content: bytes) -> dict:
    """``v`` and ``f`` records; of ``a/b/c`` the first counts, negative ids count back, facets below three corners go."""
    points, facets = [], []
    for line in content.decode("utf-8", "replace").splitlines():
        w = line.split("#", 1)[0].split()
        if w[:1] == ["v"]:
            points.append(tuple(map(float, w[1:4])))
        elif w[:1] == ["f"]:
            ids = [int(t.split("/")[0]) for t in w[1:]]
            ids = [i - 1 if i > 0 else len(points) + i for i in ids]
            if len(ids) >= 3:
                facets.append(ids)
    return _soup(points, facets)


def parse_vtk(content: bytes) -> dict:
    """Legacy polydata, ASCII and binary (big endian), with classic or OFFSETS/CONNECTIVITY polygons.  Scalars of points
    and cells keep their first component; of FIELD arrays, single-component ones of a binary file."""
    ascii_file = file_encoding("x.vtk", content) == "ASCII"
    at = 0
    for _ in range(3):
        at = content.index(b"\n", at) + 1
    points, facets = np.empty((0, 3)), []
    props = {"POINT_DATA": {}, "CELL_DATA": {}}
    where, count = None, 0

    def line() -> list[str] | None:
        nonlocal at
        while at < len(content):
            end = content.find(b"\n", at)
            end = len(content) if end < 0 else end
            words = content[at:end].decode("ascii", "replace").split()
            at = end + 1
            if words:
                return words
        return None

    def numbers(n: int, kind: str) -> np.ndarray:
        nonlocal at
        d = np.dtype(">" + _VTK_TYPES.get(kind.lower(), "f4"))
        if not ascii_file:
            values = np.frombuffer(content, d, n, at)
            at += n * d.itemsize
            return values
        values = []
        while len(values) < n:
            m = re.compile(rb"\s*(\S+)").match(content, at)
            values.append(float(m[1]))
            at = m.end()
        return np.array(values)

    while w := line():
        key = w[0].upper()
        if key == "POINTS":
            points = numbers(3 * int(w[1]), w[2]).astype(float).reshape(-1, 3)
        elif key == "POLYGONS":
            a, b, start = int(w[1]), int(w[2]), at
            following = line()
            if following and following[0].upper() == "OFFSETS":
                offsets = numbers(a, following[1]).astype(int)
                connectivity = line()
                ids = numbers(b, connectivity[1]).astype(int)
                facets = [ids[i:j].tolist() for i, j in zip(offsets, offsets[1:])]
            else:
                at, flat, i = start, None, 0
                flat = numbers(b, "int").astype(int)
                while i < len(flat):
                    facets.append(flat[i + 1 : i + 1 + flat[i]].tolist())
                    i += 1 + flat[i]
        elif key in props:
            where, count = key, int(w[1])
        elif key == "SCALARS" and where:
            parts, start = int(w[3]) if len(w) > 3 else 1, at
            if (following := line()) and following[0].upper() != "LOOKUP_TABLE":
                at = start
            props[where][w[1]] = numbers(parts * count, w[2]).astype(float).reshape(-1, parts)[:, 0].tolist()
        elif key == "FIELD":
            for _ in range(int(w[2])):
                name, parts, rows, kind = line()
                values = numbers(int(parts) * int(rows), kind) if kind.lower() != "string" else None
                if not ascii_file and where == "POINT_DATA" and int(parts) == 1 and values is not None:
                    props[where][name] = values.astype(float).tolist()
        elif key in ("NORMALS", "VECTORS") and where:
            numbers(3 * count, w[2])
    return _soup(points, facets, None, props["POINT_DATA"], props["CELL_DATA"])


PARSERS = {"STL": parse_stl, "PLY": parse_ply, "OBJ": parse_obj, "VTK": parse_vtk}


def parse(name: str, content: bytes) -> dict:
    kind = file_type(name)
    if kind == "Unsupported":
        raise ValueError(f"{name}: unsupported mesh file")
    return PARSERS[kind](content)


_SCHEMA = (
    "mesh_id string, points array<struct<x: double, y: double, z: double, props: map<string, double>>>, "
    "facets array<struct<vids: array<int>, meta: long, props: map<string, double>>>"
)


def types(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, type, encoding) of each file, by its name and its first bytes."""

    @F.arrow_udf("struct<type: string, encoding: string>")
    def kind(names: pa.Array, heads: pa.Array) -> pa.Array:
        return pa.array([{"type": file_type(n), "encoding": file_encoding(n, h)} for n, h in zip(names.to_pylist(), heads.to_pylist(), strict=True)], pa.struct([("type", pa.string()), ("encoding", pa.string())]))

    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", kind("path", F.substring("content", 1, 4096)).alias("k")).select("path", "k.type", "k.encoding")


def read(spark: SparkSession, *paths: str, malformed: str = "error") -> DataFrame:
    """One row (mesh_id, points, facets) a file; mesh_id is its path.  A file that can't be parsed is an error that names it
    or, with ``malformed="skip"``, gives no row."""
    if malformed not in ("error", "skip"):
        raise ValueError("malformed must be error or skip")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    s = parse(name, content.as_py())
                except (ValueError, IndexError, KeyError, StopIteration, TypeError, AttributeError) as e:
                    if malformed == "skip":
                        continue
                    raise ValueError(f"{name}: not a readable mesh file: {e!r}") from e
                props = lambda table, i: [(k, v[i]) for k, v in table.items() if i < len(v)]
                points = [{"x": p[0], "y": p[1], "z": p[2], "props": props(s["vertex_props"], i)} for i, p in enumerate(s["points"].tolist())]
                facets = [{"vids": f, "meta": a, "props": props(s["face_props"], i)} for i, (f, a) in enumerate(zip(s["facets"], s["metas"], strict=True))]
                values = pa.map_(pa.string(), pa.float64())
                kinds = (
                    pa.string(),
                    pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("props", values)])),
                    pa.list_(pa.struct([("vids", pa.list_(pa.int32())), ("meta", pa.int64()), ("props", values)])),
                )
                columns = [pa.array([v], k) for v, k in zip((name, points, facets), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["mesh_id", "points", "facets"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, _SCHEMA)


def vertices(files: DataFrame) -> DataFrame:
    """mesh_id, vid, x, y, z, props."""
    return files.select("mesh_id", F.posexplode("points").alias("vid", "p")).select("mesh_id", "vid", "p.x", "p.y", "p.z", "p.props")


def facets(files: DataFrame) -> DataFrame:
    """mesh_id, fid, vids, meta, props."""
    return files.select("mesh_id", F.posexplode("facets").alias("fid", "f")).select("mesh_id", "fid", "f.vids", "f.meta", "f.props")


def property_of(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a named property as column ``value``; an unknown name raises."""
    if rows.where(F.map_contains_key("props", name)).isEmpty():
        raise KeyError(name)
    return rows.withColumn("value", F.col("props")[name])


def read_soup(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and facets with repeated positions merged."""
    files = read(spark, *paths)
    return mesh.compress(vertices(files).drop("props"), facets(files).drop("props"))


def read_triangles(spark: SparkSession, *paths: str) -> DataFrame:
    """The triangles of the files with their pseudonormals, ready for ``mesh.distance``."""
    return mesh.triangles(*read_soup(spark, *paths))


def read_polygons(spark: SparkSession, *paths: str) -> DataFrame:
    """The facets of the files, whatever their corners, ready for ``mesh.polygon_distance``."""
    return mesh.polygons(*read_soup(spark, *paths))


def read_half_edges(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices with normals, faces with normals, centres and areas, and half-edges with their pairs and normals."""
    vertices_of, facets_of = read_soup(spark, *paths)
    face_rows = mesh.faces(vertices_of, facets_of)
    return mesh.vertex_normals(vertices_of, facets_of, face_rows), face_rows, mesh.edge_normals(mesh.half_edges(facets_of), face_rows)
