"""Queries over mesh files, which each query writes first, through Spark's file systems, into the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.operators import mesh
from feldspar.sources import mesh_files

from . import fixtures
from .registry import register


def written(spark: SparkSession, *names: str, which: str = "dodeca") -> list[str]:
    """The paths of files of ``fixtures.mesh_files``, written anew."""
    content, paths = fixtures.mesh_files(which), []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.sql.warehouse.dir')}/_mesh_files/{which}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(content[name])
        out.close()
        paths.append(path.toString())
    return paths


def _name(column: str = "mesh_id"):
    return F.element_at(F.split(column, "/"), -1)


def _places(spark: SparkSession, *names: str) -> DataFrame:
    files = mesh_files.read(spark, *written(spark, *names))
    corners = mesh.corners(mesh_files.vertices(files), mesh_files.facets(files))
    return corners.select("fid", "place", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


def _values(rows, *names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{x!r}e0" if isinstance(x, float) else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") t({', '.join(names)}))"


_V, _T = fixtures.MESHES["dodeca"]
_CORNERS = _values([(f, i, *map(float, _V[v])) for f, ids in enumerate(_T) for i, v in enumerate(ids)], "fid", "place", "x", "y", "z")
_PLACES = f"SELECT fid, place, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM {_CORNERS}"
ENCODINGS = {"ascii.stl": ("STL", "ASCII"), "binary.stl": ("STL", "Binary"), "text.obj": ("OBJ", "ASCII"), "ascii.ply": ("PLY", "ASCII"), "little.ply": ("PLY", "Binary"), "big.ply": ("PLY", "Binary"), "ascii.vtk": ("VTK", "ASCII"), "binary.vtk": ("VTK", "Binary")}
for _file in ENCODINGS:
    _encoding, _format = _file.split(".")
    register(f"read_{_format}_{_encoding}", lambda s, d, name=_file: _places(s, name), _PLACES)

register(
    "mesh_file_types",
    lambda s, d: mesh_files.types(s, *written(s, *ENCODINGS)).select(_name("path").alias("name"), "type", "encoding"),
    f"SELECT * FROM {_values([(n, *k) for n, k in ENCODINGS.items()], 'name', 'type', 'encoding')}",
)
register(
    "mesh_file_properties",
    lambda s, d: mesh_files.property_of(mesh_files.vertices(mesh_files.read(s, *written(s, "ascii.ply", "little.ply", "big.ply"))), "q").select(_name().alias("name"), "vid", "value"),
    f"SELECT name, CAST(vid AS INTEGER) AS vid, 2e0 * vid AS value FROM range({len(_V)}) r(vid), (VALUES ('ascii.ply'), ('little.ply'), ('big.ply')) n(name)",
)
register(
    "mesh_file_face_properties",
    lambda s, d: mesh_files.property_of(mesh_files.facets(mesh_files.read(s, *written(s, "ascii.ply", "big.ply"))), "w").select(_name().alias("name"), "fid", "value"),
    f"SELECT name, CAST(fid AS INTEGER) AS fid, 5e0 - fid AS value FROM range({len(_T)}) r(fid), (VALUES ('ascii.ply'), ('big.ply')) n(name)",
)
register(
    "read_soup",
    lambda s, d: mesh.sanity(*mesh_files.read_soup(s, *written(s, *ENCODINGS))).select(_name().alias("name"), "vertices", "faces", "edges", "watertight"),
    f"SELECT name, 20 AS vertices, 36 AS faces, 108 AS edges, TRUE AS watertight FROM {_values([(n,) for n in ENCODINGS], 'name')}",
)
