"""Readers of STL, OBJ and PLY files: each file is a mesh, its path the mesh_id.

Files come through Spark's binaryFile source, so any store that Spark reads will do, and are decoded in Arrow batches.
STL gives corners, to be welded; OBJ and PLY give vertices and faces as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import weld
from ..tables import cut

ENDINGS = ("stl", "obj", "ply")
FACET = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")])
#: Type names of PLY headers.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
MOST_CORNERS = 64


class MeshError(ValueError):
    pass


def parse_stl(raw: bytes) -> np.ndarray:
    """Corners (n, 3) of a binary file, if its length fits its count, or of an ASCII one."""
    if len(raw) >= 84 and len(raw) == 84 + 50 * int(np.frombuffer(raw, "<u4", 1, 80)[0]):
        p = np.frombuffer(raw, FACET, offset=84)["p"].reshape(-1, 3).astype(float)
        if not np.isfinite(p).all():
            raise MeshError("STL: a coordinate is not finite")
        return p
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        raise MeshError("STL: neither binary nor text") from None
    if "facet" not in text.lower():
        raise MeshError("STL: no facets")
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        words = line.split()
        if words and words[0].lower() == "vertex":
            try:
                out.append([float(x) for x in words[1:4]])
                if len(words) < 4:
                    raise ValueError
            except ValueError:
                raise MeshError(f"STL: line {i} is no vertex") from None
    if not out or len(out) % 3:
        raise MeshError("STL: the number of corners is no positive multiple of three")
    return np.array(out)


def fan(refs: list[int], n: int, faces: list, what: str) -> None:
    if len(refs) < 3:
        return
    if any(not 0 <= r < n for r in refs):
        raise MeshError(f"{what}: a face refers to no vertex")
    faces += [(refs[0], refs[i], refs[i + 1]) for i in range(1, len(refs) - 1)]


def parse_obj(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and fan-triangulated faces; negative references count back from the vertices so far."""
    points, faces = [], []
    for i, line in enumerate(raw.decode(errors="replace").splitlines(), 1):
        words = line.split()
        try:
            if words[:1] == ["v"]:
                x, y, z = (float(x) for x in words[1:4])
                points.append((x, y, z))
            elif words[:1] == ["f"]:
                refs = [int(w.split("/")[0]) for w in words[1:]]
                if 0 in refs:
                    raise MeshError(f"OBJ: line {i} refers to vertex 0")
                fan([r - 1 if r > 0 else len(points) + r for r in refs], len(points), faces, f"OBJ: line {i}")
        except MeshError:
            raise
        except ValueError:
            raise MeshError(f"OBJ: line {i} can't be read") from None
    if not points or not faces:
        raise MeshError("OBJ: no vertices or no faces")
    return np.array(points), np.array(faces)


def ply_header(raw: bytes) -> tuple[str, list, int]:
    """Format, elements as (name, count, properties), and where the body begins; a property is (name, type) or (name, count type, item type)."""
    end = raw.find(b"end_header")
    if not raw.startswith(b"ply") or end < 0:
        raise MeshError("PLY: no header")
    body = raw.index(b"\n", end) + 1 if b"\n" in raw[end:] else len(raw)
    kind, elements = "", []
    for line in raw[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"] and elements:
            types = [PLY_TYPES.get(t) for t in (w[2:4] if w[1] == "list" else w[1:2])]
            if None in types:
                raise MeshError(f"PLY: unknown type in '{line}'")
            elements[-1][2].append((w[-1], *types))
    if kind not in ("ascii", "binary_little_endian"):
        raise MeshError(f"PLY: unsupported format {kind}")
    return kind, elements, body


def parse_ply(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind, elements, at = ply_header(raw)
    points, faces = np.zeros((0, 3)), []
    tokens = iter(raw[at:].split()) if kind == "ascii" else None
    try:
        for name, count, props in elements:
            lists = [p for p in props if len(p) == 3]
            names = [p[0] for p in props]
            if name == "vertex":
                if lists or not {"x", "y", "z"} <= set(names):
                    raise MeshError("PLY: vertices need x, y and z and no lists")
                if tokens is not None:
                    rows = np.array([[float(next(tokens)) for _ in props] for _ in range(count)]).reshape(count, len(props))
                    points = rows[:, [names.index(a) for a in "xyz"]]
                else:
                    kinds = np.dtype([(n, "<" + t) for n, t in props])
                    if at + count * kinds.itemsize > len(raw):
                        raise MeshError("PLY: the file is cut short")
                    rows = np.frombuffer(raw, kinds, count, at)
                    points, at = np.stack([rows[a].astype(float) for a in "xyz"], axis=1), at + count * kinds.itemsize
            elif tokens is not None:
                for _ in range(count):
                    refs = []
                    for p in props:
                        if len(p) == 3:
                            refs += [int(next(tokens)) for _ in range(int(next(tokens)))]
                        else:
                            next(tokens)
                    if name == "face":
                        fan([r if r >= 0 else len(points) + r for r in refs], len(points), faces, "PLY")
            else:
                if name == "face" and len(lists) < len(props):
                    raise MeshError("PLY: binary faces can't have other properties than lists")
                for _ in range(count):
                    for j, p in enumerate(props):
                        size = np.dtype(p[1]).itemsize
                        if at + size > len(raw):
                            raise MeshError("PLY: the file is cut short")
                        if len(p) == 2:
                            at += size
                            continue
                        n = int(np.frombuffer(raw, "<" + p[1], 1, at)[0])
                        if name == "face" and n > MOST_CORNERS:
                            raise MeshError("PLY: a face has too many corners")
                        at += size
                        if at + n * np.dtype(p[2]).itemsize > len(raw):
                            raise MeshError("PLY: the file is cut short")
                        refs = np.frombuffer(raw, "<" + p[2], n, at).tolist()
                        at += n * np.dtype(p[2]).itemsize
                        if name == "face" and j == 0:
                            fan([r if r >= 0 else len(points) + r for r in refs], len(points), faces, "PLY")
    except StopIteration:
        raise MeshError("PLY: the file is cut short") from None
    except ValueError as e:
        raise e if isinstance(e, MeshError) else MeshError("PLY: a value can't be read") from None
    if not len(points) or not faces:
        raise MeshError("PLY: no vertices or no faces")
    return points, np.array(faces)


def _ending(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower()
    if end not in ENDINGS:
        raise MeshError(f"Unsupported file type: {end}")
    return end


_ROWS = "mesh_id string, what string, id long, a double, b double, c double"


def read_mesh(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """vertices and faces of the files; a file that can't be read fails the query with its path and reason."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    end = _ending(path)
                    body = raw.as_py()
                    parts = [("corner", parse_stl(body))] if end == "stl" else list(zip(("vertex", "face"), parse_obj(body) if end == "obj" else parse_ply(body), strict=True))
                except MeshError as e:
                    raise MeshError(f"{path}: {e}") from None
                for what, rows in parts:
                    x = rows.astype(float)
                    yield pa.RecordBatch.from_pydict({"mesh_id": pa.array([path] * len(x)), "what": pa.array([what] * len(x)), "id": pa.array(np.arange(len(x))), "a": pa.array(x[:, 0]), "b": pa.array(x[:, 1]), "c": pa.array(x[:, 2])})

    rows = cut(files.mapInArrow(run, _ROWS))
    points = lambda what, name: rows.where(F.col("what") == what).select("mesh_id", F.col("id").alias(name), F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    faces = rows.where("what = 'face'").select("mesh_id", F.col("id").alias("fid"), *[F.col(a).cast("long").alias(f"v{k}") for k, a in enumerate("abc")])
    v, f = weld(points("corner", "corner_idx"))
    return v.unionByName(points("vertex", "vid")), f.unionByName(faces)
