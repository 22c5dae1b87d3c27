"""CAD text of fitted features: STEP planes and disks, DXF, a CAD host's script. Features are a few dozen rows on the driver."""

from __future__ import annotations

import math
import re

import numpy as np

from ..operators.rounds import frame


def plane_size(diagonal: float) -> float:
    return min(500.0, max(20.0, 0.4 * diagonal))


def visible(features: list[dict], which: str = "all") -> list[dict]:
    """The features to write: one kind, or all visible ones."""
    return [f for f in features if f.get("visible", True) and which in ("all", f["kind"])]


def safe_name(name: str) -> str:
    return re.sub(r"[^\w-]", "_", name)


def _real(x: float) -> str:
    s = f"{x:.9f}".rstrip("0")
    return "0." if s in ("-0.", "0.") else s


class _Step:
    def __init__(self):
        self.lines: list[str] = []

    def add(self, text: str) -> str:
        self.lines.append(f"#{len(self.lines) + 1}={text};")
        return f"#{len(self.lines)}"

    def point(self, p) -> str:
        return self.add(f"CARTESIAN_POINT('',({','.join(_real(float(x)) for x in p)}))")

    def direction(self, p) -> str:
        return self.add(f"DIRECTION('',({','.join(_real(float(x)) for x in p)}))")

    def placement(self, p, n, u) -> str:
        return self.add(f"AXIS2_PLACEMENT_3D('',{self.point(p)},{self.direction(n)},{self.direction(u)})")

    def vertex(self, p) -> str:
        return self.add(f"VERTEX_POINT('',{self.point(p)})")

    def line(self, a, b) -> str:
        d = np.asarray(b, float) - a
        v = self.add(f"VECTOR('',{self.direction(d / np.linalg.norm(d))},{_real(float(np.linalg.norm(d)))})")
        return self.add(f"LINE('',{self.point(a)},{v})")

    def face(self, edges: list[str], p, n, u) -> str:
        ring = self.add(f"EDGE_LOOP('',({','.join(self.add(f"ORIENTED_EDGE('',*,*,{e},.T.)") for e in edges)}))")
        surface = self.add(f"PLANE('',{self.placement(p, n, u)})")
        return self.add(f"ADVANCED_FACE('',({self.add(f"FACE_OUTER_BOUND('',{ring},.T.)")}),{surface},.T.)")


def step(features: list[dict], size: float, name: str = "reference") -> str:
    """An ISO 10303-21 document: planes as squares, circles as disks of two half arcs, one open shell."""
    s, faces = _Step(), []
    for f in features:
        p, n = np.asarray(f["point"], float), np.asarray(f["normal"], float)
        u, w = frame(n)
        if f["kind"] == "plane":
            half = max(size / 2, 10.0)
            corners = [p + half * (a * u + b * w) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            names = [s.vertex(c) for c in corners]
            edges = [s.add(f"EDGE_CURVE('',{names[k]},{names[(k + 1) % 4]},{s.line(corners[k], corners[(k + 1) % 4])},.T.)") for k in range(4)]
        else:
            r = max(0.1, float(f["radius"]))
            ends = [p + r * u, p - r * u]
            names = [s.vertex(c) for c in ends]
            circle = s.add(f"CIRCLE('',{s.placement(p, n, u)},{_real(r)})")
            edges = [s.add(f"EDGE_CURVE('',{names[k]},{names[1 - k]},{circle},.T.)") for k in range(2)]
        faces.append(s.face(edges, p, n, u))
    if faces:
        shell = s.add(f"OPEN_SHELL('',({','.join(faces)}))")
        s.add(f"SHELL_BASED_SURFACE_MODEL('{name.replace("'", "''")}',({shell}))")
    return _document(s, name)


def compressed(knots, tolerance: float = 1e-12) -> list[tuple[float, int]]:
    """Different knots and how often each occurs."""
    out: list[tuple[float, int]] = []
    for k in map(float, knots):
        if out and abs(k - out[-1][0]) <= tolerance:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((k, 1))
    return out


def _document(s: _Step, name: str) -> str:
    head = f"ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('{name.replace("'", "''")}','',(''),(''),'','','');\nFILE_SCHEMA(('AUTOMOTIVE_DESIGN'));\nENDSEC;\nDATA;\n"
    return head + "\n".join(s.lines) + "\nENDSEC;\nEND-ISO-10303-21;\n"


def step_freeform(net: np.ndarray, along_u: np.ndarray, along_v: np.ndarray, name: str = "freeform", degree: int = 3) -> str:
    """A document of one cubic spline face of net[row, column, axis], bounded by the four exact curves of its rim (freeform.control_net)."""
    s = _Step()
    points = [[s.point(p) for p in row] for row in net]  # lists by v; the surface wants them by u
    ku, kv = compressed(along_u), compressed(along_v)
    times = lambda k: f"({','.join(str(n) for _, n in k)})"
    places = lambda k: f"({','.join(_real(x) for x, _ in k)})"
    rows = ",".join(f"({','.join(points[j][i] for j in range(len(points)))})" for i in range(len(points[0])))
    surface = s.add(f"B_SPLINE_SURFACE_WITH_KNOTS('',{degree},{degree},({rows}),.UNSPECIFIED.,.F.,.F.,.F.,{times(ku)},{times(kv)},{places(ku)},{places(kv)},.UNSPECIFIED.)")
    low, high = points[0], points[-1]
    left, right = [r[0] for r in points], [r[-1] for r in points]
    corner = {p: s.add(f"VERTEX_POINT('',{p})") for p in (low[0], low[-1], high[0], high[-1])}

    def edge(curve: list[str], k) -> str:
        c = s.add(f"B_SPLINE_CURVE_WITH_KNOTS('',{degree},({','.join(curve)}),.UNSPECIFIED.,.F.,.F.,{times(k)},{places(k)},.UNSPECIFIED.)")
        return s.add(f"EDGE_CURVE('',{corner[curve[0]]},{corner[curve[-1]]},{c},.T.)")

    sides = [(edge(low, ku), ".T."), (edge(right, kv), ".T."), (edge(high, ku), ".F."), (edge(left, kv), ".F.")]
    ring = s.add(f"EDGE_LOOP('',({','.join(s.add(f"ORIENTED_EDGE('',*,*,{e},{way})") for e, way in sides)}))")
    face = s.add(f"ADVANCED_FACE('',({s.add(f"FACE_OUTER_BOUND('',{ring},.T.)")}),{surface},.T.)")
    s.add(f"SHELL_BASED_SURFACE_MODEL('{name.replace("'", "''")}',({s.add(f"OPEN_SHELL('',({face}))")}))")
    return _document(s, name)


def dxf(features: list[dict], size: float, segments: int = 64) -> str:
    """DXF R12 in millimetres: a plane is a face and its four lines, a circle its centre, itself and a polygon of lines."""
    out = ["0", "SECTION", "2", "HEADER", "9", "$INSUNITS", "70", "4", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]

    def put(kind: str, *points, **more) -> None:
        out.extend(["0", kind, "8", "0"])
        for k, p in enumerate(points):
            for i, x in enumerate(p):
                out.extend([str(10 * (i + 1) + k), f"{x:.6f}"])
        for code, x in more.items():
            out.extend([code.removeprefix("c"), f"{x:.6f}"])

    for f in features:
        p, n = np.asarray(f["point"], float), np.asarray(f["normal"], float)
        u, w = frame(n)
        if f["kind"] == "plane":
            corners = [p + size / 2 * (a * u + b * w) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            put("3DFACE", *corners)
            for k in range(4):
                put("LINE", corners[k], corners[(k + 1) % 4])
        else:
            r = max(0.01, float(f["radius"]))
            put("POINT", p)
            put("CIRCLE", p, c40=r, c210=n[0], c220=n[1], c230=n[2])
            ring = [p + r * (math.cos(t) * u + math.sin(t) * w) for t in np.linspace(0, 2 * math.pi, segments + 1)]
            for a, b in zip(ring, ring[1:], strict=False):
                put("LINE", a, b)
    return "\n".join([*out, "0", "ENDSEC", "0", "EOF"]) + "\n"


def host_script(features: list[dict]) -> str:
    """Python source for a CAD host, whose unit is the centimetre: a list of planes and circles. It is written, never run."""
    rows = []
    for f in features:
        row = {"kind": f["kind"], "name": str(f.get("name", f["kind"])), "point": [round(float(x) / 10, 9) for x in f["point"]], "normal": [round(float(x), 9) for x in f["normal"]]}
        rows.append(row | ({"radius": max(0.01, float(f["radius"])) / 10} if f["kind"] != "plane" else {}))
    body = ",\n".join(f"    {r!r}" for r in rows)
    return f"# lengths in centimetres\nFEATURES = [\n{body}\n]\n\n\ndef build(add_plane, add_circle):\n    for f in FEATURES:\n        if f['kind'] == 'plane':\n            add_plane(f['name'], f['point'], f['normal'])\n        else:\n            add_circle(f['name'], f['point'], f['normal'], f['radius'])\n"


def write(features: list[dict], path: str, diagonal: float, which: str = "all") -> str:
    """The text by the path's ending (STEP where it has none of the known ones)."""
    chosen, size = visible(features, which), plane_size(diagonal)
    end = path.rsplit(".", 1)[-1].lower()
    return dxf(chosen, size) if end == "dxf" else host_script(chosen) if end == "py" else step(chosen, size, safe_name(path.rsplit("/", 1)[-1]))
