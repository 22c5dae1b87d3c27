"""Fewer faces by edge collapses of least quadric error. Vertices that stay are a subset of the old ones.

Collapses go by passes over whole meshes. Each vertex picks its cheapest collapse onto a neighbour that keeps the surface
as it is; collapses whose vertex and neighbours meet no cheaper one's go together. Most go in tiles that lie elsewhere in each pass: a tile has
all faces of its vertices, and a vertex moves if its neighbours are the tile's as well, so no two tiles touch one face. Which costs
may go is settled for the whole mesh, from counts of the pass before. The rest, and what lies too densely for tiles, goes by rounds in
which quadrics, links and turned faces are joins and sums over edges, so no mesh is ever one group, and nothing is locked but by choice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..tables import cut, forget, numbered
from . import spatial
from .mesh import AXES, bounding_box, compact, corners_of

#: Neighbours that a vertex tries in a round, one of each class of their salted hash; another round has other classes.
TRIES = 4
#: Rounds without any collapse after which no more is expected.
IDLE = 2
#: Contests a round: vertices left free by the winners contend again.
CONTESTS = 2
#: A turned face keeps at least this cosine to its old normal.
TURN = 0.2
#: Weight of the planes that hold borders.
BORDER_WEIGHT = 10.0

#: Vertices that a tile should hold, and the most that one may: those of fuller ones wait for the rounds.
TILE, MOST = 8192, 1 << 18
#: A pass takes vertices of a mesh's cheapest part of one in so many, or within four steps of the cheapest; it ends after so many contests.
PART, INNER = 4, 8
#: Parts of a step, by hash, that the counts tell apart.
SPLIT = 16

#: Upper triangle of a plane's outer product.
TERMS = [(i, j) for i in range(4) for j in range(i, 4)]
Q = [f"q{i}{j}" for i, j in TERMS]
Vec = tuple[Column, Column, Column]


def _at(prefix: str) -> Vec:
    return tuple(F.col(f"{prefix}{a}") for a in AXES)


def _plane(n: Vec, p: Vec, weight: Column) -> list[Column]:
    """Weighted terms of the plane through p with unit normal n."""
    c = [*n, -spatial.dot(n, p)]
    return [(weight * c[i] * c[j]).alias(q) for q, (i, j) in zip(Q, TERMS, strict=True)]


def _cost(p: Vec) -> Column:
    """Mean square distance of p to the planes of q00..q33 and w."""
    h = [*p, F.lit(1.0)]
    total = sum((F.col(q) * h[i] * h[j] * (1.0 if i == j else 2.0) for q, (i, j) in zip(Q, TERMS, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), total / F.greatest(F.col("w"), F.lit(1e-300)))


def _star(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, a, u, v: each face from each of its corners a, in its turning order, with their coordinates (ax.. vz)."""
    turn = lambda k: F.struct(*[F.col(f"v{(k + i) % 3}").alias(n) for i, n in enumerate("auv")], *[F.col(f"{c}{(k + i) % 3}").alias(f"{n}{c}") for i, n in enumerate("auv") for c in AXES])
    return faces.select("mesh_id", "fid", F.explode(F.array(*[turn(k) for k in range(3)])).alias("s")).select("mesh_id", "fid", "s.*")


def _neighbours(star: DataFrame) -> DataFrame:
    """mesh_id, a, b, n: both directions of each edge with the number of its faces."""
    e = star.groupBy("mesh_id", F.least("a", "u").alias("lo"), F.greatest("a", "u").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return e.select("mesh_id", "n", F.explode(F.array(way("lo", "hi"), way("hi", "lo"))).alias("e")).select("mesh_id", "e.*", "n")


def _quadrics(faces: DataFrame) -> DataFrame:
    """mesh_id, vid, x, y, z, w and the quadric of each corner: the planes of its faces by area, and planes across the borders."""
    star = _star(faces)
    n = spatial.cross(spatial.minus(_at("u"), _at("a")), spatial.minus(_at("v"), _at("a")))
    size = F.sqrt(spatial.dot(n, n))
    unit = tuple(F.when(size > 0, c / size).otherwise(0.0) for c in n)
    sized = star.select("*", size.alias("size"), *[c.alias(f"n{a}") for a, c in zip(AXES, unit, strict=True)])
    own = sized.select("mesh_id", F.col("a").alias("vid"), *[F.col(f"a{a}").alias(a) for a in AXES], (F.col("size") / 2).alias("w"), *_plane(_at("n"), _at("a"), F.col("size") / 2))
    edge = F.struct(F.array(*[F.struct(F.col(k).alias("vid"), *[F.col(f"{k}{a}").alias(a) for a in AXES]) for k in "au"]).alias("ends"), *[F.col(f"{k}{a}") for k in "aun" for a in AXES])
    rim = sized.groupBy("mesh_id", F.least("a", "u").alias("lo"), F.greatest("a", "u").alias("hi")).agg(F.count(F.lit(1)).alias("uses"), F.first(edge).alias("e")).where("uses = 1").select("mesh_id", "e.*")
    d = spatial.minus(_at("u"), _at("a"))
    across = spatial.cross(d, _at("n"))
    length = F.sqrt(spatial.dot(across, across))
    held = rim.select("mesh_id", F.explode("ends").alias("end"), *_plane(tuple(F.when(length > 0, c / length).otherwise(0.0) for c in across), _at("a"), BORDER_WEIGHT * spatial.dot(d, d)))
    held = held.select("mesh_id", "end.*", F.lit(0.0).alias("w"), *Q)
    return _summed(own.unionByName(held))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mesh_id", "vid").agg(*[F.min(a).alias(a) for a in AXES], *[F.sum(c).alias(c) for c in ("w", *Q)])


def _candidates(near: DataFrame, corners: DataFrame, state: DataFrame, salt: int, lock_border: bool) -> DataFrame:
    """mesh_id, a, b, n, step, cost, tie and b's place: of each class of neighbours the cheapest that borders and the limit allow."""
    kind = near.groupBy("mesh_id", "a").agg(F.count(F.lit(1)).alias("deg"), (F.min("n") == 1).alias("rim"), (F.max("n") > 2).alias("knot"))
    at = corners.withColumnRenamed("vid", "a").join(kind, ["mesh_id", "a"])
    to = at.select("mesh_id", F.col("a").alias("b"), *[F.col(a).alias(f"b{a}") for a in AXES], F.col("deg").alias("bdeg"), F.col("rim").alias("brim"))
    c = near.join(at.drop(*AXES), ["mesh_id", "a"]).where(~F.col("knot") & ((~F.col("rim") & (F.col("n") == 2)) | ((F.col("n") == 1) & F.lit(not lock_border))))
    c = c.join(to, ["mesh_id", "b"]).join(state.where("faces > target"), "mesh_id").withColumn("cost", _cost(_at("b"))).where(F.col("cost") <= F.col("top") * F.col("top"))
    # b keeps a face of its own, and a tetrahedron stays one
    c = c.where((F.col("bdeg") - F.col("brim").cast("int") > F.col("n")) & ((F.col("deg") != 3) | (F.col("bdeg") != 3) | F.col("rim") | F.col("brim")))
    step = F.floor(2 * F.log2(F.greatest("cost", "tiny"))).cast("int")
    tie = F.xxhash64("a", F.lit(salt))
    way = F.struct(step.alias("step"), "cost", tie.alias("tie"), "b", "n", *[f"b{a}" for a in AXES])
    return c.groupBy("mesh_id", "a", F.pmod(F.xxhash64("b", F.lit(salt)), F.lit(TRIES)).alias("class")).agg(F.min(way).alias("s")).select("mesh_id", "a", "s.*")


def _sound(cand: DataFrame, near: DataFrame, star: DataFrame) -> DataFrame:
    """Each vertex's cheapest candidate that turns no face over and joins only its edge's own faces."""
    met = cand.select("mesh_id", "a", "b", "n").join(near.select("mesh_id", "a", F.col("b").alias("x")), ["mesh_id", "a"]).where("x != b")
    both = met.join(near.select("mesh_id", F.col("a").alias("b"), F.col("b").alias("x")), ["mesh_id", "b", "x"], "left_semi")
    linked = both.groupBy("mesh_id", "a", "b", "n").agg(F.count(F.lit(1)).alias("common")).where("common = n").select("mesh_id", "a", "b")
    round_ = cand.select("mesh_id", "a", "b", *[f"b{a}" for a in AXES]).join(star, ["mesh_id", "a"]).where("u != b AND v != b")
    old, new = (spatial.cross(spatial.minus(_at("u"), _at(k)), spatial.minus(_at("v"), _at(k))) for k in "ab")
    turned = round_.where((spatial.dot(old, old) > 0) & (spatial.dot(old, new) <= TURN * F.sqrt(spatial.dot(old, old) * spatial.dot(new, new)))).select("mesh_id", "a", "b").distinct()
    good = cand.join(linked, ["mesh_id", "a", "b"]).join(turned, ["mesh_id", "a", "b"], "left_anti")
    way = F.struct("step", "tie", "cost", "b", *[f"b{a}" for a in AXES])
    return good.groupBy("mesh_id", "a").agg(F.min(way).alias("s")).select("mesh_id", "a", "s.*")


def _cheap(choice: DataFrame) -> DataFrame:
    """Choices within four steps of a mesh's cheapest, or within the steps that hold its cheapest eighth."""
    steps = choice.groupBy("mesh_id", "step").agg(F.count(F.lit(1)).alias("k"))
    own = Window.partitionBy("mesh_id")  # a mesh has some hundred steps
    up = own.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("k").over(up), F.lit(0))).withColumn("all", F.sum("k").over(own)).withColumn("low", F.min("step").over(own))
    last = steps.where((F.col("step") <= F.col("low") + 4) | (F.col("before") < F.floor(F.col("all") / 8))).groupBy("mesh_id").agg(F.max("step").alias("last"))
    return choice.join(last, "mesh_id").where("step <= last").drop("last")


def _apart(choice: DataFrame, near: DataFrame) -> DataFrame:
    """Choices of which no two share a vertex among themselves and their neighbours, the cheapest of each surrounding first."""
    key = F.struct("step", "tie", "a").alias("key")
    pick = choice.select("mesh_id", "a", key)
    claims = cut(pick.join(near.select("mesh_id", "a", F.col("b").alias("x")), ["mesh_id", "a"]).unionByName(pick.withColumn("x", F.col("a"))))
    won, free = None, claims
    for i in range(CONTESTS):
        low = free.groupBy("mesh_id", "x").agg(F.min("key").alias("low"))
        first = free.join(low, ["mesh_id", "x"]).groupBy("mesh_id", "a").agg(F.min((F.col("key") == F.col("low")).cast("int")).alias("all")).where("all = 1").select("mesh_id", "a")
        won = first if won is None else won.union(first)
        if i + 1 < CONTESTS:
            won = cut(won)
            taken = claims.join(won, ["mesh_id", "a"], "left_semi").select("mesh_id", "x").distinct()
            hit = claims.join(taken, ["mesh_id", "x"], "left_semi").select("mesh_id", "a").distinct()
            free = claims.join(hit, ["mesh_id", "a"], "left_anti")
    return choice.join(won, ["mesh_id", "a"], "left_semi")


def _limited(moves: DataFrame, state: DataFrame) -> DataFrame | None:
    """The cheapest moves up to each mesh's target (a move takes at most two faces), or None if there are no moves."""
    most = moves.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("k")).join(state, "mesh_id")
    over = most.agg(F.max(F.col("k") * 2 > F.col("faces") - F.col("target") + 1)).first()[0]
    if not over:
        return None if over is None else moves
    ranked = numbered(moves, ["step", "tie", "a"], "rank")
    return cut(ranked.join(state.select("mesh_id", "faces", "target"), "mesh_id").where("2 * rank < faces - target").select(*moves.columns))


def _applied(faces: DataFrame, corners: DataFrame, star: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces with the moved corners (without those that the moves close) and quadrics given to the vertices that stay."""
    place = [f"b{a}" for a in AXES]
    met = moves.select("mesh_id", "a", "b", *place).join(star.select("mesh_id", "fid", "a"), ["mesh_id", "a"])
    there = F.col("b").isin(F.col("v0"), F.col("v1"), F.col("v2"))
    out = faces.join(met, ["mesh_id", "fid"], "left").where(F.col("a").isNull() | ~there)
    new = {f"v{k}": F.when(F.col(f"v{k}") == F.col("a"), F.col("b")).otherwise(F.col(f"v{k}")) for k in range(3)}
    new |= {f"{c}{k}": F.when(F.col(f"v{k}") == F.col("a"), F.col(f"b{c}")).otherwise(F.col(f"{c}{k}")) for k in range(3) for c in AXES}
    given = corners.drop(*AXES).withColumnRenamed("vid", "a").join(moves.select("mesh_id", "a", F.col("b").alias("vid"), *[F.col(f"b{a}").alias(a) for a in AXES]), ["mesh_id", "a"]).drop("a")
    stay = corners.join(moves.select("mesh_id", F.col("a").alias("vid")), ["mesh_id", "vid"], "left_anti")
    return out.withColumns(new).select(*faces.columns), _summed(stay.unionByName(given))


CELL = ["tx", "ty", "tz"]
_SPOT = [f"{a}{k}" for k in range(3) for a in AXES]
#: Rows of a tile: faces (id, v0.., c0..c8), vertices (id, c0.. place, w and quadric), counts of costs (id of them at v0), ends (id faces less, c0 the
#: largest cost), moves (id to v0, v1 the step, v2 the tie, c0.. the place, c3 the cost).
FACE, VERTEX, COUNT, END, MOVE = range(5)
_REST = ["v0", "v1", "v2", *[f"c{i}" for i in range(14)]]


def _mixed(vid: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 62 bits."""
    x = vid.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for turn, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(turn))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(2)).astype(np.int64)


def _groups(start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `of` its group's places, start .. start + size: which of them it was, and the place."""
    n = size[of]
    first = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(of)), n), np.arange(len(first)) - first + np.repeat(start[of], n)


class _Tile:
    """Faces (tri, numbers of ids), places, quadrics and weights of a tile; own says which vertices are its own."""

    def __init__(self, faces: pa.Table, vertices: pa.Table, lock: bool):
        col = lambda t, c: t.column(c).to_numpy()
        self.fid, self.home, self.lock = col(faces, "fid"), faces.column("home").to_numpy(zero_copy_only=False), lock
        self.ids, tri = np.unique(np.stack([col(faces, f"v{k}") for k in range(3)], 1), return_inverse=True)
        self.tri, n = tri.reshape(-1, 3), len(self.ids)
        self.at, self.q, self.w, self.own = np.zeros((n, 3)), np.zeros((n, 10)), np.zeros(n), np.zeros(n, bool)
        for k in range(3):
            self.at[self.tri[:, k]] = np.stack([col(faces, f"{a}{k}") for a in AXES], 1)
        i = np.searchsorted(self.ids, col(vertices, "vid"))
        self.own[i], self.w[i], self.q[i] = True, col(vertices, "w"), np.stack([col(vertices, c) for c in Q], 1)
        self.top, self.tiny, self.last = (col(vertices, c)[0] for c in ("top", "tiny", "last"))

    def edges(self) -> None:
        """a, b, n: both directions of each edge, by a and b, with the number of its faces; start and deg of each a's."""
        n = len(self.ids)
        one, two = self.tri.ravel(), np.roll(self.tri, -1, 1).ravel()
        key, times = np.unique(np.minimum(one, two) * n + np.maximum(one, two), return_counts=True)
        a, b = np.concatenate([key // n, key % n]), np.concatenate([key % n, key // n])
        self.key = a * n + b
        order = np.argsort(self.key)
        self.key, self.a, self.b, self.n = self.key[order], a[order], b[order], np.concatenate([times, times])[order]
        self.deg = np.bincount(self.a, minlength=n)
        self.start = np.cumsum(self.deg) - self.deg
        self.rim, self.knot = (np.bincount(self.a, x, n) > 0 for x in (self.n == 1, self.n > 2))
        h = np.concatenate([self.at[self.b], np.ones((len(self.b), 1))], 1)
        cost = sum(self.q[self.a, t] * h[:, i] * h[:, j] * (1.0 if i == j else 2.0) for t, (i, j) in enumerate(TERMS))
        self.cost = np.maximum(0.0, cost / np.maximum(self.w[self.a], 1e-300))
        self.step = np.floor(2 * np.log2(np.maximum(self.cost, self.tiny))).astype(np.int64)
        self.may = self.own[self.a] & ~self.knot[self.a] & ((~self.rim[self.a] & (self.n == 2)) | ((self.n == 1) & (not self.lock))) & (self.cost <= self.top * self.top)

    def costs(self, salt: int) -> np.ndarray:
        """The least step of each own vertex's collapses, in parts."""
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.a[self.may], self.step[self.may])
        some = least < np.iinfo(np.int64).max
        return least[some] * SPLIT + _mixed(self.ids[some], salt) % SPLIT

    def moves(self, salt: int, last: float) -> tuple[np.ndarray, np.ndarray]:
        """Edges' numbers and ties of the collapses that go together, the cheapest first."""
        n, tie = len(self.ids), _mixed(self.ids, salt)
        free = self.own.copy()
        free[self.tri[~self.own[self.tri].all(1)]] = False
        e = np.flatnonzero(self.may & free[self.a] & (self.step * SPLIT + tie[self.a] % SPLIT <= last))
        a, b = self.a[e], self.b[e]
        # b keeps a face of its own, and a tetrahedron stays one
        e = e[(self.deg[b] - self.rim[b] > self.n[e]) & ((self.deg[a] != 3) | (self.deg[b] != 3) | self.rim[a] | self.rim[b])]
        which, x = _groups(self.start, self.deg, self.a[e])
        want = self.b[e][which] * n + self.b[x]
        both = self.key[np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)] == want
        e = e[np.bincount(which, both, len(e)) == self.n[e]]
        order = np.argsort(self.tri.ravel(), kind="stable")
        faces = np.bincount(self.tri.ravel(), minlength=n)
        which, x = _groups(np.cumsum(faces) - faces, faces, self.a[e])
        f, k = order[x] // 3, order[x] % 3
        u, v, to = self.tri[f, (k + 1) % 3], self.tri[f, (k + 2) % 3], self.b[e][which]
        stay = (u != to) & (v != to)
        which, u, v, to = which[stay], u[stay], v[stay], to[stay]
        old, new = (np.cross(self.at[u] - self.at[p], self.at[v] - self.at[p]) for p in (self.a[e][which], to))
        oo, on, nn = (old * old).sum(1), (old * new).sum(1), (new * new).sum(1)
        e = e[np.bincount(which, (oo > 0) & (on <= TURN * np.sqrt(oo * nn)), len(e)) == 0]
        e = e[np.lexsort((self.b[e], self.cost[e], self.a[e], tie[self.a[e]], self.step[e]))]
        e = e[np.sort(np.unique(self.a[e], return_index=True)[1])]
        which, x = _groups(self.start, self.deg, self.a[e])
        which, x = np.concatenate([np.arange(len(e)), which]), np.concatenate([self.a[e], self.b[x]])
        low = np.full(n, len(e))
        np.minimum.at(low, x, which)
        e = e[np.bincount(which, low[x] < which, len(e)) == 0]
        return e, tie[self.a[e]]

    def apply(self, e: np.ndarray) -> None:
        a, b, to = self.a[e], self.b[e], np.arange(len(self.ids))
        to[a] = b
        np.add.at(self.q, b, self.q[a])
        np.add.at(self.w, b, self.w[a])
        self.own[a] = False
        tri = to[self.tri]
        left = (tri[:, 0] != tri[:, 1]) & (tri[:, 1] != tri[:, 2]) & (tri[:, 2] != tri[:, 0])
        self.tri, self.fid, self.home = tri[left], self.fid[left], self.home[left]


def _in_tile(faces: pa.Table, vertices: pa.Table, salt: int, lock: bool, form: pa.Schema, mode: int) -> pa.Table:
    t, out, mesh = _Tile(faces, vertices, lock), [], faces.column("mesh_id")[0]

    def rows(kind: int, ids: np.ndarray, **more: np.ndarray) -> None:
        given = {"mesh_id": pa.repeat(mesh, len(ids)), "kind": pa.repeat(pa.scalar(kind, pa.int32()), len(ids)), "id": pa.array(ids, pa.int64())} | {c: pa.array(x) for c, x in more.items()}
        out.append(pa.table([given[f.name] if f.name in given else pa.nulls(len(ids), f.type) for f in form], schema=form))

    def places(x: np.ndarray) -> dict:
        return {f"c{i}": np.ascontiguousarray(x[:, i]) for i in range(x.shape[1])}

    t.edges()
    if mode == MOVE:
        e, tie = t.moves(salt, math.inf)
        rows(MOVE, t.ids[t.a[e]], v0=t.ids[t.b[e]], v1=t.step[e], v2=tie, **places(np.concatenate([t.at[t.b[e]], t.cost[e][:, None]], 1)))
        return pa.concat_tables(out)
    if mode == FACE:
        before, worst = len(t.fid), 0.0
        left = int((t.costs(salt) <= t.last).sum())
        for _ in range(INNER):
            e = t.moves(salt, t.last)[0][:left]
            if not len(e):
                break
            few = len(e) * 50 < left
            left, worst = left - len(e), max(worst, t.cost[e].max())
            t.apply(e)
            t.edges()
            if few:
                break
        own = np.flatnonzero(t.own)
        home = t.tri[t.home]
        rows(FACE, t.fid[t.home], v0=t.ids[home[:, 0]], v1=t.ids[home[:, 1]], v2=t.ids[home[:, 2]], **places(t.at[home].reshape(-1, 9)))
        rows(VERTEX, t.ids[own], **places(np.concatenate([t.at[own], t.w[own][:, None], t.q[own]], 1)))
        rows(END, np.array([before - len(t.fid)]), c0=np.array([worst]))
    cost, times = np.unique(t.costs(salt + 1), return_counts=True)
    rows(COUNT, times, v0=cost)
    return pa.concat_tables(out)


def _tiled(faces: DataFrame, corners: DataFrame, state: DataFrame, salt: int, lock: bool, mode: int, tile: int, most: int) -> DataFrame:
    """Rows of all tiles; with mode FACE also the faces and vertices of those that are too full. state: with last, null for meshes that rest."""
    spot = [F.col(a) for a in AXES]
    fine = corners.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*[F.abs(c) for c in spot])).alias("reach"))
    fine = cut(fine.where("reach > 0").join(state.where("last IS NOT NULL").select("mesh_id", "top", "tiny", "last"), "mesh_id"))
    used = corners.select("mesh_id", *AXES).join(F.broadcast(fine), "mesh_id").groupBy("mesh_id").agg(F.approx_count_distinct(F.struct(*[F.floor(c / F.col("reach") * 32) for c in spot])).alias("used"))
    # a surface is taken for flat: cells of twice the side hold four times the vertices
    side = F.col("reach") / 32 * F.sqrt(F.lit(float(tile)) * F.col("used") / F.col("n"))
    fine = F.broadcast(cut(fine.join(used, "mesh_id").select("mesh_id", side.alias("side"), "top", "tiny", "last")))
    moved = dict(zip(AXES, ((salt * x) % 1.0 for x in (0.618033988749895, 0.754877666246693, 0.569840290998053)), strict=True))
    cell = lambda k: F.struct(*[F.floor(F.col(f"{a}{k}") / F.col("side") + moved[a]).cast("long").alias(c) for a, c in zip(AXES, CELL, strict=True)])
    mine = corners.join(fine, "mesh_id").select("*", cell("").alias("t")).select("mesh_id", "vid", *AXES, "w", *Q, "top", "tiny", "last", "t.*")
    theirs = faces.join(fine, "mesh_id").select("mesh_id", "fid", "v0", "v1", "v2", *_SPOT, cell(0).alias("own"), F.explode(F.array_distinct(F.array(*[cell(k) for k in range(3)]))).alias("t"))
    theirs = theirs.select("mesh_id", "fid", "v0", "v1", "v2", *_SPOT, (F.col("own") == F.col("t")).alias("home"), "t.*")
    by = ["mesh_id", *CELL]
    full = cut(mine.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*by))
    over = not full.isEmpty()
    light = [x.join(F.broadcast(full), by, "left_anti") if over else x for x in (theirs, mine)]
    kind = faces.schema["mesh_id"].dataType.simpleString()
    form = f"mesh_id {kind}, kind int, id long, v0 long, v1 long, v2 long, " + ", ".join(f"c{i} double" for i in range(14))
    schema = pa.schema([("mesh_id", pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), *[(f"v{k}", pa.int64()) for k in range(3)], *[(f"c{i}", pa.float64()) for i in range(14)]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _in_tile(left, right, salt, lock, schema, mode)

    light[1] = light[1].select("mesh_id", "vid", *AXES, "w", *Q, "top", "tiny", "last", *CELL)
    out = light[0].groupBy(*by).cogroup(light[1].groupBy(*by)).applyInArrow(run, form)
    if mode == FACE:
        rest = [x.join(fine.select("mesh_id"), "mesh_id", "left_anti").drop("top", "tiny", "last") for x in (faces, corners)]
        if over:
            kept = [x.join(F.broadcast(full), by, "left_semi") for x in (theirs.where("home"), mine)]
            rest = [r.unionByName(x.select(*r.columns)) for r, x in zip(rest, kept, strict=True)]
        none = F.lit(None)
        out = out.union(rest[0].select("mesh_id", F.lit(FACE), "fid", "v0", "v1", "v2", *_SPOT, *[none] * 5)).union(rest[1].select("mesh_id", F.lit(VERTEX), "vid", *[none] * 3, *AXES, "w", *Q))
    return cut(out)


def _faces(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == FACE).select("mesh_id", F.col("id").alias("fid"), "v0", "v1", "v2", *[F.col(f"c{i}").alias(c) for i, c in enumerate(_SPOT)])


def _vertices(rows: DataFrame) -> DataFrame:
    rows = rows.sparkSession.read.schema(rows.schema).parquet(rows._cut_path)  # read anew: tiles join it with the faces
    return rows.where(F.col("kind") == VERTEX).select("mesh_id", F.col("id").alias("vid"), *[F.col(f"c{i}").alias(c) for i, c in enumerate([*AXES, "w", *Q])])


def _bounds(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state with last, the largest cost (in parts of steps) of the next pass: no more vertices than may go; null if there is none."""
    have = rows.where(F.col("kind") == COUNT).groupBy("mesh_id", F.col("v0").alias("cost")).agg(F.sum("id").alias("k"))
    own = Window.partitionBy("mesh_id")  # a mesh has some thousand parts of steps
    have = have.withColumn("upto", F.sum("k").over(own.orderBy("cost"))).withColumn("all", F.sum("k").over(own)).withColumn("low", F.min("cost").over(own))
    ok = (2 * F.col("upto") <= F.col("faces") - F.col("target")) & ((F.col("cost") <= F.col("low") + 4 * SPLIT) | (F.col("upto") <= F.col("all") / PART))
    last = have.join(state.drop("last"), "mesh_id").where(ok).groupBy("mesh_id").agg(F.max("cost").cast("double").alias("last"))
    return cut(state.drop("last").join(last, "mesh_id", "left"))


def _by_tiles(faces: DataFrame, corners: DataFrame, state: DataFrame, lock: bool, tile: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Faces, vertices and state after the passes by tiles, and the next salt. A mesh may reach its target, and never passes it by more than a face."""
    salt = 1
    rows = _tiled(faces, corners, state.withColumn("last", F.when(F.col("faces") > F.col("target"), F.lit(0.0))), salt - 1, lock, COUNT, tile, most)
    state, held = _bounds(rows, state), [faces, corners]
    forget(rows)
    while state.where("last IS NOT NULL").limit(1).count():
        rows = _tiled(faces, corners, state, salt, lock, FACE, tile, most)
        ends = rows.where(F.col("kind") == END).groupBy("mesh_id").agg(F.sum("id").alias("less"), F.sqrt(F.max("c0")).alias("worst"))
        new = cut(state.join(ends, "mesh_id", "left").withColumn("less", F.coalesce("less", F.lit(0))))
        on = new.where("last IS NOT NULL AND less * 16 >= faces - target AND faces - less - target > faces / 512").select("mesh_id")
        forget(*held, state)
        faces, corners, held = _faces(rows), _vertices(rows), [rows]
        state = cut(new.select("mesh_id", (F.col("faces") - F.col("less")).alias("faces"), "target", "top", "tiny", F.greatest("error", F.coalesce("worst", F.lit(0.0))).alias("error")))
        salt += 1
        state = _bounds(rows.join(on, "mesh_id", "left_semi"), state)
    # what is left to the targets: sets of collapses of any cost, of which the cheapest go
    state = cut(state.drop("last"))
    while state.where("faces > target").limit(1).count():
        rows = _tiled(faces, corners, state.withColumn("last", F.when(F.col("faces") > F.col("target"), F.lit(0.0))), salt, lock, MOVE, tile, most)
        found = rows.select("mesh_id", F.col("id").alias("a"), F.col("v0").alias("b"), F.col("v1").alias("step"), F.col("v2").alias("tie"), *[F.col(f"c{i}").alias(f"b{a}") for i, a in enumerate(AXES)], F.col("c3").alias("cost"))
        few = state.where("faces - target <= faces / 256").select("mesh_id")
        found = cut(found.join(few, "mesh_id", "left_semi").union(_cheap(found.join(few, "mesh_id", "left_anti")).select(*found.columns)))
        moves = _limited(found, state)
        salt += 1
        if moves is None:
            break
        faces, corners, state = _moved(faces, corners, _star(faces), state, moves)
        forget(*held, rows, found, moves)
        held = [faces, corners]
    return faces, corners, state, salt


def _moved(faces: DataFrame, corners: DataFrame, star: DataFrame, state: DataFrame, moves: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    if moves is None:
        return faces, corners, state
    next_faces, next_corners = (cut(x) for x in _applied(faces, corners, star, moves))
    worst = moves.groupBy("mesh_id").agg(F.sqrt(F.max("cost")).alias("worst"))
    left = next_faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("left"))
    next_state = cut(state.join(left, "mesh_id").join(worst, "mesh_id", "left").select("mesh_id", F.col("left").alias("faces"), "target", "top", "tiny", F.greatest("error", F.coalesce("worst", F.lit(0.0))).alias("error")))
    forget(faces, corners, state)
    return next_faces, next_corners, next_state


def decimate(v: DataFrame, f: DataFrame, ratio: float, limit: float | DataFrame = math.inf, lock_border: bool = False, tile: int = TILE, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices and faces left, numbered anew, and per mesh the largest error of a collapse (mesh_id, error).

    ratio: share of faces to keep, 1e-4 to 1; a mesh ends with that many faces (rounded down, at least one) or one less, or before if
    no collapse is left. limit: a distance that no collapse may exceed, or a table (mesh_id, limit); meshes without a row there stay.
    Each mesh has its own target, limit and order of costs.

    Collapses keep the Euler number, borders' number and closed surfaces closed. Faces that name a vertex twice, or one that is absent, null or not
    finite, go first; edges of three faces and more hold their vertices; flat faces (without area) hold nothing. Costs are told apart in
    steps of a factor of 1.4, equal steps by hash. A mesh without faces, and an empty table, leave no rows.
    """
    ratio = min(1.0, max(1e-4, ratio))
    box = bounding_box(v.select("mesh_id", *[F.col(a).cast("double").alias(a) for a in AXES])).select("mesh_id", "diagonal", *[f"center_{a}" for a in AXES])
    real = v.select("mesh_id", "vid", *[F.col(a).cast("double").alias(a) for a in AXES]).where(" AND ".join(f"abs({a}) < double('infinity')" for a in AXES)).dropDuplicates(["mesh_id", "vid"])
    whole = f.select("mesh_id", "fid", "v0", "v1", "v2").where("v0 != v1 AND v1 != v2 AND v2 != v0")
    c = corners_of(real, whole).where(" AND ".join(f"v{k} IS NOT NULL" for k in range(3))).join(box, "mesh_id")
    faces = cut(c.select("mesh_id", *[F.col(i).cast("long").alias(i) for i in ("fid", "v0", "v1", "v2")], *[(F.col(f"{a}{k}") - F.col(f"center_{a}")).alias(f"{a}{k}") for k in range(3) for a in AXES]))
    n = faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces")).join(box.select("mesh_id", "diagonal"), "mesh_id")
    n = n.join(limit.select("mesh_id", F.col("limit").cast("double").alias("top")), "mesh_id", "left") if isinstance(limit, DataFrame) else n.withColumn("top", F.lit(float(limit)))
    state = cut(n.select("mesh_id", "faces", F.greatest(F.lit(1), F.floor(F.col("faces") * ratio)).cast("long").alias("target"), F.coalesce("top", F.lit(-1.0)).alias("top"), F.greatest(F.pow(1e-7 * F.col("diagonal"), 2), F.lit(1e-300)).alias("tiny"), F.lit(0.0).alias("error")).withColumn("target", F.when(F.col("top") < 0, F.col("faces")).otherwise(F.col("target"))))
    corners = cut(_quadrics(faces))
    faces, corners, state, salt = _by_tiles(faces, corners, state, lock_border, tile, most)
    idle = 0
    while idle < IDLE and state.where("faces > target").limit(1).count():
        salt += 1
        star = _star(faces)
        near = cut(_neighbours(star))
        cand = cut(_candidates(near, corners, state, salt, lock_border))
        choice = cut(_sound(cand, near, star))
        moves = cut(_apart(_cheap(choice), near))
        made, moves = moves, _limited(moves, state)
        if moves is None:
            idle += 1
            forget(near, cand, choice, made)
            continue
        idle = 0
        faces, corners, state = _moved(faces, corners, star, state, moves)
        forget(near, cand, choice, made, moves)
    return *compact(v, faces.select("mesh_id", "fid", "v0", "v1", "v2")), state.select("mesh_id", "error")


def measure(v: DataFrame, found_v: DataFrame, found_f: DataFrame, cell: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-sided deviation of the old vertices from the new surface: totals, per face and per vertex."""
    at = cut(spatial.closest(v.withColumnRenamed("vid", "pid"), found_v, found_f, cell))
    per_face = spatial.face_maxima(at)
    return spatial.deviation(at), per_face, spatial.vertex_maxima(found_v, found_f, per_face)


def target_deviation(accuracy: float, diagonal: float) -> float:
    return (1 - accuracy / 100) * diagonal


def contour_match(max_dev: float, diagonal: float) -> float:
    return 100 * (1 - max_dev / diagonal) if diagonal > 0 else 0.0


def auto_decimate(v: DataFrame, f: DataFrame, target: float, cell: float, lock_border: bool = False, passes: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of each mesh the fewest faces whose deviation stays within the target, of at most `passes` tries; the least bad if none does.

    Every mesh has its own limit, and rests once a try within the target uses 0.7 of it. Tables are joined by mesh and try, so
    any number of meshes is decimated at once.
    """
    limits = cut(f.select("mesh_id").distinct().withColumn("limit", F.lit(max(0.5 * target, 1e-6))))
    tries, seen = [], None
    for i in range(passes):
        own = limits.select("mesh_id")
        nv, nf, _ = decimate(v.join(own, "mesh_id", "left_semi"), f.join(own, "mesh_id", "left_semi"), 1e-4, limits, lock_border)
        nv, nf = cut(nv), cut(nf)
        dev = measure(v.join(own, "mesh_id", "left_semi"), nv, nf, cell)[0].select("mesh_id", "max_dev")
        made = cut(nf.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).join(dev, "mesh_id").withColumn("try", F.lit(i)))
        tries.append((nv, nf))
        seen = made if seen is None else seen.union(made)
        more = made.where(~F.col("max_dev").between(0.7 * target, target)).join(limits, "mesh_id")
        scale = F.when(F.col("max_dev") <= target, 1.35).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.2), target / F.col("max_dev"))))
        limits = cut(more.select("mesh_id", (F.col("limit") * scale).alias("limit")))
        if not limits.limit(1).count():
            break
    good = F.col("max_dev") <= target
    rank = F.struct((~good).alias("bad"), F.when(good, F.col("n")).alias("n"), "max_dev", "try")
    best = cut(seen.groupBy("mesh_id").agg(F.min(rank).alias("b")).select("mesh_id", F.col("b.try").alias("try")))
    parts = [tuple(x.join(best.where(F.col("try") == i), "mesh_id", "left_semi") for x in t) for i, t in enumerate(tries)]
    out_v, out_f = parts[0]
    for pv, pf in parts[1:]:
        out_v, out_f = out_v.unionByName(pv), out_f.unionByName(pf)
    return out_v, out_f
