"""Alpha shapes: Delaunay triangles by the empty-circle rule, and what follows from their circumradii.

The triangles of a stroke come from divide and conquer over its points by place, with signs of determinants that are exact where
rounding could change them; points of one circle are then given all their triples.  That is a procedure on one stroke's points, in
an Arrow function, and its work is that of sorting.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.state import dealt

#: Triangles of no more area are none; a circle is empty if no point is further inside than this.
LEAST_AREA, SLACK = 1e-10, 1e-10


def circle(x: np.ndarray, y: np.ndarray, a, b, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and radius of the circle through three points."""
    den = 2 * (x[a] * (y[b] - y[c]) + x[b] * (y[c] - y[a]) + x[c] * (y[a] - y[b]))
    qa, qb, qc = (x[k] * x[k] + y[k] * y[k] for k in (a, b, c))
    cx = (qa * (y[b] - y[c]) + qb * (y[c] - y[a]) + qc * (y[a] - y[b])) / den
    cy = (qa * (x[c] - x[b]) + qb * (x[a] - x[c]) + qc * (x[b] - x[a])) / den
    return cx, cy, np.sqrt((cx - x[a]) ** 2 + (cy - y[a]) ** 2)


class Edge:
    """A directed edge; ``onext`` and ``oprev`` are the next ones around its origin, against the clock and with it."""

    __slots__ = ("org", "dest", "onext", "oprev", "sym", "gone")

    def __init__(self, org: int, dest: int, sym: Edge | None = None):
        self.org, self.dest, self.onext, self.oprev, self.gone = org, dest, self, self, False
        self.sym = sym or Edge(dest, org, self)


def splice(a: Edge, b: Edge) -> None:
    a.onext.oprev, b.onext.oprev = b, a
    a.onext, b.onext = b.onext, a.onext


class Mesh:
    """Delaunay edges of distinct points sorted by x, then y."""

    def __init__(self, points: list[tuple[float, float]]):
        self.points, self.edges = points, []
        if len(points) > 1:
            self.divided(0, len(points))

    def turn(self, a: int, b: int, c: int) -> float:
        """Over 0 if a, b, c go against the clock."""
        (ax, ay), (bx, by), (cx, cy) = self.points[a], self.points[b], self.points[c]
        left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
        if abs(left - right) > 4e-16 * (abs(left) + abs(right)):
            return left - right
        ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
        return (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)

    def inside(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether d is in the circle through a, b, c, which go against the clock."""
        dx, dy = self.points[d]
        flat = [v for k in (a, b, c) for v in (self.points[k][0] - dx, self.points[k][1] - dy)]

        def parts(ax, ay, bx, by, cx, cy):
            qa, qb, qc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            return qa * (bx * cy), -qa * (by * cx), qb * (cx * ay), -qb * (cy * ax), qc * (ax * by), -qc * (ay * bx)

        found = parts(*flat)
        total = sum(found)
        if abs(total) > 3e-15 * sum(map(abs, found)):
            return total > 0
        dx, dy = Fraction(dx), Fraction(dy)
        return sum(parts(*(v for k in (a, b, c) for v in (Fraction(self.points[k][0]) - dx, Fraction(self.points[k][1]) - dy)))) > 0

    def made(self, a: int, b: int) -> Edge:
        self.edges.append(Edge(a, b))
        return self.edges[-1]

    def connected(self, a: Edge, b: Edge) -> Edge:
        e = self.made(a.dest, b.org)
        splice(e, a.sym.oprev)
        splice(e.sym, b)
        return e

    def removed(self, e: Edge) -> None:
        splice(e, e.oprev)
        splice(e.sym, e.sym.oprev)
        e.gone = e.sym.gone = True

    def divided(self, low: int, high: int) -> tuple[Edge, Edge]:
        """The hull's edges out of the first point, against the clock, and out of the last, with it."""
        if high - low == 2:
            e = self.made(low, low + 1)
            return e, e.sym
        if high - low == 3:
            a, b = self.made(low, low + 1), self.made(low + 1, low + 2)
            splice(a.sym, b)
            bend = self.turn(low, low + 1, low + 2)
            if bend > 0:
                self.connected(b, a)
            elif bend < 0:
                c = self.connected(b, a)
                return c.sym, c
            return a, b.sym
        middle = (low + high) // 2
        left_out, left_in = self.divided(low, middle)
        right_in, right_out = self.divided(middle, high)
        return self.sewn(left_out, left_in, right_in, right_out)

    def sewn(self, left_out: Edge, left_in: Edge, right_in: Edge, right_out: Edge) -> tuple[Edge, Edge]:
        while True:  # down to the common tangent below both
            if self.turn(right_in.org, left_in.org, left_in.dest) > 0:
                left_in = left_in.sym.oprev
            elif self.turn(left_in.org, right_in.dest, right_in.org) > 0:
                right_in = right_in.sym.onext
            else:
                break
        base = self.connected(right_in.sym, left_in)
        left_out = base.sym if left_in.org == left_out.org else left_out
        right_out = base if right_in.org == right_out.org else right_out
        while True:  # and up
            above = lambda e: self.turn(e.dest, base.dest, base.org) > 0  # noqa: B023, E731
            left, right = base.sym.onext, base.oprev
            if above(left):
                while self.inside(base.dest, base.org, left.dest, left.onext.dest):
                    left, old = left.onext, left
                    self.removed(old)
            if above(right):
                while self.inside(base.dest, base.org, right.dest, right.oprev.dest):
                    right, old = right.oprev, right
                    self.removed(old)
            left_fits, right_fits = above(left), above(right)
            if not left_fits and not right_fits:
                return left_out, right_out
            if not left_fits or (right_fits and self.inside(left.dest, left.org, right.org, right.dest)):
                base = self.connected(right, base.sym)
            else:
                base = self.connected(base.sym, left.sym)

    def triangles(self) -> list[tuple[int, int, int]]:
        found = []
        for one in self.edges:
            for e in () if one.gone else (one, one.sym):
                after = e.sym.oprev
                if e.org < e.dest and e.org < after.dest and after.sym.oprev.dest == e.org and self.turn(e.org, e.dest, after.dest) > 0:
                    found.append((e.org, e.dest, after.dest))
        return found


def of_one_circle(x: np.ndarray, y: np.ndarray, found: list[tuple[int, int, int]]) -> list[list[int]]:
    """Points of triangles side by side whose circles are the same but for rounding, where these are more than three."""
    a, b, c = np.array(found, np.int64).reshape(-1, 3).T
    with np.errstate(all="ignore"):
        cx, cy, r = circle(x, y, a, b, c)
    far: dict[tuple[int, int], tuple[int, int]] = {}
    above = list(range(len(found)))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    for k, corners in enumerate(found):
        for n in range(3):
            u, v, w = corners[n], corners[n - 2], corners[n - 1]
            if (v, u) in far:
                other, there = far[v, u]
                if abs(np.hypot(x[there] - cx[k], y[there] - cy[k]) - r[k]) <= 1e-6 * (1 + r[k]):
                    above[top(k)] = top(other)
            far[u, v] = (k, w)
    groups: dict[int, set[int]] = {}
    for k, corners in enumerate(found):
        groups.setdefault(top(k), set()).update(corners)
    return [sorted(g) for g in groups.values() if len(g) > 3]


def empty_triangles(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """All triples, in rising order, of some area whose circle holds no other point; of points on one circle every triple, of
    points at one place each."""
    places, group = np.unique(np.stack([x, y], axis=1), axis=0, return_inverse=True)
    px, py = places[:, 0].copy(), places[:, 1].copy()
    sure = Mesh(list(zip(px.tolist(), py.tolist()))).triangles()
    kept = {tuple(sorted(t)) for t in sure}
    more = {t for points in of_one_circle(px, py, sure) for t in itertools.combinations(points, 3)} - kept
    tried = np.array(sorted(kept) + sorted(more), np.int64).reshape(-1, 3)
    a, b, c = tried.T
    area = np.abs((px[b] - px[a]) * (py[c] - py[a]) - (px[c] - px[a]) * (py[b] - py[a])) / 2
    with np.errstate(all="ignore"):
        cx, cy, r = circle(px, py, a, b, c)
    good = area > LEAST_AREA
    # large circles are held against all points too, as rounding of the radius decides there
    for k in np.flatnonzero(good & ((np.arange(len(tried)) >= len(kept)) | (r > 10 * (1 + np.ptp(px) + np.ptp(py))))).tolist() if len(tried) else ():
        away = np.sqrt((px - cx[k]) ** 2 + (py - cy[k]) ** 2)
        away[tried[k]] = np.inf
        good[k] = not (away < r[k] - SLACK).any()
    chosen = tried[good]
    if len(places) == len(x):
        back = np.argsort(group.ravel())
        return sorted(map(tuple, np.sort(back[chosen], axis=1).tolist()))
    members: list[list[int]] = [[] for _ in places]
    for k, at in enumerate(group.ravel().tolist()):
        members[at].append(k)
    return sorted(tuple(sorted(t)) for one in chosen.tolist() for t in itertools.product(*(members[k] for k in one)))


def triangles(points: DataFrame) -> DataFrame:
    """``stroke_id, a, b, c, cx, cy, r, area`` and the corners' coordinates ``xa .. yc``: triples whose circle holds no other
    point."""
    kind = dict(points.dtypes)["stroke_id"]
    corners = [f"{axis}{corner}" for axis in "xy" for corner in "abc"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        place, x, y = (rows.column(c).to_numpy() for c in ("i", "x", "y"))
        found = np.array(empty_triangles(x, y), np.int64).reshape(-1, 3)
        a, b, c = found.T
        cx, cy, r = circle(x, y, a, b, c)
        area = np.abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2
        ids = rows.column("stroke_id").combine_chunks().take(pa.array(np.zeros(len(found), np.int64)))
        own = {"stroke_id": ids} | {n: pa.array(place[k], pa.int32()) for n, k in (("a", a), ("b", b), ("c", c))} | {"cx": cx, "cy": cy, "r": r, "area": area}
        return pa.table(own | {f"{axis}{n}": values[k] for axis, values in (("x", x), ("y", y)) for n, k in (("a", a), ("b", b), ("c", c))})

    numbers = ", ".join(f"{c} double" for c in ("cx", "cy", "r", "area", *corners))
    own = points.select("stroke_id", F.col("i").cast("int").alias("i"), "x", "y")
    return dealt(own, "stroke_id").groupBy("stroke_id").applyInArrow(run, f"stroke_id {kind}, a int, b int, c int, {numbers}")


def edges(found: DataFrame) -> DataFrame:
    """Each edge's alpha: over its triangles the least of half its length and the triangle's radius."""
    sides = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.expr(f"sqrt((x{u}-x{v})*(x{u}-x{v}) + (y{u}-y{v})*(y{u}-y{v}))").alias("length")) for u, v in (("a", "b"), ("b", "c"), ("a", "c"))))
    long = found.select("stroke_id", "r", F.explode(sides).alias("e")).select("stroke_id", "r", "e.*")
    return long.groupBy("stroke_id", "u", "v").agg(F.min(F.least("r", F.col("length") / 2)).alias("alpha"), F.count("*").alias("n"), F.first("length").alias("length"))


def shape(found: DataFrame, alpha: float) -> DataFrame:
    """Triangles, area, boundary edges and their length of the shape at ``alpha``."""
    kept = found.where(F.col("r") <= alpha)
    border = edges(kept).where("n = 1").groupBy("stroke_id").agg(F.count("*").alias("n_border"), F.sum("length").alias("perimeter"))
    inner = kept.groupBy("stroke_id").agg(F.count("*").alias("n_triangles"), F.sum("area").alias("area"))
    return inner.join(border, "stroke_id", "left")


def critical_alpha(found: DataFrame) -> DataFrame:
    """The upper median of the distinct values at which triangles (radius) and edges come in."""
    values = found.select("stroke_id", F.col("r").alias("alpha")).unionByName(edges(found).select("stroke_id", "alpha"))
    lists = values.groupBy("stroke_id").agg(F.array_sort(F.collect_set("alpha")).alias("alphas"))
    return lists.select("stroke_id", F.get("alphas", F.floor(F.size("alphas") / 2).cast("int")).alias("alpha"))


def holes(border: list[tuple[int, int]], n: int) -> list[list[int]]:
    """Connected pieces of border edges with three points or more and no more than a third of all, in the order of a walk that
    goes on from the neighbour met last."""
    near: dict[int, list[int]] = {}
    for a, b in border:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, seen = [], set()
    for start in near:
        walk, ahead = [], [start]
        while ahead:
            at = ahead.pop()
            if at not in seen:
                seen.add(at)
                walk.append(at)
                ahead += [k for k in near[at] if k not in seen]
        if 3 <= len(walk) <= n / 3:
            out.append(walk)
    return out


def alpha_features(x: np.ndarray, y: np.ndarray, alpha: float) -> list[float]:
    """Area, border length, points, border edges, triangles, area by border length squared, holes, their area, its share, alpha."""
    n = len(x)
    found = np.array(empty_triangles(x, y), np.int64).reshape(-1, 3)
    kept = found[circle(x, y, *found.T)[2] <= alpha]
    count: dict[tuple[int, int], int] = {}
    for a, b, c in kept.tolist():
        for edge in ((a, b), (b, c), (a, c)):
            count[edge] = count.get(edge, 0) + 1
    border = [edge for edge, k in count.items() if k == 1]
    a, b, c = kept.T
    area = float((np.abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2).sum())
    around = sum(float(np.hypot(x[u] - x[v], y[u] - y[v])) for u, v in border)
    inner = holes(border, n)
    hollow = sum(abs(float((x[w] * np.roll(y[w], -1) - np.roll(x[w], -1) * y[w]).sum())) / 2 for w in inner)
    return [area, around, float(n), float(len(border)), float(len(kept)), area / around**2 if around > 0 else 0.0, float(len(inner)), hollow, hollow / area if area > 0 else 0.0, alpha]


def shape_features(points: DataFrame, alpha: float) -> DataFrame:
    """``stroke_id, features``: the ten numbers of each stroke's shape at ``alpha``; a stroke of under three points has none but
    its points and alpha."""
    kind = dict(points.dtypes)["stroke_id"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        return pa.table({"stroke_id": rows.column("stroke_id").slice(0, 1), "features": pa.array([alpha_features(x, y, alpha)], pa.list_(pa.float64()))})

    return dealt(points.select("stroke_id", "i", "x", "y"), "stroke_id").groupBy("stroke_id").applyInArrow(run, f"stroke_id {kind}, features array<double>")


def shape_similarity(a: Column, b: Column) -> Column:
    """Mean of exp(-relative difference) over the numbers that are not 0 in both; 0 if all are."""
    parts = F.zip_with(a, b, lambda p, q: F.when(F.greatest(F.abs(p), F.abs(q)) > 1e-10, F.exp(-F.abs(p - q) / F.nullif(F.greatest(F.abs(p), F.abs(q)), F.lit(0.0)))))
    counted = F.array_compact(parts)
    return F.when(F.size(counted) > 0, F.aggregate(counted, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(counted), F.lit(0))).otherwise(0.0)


def polygon_area(points: DataFrame) -> DataFrame:
    """Area inside the closed path through a stroke's points."""
    p = points.groupBy("stroke_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    turn = lambda a, k: a.x * F.get("p", (k + 1) % F.size("p")).y - F.get("p", (k + 1) % F.size("p")).x * a.y
    return p.select("stroke_id", (F.abs(F.aggregate(F.transform("p", turn), F.lit(0.0), lambda s, v: s + v)) / 2).alias("area"))
