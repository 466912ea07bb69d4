"""Predicates, distances, measures, linear referencing and bounds of single geographies."""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np

from . import sphere as S
from .geometry import COLLECTION, LINESTRING, MULTILINESTRING, POINT, XY, XYM, XYZ, XYZM, Geography, GeographyError, assemble, empty, line, point, polygon, vertices


class Shape:
    """A geography decoded for computing: unit vectors of points, chains and polygons."""

    def __init__(self, g: Geography):
        self.g = g
        self.points = S.xyz(g.points)
        self.chains = [S.xyz(c) for c in g.lines if len(c) > 1]
        self.single = [S.xyz(c) for c in g.lines if len(c) == 1]

    @cached_property
    def polygons(self) -> list[list[np.ndarray]]:
        return [S.oriented([S.xyz(r) for r in p]) for p in self.g.polygons]

    @cached_property
    def regions(self) -> list[S.Region]:
        return [S.Region(p) for p in self.polygons]

    @cached_property
    def is_empty(self) -> bool:
        """Nothing to compute with: a line of one vertex has no edge."""
        return not len(self.points) and not self.chains and not self.g.polygons

    @cached_property
    def line_edges(self) -> tuple[np.ndarray, np.ndarray]:
        return _edges(self.chains)

    @cached_property
    def ring_edges(self) -> tuple[np.ndarray, np.ndarray]:
        return _edges([r for p in self.polygons for r in p])

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Points as edges of no length, lines, rings."""
        parts = [(self.points, self.points), self.line_edges, self.ring_edges]
        return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))

    @cached_property
    def vertices(self) -> np.ndarray:
        return np.concatenate([self.points, *self.chains, *[r[:-1] for p in self.polygons for r in p]])

    def covers(self, p: np.ndarray) -> np.ndarray:
        """1 in the interior of a polygon, 0 on the boundary of one, -1 outside, for (n, 3)."""
        out = np.full(len(p), -1)
        for r in self.regions:
            out = np.maximum(out, r.side(p))
        return out


def _edges(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not chains:
        return np.zeros((0, 3)), np.zeros((0, 3))
    return np.concatenate([c[:-1] for c in chains]), np.concatenate([c[1:] for c in chains])


# Extremal pairs ----------------------------------------------------------------------------------


def closest(a: Shape, b: Shape) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(angle, point of a, point of b); interiors count."""
    if a.is_empty or b.is_empty:
        return None
    (p, q), (r, s) = a.edges, b.edges
    cross = np.argwhere(S.crossings(p, q, r, s))
    if len(cross):
        i, j = cross[0]
        x = S.intersection(p[i], q[i], r[j], s[j])
        return 0.0, x, x
    for one, other in ((a, b), (b, a)):
        if other.polygons:
            heads = np.concatenate([one.points, *[c[:1] for c in one.chains], *[x[0][:1] for x in one.polygons]])
            inside = np.flatnonzero(other.covers(heads) >= 0)
            if len(inside):
                return 0.0, heads[inside[0]], heads[inside[0]]
    best = (np.inf, None, None)
    for u, v, w, swap in ((p, r, s, False), (q, r, s, False), (r, p, q, True), (s, p, q, True)):
        for begin in range(0, len(u), 256):
            x = u[begin : begin + 256, None]
            foot = S.project(x, v[None], w[None])
            d = S.angle(x, foot)
            k = np.unravel_index(d.argmin(), d.shape)
            if d[k] < best[0]:
                best = (float(d[k]), *((foot[k], x[k[0], 0]) if swap else (x[k[0], 0], foot[k])))
    return best


def farthest(a: Shape, b: Shape) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(angle, point of a, point of b) over edges only: the far side of an edge's nearest point to the antipode."""
    if a.is_empty or b.is_empty:
        return None
    (p, q), (r, s) = a.edges, b.edges
    cross = np.argwhere(S.crossings(-p, -q, r, s))
    if len(cross):
        i, j = cross[0]
        x = S.intersection(-p[i], -q[i], r[j], s[j])
        return math.pi, -x, x
    best = (-1.0, None, None)
    for i in range(len(p)):
        for u in (p[i], q[i]):
            ends = np.stack((r, s), 1).reshape(-1, 3)
            d = S.angle(u, ends)
            k = int(d.argmax())
            if d[k] > best[0]:
                best = (float(d[k]), u, ends[k])
    for u, v, w, swap in ((p, r, s, False), (q, r, s, False), (r, p, q, True), (s, p, q, True)):
        foot = S.project(-u[:, None], v[None], w[None])
        d = S.angle(u[:, None], foot)
        k = np.unravel_index(d.argmax(), d.shape)
        if d[k] > best[0] + 1e-15:
            best = (float(d[k]), *((foot[k], u[k[0]]) if swap else (u[k[0]], foot[k])))
    return best


def distance(a: Shape, b: Shape) -> float | None:
    found = closest(a, b)
    return None if found is None else found[0] * S.RADIUS


def max_distance(a: Shape, b: Shape) -> float | None:
    found = farthest(a, b)
    return None if found is None else found[0] * S.RADIUS


def dwithin(a: Shape, b: Shape, metres: float) -> bool:
    if metres < 0 or a.is_empty or b.is_empty:
        return False
    return distance(a, b) <= metres


def common_dims(a: int, b: int) -> int:
    if XY in (a, b) or {a, b} == {XYZ, XYM}:
        return XY
    return min(a, b)


def vertex_at(g: Geography, p: np.ndarray) -> np.ndarray:
    """The full vertex of a point on a geography: a source vertex as it is, else Z and M by the fraction along the nearest edge."""
    coords = g.all_vertices()
    v = S.xyz(coords)
    same = np.flatnonzero(np.linalg.norm(v - p, axis=1) <= 1e-15)
    if len(same):
        return coords[same[0]]
    out = np.full(4, np.nan)
    out[:2] = S.lnglat(p)
    chains = [c for c in [*g.lines, *[r for poly in g.polygons for r in poly]] if len(c) > 1]
    if g.dims != XY and chains:
        a, b = np.concatenate([c[:-1] for c in chains]), np.concatenate([c[1:] for c in chains])
        x, y = S.xyz(a), S.xyz(b)
        k = int(S.angle(p, S.project(p, x, y)).argmin())
        da, db = float(S.angle(x[k], p)), float(S.angle(p, y[k]))
        f = da / (da + db) if da + db else 0.0
        out[2:] = a[k, 2:] * (1 - f) + b[k, 2:] * f
    return out


def pair_line(a: Shape, b: Shape, found) -> Geography:
    dims = common_dims(a.g.dims, b.g.dims)
    return empty(LINESTRING) if found is None else line(np.stack((vertex_at(a.g, found[1]), vertex_at(b.g, found[2]))), dims)


def shortest_line(a: Shape, b: Shape) -> Geography:
    return pair_line(a, b, closest(a, b))


def longest_line(a: Shape, b: Shape) -> Geography:
    return pair_line(a, b, farthest(a, b))


def closest_point(a: Shape, b: Shape) -> Geography:
    found = closest(a, b)
    return empty(POINT) if found is None else point(vertex_at(a.g, found[1]), a.g.dims)


# Predicates --------------------------------------------------------------------------------------


def touching(a: Shape, b: Shape) -> bool:
    """Points and edges of both meet or come as near as rounding."""
    (p, q), (r, s) = a.edges, b.edges
    if not len(p) or not len(r):
        return False
    if S.crossings(p, q, r, s).any():
        return True
    for u, v, w in ((a.vertices, r, s), (b.vertices, p, q)):
        for begin in range(0, len(u), 256):
            x = u[begin : begin + 256, None]
            if (S.angle(x, S.project(x, v[None], w[None])) <= S.TOUCH).any():
                return True
    return False


def intersects(a: Shape, b: Shape) -> bool:
    if a.is_empty or b.is_empty:
        return False
    if a.polygons and (a.covers(heads(b)) >= 0).any() or b.polygons and (b.covers(heads(a)) >= 0).any():
        return True
    return touching(a, b)


def heads(a: Shape) -> np.ndarray:
    """A vertex of every connected part."""
    return np.concatenate([a.points, *[c[:1] for c in a.chains], *[x[0][:1] for x in a.polygons]])


def contains(a: Shape, b: Shape) -> bool:
    """The polygons of a hold all of b in their interior."""
    if a.is_empty or b.is_empty or not a.polygons:
        return False
    if (a.covers(b.vertices) < 1).any():
        return False
    (p, q), (r, s) = a.ring_edges, b.edges
    if S.crossings(p, q, r, s).any():
        return False
    corners = np.concatenate([x for poly in a.polygons for x in poly])
    if b.polygons and (b.covers(corners) >= 0).any():
        return False  # a hole or another edge of a lies in b
    long = (r != s).any(1)
    if long.any():
        near = min(float(S.angle(x, S.project(x, r[long], s[long])).min()) for x in corners)
        return near > S.TOUCH
    return True


def equals(a: Shape, b: Shape) -> bool:
    """The same points, the same line edges in either direction, the same rings up to rotation."""
    if a.is_empty or b.is_empty:
        return a.is_empty and b.is_empty

    def code(v: np.ndarray) -> list[tuple]:
        return [tuple(x) for x in (np.round(v, 15) + 0.0).tolist()]

    def parts(x: Shape):
        edges = {frozenset(e) for e in zip(*map(code, x.line_edges), strict=True)}
        rings = set(zip(*map(code, x.ring_edges), strict=True))
        corners = {p for e in edges for p in e} | {p for e in rings for p in e}
        return set(code(x.points)) - corners, {e for e in edges if len(e) > 1}, {e for e in rings if e[0] != e[1]}

    return parts(a) == parts(b)


def touches(a: Shape, b: Shape) -> bool:
    """They meet as closed sets, not as open ones: no interior is shared."""
    if not intersects(a, b):
        return False
    for one, other in ((a, b), (b, a)):
        if one.polygons:
            (p, q), (r, s) = one.ring_edges, other.edges
            middles = S.unit(r + s)
            if (one.covers(np.concatenate([other.vertices, middles])) > 0).any() or (len(r) and S.crossings(p, q, r, s).any()):
                return False
            if other.polygons and any((one.covers(_inner_point(reg)[None]) > 0).any() for reg in other.regions):
                return False
    if not a.polygons and not b.polygons:
        (p, q), (r, s) = a.edges, b.edges
        return not S.crossings(p, q, r, s).any() and bool(a.chains or b.chains)
    return True


def _inner_point(region: S.Region) -> np.ndarray:
    k = int(np.linalg.norm(region.a - region.b, axis=1).argmax())
    a, b = region.a[k], region.b[k]
    return S.unit(S.unit(a + b) + S.unit(S.cross(a + b, b - a)) * min(1e-7, np.linalg.norm(a - b) * 1e-3))


# Measures ----------------------------------------------------------------------------------------


def chain_length(c: np.ndarray) -> float:
    return float(S.angle(c[:-1], c[1:]).sum()) if len(c) > 1 else 0.0


def length(a: Shape) -> float:
    return sum(map(chain_length, a.chains)) * S.RADIUS


def perimeter(a: Shape) -> float:
    return sum(chain_length(r) for p in a.polygons for r in p) * S.RADIUS


def area(a: Shape) -> float:
    return sum(S.ring_area(r) for p in a.polygons for r in p) * S.RADIUS**2


def num_points(g: Geography) -> int:
    return len(g.points) + sum(map(len, g.lines)) + sum(max(0, len(r) - 1) for p in g.polygons for r in p)


def is_collection(g: Geography) -> bool:
    return len(g.points) > 1 or len([x for x in g.lines if len(x)]) > 1 or len(g.polygons) > 1 or (len(g.points) > 0) + (len(g.lines) > 0) + (len(g.polygons) > 0) > 1


def coordinate(g: Geography, k: int) -> float:
    p = g.points
    return float(p[0, k]) if len(p) == 1 and not g.lines and not g.polygons else math.nan


def validation_error(g: Geography) -> str | None:
    for c in g.lines:
        v = S.xyz(c)
        if len(v) > 1:
            if (v[1:] == v[:-1]).all(1).any():
                return "Line has duplicate adjacent vertices"
            if (v[1:] == -v[:-1]).all(1).any():
                return "Line has antipodal adjacent vertices"
    for rings in g.polygons:
        for k, r in enumerate(rings):
            v = S.xyz(r)
            if len(v) < 4 or not np.array_equal(r[0, :2], r[-1, :2]):
                return f"Ring {k}: fewer than 3 vertices or not closed"
            w = v[:-1]
            if len(np.unique(w, axis=0)) != len(w):
                return f"Ring {k}: duplicate vertices"
            a, b = v[:-1], v[1:]
            if S.crossings(a, b, a, b).any():
                return f"Ring {k}: edges cross"
        if len(rings) > 1:
            for i, r in enumerate(rings):
                for o in rings[i + 1 :]:
                    v, w = S.xyz(r), S.xyz(o)
                    if S.crossings(v[:-1], v[1:], w[:-1], w[1:]).any():
                        return "Rings cross"
    return None


def centroid_vector(a: Shape) -> np.ndarray:
    """Not normalised, of the highest dimension present."""
    if a.polygons:
        total = np.zeros(3)
        for p in a.polygons:
            for r in p:
                u, v = r[:-1], r[1:]
                n = S.cross(u, v)
                long = np.linalg.norm(n, axis=1, keepdims=True)
                total += (0.5 * S.angle(u, v)[:, None] * n / np.where(long == 0, 1, long)).sum(0)
        return total
    if a.chains:
        total = np.zeros(3)
        for c in a.chains:
            u, v = c[:-1], c[1:]
            wide, mid = np.linalg.norm(u - v, axis=1), np.linalg.norm(u + v, axis=1)
            total += ((wide / np.where(mid == 0, 1, mid))[:, None] * (u + v)).sum(0)
        return total
    return a.points.sum(0)


def centroid(a: Shape) -> Geography:
    g = a.g
    if a.is_empty and not a.single:
        return empty(COLLECTION)
    v = centroid_vector(a) if not a.is_empty else a.single[0].sum(0)
    out = np.full(4, np.nan)
    out[:2] = S.lnglat(S.unit(v))
    if g.dims != XY:
        if g.polygons:
            weights, values = [], []
            for p, raw in zip(a.polygons, g.polygons, strict=True):
                for k, (r, c) in enumerate(zip(p, raw, strict=True)):
                    shell = S.xyz(c)
                    for i in range(1, len(c) - 2):
                        w = abs(float(S.triangle_area(shell[0], shell[i], shell[i + 1]))) * (-1 if k else 1)
                        weights.append(w)
                        values.append((c[0, 2:] + c[i, 2:] + c[i + 1, 2:]) / 3)
        elif a.chains:
            pairs = [(S.xyz(c), c) for c in g.lines if len(c) > 1]
            weights = np.concatenate([S.angle(x[:-1], x[1:]) for x, _ in pairs])
            values = np.concatenate([(c[:-1, 2:] + c[1:, 2:]) / 2 for _, c in pairs])
        else:
            weights, values = np.ones(len(g.points)), g.points[:, 2:]
        weights, values = np.asarray(weights, float), np.asarray(values, float)
        out[2:] = (weights[:, None] * values).sum(0) / (weights.sum() or 1)
    return point(out, g.dims)


def boundary(g: Geography) -> Geography:
    """Lines: their end points; polygons: their rings; mixed with polygons an error; else empty."""
    has_points, lines, polygons = len(g.points) > 0, [c for c in g.lines if len(c)], g.polygons
    if polygons:
        if has_points or lines:
            raise GeographyError("the boundary of mixed geographies is not defined")
        return Geography(MULTILINESTRING, g.dims, parts=[line(r, g.dims) for p in polygons for r in p])
    if lines and not has_points:
        return Geography(4, g.dims, parts=[point(c[k], g.dims) for c in lines for k in (0, -1)])
    return empty(COLLECTION)


def hull_ring(v: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of unit vectors, counter-clockwise; they must fit into a hemisphere."""
    v = np.unique(v, axis=0)
    middle = S.unit(v.sum(0))
    if (v @ middle <= 1e-9).any():
        raise GeographyError("the convex hull does not fit into a hemisphere")
    east = S.cross([0.0, 0.0, 1.0], middle)
    east = S.unit(east) if np.linalg.norm(east) > 1e-12 else np.array([1.0, 0.0, 0.0])
    north = S.cross(middle, east)
    w = v @ middle
    x, y = v @ east / w, v @ north / w
    order = np.lexsort((y, x))
    turn = lambda o, a, b: float(S.det(v[o], v[a], v[b]))

    def half(ids):
        out: list[int] = []
        for i in ids:
            while len(out) > 1 and turn(out[-2], out[-1], i) <= 1e-15 * np.linalg.norm(v[out[-2]] - v[i]):
                out.pop()
            out.append(i)
        return out

    lower, upper = half(order.tolist()), half(order[::-1].tolist())
    return v[lower[:-1] + upper[:-1]]


def hull_of(v: np.ndarray, coords: np.ndarray | None = None) -> Geography:
    if not len(v):
        return empty(COLLECTION)
    back = {tuple(x): c for x, c in zip(v.tolist(), coords.tolist(), strict=True)} if coords is not None else {}
    as_vertex = lambda r: vertices([back[tuple(x)][:2] if tuple(x) in back else S.lnglat(x) for x in r])
    distinct = np.unique(v, axis=0)
    if len(distinct) == 1:
        return point(as_vertex(distinct)[0])
    ring = hull_ring(v) if len(distinct) > 2 else distinct
    if len(ring) < 3:
        pairs = [(float(S.angle(a, b)), i, j) for i, a in enumerate(ring) for j, b in enumerate(ring[:i])]
        _, i, j = max(pairs)
        first = min(i, j, key=lambda k: int(np.flatnonzero((v == ring[k]).all(1))[0]))
        return line(as_vertex([ring[first], ring[i + j - first]]))
    return polygon([as_vertex([*ring, ring[0]])])


def convex_hull(a: Shape) -> Geography:
    return hull_of(S.xyz(a.g.all_vertices()), a.g.all_vertices())


def point_on_surface(a: Shape) -> Geography:
    from .cells import largest_inner_cell

    g = a.g
    if a.is_empty and not a.single:
        return empty(POINT)
    if a.polygons:
        center = largest_inner_cell(a)
        if center is None:
            return point([*g.polygons[0][0][0, :2], np.nan, np.nan])
        return point([*S.lnglat(center), np.nan, np.nan])
    coords = np.concatenate([g.points, *g.lines]) if not a.chains else np.concatenate([c for c in g.lines if len(c) > 1])
    middle = S.unit(centroid_vector(a))
    return point(coords[int(S.angle(S.xyz(coords), middle).argmin())], g.dims)


# Linear referencing ------------------------------------------------------------------------------


def single_line(g: Geography) -> np.ndarray | None:
    """The only line, None if there is nothing; anything else is an error."""
    if g.is_empty:
        return None
    lines = [c for c in g.lines if len(c)]
    if len(lines) != 1 or len(g.points) or g.polygons:
        raise GeographyError("expected a single linestring")
    return lines[0] if len(lines[0]) > 1 else None


def interpolate_edge(a: np.ndarray, b: np.ndarray, f: float) -> np.ndarray:
    """The vertex at a fraction of an edge; Z and M are linear."""
    if f <= 0:
        return a
    if f >= 1:
        return b
    u, v = S.xyz(a), S.xyz(b)
    long = float(S.angle(u, v))
    if not long:
        return a
    x = (np.sin((1 - f) * long) * u + np.sin(f * long) * v) / np.sin(long)
    return np.concatenate((S.lnglat(S.unit(x)), a[2:] * (1 - f) + b[2:] * f))


def line_interpolate(g: Geography, fraction: float) -> Geography | None:
    c = single_line(g)
    if c is None:
        return None
    v = S.xyz(c)
    ends = np.cumsum(S.angle(v[:-1], v[1:]))
    total = float(ends[-1])
    if fraction <= 0 or not total:
        return point(c[0], g.dims)
    if fraction >= 1:
        return point(c[-1], g.dims)
    want = fraction * total
    k = min(int(np.searchsorted(ends, want, "left")), len(ends) - 1)
    begin = float(ends[k - 1]) if k else 0.0
    own = float(ends[k]) - begin
    return point(interpolate_edge(c[k], c[k + 1], (want - begin) / own if own else 0.0), g.dims)


def line_locate(g: Geography, p: Geography) -> float | None:
    c = single_line(g)
    if c is None or p.is_empty:
        return None
    if len(p.points) != 1 or p.lines or p.polygons:
        raise GeographyError("expected a single point")
    v, x = S.xyz(c), S.xyz(p.points)[0]
    long = S.angle(v[:-1], v[1:])
    total = float(long.sum())
    if not total:
        return 0.0
    foot = S.project(x, v[:-1], v[1:])
    k = int(S.angle(x, foot).argmin())
    return min(1.0, max(0.0, (float(long[:k].sum()) + float(S.angle(v[k], foot[k]))) / total))


# Bounds ------------------------------------------------------------------------------------------

FULL = (-180.0, -90.0, 180.0, 90.0)


def lng_union(intervals: list[tuple[float, float]]) -> tuple[float, float] | None:
    """The least circular interval, in degrees, over intervals that may wrap (low > high): the largest gap is left out."""
    if not intervals:
        return None
    flat = sorted(piece for lo, hi in intervals for piece in ([(lo, hi)] if lo <= hi else [(lo, 180.0), (-180.0, hi)]))
    merged = [list(flat[0])]
    for lo, hi in flat[1:]:
        if lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    gaps = [(merged[k + 1][0] - merged[k][1], k) for k in range(len(merged) - 1)]
    outer = merged[0][0] + 360 - merged[-1][1]
    if outer <= 0 and not gaps:
        return (-180.0, 180.0)
    best = max([(outer, -1), *gaps])
    return (merged[0][0], merged[-1][1]) if best[1] == -1 else (merged[best[1] + 1][0], merged[best[1]][1])


def chain_bounds(v: np.ndarray) -> tuple[list[tuple[float, float]], float, float]:
    """Longitude intervals of the edges and the latitude range of a chain, with the bulge of its arcs."""
    ll = S.lnglat(v)
    low, high = float(ll[:, 1].min()), float(ll[:, 1].max())
    intervals = []
    for k in range(len(v) - 1):
        a, b = ll[k, 0], ll[k + 1, 0]
        d = (b - a + 540) % 360 - 180
        intervals.append((a, b) if d >= 0 else (b, a))
        n = S.cross(v[k] - v[k + 1], v[k] + v[k + 1])
        long = np.linalg.norm(n)
        if long < 1e-15:
            continue
        n = n / long
        m = S.cross(n, [0.0, 0.0, 1.0])
        da, db = float(m @ v[k]), float(m @ v[k + 1])
        if da * db < 0:
            top = float(np.degrees(np.arccos(min(1.0, abs(n[2])))))
            if (v[k] + v[k + 1])[2] >= 0:
                high = max(high, top)
            else:
                low = min(low, -top)
    return intervals, low, high


#: What rounding may add to each side, in degrees.
_EDGE = float(np.degrees(2 * np.finfo(float).eps))


def bounds(a: Shape) -> tuple[float, float, float, float] | None:
    """(xmin, ymin, xmax, ymax) in degrees; xmin > xmax means that the antimeridian is inside."""
    intervals, low, high = [], 90.0, -90.0
    if len(a.points):
        ll = S.lnglat(a.points)
        intervals += [(float(x), float(x)) for x in ll[:, 0]]
        low, high = min(low, float(ll[:, 1].min())), max(high, float(ll[:, 1].max()))
    rings = [(p[0], r) for p, r in zip(a.polygons, a.regions, strict=True)]
    for c in [*a.chains, *[x for x, _ in rings]]:
        own, lo, hi = chain_bounds(c)
        intervals += own
        low, high = min(low, lo), max(high, hi)
    for _, region in rings:
        for pole, lat in (((0.0, 0.0, 1.0), 90.0), ((0.0, 0.0, -1.0), -90.0)):
            if region.side(np.array([pole]))[0] >= 0:
                intervals = [(-180.0, 180.0)]
                low, high = min(low, lat), max(high, lat)
    lng = lng_union(intervals)
    if lng is None:
        return None
    if not a.chains and not rings:
        return lng[0] - _EDGE, low, lng[1] + _EDGE, high
    return lng[0], low, lng[1], high
