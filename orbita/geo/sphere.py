"""Vectors, edges and rings on the unit sphere."""

from __future__ import annotations

import math

import numpy as np

#: The fixed radius of the sphere in metres.
RADIUS = 6371010.0
#: Angles below which a point counts as lying on an edge or vertex.
TOUCH = 1e-14


def xyz(coords: np.ndarray) -> np.ndarray:
    """(n, 3) unit vectors of (n, >=2) lng, lat in degrees; nothing is clamped or wrapped."""
    lng, lat = np.radians(coords[..., 0]), np.radians(coords[..., 1])
    c = np.cos(lat)
    return np.stack((np.cos(lng) * c, np.sin(lng) * c, np.sin(lat)), -1)


def lnglat(v: np.ndarray) -> np.ndarray:
    return np.stack((np.degrees(np.arctan2(v[..., 1], v[..., 0])), np.degrees(np.arctan2(v[..., 2], np.hypot(v[..., 0], v[..., 1])))), -1)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def cross(a, b) -> np.ndarray:
    """As numpy's, without its handling of axes, which costs more than the products."""
    a, b = np.asarray(a), np.asarray(b)
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    out[..., 0] = a[..., 1] * b[..., 2] - a[..., 2] * b[..., 1]
    out[..., 1] = a[..., 2] * b[..., 0] - a[..., 0] * b[..., 2]
    out[..., 2] = a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a, b)


def det(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a . (b x c), from differences where the vectors are close."""
    return dot(a, cross(b - a, c - a))


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The angle between unit vectors by their chord, from the far side where that is nearer."""
    near = np.linalg.norm(a - b, axis=-1)
    far = np.linalg.norm(a + b, axis=-1)
    return np.where(near <= 1.5, 2 * np.arcsin(np.minimum(1, near / 2)), np.pi - 2 * np.arcsin(np.minimum(1, far / 2)))


def project(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The point of the edges a-b nearest to p; all broadcast."""
    p, a, b = np.broadcast_arrays(p, a, b)
    n = cross(a - b, a + b)
    long = np.linalg.norm(n, axis=-1, keepdims=True)
    n = n / np.where(long == 0, 1, long)
    foot = unit(p - dot(p, n)[..., None] * n)
    inside = (dot(cross(n, a), foot) >= 0) & (dot(cross(b, n), foot) >= 0) & (long[..., 0] > 0) & (np.linalg.norm(foot, axis=-1) > 0)
    ends = np.where((np.linalg.norm(p - a, axis=-1) <= np.linalg.norm(p - b, axis=-1))[..., None], a, b)
    return np.where(inside[..., None], foot, ends)


def crossings(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(n, m): which edges a-b properly cross which edges c-d: the four triangles they make turn the same way."""
    ab, cd = cross(a - b, a + b), cross(c - d, c + d)
    # what rounding may make of a determinant that is zero: such edges touch, if at all
    e, f = 8e-16 * np.linalg.norm(ab, axis=1)[:, None], 8e-16 * np.linalg.norm(cd, axis=1)[None]
    w, x, y, z = -(ab @ c.T), ab @ d.T, -(cd @ b.T).T, (cd @ a.T).T
    return (w > e) & (x > e) & (y > f) & (z > f) | (w < -e) & (x < -e) & (y < -f) & (z < -f)


def intersection(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Where crossing edges a-b and c-d meet."""
    x = unit(cross(cross(a - b, a + b), cross(c - d, c + d)))
    return np.where((dot(x, a + b + c + d) < 0)[..., None], -x, x)


def edges_of(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return chain[:-1], chain[1:]


def triangle_area(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Signed; positive for counter-clockwise."""
    return 2 * np.arctan2(det(a, b, c), 1 + dot(a, b) + dot(b, c) + dot(c, a))


def ring_area(ring: np.ndarray) -> float:
    """Signed area in steradians of a closed ring of unit vectors; the smaller side counts."""
    v = ring[:-1] if len(ring) > 1 and np.array_equal(ring[0], ring[-1]) else ring
    if len(v) < 3:
        return 0.0
    middle = unit(v.sum(0))
    apex = middle if np.linalg.norm(v.sum(0)) > 1e-9 and (v @ middle).min() > 0.1 else v[0]
    area = float(triangle_area(apex, v, np.roll(v, -1, 0)).sum())
    return area if abs(area) <= 2 * np.pi else area - math.copysign(4 * np.pi, area)


def oriented(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings of unit vectors, the shell counter-clockwise and holes clockwise."""
    out = []
    for k, r in enumerate(rings):
        if len(r) and not np.array_equal(r[0], r[-1]):
            r = np.concatenate((r, r[:1]))
        if (ring_area(r) < 0) != (k > 0):
            r = r[::-1]
        out.append(r)
    return out


class Region:
    """A polygon's rings, oriented, as edges with the interior on the left."""

    def __init__(self, rings: list[np.ndarray]):
        self.rings = rings
        pairs = [edges_of(r) for r in rings if len(r) > 1]
        self.a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros((0, 3))
        self.b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros((0, 3))
        keep = (self.a != self.b).any(1)
        self.a, self.b = self.a[keep], self.b[keep]
        self.normal = cross(self.a - self.b, self.a + self.b)

    def boundary_distance(self, p: np.ndarray) -> np.ndarray:
        if not len(self.a):
            return np.full(len(p), np.inf)
        return np.concatenate([angle(q[:, None], project(q[:, None], self.a[None], self.b[None])).min(1) for q in np.array_split(p, max(1, len(p) * len(self.a) // 200_000 + 1))]) if len(p) else np.zeros(0)

    def side(self, p: np.ndarray) -> np.ndarray:
        """1 inside, 0 on the boundary, -1 outside, for (n, 3)."""
        out = np.full(len(p), -1)
        if not len(self.a):
            return out
        on = self.boundary_distance(p) <= TOUCH
        out[on] = 0
        rest = np.flatnonzero(~on)
        out[rest[self._inside(p[rest])]] = 1
        return out

    def _inside(self, p: np.ndarray) -> np.ndarray:
        """By crossings of the way to a point just left of an edge; another edge is tried where the way meets a vertex."""
        inside, todo = np.zeros(len(p), bool), np.arange(len(p))
        order = np.argsort(-np.linalg.norm(self.a - self.b, axis=1))
        for turn, k in enumerate(np.resize(order, max(16, len(order)))):
            if not len(todo) or turn > 64:
                break
            t = 0.5 + 0.37 * np.sin(turn)
            foot = unit(self.a[k] * (1 - t) + self.b[k] * t)
            left = unit(cross(self.a[k] + self.b[k], self.b[k] - self.a[k]))
            way = min(1e-7, np.linalg.norm(self.a[k] - self.b[k]) * 1e-3)
            ref = unit(foot + left * way)
            q = p[todo]
            n = cross(q, ref)
            vague = ((np.abs(n @ self.a.T) < 1e-16) & (q @ self.a.T > -0.5)).any(1) | (np.linalg.norm(n, axis=1) < 1e-9)
            odd = crossings(q, np.broadcast_to(ref, q.shape), self.a, self.b).sum(1) % 2 == 1
            sure = ~vague
            inside[todo[sure]] = ~odd[sure]
            todo = todo[~sure]
        return inside
