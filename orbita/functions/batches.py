"""Kernels over whole Arrow batches of plain points and plain lines, in numpy.

Each takes the arrays of a call and gives ``(rows it can answer, their values in order)``; the other rows (nulls, empty
ones, Z and M, other types, big-endian) are left to the kernel of one row, and the results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from orbita.geo import cells, kernels
from orbita.geo import sphere as S

POINT_HEAD, LINE_HEAD = np.frombuffer(b"\x01\x01\0\0\0", np.uint8), np.frombuffer(b"\x01\x02\0\0\0", np.uint8)
POINT_SIZE = 21


class Blobs:
    """The bytes of a binary array and where each value begins and ends."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.begin, self.size = ends[:-1], np.diff(ends)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.valid = np.asarray(column.is_valid())

    def rows(self, which: np.ndarray, size: int) -> np.ndarray:
        """(n, size) of values of one size."""
        begin = self.begin[which]
        if len(begin) and begin[-1] - begin[0] == size * (len(begin) - 1) and (np.diff(begin) == size).all():
            return self.data[begin[0] : begin[0] + size * len(begin)].reshape(-1, size)
        return self.data[begin[:, None] + np.arange(size)]


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are points, and the (n, 2) of all rows, NaN where they are not."""
    blobs = Blobs(column)
    at = np.flatnonzero(blobs.valid & (blobs.size == POINT_SIZE))
    out = np.full((len(column), 2), np.nan)
    if len(at):
        raw = blobs.rows(at, POINT_SIZE)
        good = (raw[:, :5] == POINT_HEAD).all(1)
        out[at[good]] = np.ascontiguousarray(raw[good, 5:]).view("<f8")
    return np.isfinite(out).all(1), out


def lines(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, (n, vertices, 2)) of lines with finite vertices, two at least, by their number of vertices."""
    blobs, found = Blobs(column), []
    whole = blobs.valid & (blobs.size >= 41) & ((blobs.size - 9) % 16 == 0)
    for size in np.unique(blobs.size[whole]):
        at = np.flatnonzero(whole & (blobs.size == size))
        n = (int(size) - 9) // 16
        raw = blobs.rows(at, int(size))
        coords = np.ascontiguousarray(raw[:, 9:]).view("<f8").reshape(-1, n, 2)
        good = (raw[:, :5] == LINE_HEAD).all(1) & (np.ascontiguousarray(raw[:, 5:9]).view("<u4")[:, 0] == n) & np.isfinite(coords).all((1, 2))
        if good.any():
            found.append((at[good], coords[good]))
    return found


def binary(raw: np.ndarray) -> pa.Array:
    """(n, size) bytes as a binary array."""
    raw = np.ascontiguousarray(raw)
    ends = np.arange(len(raw) + 1, dtype=np.int64) * raw.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())


def point_wkb(xy: np.ndarray) -> pa.Array:
    raw = np.empty((len(xy), POINT_SIZE), np.uint8)
    raw[:, :5], raw[:, 5:] = POINT_HEAD, np.ascontiguousarray(xy).astype("<f8").view(np.uint8)
    return binary(raw)


def line_wkb(coords: np.ndarray) -> np.ndarray:
    """(n, 9 + 16 * vertices) bytes of (n, vertices, 2)."""
    n, k = coords.shape[:2]
    raw = np.empty((n, 9 + 16 * k), np.uint8)
    raw[:, :5], raw[:, 5:9] = LINE_HEAD, np.frombuffer(np.uint32(k).tobytes(), np.uint8)
    raw[:, 9:] = np.ascontiguousarray(coords.reshape(n, 2 * k)).astype("<f8").view(np.uint8)
    return raw


def lines_wkb(ends: np.ndarray, xy: np.ndarray) -> pa.Array:
    """Lines of the vertices between one end and the next."""
    n = np.diff(ends)
    to = np.concatenate(([0], np.cumsum(9 + 16 * n))).astype(np.int64)
    raw = np.empty(int(to[-1]), np.uint8)
    head = to[:-1, None] + np.arange(9)
    body = np.ones(len(raw), bool)
    body[head.ravel()] = False
    raw[head[:, :5]], raw[head[:, 5:]] = LINE_HEAD, n.astype("<u4").view(np.uint8).reshape(-1, 4)
    raw[body] = np.ascontiguousarray(xy[ends[0] : ends[-1]]).astype("<f8").view(np.uint8).ravel()
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(to), pa.py_buffer(raw)]).cast(pa.binary())


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    out = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.isfinite(out), out


def _pair(a, b):
    (ok, p), (good, q) = points(a), points(b)
    ok &= good
    return ok, p[ok], q[ok]


def _apart(p, q):
    return S.angle(S.xyz(p), S.xyz(q)) * S.RADIUS


def cell_id(a):
    ok, p = points(a)
    return ok, pa.array(cells.from_vectors(S.xyz(p[ok])))


def distance(a, b):
    ok, p, q = _pair(a, b)
    return ok, pa.array(_apart(p, q))


def dwithin(a, b, metres):
    ok, p, q = _pair(a, b)
    good, d = numbers(metres)
    keep = good[ok]
    return ok & good, pa.array((d[ok][keep] >= 0) & (_apart(p[keep], q[keep]) <= d[ok][keep]))


def pair_line(a, b):
    ok, p, q = _pair(a, b)
    return ok, binary(line_wkb(np.stack((p, q), 1)))


def closest_point(a, b):
    ok, p, _ = _pair(a, b)
    return ok, point_wkb(p)


def coordinate(k: int):
    def run(a):
        ok, p = points(a)
        return ok, pa.array(p[ok, k])

    return run


def bounds(a):
    ok, p = points(a)
    ll = S.lnglat(S.xyz(p[ok]))
    at = [ll[:, 0] - kernels._EDGE, ll[:, 1], ll[:, 0] + kernels._EDGE, ll[:, 1]]
    return ok, pa.StructArray.from_arrays([pa.array(x) for x in at], ["xmin", "ymin", "xmax", "ymax"])


def _gathered(n: int, parts: list[tuple[np.ndarray, np.ndarray]], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values of groups of rows in the order of the rows."""
    ok = np.zeros(n, bool)
    out = np.zeros(n) if width is None else np.zeros((n, width))
    for at, x in parts:
        ok[at], out[at] = True, x
    return ok, out[ok]


def length(a):
    parts = []
    for at, c in lines(a):
        v = S.xyz(c)
        parts.append((at, S.angle(v[:, :-1], v[:, 1:]).sum(1) * S.RADIUS))
    ok, out = _gathered(len(a), parts)
    return ok, pa.array(out)


def interpolate(a, fraction):
    good, f = numbers(fraction)
    parts = []
    for at, c in lines(a):
        keep = good[at]
        at, c = at[keep], c[keep]
        g = f[at]
        v = S.xyz(c)
        ends = np.cumsum(S.angle(v[:, :-1], v[:, 1:]), 1)
        total, row = ends[:, -1], np.arange(len(at))
        want = g * total
        k = np.minimum((ends < want[:, None]).sum(1), ends.shape[1] - 1)
        begin = np.where(k > 0, ends[row, np.maximum(k - 1, 0)], 0.0)
        own = ends[row, k] - begin
        t = np.where(own > 0, (want - begin) / np.where(own > 0, own, 1), 0.0)
        u, w = v[row, k], v[row, k + 1]
        long = S.angle(u, w)
        with np.errstate(invalid="ignore", divide="ignore"):
            x = (np.sin((1 - t) * long)[:, None] * u + np.sin(t * long)[:, None] * w) / np.sin(long)[:, None]
            out = S.lnglat(S.unit(x))
        out = np.where(((t <= 0) | (long == 0))[:, None], c[row, k], np.where((t >= 1)[:, None], c[row, k + 1], out))
        out = np.where(((g <= 0) | (total == 0))[:, None], c[:, 0], np.where((g >= 1)[:, None], c[:, -1], out))
        parts.append((at, out))
    ok, out = _gathered(len(a), parts, 2)
    return ok, point_wkb(out)


def locate(a, b):
    good, p = points(b)
    parts = []
    for at, c in lines(a):
        keep = good[at]
        at, c = at[keep], c[keep]
        v, x = S.xyz(c), S.xyz(p[at])[:, None]
        long = S.angle(v[:, :-1], v[:, 1:])
        total, row = long.sum(1), np.arange(len(at))
        foot = S.project(x, v[:, :-1], v[:, 1:])
        k = S.angle(x, foot).argmin(1)
        before = np.where(np.arange(long.shape[1]) < k[:, None], long, 0.0).sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            found = np.clip((before + S.angle(v[row, k], foot[row, k])) / total, 0.0, 1.0)
        parts.append((at, np.where(total == 0, 0.0, found)))
    ok, out = _gathered(len(a), parts)
    return ok, pa.array(out)


def num_points(a):
    ok, out = points(a)
    count = np.where(ok, 1, 0)
    for at, c in lines(a):
        ok[at], count[at] = True, c.shape[1]
    return ok, pa.array(count[ok].astype(np.int32))


def _cells(column) -> tuple[np.ndarray, np.ndarray]:
    c = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return np.asarray(column.is_valid()) & cells.are_valid(c), c


def _xyz(v: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v[:, k])) for k in range(3)], list("xyz"))


def cell_center(c):
    ok, c = _cells(c)
    return ok, _xyz(cells.centers(c[ok]))


def cell_vertex(c, k):
    ok, c = _cells(c)
    n = k.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    ok &= n >= 0
    return ok, _xyz(cells.vertices_of(c[ok], n[ok] % 4))


def edge_neighbor(c, k):
    ok, c = _cells(c)
    n = k.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    ok &= (n >= 0) & (n < 4)
    return ok, pa.array(cells.edge_neighbors(c[ok], n[ok]))


BATCHES = {
    "s2_cellidfrompoint": cell_id, "st_distance": distance, "st_dwithin": dwithin, "st_longestline": pair_line, "st_shortestline": pair_line, "st_closestpoint": closest_point,
    "st_x": coordinate(0), "st_y": coordinate(1), "s2_x": coordinate(0), "s2_y": coordinate(1), "st_boundingbox": bounds, "st_length": length, "st_lineinterpolatepoint": interpolate, "st_linelocatepoint": locate,
    "st_npoints": num_points, "s2_num_points": num_points, "s2_cell_center": cell_center, "s2_cell_to_point": cell_center, "s2_cell_vertex": cell_vertex, "s2_cell_edge_neighbor": edge_neighbor,
}
