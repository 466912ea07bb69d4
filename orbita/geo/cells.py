"""The hierarchy of cells on the faces of a cube, in numpy: 64-bit ids along a Hilbert curve."""

from __future__ import annotations

import heapq
import math

import numpy as np

from . import sphere as S

LEVELS, SENTINEL = 30, -1
MASK = (1 << 64) - 1
#: Fixed values of the curve: for each orientation the (i, j) of its four quadrants, and how a quadrant turns.
CURVE = (((0, 0), (0, 1), (1, 1), (1, 0)), ((0, 0), (1, 0), (1, 1), (0, 1)), ((1, 1), (1, 0), (0, 0), (0, 1)), ((1, 1), (0, 1), (0, 0), (1, 0)))
TURN = (1, 0, 0, 3)


def curve_tables() -> tuple[np.ndarray, np.ndarray]:
    """For four levels at once: (4 bits of i, 4 bits of j, orientation) -> (position, orientation), and back."""
    forth, back = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for start in range(4):
        for pos in range(256):
            turn, i, j = start, 0, 0
            for level in range(4):
                q = pos >> (2 * (3 - level)) & 3
                a, b = CURVE[turn][q]
                i, j, turn = i << 1 | a, j << 1 | b, turn ^ TURN[q]
            forth[i << 6 | j << 2 | start] = pos << 2 | turn
            back[pos << 2 | start] = i << 6 | j << 2 | turn
    return forth, back


FORTH, BACK = curve_tables()


def st_to_uv(s: np.ndarray) -> np.ndarray:
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)


def uv_to_st(u: np.ndarray) -> np.ndarray:
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def face_uv(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    axis = np.abs(v).argmax(-1)
    face = axis + 3 * (np.take_along_axis(v, axis[..., None], -1)[..., 0] < 0)
    x, y, z = v[..., 0], v[..., 1], v[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, (y / x, -x / y, -x / z, z / x, z / y, -y / z))
        w = np.choose(face, (z / x, z / y, -y / z, y / x, -x / y, -x / z))
    return face, u, w


def uv_vector(face: int, u, v) -> np.ndarray:
    u, v = np.broadcast_arrays(np.asarray(u, float), np.asarray(v, float))
    one = np.ones_like(u)
    return np.stack(((one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one))[face], -1)


def from_vectors(v: np.ndarray) -> np.ndarray:
    """Leaf ids, as signed 64-bit numbers, of (n, 3)."""
    face, u, w = face_uv(v)
    size = 1 << LEVELS
    i = np.clip(np.floor(size * uv_to_st(u)), 0, size - 1).astype(np.int64)
    j = np.clip(np.floor(size * uv_to_st(w)), 0, size - 1).astype(np.int64)
    out, turn = face.astype(np.uint64), (face & 1).astype(np.int64)
    for k in range(7, -1, -1):
        got = FORTH[((i >> (4 * k)) & 15) << 6 | ((j >> (4 * k)) & 15) << 2 | turn] if k < 7 else FORTH[((i >> 28) & 15) << 6 | ((j >> 28) & 15) << 2 | turn]
        if k == 7:  # the topmost step has two levels only, its upper bits are zero
            out, turn = out << np.uint64(4) | ((got >> 2) & 15).astype(np.uint64), got & 3
        else:
            out, turn = out << np.uint64(8) | (got >> 2).astype(np.uint64), got & 3
    return (out << np.uint64(1) | np.uint64(1)).view(np.int64)


def lsb(c: int) -> int:
    return c & -c


def is_valid(cell: int) -> bool:
    c = cell & MASK
    return c >> 61 < 6 and bool(lsb(c) & 0x1555555555555555)


def level(cell: int) -> int:
    return LEVELS - (lsb(cell & MASK).bit_length() - 1) // 2 if is_valid(cell) else -1


def signed(c: int) -> int:
    c &= MASK
    return c - (1 << 64) if c >> 63 else c


def parent(cell: int, at: int) -> int:
    """At a level, or so many levels up where negative; the sentinel where there is none."""
    own = level(cell)
    at = own + at if at < 0 else at
    if own < 0 or not 0 <= at <= own:
        return SENTINEL
    bit = 1 << (2 * (LEVELS - at))
    return signed((cell & MASK) & -bit | bit)


def child(cell: int, k: int) -> int:
    c = cell & MASK
    return signed(c + (2 * k - 3) * (lsb(c) >> 2)) if 0 <= k < 4 else SENTINEL


def of_face(face: int) -> int:
    return signed((face << 61) + (1 << 60))


def face_ij(cell: int) -> tuple[int, int, int]:
    """Face and the (i, j) of a leaf inside the cell."""
    c = cell & MASK
    face, turn, i, j = c >> 61, (c >> 61) & 1, 0, 0
    for k in range(7, -1, -1):
        bits = 2 if k == 7 else 4
        got = int(BACK[((c >> (8 * k + 1)) & ((1 << (2 * bits)) - 1)) << 2 | turn])
        i, j, turn = i | (got >> 6) << (4 * k), j | ((got >> 2) & 15) << (4 * k), got & 3
    return face, i, j


def uv_box(cell: int) -> tuple[int, float, float, float, float]:
    face, i, j = face_ij(cell)
    size = 1 << (LEVELS - level(cell))
    i, j = i & -size, j & -size
    s = np.array([i, i + size, j, j + size], float) / (1 << LEVELS)
    return (face, *map(float, st_to_uv(s)))


def center(cell: int) -> np.ndarray:
    face, i, j = face_ij(cell)
    size = 1 << (LEVELS - level(cell))
    i, j = (i & -size) + size / 2, (j & -size) + size / 2
    return S.unit(uv_vector(face, st_to_uv(np.float64(i / (1 << LEVELS))), st_to_uv(np.float64(j / (1 << LEVELS)))))


def corners(cell: int) -> np.ndarray:
    """(4, 3), counter-clockwise from the lower left."""
    face, u0, u1, v0, v1 = uv_box(cell)
    return S.unit(uv_vector(face, np.array([u0, u1, u1, u0]), np.array([v0, v0, v1, v1])))


def area(cell: int) -> float:
    if not is_valid(cell):
        return math.nan
    if level(cell) == 0:
        return 4 * math.pi / 6
    c = corners(cell)
    return float(S.triangle_area(c[0], c[1], c[2]) + S.triangle_area(c[0], c[2], c[3]))


def area_approx(cell: int) -> float:
    """The flat quadrilateral of the corners, bulged to the sphere."""
    if not is_valid(cell):
        return math.nan
    if level(cell) < 2:
        return 4 * math.pi / (6 * 4 ** level(cell))
    c = corners(cell)
    flat = 0.5 * np.linalg.norm(S.cross(c[2] - c[0], c[3] - c[1]))
    return float(flat * 2 / (1 + math.sqrt(1 - min(flat / math.pi, 1))))


def edge_neighbor(cell: int, k: int) -> int:
    """Across the lower, right, upper or left edge."""
    if not is_valid(cell) or not 0 <= k < 4:
        return SENTINEL
    face, u0, u1, v0, v1 = uv_box(cell)
    size = 1.0 / (1 << level(cell))
    um, vm = center_uv(cell)
    tiny = 1e-3 * size
    u, v = ((um, v0 - tiny), (u1 + tiny, vm), (um, v1 + tiny), (u0 - tiny, vm))[k]
    return parent(int(from_vectors(S.unit(uv_vector(face, u, v))[None])[0]), level(cell))


def center_uv(cell: int) -> tuple[float, float]:
    face, i, j = face_ij(cell)
    size = 1 << (LEVELS - level(cell))
    return tuple(float(st_to_uv(np.float64(((x & -size) + size / 2) / (1 << LEVELS)))) for x in (i, j))


def contains(a: int, b: int) -> bool:
    if not is_valid(a) or not is_valid(b):
        return False
    low = lsb(a & MASK) - 1
    return (a & MASK) - low <= (b & MASK) <= (a & MASK) + low


def may_intersect(a: int, b: int) -> bool:
    return contains(a, b) or contains(b, a)


def common_ancestor_level(a: int, b: int) -> int:
    if not is_valid(a) or not is_valid(b):
        return -1
    bits = max((a ^ b) & MASK, lsb(a & MASK), lsb(b & MASK))
    top = bits.bit_length() - 1
    return -1 if top > 60 else (60 - top) // 2


def cell_shape(cell: int):
    """A cell as a Shape: edges are geodesics as they are in the cell."""
    from .geometry import polygon, vertices
    from .kernels import Shape

    c = S.lnglat(corners(cell))
    return Shape(polygon([vertices([*c, c[0]])]))


def distance(a: int, b: int) -> float:
    from .kernels import closest

    if not is_valid(a) or not is_valid(b):
        return math.nan
    return 0.0 if may_intersect(a, b) else closest(cell_shape(a), cell_shape(b))[0]


def max_distance(a: int, b: int) -> float:
    if not is_valid(a) or not is_valid(b):
        return math.nan
    from .kernels import closest, farthest

    x, y = cell_shape(a), cell_shape(b)
    far = cell_shape(a)
    far.polygons = [[-r[::-1] for r in p] for p in x.polygons]
    far.regions = [S.Region(p) for p in far.polygons]
    met = closest(far, y)
    return math.pi if met and met[0] == 0 else farthest(x, y)[0]


def to_token(cell: int) -> str:
    c = cell & MASK
    return f"{c:016x}".rstrip("0") if c else "X"


def from_token(token: str) -> int:
    try:
        return signed(int(token.ljust(16, "0"), 16)) if 0 < len(token) <= 16 and token not in ("X", "x") else 0
    except ValueError:
        return 0


def to_debug(cell: int) -> str:
    c = cell & MASK
    if not is_valid(cell):
        return f"(invalid: {c:016x})"
    return f"{c >> 61}/" + "".join(str((c >> (61 - 2 * k)) & 3) for k in range(1, level(cell) + 1))


def from_debug(text: str) -> int:
    if len(text) < 2 or text[1] != "/" or text[0] not in "012345" or len(text) > 32 or set(text[2:]) - set("0123"):
        return 0
    c = of_face(int(text[0]))
    for d in text[2:]:
        c = child(c, int(d))
    return c


# Many cells at once: as the functions above, for valid cells ---------------------------------------


def are_valid(c: np.ndarray) -> np.ndarray:
    return (c.view(np.uint64) >> np.uint64(61) < 6) & ((c & -c) & 0x1555555555555555 != 0)


def levels(c: np.ndarray) -> np.ndarray:
    return LEVELS - (np.frexp((c & -c).astype(float))[1] - 1) // 2


def faces_ij(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = c.view(np.uint64)
    face = (u >> np.uint64(61)).astype(np.int64)
    turn, i, j = face & 1, np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for k in range(7, -1, -1):
        bits = 2 if k == 7 else 4
        got = BACK[((u >> np.uint64(8 * k + 1)).astype(np.int64) & ((1 << (2 * bits)) - 1)) << 2 | turn]
        i, j, turn = i | got >> 6 << (4 * k), j | (got >> 2 & 15) << (4 * k), got & 3
    return face, i, j


def uv_vectors(face: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    one = np.ones_like(u)
    return np.stack((np.choose(face, (one, -u, -u, -one, v, v)), np.choose(face, (u, one, -v, -v, -one, u)), np.choose(face, (v, v, one, -u, -u, -one))), -1)


def uv_of(c: np.ndarray, *parts: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The face, and (u, v) at so many parts of the cell's width from its lower left."""
    face, i, j = faces_ij(c)
    size = np.int64(1) << (LEVELS - levels(c)).astype(np.int64)
    at = lambda x, part: st_to_uv(((x & -size) + size * part) / (1 << LEVELS))
    return face, [(at(i, part), at(j, part)) for part in parts]


def centers(c: np.ndarray) -> np.ndarray:
    face, (middle,) = uv_of(c, 0.5)
    return S.unit(uv_vectors(face, *middle))


def vertices_of(c: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th of each cell's ``corners``."""
    face, (low, high) = uv_of(c, 0.0, 1.0)
    right, upper = (k == 1) | (k == 2), k > 1
    return S.unit(uv_vectors(face, np.where(right, high[0], low[0]), np.where(upper, high[1], low[1])))


def edge_neighbors(c: np.ndarray, k: np.ndarray) -> np.ndarray:
    face, (low, middle, high) = uv_of(c, 0.0, 0.5, 1.0)
    own = levels(c).astype(np.int64)
    tiny = 1e-3 * (1.0 / (np.int64(1) << own))
    u = np.choose(k, (middle[0], high[0] + tiny, middle[0], low[0] - tiny))
    v = np.choose(k, (low[1] - tiny, middle[1], high[1] + tiny, middle[1]))
    bit = np.int64(1) << (2 * (LEVELS - own))
    return from_vectors(S.unit(uv_vectors(face, u, v))) & -bit | bit


# Coverings ---------------------------------------------------------------------------------------


def relation(shape, cell: int) -> int:
    """-1 apart, 0 overlapping, 1 the cell lies inside a polygon of the shape.

    Without an edge that ends in the cell, crosses its rim or touches a corner, the cell is on one side as a whole.
    """
    c = corners(cell)
    d = np.roll(c, -1, 0)
    mid = S.unit(c.sum(0))
    p, q = shape.edges
    if len(p):
        near = S.angle(mid, S.project(mid, p, q)) <= float(S.angle(mid, c).max()) + 1e-15
        if near.any():
            p, q, rim = p[near], q[near], S.cross(c, d)
            if (p @ rim.T >= -1e-15).all(1).any() or (q @ rim.T >= -1e-15).all(1).any() or S.crossings(p, q, c, d).any():
                return 0
            if (S.angle(c[:, None], S.project(c[:, None], p[None], q[None])) <= S.TOUCH).any():
                return 0
    return 1 if shape.polygons and shape.covers(mid[None])[0] == 1 else -1


def covering(shape, max_cells: int = 8, min_level: int = 0, max_level: int = LEVELS, interior: bool = False) -> list[int]:
    """Cells that together hold the shape (or lie inside it), the largest cells split first while the number allows."""
    if shape.is_empty and not shape.single:
        return []
    if not shape.chains and not shape.g.polygons:
        leaves = np.unique(from_vectors(np.concatenate([shape.points, *shape.single])))
        if len(leaves) <= max_cells:
            return sorted({parent(int(c), max_level) for c in leaves}, key=lambda c: c & MASK)
    done, heap = [], []

    def push(cell: int) -> None:
        r = relation(shape, cell)
        if r >= 0:
            heapq.heappush(heap, (level(cell), cell & MASK, cell, r))

    for f in range(6):
        push(of_face(f))
    while heap:
        depth, _, cell, r = heapq.heappop(heap)
        if r == 1 and depth >= min_level:
            done.append(cell)
            if interior and len(done) >= max_cells:
                break
            continue
        if depth >= max_level:
            if not interior:
                done.append(cell)
            continue
        below = [(c, x) for c in (child(cell, k) for k in range(4)) if (x := relation(shape, c)) >= 0]
        if interior:
            if depth >= 12 and not done and len(heap) > 4000:
                break
            for c, x in below:
                heapq.heappush(heap, (depth + 1, c & MASK, c, x))
        elif depth < min_level or len(done) + len(heap) + len(below) <= max_cells:
            for c, x in below:
                heapq.heappush(heap, (depth + 1, c & MASK, c, x))
        else:
            done.append(cell)
    return sorted(done, key=lambda c: c & MASK)


def largest_inner_cell(shape) -> np.ndarray | None:
    """The centre of the largest cell inside the polygons, the first along the curve among those of one level."""
    frontier = [c for c in map(of_face, range(6)) if relation(shape, c) >= 0]
    for _ in range(LEVELS):
        inner = [c for c in frontier if relation(shape, c) == 1]
        if inner:
            return center(min(inner, key=lambda c: c & MASK))
        below = [child(c, k) for c in frontier for k in range(4)]
        frontier = [c for c in below if relation(shape, c) >= 0]
        if len(frontier) > 4096:
            return None
    return None


def buffered_covering(shape, radius: float, max_cells: int = 8, max_level: int = LEVELS) -> list[int]:
    """Cells that hold all points within ``radius`` radians of the shape."""
    from .kernels import closest

    if shape.is_empty:
        return []

    def near(cell: int) -> bool:
        found = closest(shape, cell_shape(cell))
        return found is not None and found[0] <= radius

    done, heap = [], [(0, of_face(f) & MASK, of_face(f)) for f in range(6) if near(of_face(f))]
    heapq.heapify(heap)
    while heap:
        depth, _, cell = heapq.heappop(heap)
        below = [c for c in (child(cell, k) for k in range(4)) if near(c)] if depth < max_level else []
        if below and len(done) + len(heap) + len(below) <= max_cells:
            for c in below:
                heapq.heappush(heap, (depth + 1, c & MASK, c))
        else:
            done.append(cell)
    return sorted(done, key=lambda c: c & MASK)
