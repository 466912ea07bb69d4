"""Column builders that stay in the JVM: points, projections, cells, and sums over arrays of vertices.

Points are structs (lng, lat) in degrees or (x, y, z); everything here compiles to plain expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbita.geo.cells import FORTH

#: The fixed radius of the sphere in metres, and half the width of the Mercator square.
RADIUS, MERCATOR = 6371010.0, 20037508.3427892
LEAF_LEVEL, SENTINEL = 30, -1


def point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))


def to_xyz(lng: Column, lat: Column) -> Column:
    """The unit vector; nothing is clamped or wrapped."""
    c = F.cos(F.radians(lat))
    return F.struct((F.cos(F.radians(lng)) * c).alias("x"), (F.sin(F.radians(lng)) * c).alias("y"), F.sin(F.radians(lat)).alias("z"))


def to_lnglat(v: Column) -> Column:
    return F.struct(F.degrees(F.atan2(v["y"], v["x"])).alias("lng"), F.degrees(F.atan2(v["z"], F.hypot(v["x"], v["y"]))).alias("lat"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def angle(a: Column, b: Column) -> Column:
    """Radians between unit vectors, from their chord."""
    chord = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(a["z"] - b["z"], 2))
    return 2 * F.asin(F.least(F.lit(1.0), chord / 2))


def distance(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres between points; null if anything is."""
    return angle(to_xyz(lng1, lat1), to_xyz(lng2, lat2)) * RADIUS


def dwithin(lng1: Column, lat1: Column, lng2: Column, lat2: Column, metres: Column | float) -> Column:
    return (F.lit(metres) >= 0) & (distance(lng1, lat1, lng2, lat2) <= F.lit(metres))


def inside_convex(v: Column, corners: list[Column]) -> Column:
    """A vector strictly inside a convex counter-clockwise ring of vectors: left of every edge.

    Written as a . (b x v): on an edge rounding decides, so that the order of the operations is part of the result.
    """
    found = F.lit(True)
    for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
        found = found & (dot(a, cross(b, v)) > 0)
    return found


def vectors(points: Column) -> Column:
    """array<struct<lng, lat>> to array<struct<x, y, z>>."""
    return F.transform(points, lambda p: to_xyz(p["lng"], p["lat"]))


def chain_length(points: Column) -> Column:
    """Metres along an array of (lng, lat); 0 for fewer than two."""
    v = vectors(points)
    steps = F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), angle)
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x) * RADIUS


def ring_area(points: Column) -> Column:
    """Square metres inside a ring of (lng, lat), first vertex repeated at the end; the smaller side counts."""
    v = vectors(points)
    a = F.get(v, F.lit(0))
    pairs = F.zip_with(F.slice(v, 2, F.size(v) - 2), F.slice(v, 3, F.size(v) - 2), lambda b, c: 2 * F.atan2(dot(a, cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a)))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)) * RADIUS**2


# Projections -------------------------------------------------------------------------------------


def mercator(lng: Column, lat: Column) -> Column:
    return F.struct((lng * MERCATOR / 180).alias("x"), (F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR / math.pi).alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    return F.struct((x * 180 / MERCATOR).alias("lng"), F.degrees(2 * F.atan(F.exp(y * math.pi / MERCATOR)) - math.pi / 2).alias("lat"))


def plate_carree(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("x"), lat.alias("y"))


def orthographic(lng: Column, lat: Column, center_lng: float, center_lat: float) -> Column:
    """Seen from above the centre; NaN on the far side."""
    d, a, b = F.radians(lng - center_lng), F.radians(lat), math.radians(center_lat)
    near = math.sin(b) * F.sin(a) + math.cos(b) * F.cos(a) * F.cos(d)
    side = lambda x: F.when(near >= 0, x).otherwise(F.lit(float("nan")))
    return F.struct(side(F.cos(a) * F.sin(d)).alias("x"), side(math.cos(b) * F.sin(a) - math.sin(b) * F.cos(a) * F.cos(d)).alias("y"))


def from_orthographic(x: Column, y: Column, center_lng: float, center_lat: float) -> Column:
    b = math.radians(center_lat)
    z = F.sqrt(1 - x * x - y * y)
    lat = F.asin(y * math.cos(b) + z * math.sin(b))
    lng = center_lng + F.degrees(F.atan2(x, z * math.cos(b) - y * math.sin(b)))
    return F.struct(F.when(lng > 180, lng - 360).when(lng < -180, lng + 360).otherwise(lng).alias("lng"), F.degrees(lat).alias("lat"))


# Cells -------------------------------------------------------------------------------------------


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cell_of(lng: Column, lat: Column) -> Column:
    """The leaf cell of a point as a signed 64-bit id: face, then the curve four levels at a time by a constant table.

    ``registry.cells`` gives the same by numpy over batches, which is faster; this one needs no Python.
    """
    size, table = 1 << LEAF_LEVEL, F.lit(FORTH.tolist())

    def face(v: Column) -> Column:
        ax, ay, az = F.abs(v["x"]), F.abs(v["y"]), F.abs(v["z"])
        return F.when((ax >= ay) & (ax >= az), F.when(v["x"] < 0, 3).otherwise(0)).when(ay >= az, F.when(v["y"] < 0, 4).otherwise(1)).otherwise(F.when(v["z"] < 0, 5).otherwise(2))

    def projected(v: Column) -> Column:
        """The coordinate that is largest divides the other two, with signs by face."""
        x, y, z = v["x"], v["y"], v["z"]
        on = lambda p, q: F.struct(v["f"].alias("f"), p.alias("u"), q.alias("w"))
        return F.when(v["f"] == 0, on(y / x, z / x)).when(v["f"] == 1, on(-x / y, z / y)).when(v["f"] == 2, on(-x / z, -y / z)).when(v["f"] == 3, on(z / x, y / x)).when(v["f"] == 4, on(z / y, -x / y)).otherwise(on(-y / z, -x / z))

    def gridded(p: Column) -> Column:
        st = lambda u: F.when(u >= 0, 0.5 * F.sqrt(1 + 3 * F.abs(u))).otherwise(1 - 0.5 * F.sqrt(1 + 3 * F.abs(u)))
        grid = lambda u: F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor(st(u) * size).cast("int")))
        return F.struct(grid(p["u"]).alias("i"), grid(p["w"]).alias("j"), (p["f"] % 2).cast("int").alias("turn"), p["f"].cast("long").alias("id"), p["f"].cast("long").alias("f"))

    def step(state: Column, k: Column) -> Column:
        nibble = lambda c: F.call_function("shiftright", state[c], k * 4).bitwiseAND(15)
        got = F.get(table, (nibble("i") * 64 + nibble("j") * 4 + state["turn"]).cast("int"))
        return let(got, lambda g: F.struct(state["i"].alias("i"), state["j"].alias("j"), g.bitwiseAND(3).cast("int").alias("turn"), F.shiftleft(state["id"], 8).bitwiseOR(F.shiftright(g, 2).bitwiseAND(255)).alias("id"), state["f"].alias("f")))

    # the first of eight steps has two levels only: its four upper bits are zero, and the face is put in again
    packed = lambda e: F.shiftleft(e["f"], 61).bitwiseOR(F.shiftleft(e["id"].bitwiseAND((1 << 60) - 1), 1)).bitwiseOR(F.lit(1).cast("long"))
    walked = lambda g: F.aggregate(F.array(*[F.lit(k) for k in range(7, -1, -1)]), g, step, packed)
    found = let(let(let(let(to_xyz(lng, lat), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), face(v).alias("f"))), projected), gridded), walked)
    return F.when(lng.isNull() | lat.isNull(), F.lit(None)).when(F.isnan(lng) | F.isnan(lat), F.lit(SENTINEL).cast("long")).otherwise(found)


def leaf_parent(leaf: Column, at: int) -> Column:
    """The ancestor of a leaf cell at a fixed level: two bit operations."""
    bit = 1 << (2 * (LEAF_LEVEL - at))
    return leaf.bitwiseAND(F.lit(-bit).cast("long")).bitwiseOR(F.lit(bit).cast("long"))


def lowest_bit(cell: Column) -> Column:
    """The marker bit; written so that it never overflows."""
    return cell.bitwiseAND(F.bitwise_not(cell) + F.when(cell == 0, 0).otherwise(1))


def is_valid(cell: Column) -> Column:
    return (F.shiftrightunsigned(cell, 61) < 6) & (lowest_bit(cell).bitwiseAND(0x1555555555555555) != 0)


def level(cell: Column) -> Column:
    """-1 for an invalid cell."""
    return F.when(is_valid(cell), LEAF_LEVEL - F.floor(F.bit_count(lowest_bit(cell) - 1) / 2)).otherwise(-1).cast("int")


def bit_of(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (LEAF_LEVEL - at)).cast("int"))


def parent(cell: Column, at: int | Column) -> Column:
    """At a level, or so many levels up where negative; the sentinel where there is none."""
    at = F.lit(at) if isinstance(at, int) else at
    own = level(cell)
    to = F.when(at < 0, own + at).otherwise(at)
    bit = bit_of(F.greatest(F.lit(0), F.least(to, F.lit(LEAF_LEVEL))))
    return F.when((own >= 0) & (to >= 0) & (to <= own), cell.bitwiseAND(F.bitwise_not(bit - 1)).bitwiseOR(bit)).otherwise(F.lit(SENTINEL).cast("long"))


def child(cell: Column, k: int | Column) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    quarter = F.shiftrightunsigned(lowest_bit(cell), 2)
    moved = F.when(k == 0, cell - 3 * quarter).when(k == 1, cell - quarter).when(k == 2, cell + quarter).when(k == 3, cell + 3 * quarter)
    return F.coalesce(moved, F.lit(SENTINEL).cast("long"))


def range_min(cell: Column) -> Column:
    return cell - (lowest_bit(cell) - 1)


def range_max(cell: Column) -> Column:
    return cell + (lowest_bit(cell) - 1)


def contains(a: Column, b: Column) -> Column:
    """A cell's leaves are one range; it never crosses the sign, so signed comparison holds."""
    return is_valid(a) & is_valid(b) & (b >= range_min(a)) & (b <= range_max(a))


def may_intersect(a: Column, b: Column) -> Column:
    return contains(a, b) | contains(b, a)


def common_ancestor_level(a: Column, b: Column) -> Column:
    """-1 for cells of different faces or invalid ones: the topmost bit in which the ids differ tells."""
    top = F.length(F.bin(F.greatest(a.bitwiseXOR(b), lowest_bit(a), lowest_bit(b)))) - 1
    return F.when(is_valid(a) & is_valid(b) & (a.bitwiseXOR(b) >= 0) & (top <= 60), F.floor((60 - top) / 2)).otherwise(-1).cast("int")


def to_token(cell: Column) -> Column:
    return F.when(cell == 0, "X").otherwise(F.rtrim(F.lower(F.lpad(F.hex(cell), 16, "0")), F.lit("0")))


def from_token(token: Column) -> Column:
    """0 for what is no token."""
    good = token.rlike("^[0-9a-fA-F]{1,16}$")
    wide = F.rpad(token, 16, "0")
    high, low = F.conv(F.substring(wide, 1, 8), 16, 10).cast("long"), F.conv(F.substring(wide, 9, 8), 16, 10).cast("long")
    return F.when(good, F.shiftleft(high, 32).bitwiseOR(low)).otherwise(F.lit(0).cast("long"))


def to_debug(cell: Column) -> Column:
    """Face and the digits of the levels."""
    digits = F.transform(F.sequence(F.lit(1), F.greatest(level(cell), F.lit(1))), lambda k: F.call_function("shiftrightunsigned", cell, (61 - 2 * k).cast("int")).bitwiseAND(3).cast("string"))
    text = F.concat(F.shiftrightunsigned(cell, 61).cast("string"), F.lit("/"), F.when(level(cell) > 0, F.array_join(digits, "")).otherwise(""))
    return F.when(is_valid(cell), text).otherwise(F.concat(F.lit("(invalid: "), F.lower(F.lpad(F.hex(cell), 16, "0")), F.lit(")")))
