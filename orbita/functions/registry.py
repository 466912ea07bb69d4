"""The st_* and s2_* functions over WKB columns, as Columns and as SQL functions.

Every function is an Arrow-backed UDF over batches: a null argument gives null, equal WKB values are decoded once (so
a literal is prepared once for a task), and calls with nothing but constants can be folded with ``evaluate``. Plain
points, plain lines and cells are answered a batch at a time where ``batches`` has a form of the kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from orbita import ship
from orbita.functions import batches
from orbita.geo import cells, kernels, overlay
from orbita.geo import sphere as S
from orbita.geo.geometry import COLLECTION, POLYGON, Geography, GeographyError, from_wkb, from_wkt, point, polygon, to_wkb, to_wkt, vertices
from orbita.geo.kernels import Shape

BOX = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
XYZ = "struct<x: double, y: double, z: double>"


@lru_cache(maxsize=4096)
def shape_of(wkb: bytes) -> Shape:
    return Shape(from_wkb(wkb))


@dataclass(frozen=True)
class Kernel:
    """``kinds``: g geography, d double, i integer, s string, c cell, x cell array; a later one may be left out where ``least`` is smaller."""

    name: str
    kinds: str
    returns: str
    run: Callable
    least: int | None = None

    def __call__(self, *args):
        """One row."""
        n = len(self.kinds) if self.least is None else self.least
        if not n <= len(args) <= len(self.kinds):
            raise TypeError(f"{self.name} takes {n} to {len(self.kinds)} arguments")
        if any(a is None or (isinstance(a, float) and math.isnan(a) and k in "gsic") for a, k in zip(args, self.kinds, strict=False)):
            return None
        ready = [shape_of(bytes(a)) if k == "g" else int(a) if k in "ic" and not isinstance(a, str) else a for a, k in zip(args, self.kinds, strict=False)]
        out = self.run(*ready)
        return to_wkb(out) if isinstance(out, Geography) else out


KERNELS: dict[str, Kernel] = {}


def kernel(name: str, kinds: str, returns: str, run: Callable, least: int | None = None) -> None:
    KERNELS[name] = Kernel(name, kinds, returns, run, least)


def as_box(b) -> dict | None:
    return None if b is None else dict(zip(("xmin", "ymin", "xmax", "ymax"), map(float, b), strict=True))


def as_xyz(v) -> dict:
    return dict(zip("xyz", map(float, v), strict=True))


def buffer(a: Shape, metres: float, how=None) -> Geography:
    text = "" if how is None else how if isinstance(how, str) else f"quad_segs={int(how)}"
    return overlay.buffer(a.g, float(metres), text)


def cell_id(a: Shape) -> int | None:
    if a.is_empty:
        return None
    if len(a.points) != 1 or a.chains or a.polygons:
        raise GeographyError("expected a single point")
    return int(cells.from_vectors(a.points)[0])


def project(a: Shape, name: str) -> Geography:
    """Vertices to the plane: lnglat, mercator or "orthographic lng lat"."""
    import numpy as np

    kind, *center = name.lower().split()

    def move(c):
        out = c.copy()
        if kind == "mercator":
            out[:, 0] = c[:, 0] * 20037508.3427892 / 180
            out[:, 1] = np.log(np.tan(np.pi / 4 + np.radians(c[:, 1]) / 2)) * 20037508.3427892 / np.pi
        elif kind == "orthographic":
            d, p, q = np.radians(c[:, 0] - float(center[0])), np.radians(c[:, 1]), math.radians(float(center[1]))
            far = math.sin(q) * np.sin(p) + math.cos(q) * np.cos(p) * np.cos(d) < 0
            out[:, 0], out[:, 1] = np.cos(p) * np.sin(d), math.cos(q) * np.sin(p) - math.sin(q) * np.cos(p) * np.cos(d)
            out[far, :2] = np.nan
            if far.any() and len(c) > 1:
                raise GeographyError("an edge runs out of the projection")
        elif kind != "lnglat":
            raise GeographyError(f"unknown projection {name}")
        return out

    def walk(g: Geography) -> Geography:
        return Geography(g.type, g.dims, None if g.coords is None else move(g.coords) if len(g.coords) else g.coords, [move(r) for r in g.rings], [walk(p) for p in g.parts])

    return walk(a.g)


def tessellate(a: Shape, metres: float) -> Geography:
    """Edges cut in halves until the plate carrée chord stays within the tolerance of the geodesic."""
    import numpy as np

    def between(p, q, depth=0):
        half = kernels.interpolate_edge(p, q, 0.5)
        flat = (p + q) / 2
        if depth > 20 or float(S.angle(S.xyz(half), S.xyz(flat))) * S.RADIUS <= metres:
            return [q]
        return between(p, half, depth + 1) + between(half, q, depth + 1)

    def walk(g: Geography) -> Geography:
        chain = lambda c: np.array([c[0], *[x for p, q in zip(c[:-1], c[1:], strict=True) for x in between(p, q)]]) if len(c) > 1 else c
        return Geography(g.type, g.dims, None if g.coords is None else chain(g.coords), [chain(r) for r in g.rings], [walk(p) for p in g.parts])

    return walk(a.g)


def centroid_of_parts(a: Shape):
    """Unit vector; of a collection the sum of its parts' unit centroids."""
    if a.g.type == COLLECTION:
        parts = [centroid_of_parts(s) for s in map(Shape, a.g.parts) if not s.is_empty]
        return S.unit(sum(parts)) if parts else kernels.centroid_vector(a)
    return S.unit(kernels.centroid_vector(a))


def hull_polygon(a: Shape) -> Geography:
    """The convex hull as a polygon; of one place a triangle of some micrometres, of an edge one with its middle as a third vertex."""
    import numpy as np

    out = kernels.convex_hull(a)
    v = S.xyz(out.all_vertices())
    if out.type == POLYGON or not len(v):
        return out
    if len(v) == 1:
        across = np.cross(v[0], np.eye(3)[int(np.abs(v[0]).argmin())])
        ring = S.unit(np.stack((v[0], v[0] + 1e-12 * across, v[0] + 1e-12 * np.cross(v[0], across))))
    else:
        ring = np.stack((v[0], S.unit(v[0] + v[-1]), v[-1]))
    return polygon([vertices(S.lnglat(np.concatenate((ring, ring[:1]))))])


def surface_point(a: Shape) -> Geography:
    if not a.is_empty and (a.chains or len(a.points)):
        raise GeographyError("expected polygons only")
    return kernels.point_on_surface(a)


def interpolate_normalized(a: Shape, fraction: float) -> Geography | None:
    """Of an empty geography the zero vector, which has longitude and latitude 0."""
    return point([0.0, 0.0, float("nan"), float("nan")]) if a.is_empty else kernels.line_interpolate(a.g, fraction)


def intersects_box(a: Shape, xmin: float, ymin: float, xmax: float, ymax: float, tolerance: float = 0.1) -> bool:
    """The box follows its parallels within a tolerance in degrees."""
    from orbita.geo.geometry import polygon, vertices

    width = (xmax - xmin) % 360 or (360.0 if xmax != xmin else 0.0)
    steps = max(2, math.ceil(width / max(0.05, math.sqrt(max(tolerance, 1e-6)) * 8)))
    if len(a.points) == 1 and not a.chains and not a.polygons:
        lng, lat = S.lnglat(a.points[0])
        return bool(ymin <= lat <= ymax and (lng - xmin) % 360 <= width)
    low = [(xmin + width * k / steps, ymin) for k in range(steps + 1)]
    high = [(xmin + width * k / steps, ymax) for k in range(steps, -1, -1)]
    return kernels.intersects(a, Shape(polygon([vertices([*low, *high, low[0]])])))


def legacy_measure(a: Shape, dimension: int, value: float) -> float:
    return value if a.g.dimension == dimension and not (dimension == 1 and len(a.points)) else 0.0


def project_normalized(a: Shape, b: Shape) -> float:
    try:
        found = kernels.line_locate(a.g, b.g)
    except GeographyError:
        return math.nan
    return math.nan if found is None else found


def clearance(a: Shape, b: Shape, k: int) -> dict:
    found = kernels.closest(a, b)
    return as_xyz(found[k] if found else (0.0, 0.0, 0.0))


def radians_between(found, missing: float) -> float:
    return missing if found is None else found[0]


def model_contains(a: Shape, b: Shape) -> bool:
    return kernels.contains(a, b)


# The names and argument types of the functions.
kernel("st_area", "g", "double", kernels.area)
kernel("st_centroid", "g", "binary", kernels.centroid)
kernel("st_closestpoint", "gg", "binary", kernels.closest_point)
kernel("st_contains", "gg", "boolean", kernels.contains)
kernel("st_within", "gg", "boolean", lambda a, b: kernels.contains(b, a))
kernel("st_convexhull", "g", "binary", kernels.convex_hull)
kernel("st_difference", "gg", "binary", overlay.difference)
kernel("st_distance", "gg", "double", kernels.distance)
kernel("st_equals", "gg", "boolean", kernels.equals)
kernel("st_intersection", "gg", "binary", overlay.intersection)
kernel("st_intersects", "gg", "boolean", kernels.intersects)
kernel("st_disjoint", "gg", "boolean", lambda a, b: not kernels.intersects(a, b))
kernel("st_length", "g", "double", kernels.length)
kernel("st_lineinterpolatepoint", "gd", "binary", lambda a, f: kernels.line_interpolate(a.g, f))
kernel("st_linelocatepoint", "gg", "double", lambda a, b: kernels.line_locate(a.g, b.g))
kernel("st_maxdistance", "gg", "double", kernels.max_distance)
kernel("st_perimeter", "g", "double", kernels.perimeter)
kernel("st_shortestline", "gg", "binary", kernels.shortest_line)
kernel("st_symdifference", "gg", "binary", overlay.symdifference)
kernel("st_union", "gg", "binary", overlay.union)
kernel("st_reduceprecision", "gd", "binary", lambda a, grid: overlay.reduce_precision(a.g, grid))
kernel("st_simplify", "gd", "binary", lambda a, m: overlay.simplify(a.g, m))
kernel("st_buffer", "gds", "binary", buffer, 2)
kernel("st_dwithin", "ggd", "boolean", kernels.dwithin)
kernel("s2_cellidfrompoint", "g", "bigint", cell_id)
kernel("s2_coveringcellids", "g", "array<bigint>", lambda a: cells.covering(a))
kernel("st_longestline", "gg", "binary", kernels.longest_line)
kernel("st_boundingbox", "g", BOX, lambda a: as_box(kernels.bounds(a)))
kernel("st_pointonsurface", "g", "binary", kernels.point_on_surface)
kernel("st_geogfromwkt", "s", "binary", from_wkt)
kernel("st_geogfromwkb", "g", "binary", lambda a: a.g)
kernel("st_asbinary", "g", "binary", lambda a: a.g)
kernel("st_geogfromtext", "s", "binary", from_wkt)
kernel("st_astext", "gi", "string", lambda a, p=16: to_wkt(a.g, p), 1)
kernel("st_checkwkb", "g", "binary", lambda a: a.g)
kernel("st_isvalid", "g", "boolean", lambda a: kernels.validation_error(a.g) is None)
kernel("st_isvalidreason", "g", "string", lambda a: kernels.validation_error(a.g) or "Valid Geometry")
kernel("st_touches", "gg", "boolean", kernels.touches)
kernel("st_isempty", "g", "boolean", lambda a: a.g.is_empty)
kernel("st_dimension", "g", "int", lambda a: a.g.dimension)
kernel("st_npoints", "g", "int", lambda a: kernels.num_points(a.g))
kernel("st_x", "g", "double", lambda a: kernels.coordinate(a.g, 0))
kernel("st_y", "g", "double", lambda a: kernels.coordinate(a.g, 1))
kernel("st_boundary", "g", "binary", lambda a: kernels.boundary(a.g))
kernel("st_project", "gs", "binary", project)
kernel("st_tessellate", "gd", "binary", tessellate)
kernel("st_unaryunion", "g", "binary", lambda a: overlay.unary_union(a.g))
kernel("s2_distance", "gg", "double", lambda a, b: radians_between(kernels.closest(a, b), math.inf))
kernel("s2_max_distance", "gg", "double", lambda a, b: radians_between(kernels.farthest(a, b), -1.0))
kernel("s2_closest_point", "gg", XYZ, lambda a, b: clearance(a, b, 1))
kernel("s2_clearance_start", "gg", XYZ, lambda a, b: clearance(a, b, 1))
kernel("s2_clearance_end", "gg", XYZ, lambda a, b: clearance(a, b, 2))
kernel("s2_area", "g", "double", lambda a: legacy_measure(a, 2, kernels.area(a) / S.RADIUS**2))
kernel("s2_length", "g", "double", lambda a: legacy_measure(a, 1, kernels.length(a) / S.RADIUS))
kernel("s2_perimeter", "g", "double", lambda a: legacy_measure(a, 2, kernels.perimeter(a) / S.RADIUS))
kernel("s2_dimension", "g", "int", lambda a: a.g.dimension)
kernel("s2_num_points", "g", "int", lambda a: kernels.num_points(a.g))
kernel("s2_is_empty", "g", "boolean", lambda a: a.g.is_empty)
kernel("s2_is_collection", "g", "boolean", lambda a: kernels.is_collection(a.g))
kernel("s2_x", "g", "double", lambda a: kernels.coordinate(a.g, 0))
kernel("s2_y", "g", "double", lambda a: kernels.coordinate(a.g, 1))
kernel("s2_find_validation_error", "g", "string", lambda a: kernels.validation_error(a.g))
kernel("s2_centroid", "g", XYZ, lambda a: as_xyz(centroid_of_parts(a)))
kernel("s2_boundary", "g", "binary", lambda a: kernels.boundary(a.g))
kernel("s2_convex_hull", "g", "binary", hull_polygon)
kernel("s2_point_on_surface", "g", "binary", surface_point)
kernel("s2_intersects", "gg", "boolean", kernels.intersects)
kernel("s2_equals", "gg", "boolean", kernels.equals)
kernel("s2_contains", "gg", "boolean", kernels.contains)
kernel("s2_touches", "gg", "boolean", kernels.touches)
kernel("s2_intersects_box", "gddddd", "boolean", intersects_box, 5)
kernel("s2_boolean_operation", "ggs", "binary", lambda a, b, op: {"union": overlay.union, "intersection": overlay.intersection, "difference": overlay.difference, "symmetric_difference": overlay.symdifference}[op.lower()](a, b))
kernel("s2_unary_union", "g", "binary", lambda a: overlay.unary_union(a.g))
kernel("s2_rebuild", "gsss", "binary", lambda a, *layers: overlay.rebuild(a.g, *layers), 1)
kernel("s2_build_point", "g", "binary", lambda a: overlay.rebuild(a.g, "include", "error", "error"))
kernel("s2_build_polyline", "g", "binary", lambda a: overlay.rebuild(a.g, "error", "include", "error"))
kernel("s2_build_polygon", "g", "binary", lambda a: overlay.rebuild(a.g, "error", "error", "include"))
kernel("s2_project_normalized", "gg", "double", project_normalized)
kernel("s2_interpolate_normalized", "gd", "binary", interpolate_normalized)
kernel("s2_covering", "giii", "array<bigint>", lambda a, n=8, low=0, high=30: cells.covering(a, n, low, high), 1)
kernel("s2_interior_covering", "gii", "array<bigint>", lambda a, n=8, high=12: cells.covering(a, n, 0, high, True), 1)
kernel("s2_covering_buffered", "gdi", "array<bigint>", lambda a, r, n=8: cells.buffered_covering(a, r, n), 2)
kernel("s2_cell_center", "c", XYZ, lambda c: as_xyz(cells.center(c) if cells.is_valid(c) else [math.nan] * 3))
kernel("s2_cell_to_point", "c", XYZ, lambda c: as_xyz(cells.center(c) if cells.is_valid(c) else [math.nan] * 3))
kernel("s2_cell_vertex", "ci", XYZ, lambda c, k: as_xyz(cells.corners(c)[k % 4] if cells.is_valid(c) and k >= 0 else [math.nan] * 3))
kernel("s2_cell_area", "c", "double", cells.area)
kernel("s2_cell_area_approx", "c", "double", cells.area_approx)
kernel("s2_cell_edge_neighbor", "ci", "bigint", cells.edge_neighbor)
kernel("s2_cell_distance", "cc", "double", cells.distance)
kernel("s2_cell_max_distance", "cc", "double", cells.max_distance)
kernel("s2_cell_from_debug_string", "s", "bigint", cells.from_debug)
kernel("s2_cell_to_debug_string", "c", "string", cells.to_debug)
kernel("s2_cell_from_token", "s", "bigint", cells.from_token)
kernel("s2_cell_to_token", "c", "string", cells.to_token)
kernel("s2_cell_is_valid", "c", "boolean", cells.is_valid)
kernel("s2_cell_level", "c", "int", cells.level)
kernel("s2_cell_parent", "ci", "bigint", cells.parent)
kernel("s2_cell_child", "ci", "bigint", cells.child)
kernel("s2_cell_contains", "cc", "boolean", cells.contains)
kernel("s2_cell_may_intersect", "cc", "boolean", cells.may_intersect)
kernel("s2_cell_common_ancestor_level", "cc", "int", cells.common_ancestor_level)


ARROW = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
ARROW |= {t: pa.struct([(c, pa.float64()) for c in names]) for t, names in ((BOX, ("xmin", "ymin", "xmax", "ymax")), (XYZ, "xyz"))}


def over_batch(name: str, columns: list[pa.Array]) -> pa.Array:
    """A call over a batch: by ``batches`` where that has an answer, by the kernel for the other rows."""
    k = KERNELS[name]
    to = ARROW[k.returns]
    done, values = batches.BATCHES[name](*columns)
    if done.all():
        return values.cast(to)
    rest = np.flatnonzero(~done)
    one = [k(*[None if _missing(v) else v for v in row]) for row in zip(*[c.take(pa.array(rest)).to_pylist() for c in columns], strict=True)]
    order = np.argsort(np.concatenate((np.flatnonzero(done), rest)))
    return pa.concat_arrays([values.cast(to), pa.array(one, to)]).take(pa.array(order))


@cache
def udf(name: str):
    k = KERNELS[name]
    struct = k.returns.startswith("struct")
    if name in batches.BATCHES:

        def arrays(*columns: pa.Array) -> pa.Array:
            return over_batch(name, columns)

        arrays.__annotations__ = {"columns": pa.Array, "return": pa.Array}
        return F.arrow_udf(arrays, k.returns)

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([k(*[None if _missing(v) else v for v in row]) for row in zip(*columns, strict=True)], dtype=object)

    def batch_of_structs(*columns: pd.Series) -> pd.DataFrame:
        names = [part.split(":")[0].strip() for part in k.returns[7:-1].split(",")]
        rows = [k(*[None if _missing(v) else v for v in row]) for row in zip(*columns, strict=True)]
        return pd.DataFrame([[None if r is None else r[n] for n in names] for r in rows], columns=names, dtype="float64")

    out = F.pandas_udf(batch_of_structs if struct else batch, k.returns)
    return out


def _missing(v) -> bool:
    return v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v))


def call(name: str, *args: Column | bytes | float | int | str) -> Column:
    """A Column; plain Python values are literals, and a call with nothing else is evaluated at once."""
    if not any(isinstance(a, Column) for a in args):
        out = KERNELS[name](*args)
        return F.lit(out) if not isinstance(out, (dict, list)) else F.from_json(F.lit(__import__("json").dumps(out)), KERNELS[name].returns)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship.ensure(spark)
    out = udf(name)(*[a if isinstance(a, Column) else F.lit(a) for a in args])
    if KERNELS[name].returns == BOX:  # an empty box comes back as a struct of nulls
        out = F.when(out["xmin"].isNotNull(), out)
    return out


@cache
def _cells_udf():
    def leaves(lng: pd.Series, lat: pd.Series) -> pd.Series:
        at = np.stack((lng.to_numpy(float), lat.to_numpy(float)), 1)
        good = np.isfinite(at).all(1)
        out = np.full(len(at), cells.SENTINEL, np.int64)
        out[good] = cells.from_vectors(S.xyz(at[good]))
        return pd.Series(out)

    return F.pandas_udf(leaves, "bigint")


def leaf_cells(lng: Column, lat: Column) -> Column:
    """``native.cell_of`` by numpy over batches of points; NaN gives the sentinel, null gives null."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship.ensure(spark)
    return F.when(lng.isNotNull() & lat.isNotNull(), _cells_udf()(lng, lat))


@cache
def _wkb_udf(lines: bool):
    def of_points(lng: pa.Array, lat: pa.Array) -> pa.Array:
        return batches.point_wkb(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (lng, lat)], 1))

    def of_lines(stops: pa.Array) -> pa.Array:
        xy = np.stack([c.to_numpy(zero_copy_only=False) for c in stops.values.flatten()[:2]], 1)
        return batches.lines_wkb(stops.offsets.to_numpy(), xy)

    of_points.__annotations__ = {"lng": pa.Array, "lat": pa.Array, "return": pa.Array}
    of_lines.__annotations__ = {"stops": pa.Array, "return": pa.Array}
    return F.arrow_udf(of_lines if lines else of_points, "binary")


def point_wkb(lng: Column, lat: Column) -> Column:
    """WKB of points; null gives null, NaN an empty point."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship.ensure(spark)
    return F.when(lng.isNotNull() & lat.isNotNull(), _wkb_udf(False)(lng.cast("double"), lat.cast("double")))


def line_wkb(stops: Column) -> Column:
    """WKB of a line through an array of (lng, lat) without nulls."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship.ensure(spark)
    return F.when(stops.isNotNull(), _wkb_udf(True)(stops))


@cache
def _vectors_udf():
    def vectors(lng: pd.Series, lat: pd.Series) -> pd.DataFrame:
        at = [(c.to_numpy(float) * (math.pi / 180)).tolist() for c in (lng, lat)]
        of = lambda f, c: np.array([f(x) if math.isfinite(x) else math.nan for x in c])
        cos = of(math.cos, at[1])
        return pd.DataFrame({"x": of(math.cos, at[0]) * cos, "y": of(math.sin, at[0]) * cos, "z": of(math.sin, at[1])})

    vectors.__annotations__ = {"lng": pd.Series, "lat": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(vectors, XYZ)


def unit_vectors(lng: Column, lat: Column) -> Column:
    """``native.to_xyz`` by the C library's sines, as SQL engines take them; the JVM's differ in the last bit now and then.

    That bit decides for points on an edge. Null gives null.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship.ensure(spark)
    return F.when(lng.isNotNull() & lat.isNotNull(), _vectors_udf()(lng, lat))


def register_all(spark: SparkSession) -> list[str]:
    """Every function under its SQL name in this session."""
    ship.ensure(spark)
    for name in KERNELS:
        spark.udf.register(name, udf(name))
    return list(KERNELS)


def __getattr__(name: str) -> Callable:
    if name in KERNELS:
        return lambda *args: call(name, *args)
    raise AttributeError(name)
