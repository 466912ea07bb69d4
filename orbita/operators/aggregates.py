"""Geography aggregates in two stages: partial results by salted group, then one for each group.

Sums and extremes are built-in aggregates with map-side partials. Hull, union, rebuild and bounds are associative:
``groupBy(key, salt)`` bounds what a task holds, ``groupBy(key)`` joins the partial results.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbita import ship
from orbita.functions import native, registry
from orbita.functions.registry import BOX, shape_of
from orbita.geo import kernels, overlay
from orbita.geo.geometry import Geography, from_wkb, to_wkb

#: Partial groups of a key in the first stage, and features that one call takes at once.
SALTS = 16


def centroid_sums(lng: Column, lat: Column) -> list[Column]:
    """Sums of unit vectors; nulls are skipped."""
    v = native.to_xyz(lng, lat)
    return [F.sum(v[c]).alias(f"s{c}") for c in "xyz"]


def centroid_agg(df: DataFrame, keys: list[str], lng: str, lat: str) -> DataFrame:
    """The centroid of points for each key as (lng, lat); null where the vectors cancel or there are none."""
    sums = df.groupBy(*keys).agg(*centroid_sums(F.col(lng), F.col(lat)))
    norm = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    at = native.to_lnglat(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")))
    return sums.select(*keys, F.when(norm > 0, at["lng"]).alias("lng"), F.when(norm > 0, at["lat"]).alias("lat"))


def two_stage(df: DataFrame, keys: list[str], geog: str, combine: Callable[[list[bytes]], bytes | None], salts: int = SALTS) -> DataFrame:
    """(keys, geog): ``combine`` over features and then over its own results."""
    ship.ensure(df.sparkSession)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> bytes:
        return combine([bytes(x) for x in column if x is not None])

    salted = df.select(*keys, geog, F.pmod(F.xxhash64(geog), F.lit(salts)).alias("_salt"))
    partial = salted.groupBy(*keys, "_salt").agg(run(F.col(geog)).alias(geog))
    return partial.groupBy(*keys).agg(run(F.col(geog)).alias(geog))


def hull_of_all(features: list[bytes]) -> bytes:
    import numpy as np

    coords = [from_wkb(f).all_vertices() for f in features]
    coords = np.concatenate(coords) if coords else np.zeros((0, 4))
    from orbita.geo import sphere as S

    return to_wkb(kernels.hull_of(S.xyz(coords), coords))


def convex_hull_agg(df: DataFrame, keys: list[str], geog: str) -> DataFrame:
    return two_stage(df, keys, geog, hull_of_all)


def union_agg(df: DataFrame, keys: list[str], geog: str) -> DataFrame:
    return two_stage(df, keys, geog, lambda fs: to_wkb(overlay.union_all([shape_of(f) for f in fs])))


def coverage_union_agg(df: DataFrame, keys: list[str], geog: str) -> DataFrame:
    """Of polygons that do not overlap."""
    return two_stage(df, keys, geog, lambda fs: to_wkb(overlay.coverage_union([from_wkb(f) for f in fs])))


def rebuild_agg(df: DataFrame, keys: list[str], geog: str) -> DataFrame:
    return two_stage(df, keys, geog, lambda fs: to_wkb(overlay.rebuild(Geography(7, parts=[from_wkb(f) for f in fs]))))


def bounds_agg(df: DataFrame, keys: list[str], geog: str) -> DataFrame:
    """(keys, bounds): the least box over all features, which may wrap; null without any."""
    ship.ensure(df.sparkSession)

    @F.pandas_udf("binary")
    def merge(xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> bytes:
        rows = [r for r in zip(xmin, ymin, xmax, ymax, strict=True) if r[0] is not None and r[0] == r[0]]
        return b"" if not rows else _packed(merged(rows))

    unpack = F.pandas_udf(_unpacked, BOX)
    b = F.col("_b")
    salted = df.select(*keys, registry.udf("st_boundingbox")(F.col(geog)).alias("_b"), F.pmod(F.xxhash64(geog), F.lit(SALTS)).alias("_salt"))
    partial = salted.groupBy(*keys, "_salt").agg(merge(b["xmin"], b["ymin"], b["xmax"], b["ymax"]).alias("_p")).select(*keys, unpack(F.col("_p")).alias("_b"))
    whole = partial.groupBy(*keys).agg(merge(b["xmin"], b["ymin"], b["xmax"], b["ymax"]).alias("_p")).select(*keys, unpack(F.col("_p")).alias("bounds"))
    return whole.select(*keys, F.when(F.col("bounds.xmin").isNotNull(), F.col("bounds")).alias("bounds"))


def merged(rows) -> tuple[float, float, float, float]:
    """Latitudes by extremes, longitudes by the largest gap."""
    lng = kernels.lng_union([(r[0], r[2]) for r in rows])
    return lng[0], min(r[1] for r in rows), lng[1], max(r[3] for r in rows)


def expanded(box: tuple[float, float, float, float], metres: float) -> tuple[float, float, float, float]:
    """A box that holds all points within a distance of it."""
    import math

    d = math.degrees(metres / native.RADIUS)
    low, high = max(-90.0, box[1] - d), min(90.0, box[3] + d)
    if low <= -90 or high >= 90:
        return -180.0, low, 180.0, high
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(max(abs(box[1]), abs(box[3])))))))
    span = (box[2] - box[0]) % 360 + 2 * wide
    if span >= 360:
        return -180.0, low, 180.0, high
    wrap = lambda x: (x + 180) % 360 - 180
    return wrap(box[0] - wide), low, wrap(box[2] + wide), high


def _packed(box) -> bytes:
    import struct

    return struct.pack("<4d", *box)


def _unpacked(column: pd.Series) -> pd.DataFrame:
    import struct

    return pd.DataFrame([struct.unpack("<4d", x) if x else (None,) * 4 for x in column], columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")


_unpacked.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
