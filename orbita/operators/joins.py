"""Spatial joins as equi-joins on cells, refined exactly.

Points have one leaf cell; a shape has a covering. A point is sent with the ancestors of its leaf at the levels that the
shapes' coverings use, and meets a shape in one cell at most, since the cells of a covering are apart. Two shapes are
both cut to cells of one level and a pair counts in its least common cell only, so nothing is deduplicated by a shuffle.
Catalyst picks broadcast, sort-merge or skew-split joins; no side is broadcast by force.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbita.functions import native, registry

#: Cells of a covering, and the finest level used, by default.
CELLS, LEVEL = 12, 12
#: Left points of a task of ``knn_join``.
LEFT_ROWS = 20_000


def with_covering(shapes: DataFrame, geog: str, cells: int = CELLS, level: int = LEVEL, radius: float | None = None) -> DataFrame:
    """A row for each cell of a shape's covering, as ``_cell``; with ``radius`` (radians) of all within it."""
    if radius is None:
        found = registry.call("s2_covering", F.col(geog), F.lit(cells), F.lit(0), F.lit(level))
    else:
        found = registry.call("s2_covering_buffered", F.col(geog), F.lit(radius), F.lit(cells))
    return shapes.withColumn("_cell", F.explode(found))


def levels_of(covered: DataFrame) -> list[int]:
    """The levels in use: 31 at most."""
    return sorted(r[0] for r in covered.select(native.level(F.col("_cell"))).distinct().collect())


def points_in(points: DataFrame, covered: DataFrame, lng: str, lat: str) -> DataFrame:
    """Candidate pairs of points (lng, lat) and shapes with ``_cell``; each pair once."""
    leaf = points.withColumn("_leaf", registry.leaf_cells(F.col(lng), F.col(lat)))
    keys = F.array(*[native.leaf_parent(F.col("_leaf"), at) for at in levels_of(covered)] or [F.lit(None).cast("long")])
    return leaf.withColumn("_cell", F.explode(keys)).drop("_leaf").join(covered, "_cell").drop("_cell")


def point_join(points: DataFrame, shapes: DataFrame, lng: str, lat: str, geog: str, refine: Callable[[], Column] | None = None, how: str = "inner", predicate: str = "st_contains", point_id: str | None = None) -> DataFrame:
    """Points with the shapes that hold them (or meet them: ``st_intersects``).

    ``refine``: a native condition in place of the exact predicate over WKB. left_semi, left_anti and left need
    ``point_id``, which names a row of the points.
    """
    covered = with_covering(shapes, geog).persist()  # read for its levels, then joined; Spark drops it when memory is short
    pairs = points_in(points, covered, lng, lat)
    if refine is not None:
        exact = pairs.where(refine())
    else:
        exact = pairs.where(registry.call(predicate, F.col(geog), point_wkb(F.col(lng), F.col(lat))))
    if how == "inner":
        return exact
    if how in ("left_semi", "left_anti"):
        return points.join(exact.select(point_id).distinct(), point_id, how)
    if how == "left":
        return points.join(exact.select(point_id, *shapes.columns), point_id, "left")
    raise ValueError(f"unknown kind of join {how}")


def point_wkb(lng: Column, lat: Column) -> Column:
    """WKB of a point; for refinement only where a native condition is not given."""
    return registry.point_wkb(lng, lat)


def spatial_join(left: DataFrame, right: DataFrame, left_geog: str, right_geog: str, predicate: str = "st_intersects", level: int = 4, how: str = "inner", left_id: str | None = None) -> DataFrame:
    """Pairs of shapes for which ``predicate(left, right)`` holds; columns of both sides must differ in name.

    Predicates hold for nothing empty, but for st_disjoint and st_equals, which cells can't join.
    """
    cut = lambda df, g, c: df.withColumn(c, registry.call("s2_covering", F.col(g), F.lit(1 << 20), F.lit(level), F.lit(level)))
    a = cut(left, left_geog, "_cells_a").withColumn("_cell", F.explode("_cells_a"))
    b = cut(right, right_geog, "_cells_b").withColumn("_cell", F.explode("_cells_b"))
    first = F.col("_cell") == F.array_min(F.array_intersect("_cells_a", "_cells_b"))
    pairs = a.join(b, "_cell").where(first).drop("_cell", "_cells_a", "_cells_b")
    exact = pairs.where(registry.call(predicate, F.col(left_geog), F.col(right_geog)))
    if how == "inner":
        return exact
    if how in ("left_semi", "left_anti"):
        return left.join(exact.select(left_id).distinct(), left_id, how)
    raise ValueError(f"unknown kind of join {how}")


def distance_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], metres: float, parts: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points at most ``metres`` apart, with ``distance``; columns of both sides must differ in name.

    Bands of latitude as high as the distance are cut into columns wide enough for their latitude, a number of which
    goes round the sphere; the left side is sent to the three bands and the columns next to its own, so that the right
    one, where it is broadcast, is held once. The left side is dealt to ``parts`` tasks, by ``by``, for pairs may be many
    where its files are few.
    """
    degrees = max(1e-9, metres / native.RADIUS * 57.29577951308232)
    bands = max(1, int(180 / degrees))
    band = lambda lat: F.least(F.lit(bands - 1), F.floor((lat + 90) / 180 * bands)).cast("int")
    # the widest reach in longitude of any point of the band above or below, so that neighbours are enough
    edge = lambda b: F.greatest(F.abs(b * (180.0 / bands) - 90), F.abs((b + 1) * (180.0 / bands) - 90)) + degrees
    sine = F.sin(F.radians(F.lit(min(90.0, degrees))))
    reach = lambda b: F.when(edge(b) >= 89.9, 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine / F.cos(F.radians(edge(b)))))))
    columns = lambda b: F.greatest(F.lit(1), F.floor(F.lit(360.0) / (reach(b) * 1.0000001))).cast("int")
    column = lambda lng, b: F.least(columns(b) - 1, F.floor(F.pmod(lng + 180, F.lit(360.0)) / 360 * columns(b)).cast("int"))
    key = lambda c, b: b.cast("long") * (1 << 32) + c
    flat = lambda df, v: df.select("*", *[F.col(f"{v}.{c}").alias(v + c) for c in "xyz"]).drop(v)
    own = lambda b: F.least(F.lit(bands - 1), F.greatest(F.lit(0), b))
    near_bands = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: own(band(F.col(left_at[1])) + d)))
    near_keys = lambda b: F.transform(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(F.col(left_at[0]), b) + d, columns(b)))), lambda c: key(c, b))
    a = flat(left.withColumn("_a", native.to_xyz(F.col(left_at[0]), F.col(left_at[1]))).withColumn("_keys", F.flatten(F.transform(near_bands, near_keys))), "_a")
    # dealt after the keys are made, so that the loop over pairs is small enough to be compiled
    a = a.repartition(parts or 8 * left.sparkSession.sparkContext.defaultParallelism, *by).withColumn("_key", F.explode("_keys")).drop("_keys")
    b = flat(right.withColumn("_b", native.to_xyz(F.col(right_at[0]), F.col(right_at[1]))).withColumn("_band", band(F.col(right_at[1]))), "_b")
    b = b.withColumn("_key", key(column(F.col(right_at[0]), F.col("_band")), F.col("_band"))).drop("_band")
    apart = [F.col(f"_a{c}") - F.col(f"_b{c}") for c in "xyz"]
    square = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    # chords tell which pairs are far; the angle, which costs more, is taken of the others
    most = (2 * math.sin(min(math.pi, metres / native.RADIUS) / 2)) ** 2 * (1 + 1e-9) + 1e-15
    near = a.join(b, "_key").where(square <= most)
    found = near.withColumn("distance", 2 * F.asin(F.least(F.lit(1.0), F.sqrt(square) / 2)) * native.RADIUS).where(F.col("distance") <= metres)
    return found.drop("_key", *[v + c for v in ("_a", "_b") for c in "xyz"])


def knn_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], k: int, left_id: str, right_id: str, metres: float | None = None) -> DataFrame:
    """For each left point its ``k`` nearest right points, ties by ``right_id``: the radius grows for those that have fewer.

    ``metres``: the first radius; by default that of a cap in which four times ``k`` evenly spread points are expected.
    """
    from pyspark import StorageLevel
    from pyspark.sql import Window

    order = Window.partitionBy(left_id).orderBy("distance", right_id)
    done, rest = None, left
    n = right.count()
    wanted = min(k, n)
    if metres is None:
        metres = native.RADIUS * math.acos(max(-1.0, 1 - 8 * k / max(1, n)))
    # a task sorts the pairs of so many left points, however many there are in all
    parts = max(4 * left.sparkSession.sparkContext.defaultParallelism, math.ceil(left.count() / LEFT_ROWS))
    while True:
        whole = metres >= 20_100_000
        pairs = distance_join(rest, right, left_at, right_at, metres, parts, (left_id,))
        # read for those that are full, for the rest and for the result
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).persist(StorageLevel.DISK_ONLY)
        full = ranked.groupBy(left_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= wanted).select(left_id)
        found = ranked.join(full, left_id, "left_semi")
        done = found if done is None else done.unionByName(found)
        rest = rest.join(full, left_id, "left_anti")
        if whole or rest.isEmpty():
            return done
        metres *= 4


def cell_table(shapes: DataFrame, geog: str, id_col: str, cells: int = CELLS, level: int = LEVEL) -> DataFrame:
    """An index of many shapes: (cell, id), to be written and queried with ``lookup``."""
    return with_covering(shapes, geog, cells, level).select(F.col("_cell").alias("cell"), id_col)


def lookup(index: DataFrame, query: list[int], id_col: str) -> DataFrame:
    """The ids whose cells meet a covering, each once: a superset to be refined."""
    hit = F.lit(False)
    for c in query:
        hit = hit | native.may_intersect(F.col("cell"), F.lit(c).cast("long"))
    return index.where(hit).select(id_col).distinct()


def sorted_by_cell(points: DataFrame, lng: str, lat: str, parts: int) -> DataFrame:
    """For writing: rows in curve order with their cell, so that Parquet's statistics prune ``cell BETWEEN``."""
    return points.withColumn("cell", registry.leaf_cells(F.col(lng), F.col(lat))).repartitionByRange(parts, "cell").sortWithinPartitions("cell")
