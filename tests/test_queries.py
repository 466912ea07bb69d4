"""Every query of the catalog against its SQL, and the native columns against numpy."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbita.functions import native, registry
from orbita.operators import aggregates, joins
from orbita.plans import catalog, tables
from orbita.sources import geo_files
from orbita.streaming import geofence

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, oracle, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), oracle.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_native_cells_equal_numpy(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(float(x), float(y)) for x, y in np.c_[rng.uniform(-180, 180, 300), rng.uniform(-90, 90, 300)]] + [(0.0, 0.0), (180.0, 0.0), (0.0, 90.0), (0.0, -90.0), (None, 1.0), (float("nan"), 0.0)], "lng double, lat double")
    both = frame.select(native.cell_of(F.col("lng"), F.col("lat")).alias("a"), registry.leaf_cells(F.col("lng"), F.col("lat")).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_nulls_and_sql_names(spark):
    registry.register_all(spark)
    row = spark.sql("SELECT st_area(NULL) AS a, st_astext(st_geogfromwkt('POINT (1 2)')) AS b, st_distance(st_geogfromwkt('POINT (0 0)'), st_geogfromwkt('POINT EMPTY')) AS c, st_astext(st_buffer(st_geogfromwkt('POINT (0 0)'), 0D)) AS d, size(s2_coveringcellids(st_geogfromwkt('POINT EMPTY'))) AS e, st_boundingbox(st_geogfromwkt('POINT (3 4)')).ymin AS f").first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (None, "POINT (1 2)", None, "POLYGON EMPTY", 0, pytest.approx(4.0))
    assert {"st_area", "st_buffer", "st_longestline", "s2_coveringcellids", "st_boundingbox", "st_pointonsurface"} <= set(registry.KERNELS)


def test_distance_join_equals_nested_loop(spark):
    rng = np.random.default_rng(5)
    at = lambda n, k: [(i, float(x), float(y)) for i, (x, y) in enumerate(np.c_[rng.uniform(-180, 180, n), np.clip(rng.normal(k, 40, n), -90, 90)])]
    a = spark.createDataFrame(at(150, 60), "a long, lng double, lat double")
    b = spark.createDataFrame(at(150, 60), "b long, lng2 double, lat2 double")
    for metres in (50_000.0, 900_000.0, 5_000_000.0, 21_000_000.0):
        got = {(r.a, r.b) for r in joins.distance_join(a, b, ("lng", "lat"), ("lng2", "lat2"), metres).collect()}
        pairs = a.crossJoin(b).where(native.dwithin(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"), metres))
        assert got == {(r.a, r.b) for r in pairs.select("a", "b").collect()}


def test_files_and_tags(spark, tmp_path):
    df = spark.createDataFrame([(1, "POINT (1 2)"), (2, "POLYGON ((0 0, 1 0, 0 1, 0 0))"), (3, "LINESTRING EMPTY"), (4, None)], "id int, wkt string")
    geo = geo_files.as_geography(df.withColumn("geog", registry.call("st_geogfromwkt", F.col("wkt"))).drop("wkt"), "geog")
    geo_files.write_wkb(geo, str(tmp_path / "wkb"))
    back = geo_files.read_wkb(spark, str(tmp_path / "wkb"), check=True)
    assert geo_files.is_geography(back, "geog")
    text = back.select("id", registry.call("st_astext", F.col("geog")).alias("t")).collect()
    assert {r.id: r.t for r in text} == {1: "POINT (1 2)", 2: "POLYGON ((0 0, 1 0, 0 1, 0 0))", 3: "LINESTRING EMPTY", 4: None}
    record = geo.select("id", geo_files.tagged(F.col("geog")).alias("r")).select("id", "r", registry.call("st_astext", geo_files.untagged(F.col("r"))).alias("t")).collect()
    assert {r.id: r.t for r in record} == {1: "POINT (1 2)", 2: "POLYGON ((0 0, 1 0, 0 1, 0 0))", 3: "LINESTRING EMPTY", 4: None}
    geo_files.write_wkt(geo.where("id < 3"), str(tmp_path / "wkt"), "geog")
    assert geo_files.read_wkt(spark, str(tmp_path / "wkt"), "geog", "g").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = tables.events(spark, SF)
    events.write.parquet(str(tmp_path / "events"))
    fences = catalog.quads(spark, SF).select("n_nationkey", "geog", "lng0", "lat0")
    refine = lambda: native.inside_convex(native.to_xyz(F.col("lng"), F.col("lat")), tables.corner_vectors())
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    run = geofence.windowed_centroids(geofence.fenced(stream, fences, "lng", "lat", "geog", refine), "n_nationkey", "ts", "lng", "lat")
    streamed = geofence.replay(spark, run, "geofence_test").select("start", "n_nationkey", "n")
    batch = geofence.windowed_centroids(geofence.fenced(events, fences, "lng", "lat", "geog", refine), "n_nationkey", "ts", "lng", "lat").select("start", "n_nationkey", "n")
    assert sorted(map(tuple, streamed.collect())) == sorted((r.start, r.n_nationkey, r.n) for r in batch.collect())


def test_boxes_grow(spark):
    assert aggregates.expanded((170.0, 0.0, -170.0, 10.0), 111195.0) == pytest.approx((168.98, -1.0, -168.98, 11.0), abs=0.02)
    assert aggregates.expanded((0.0, 80.0, 10.0, 89.9), 111195.0)[3] == 90.0


def copies(oracle, to, table: str, n: int, **shifts: int) -> str:
    """A folder with ``n`` copies of a table of the smallest size with shifted keys, and the nations."""
    moved = ", ".join(f"{c} + i * {by} AS {c}" for c, by in shifts.items())
    oracle.execute(f"COPY (SELECT * REPLACE ({moved}) FROM range({n}) r(i), {table}) TO '{to}/{table}.parquet' (FORMAT parquet)")
    oracle.execute(f"COPY nation TO '{to}/nation.parquet' (FORMAT parquet)")
    return str(to)


def sql_over(name: str, folder: str, *tables: str):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(catalog.ORACLES[name]).df()


def test_events_on_edges(spark, oracle, tmp_path):
    """Whole degrees of longitude lie on the nations' meridians; rounding tells the side, and it is SQL's."""
    to = copies(oracle, tmp_path, "events", 400, event_id=1000, user_id=1500)
    got, want = catalog.QUERIES["geofence_windows"](spark, to).toPandas(), sql_over("geofence_windows", to, "events", "nation")
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_orders_on_one_place(spark, oracle, tmp_path):
    """Keys that differ by the places' period: stops of a customer repeat each other."""
    to = copies(oracle, tmp_path, "orders", 3, o_orderkey=612_000)
    got, want = catalog.QUERIES["simplify_nothing"](spark, to).toPandas(), sql_over("simplify_nothing", to, "orders")
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_pairs_of_one_file_are_dealt_to_tasks(spark):
    """Pairs of a left side in one piece come from several tasks, each left point's from one."""
    rng = np.random.default_rng(9)
    at = lambda n: [(i, float(x), float(y)) for i, (x, y) in enumerate(np.c_[rng.uniform(-180, 180, n), rng.uniform(-90, 90, n)])]
    a = spark.createDataFrame(at(400), "a long, lng double, lat double").coalesce(1)
    b = spark.createDataFrame(at(300), "b long, lng2 double, lat2 double")
    pairs = joins.distance_join(a, b, ("lng", "lat"), ("lng2", "lat2"), 2_000_000.0, 16, ("a",))
    assert {"a", "lng", "lat", "b", "lng2", "lat2", "distance"} == set(pairs.columns)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 4
    near = joins.knn_join(a, b, ("lng", "lat"), ("lng2", "lat2"), 3, "a", "b").collect()
    apart = a.crossJoin(b).select("a", "b", native.distance(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2")).alias("d")).collect()
    best = {i: [r.b for r in sorted((r for r in apart if r.a == i), key=lambda r: (r.d, r.b))[:3]] for i in range(400)}
    assert {i: [r.b for r in sorted((r for r in near if r.a == i), key=lambda r: r.rank)] for i in range(400)} == best
