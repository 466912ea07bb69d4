"""Geography derived from the integer keys of the tables, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions import native, registry

RADIUS = "6371010.0"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_points(df: DataFrame, key: str, a: int, b: int, *more: str) -> DataFrame:
    return df.select(key, ((F.col(key) * a) % 36000 / F.lit(100.0) - 180 + 0.005).alias("lng"), ((F.col(key) * b) % 17000 / F.lit(100.0) - 85 + 0.005).alias("lat"), *more)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_points(read(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_points(read(spark, sf_dir, "supplier"), "s_suppkey", 6151, 50023)


#: Corners of a nation's quadrilateral, counter-clockwise, as offsets from its lower left.
CORNERS = ((0, 0), (50, 0), (50, 25), (0, 25))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, lng0, lat0, and the WKT of the quadrilateral; its edges are geodesics."""
    n = F.col("n_nationkey")
    at = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", (-150 + 60 * (n % 5)).cast("double").alias("lng0"), (-75 + 30 * F.floor(n / 5)).cast("double").alias("lat0"))
    corner = lambda x, y: F.concat((F.col("lng0") + x).cast("string"), F.lit(" "), (F.col("lat0") + y).cast("string"))
    text = F.concat(F.lit("POLYGON (("), *[p for x, y in CORNERS for p in (corner(x, y), F.lit(", "))], corner(0, 0), F.lit("))"))
    return at.withColumn("wkt", text)


def corner_vectors(lng0=None, lat0=None) -> list:
    lng0, lat0 = F.col("lng0") if lng0 is None else lng0, F.col("lat0") if lat0 is None else lat0
    return [native.to_xyz(lng0 + x, lat0 + y) for x, y in CORNERS]


#: Columns of a nation's corners and of a point as vectors by the C library's sines, see ``registry.unit_vectors``.
CORNER_NAMES, VECTOR = [f"_corner{k}" for k in range(4)], "_vector"


def with_corners(shapes: DataFrame) -> DataFrame:
    return shapes.withColumns({name: registry.unit_vectors(F.col("lng0") + x, F.col("lat0") + y) for name, (x, y) in zip(CORNER_NAMES, CORNERS, strict=True)})


def with_vector(points: DataFrame) -> DataFrame:
    return points.withColumn(VECTOR, registry.unit_vectors(F.col("lng"), F.col("lat")))


def inside_corners():
    """A point inside a nation, or on its edge, as SQL_INSIDE has it."""
    return native.inside_convex(F.col(VECTOR), [F.col(c) for c in CORNER_NAMES])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey with the points of its orders in key order: at most some dozens for a customer."""
    points = keyed_points(read(spark, sf_dir, "orders"), "o_orderkey", 7919, 104729, "o_custkey")
    grouped = points.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "lng", "lat"))).alias("stops"))
    return grouped.select("o_custkey", F.transform("stops", lambda s: F.struct(s["lng"].alias("lng"), s["lat"].alias("lat"))).alias("stops"))


def moves(stops: str = "stops"):
    """The stops without those that are where the stop before them is."""
    return F.filter(stops, lambda s, k: (k == 0) | (s != F.get(F.col(stops), k - 1)))


def line(stops: str = "stops"):
    """WKB; null for fewer than two stops."""
    return F.when(F.size(stops) > 1, registry.line_wkb(F.col(stops)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", ((F.col("user_id") * 7919) % 36000 / F.lit(100.0) - 180).alias("lng"), ((F.col("event_id") * 31) % 17000 / F.lit(100.0) - 85).alias("lat"))


# SQL ---------------------------------------------------------------------------------------------


def sql_points(table: str, key: str, a: int, b: int, more: str = "") -> str:
    return f"SELECT {key}, (({key} * {a}) % 36000) / 100.0::DOUBLE - 180 + 0.005::DOUBLE AS lng, (({key} * {b}) % 17000) / 100.0::DOUBLE - 85 + 0.005::DOUBLE AS lat{more} FROM {table}"


SQL_CUSTOMERS = sql_points("customer", "c_custkey", 7919, 104729)
SQL_SUPPLIERS = sql_points("supplier", "s_suppkey", 6151, 50023)
SQL_ORDERS = sql_points("orders", "o_orderkey", 7919, 104729, ", o_custkey")
SQL_EVENTS = "SELECT event_id, ts, ((user_id * 7919) % 36000) / 100.0::DOUBLE - 180 AS lng, ((event_id * 31) % 17000) / 100.0::DOUBLE - 85 AS lat FROM events"
SQL_NATIONS = "SELECT n_nationkey, n_name, (-150 + 60 * (n_nationkey % 5))::DOUBLE AS lng0, (-75 + 30 * (n_nationkey // 5))::DOUBLE AS lat0 FROM nation"


def sql_xyz(lng: str, lat: str, name: str) -> str:
    return f"cos(radians({lng})) * cos(radians({lat})) AS x{name}, sin(radians({lng})) * cos(radians({lat})) AS y{name}, sin(radians({lat})) AS z{name}"


def sql_chord(a: str, b: str) -> str:
    return f"(2 * asin(least(1.0, sqrt(pow(x{a} - x{b}, 2) + pow(y{a} - y{b}, 2) + pow(z{a} - z{b}, 2)) / 2)))"


def sql_dot(a: str, b: str) -> str:
    return f"(x{a} * x{b} + y{a} * y{b} + z{a} * z{b})"


def sql_det(a: str, b: str, c: str) -> str:
    return f"(x{a} * (y{b} * z{c} - z{b} * y{c}) + y{a} * (z{b} * x{c} - x{b} * z{c}) + z{a} * (x{b} * y{c} - y{b} * x{c}))"


def sql_triangle(a: str, b: str, c: str) -> str:
    return f"(2 * atan2({sql_det(a, b, c)}, 1 + {sql_dot(a, b)} + {sql_dot(b, c)} + {sql_dot(c, a)}))"


#: Nations with the vectors of their corners 0 to 3.
SQL_QUADS = f"SELECT *, {', '.join(sql_xyz(f'lng0 + {x}', f'lat0 + {y}', str(k)) for k, (x, y) in enumerate(CORNERS))} FROM ({SQL_NATIONS})"
SQL_QUAD_AREA = f"({sql_triangle('0', '1', '2')} + {sql_triangle('0', '2', '3')})"
SQL_INSIDE = " AND ".join(f"{sql_det(str(k), str((k + 1) % 4), 'p')} > 0" for k in range(4))


def sql_vectors(query: str, name: str = "p") -> str:
    return f"SELECT *, {sql_xyz('lng', 'lat', name)} FROM ({query})"
