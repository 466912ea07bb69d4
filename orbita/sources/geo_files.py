"""Reading and writing geography columns: WKB and WKT files, point columns, and tagged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions import native, registry

#: Column metadata that marks geography: WKB with great-circle edges.
METADATA = {"edges": "spherical", "crs": "OGC:CRS84", "encoding": "WKB"}


def as_geography(df: DataFrame, column: str, crs: str = "OGC:CRS84") -> DataFrame:
    """Mark a binary column."""
    return df.withColumn(column, F.col(column).alias(column, metadata=METADATA | {"crs": crs}))


def is_geography(df: DataFrame, column: str) -> bool:
    return df.schema[column].metadata.get("edges") == "spherical"


def read_wkb(spark: SparkSession, path: str, column: str = "geog", check: bool = False) -> DataFrame:
    """Parquet with a WKB column; ``check`` parses every value and fails on what is no geography."""
    df = spark.read.parquet(path)
    if check:
        df = df.withColumn(column, registry.call("st_checkwkb", F.col(column)))
    return as_geography(df, column)


def read_wkt(spark: SparkSession, path: str, column: str = "wkt", to: str = "geog") -> DataFrame:
    """CSV with a header and a WKT column."""
    df = spark.read.option("header", True).csv(path)
    return as_geography(df.withColumn(to, registry.call("st_geogfromwkt", F.col(column))), to)


def write_wkb(df: DataFrame, path: str, column: str = "geog", mode: str = "error") -> None:
    """With the bounds of every row as plain columns, by which Parquet's statistics prune."""
    df.withColumn("bounds", registry.call("st_boundingbox", F.col(column))).write.mode(mode).parquet(path)


def write_wkt(df: DataFrame, path: str, column: str = "geog", precision: int = 16, mode: str = "error") -> None:
    df.withColumn(column, registry.call("st_astext", F.col(column), F.lit(precision))).write.mode(mode).option("header", True).csv(path)


def points_from(df: DataFrame, x: str, y: str, to: str = "geog") -> DataFrame:
    """Native point columns (struct or two doubles) to WKB."""
    text = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.concat(F.lit("POINT ("), F.col(x).cast("double").cast("string"), F.lit(" "), F.col(y).cast("double").cast("string"), F.lit(")")))
    return as_geography(df.withColumn(to, registry.call("st_geogfromwkt", text)), to)


def tagged(geog: Column, covering: bool = True) -> Column:
    """struct<kind, is_empty, covering, wkb>: a record that tells an index what it needs without decoding."""
    cover = registry.call("s2_coveringcellids", geog) if covering else F.lit(None).cast("array<bigint>")
    empty = registry.call("st_isempty", geog)
    return F.struct(registry.call("st_dimension", geog).cast("tinyint").alias("kind"), empty.alias("is_empty"), cover.alias("covering"), F.when(~empty, geog).alias("wkb"))


def untagged(record: Column) -> Column:
    """The geography of a tagged record; an empty one comes back as an empty geography of its kind."""
    blank = F.when(record["kind"] == 0, "POINT EMPTY").when(record["kind"] == 1, "LINESTRING EMPTY").when(record["kind"] == 2, "POLYGON EMPTY").otherwise("GEOMETRYCOLLECTION EMPTY")
    return F.when(record.isNotNull(), F.coalesce(record["wkb"], registry.call("st_geogfromwkt", F.when(record["is_empty"], blank))))


def with_cells(df: DataFrame, lng: str, lat: str) -> DataFrame:
    return df.withColumn("cell", native.cell_of(F.col(lng), F.col(lat)))
