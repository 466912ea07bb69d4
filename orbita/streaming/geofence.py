"""Geofences over event streams: a stream-static cell join and windowed sums, with late data cut by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions import native
from orbita.operators import aggregates, joins


def fenced(events: DataFrame, fences: DataFrame, lng: str, lat: str, geog: str, refine=None) -> DataFrame:
    """Events, batch or stream, with the fences that hold them; stateless."""
    return joins.point_join(events, fences, lng, lat, geog, refine)


def windowed_centroids(hits: DataFrame, fence: str, ts: str, lng: str, lat: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """For each window and fence the number of events and the centroid of their places."""
    if hits.isStreaming:  # a watermark takes no timestamp without a time zone
        hits = hits.withColumn(ts, F.col(ts).cast("timestamp"))
    grouped = hits.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), fence).agg(F.count(F.lit(1)).alias("n"), *aggregates.centroid_sums(F.col(lng), F.col(lat)))
    at = native.to_lnglat(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")))
    return grouped.select(F.col("window.start").alias("start"), fence, "n", at["lng"].alias("lng"), at["lat"].alias("lat"))


def replay(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a finite stream to its end into a table in memory: for tests and demonstrations."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
