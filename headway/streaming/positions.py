"""Vehicle positions as a stream: landing files in, daily folders out, and a watermarked speed check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headway.functions import geo

ENTITY = "id string, vehicle struct<trip:struct<tripId:string,routeId:string>,vehicle:struct<id:string>,position:struct<latitude:double,longitude:double,speed:double>,timestamp:string>"


def read_positions(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of JSON lines; a poller writes one file a poll into ``folder``."""
    return spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", max_files).json(folder)


def vehicles(entities: DataFrame) -> DataFrame:
    """Only entities with a vehicle, flat; works on streams and tables."""
    v = entities.filter("vehicle IS NOT NULL")
    return v.select("id", F.col("vehicle.vehicle.id").alias("vehicle_id"), F.col("vehicle.trip.tripId").alias("trip_id"), F.col("vehicle.position.latitude").alias("lat"), F.col("vehicle.position.longitude").alias("lon"), F.timestamp_seconds(F.col("vehicle.timestamp").cast("long")).alias("ts"))


def append_daily(stream: DataFrame, folder: str, checkpoint: str, *, every: str | None = "30 seconds", fmt: str = "json") -> StreamingQuery:
    """Append by processing date.  With ``every=None`` it takes what is there and stops."""
    w = stream.withColumn("log_date", F.current_date()).writeStream.format(fmt).partitionBy("log_date").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def hourly_speeds(positions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Straight-line km per vehicle and five-minute window between its first and last position; late rows are dropped.

    State is one small aggregate per vehicle and open window.
    """
    p = positions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["vehicle_id", "ts"])
    at = F.struct("lat", "lon")
    g = p.groupBy(F.window("ts", "5 minutes").alias("w"), "vehicle_id").agg(F.min_by(at, "ts").alias("a"), F.max_by(at, "ts").alias("z"), F.count("*").alias("n"))
    km = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon"))
    return g.select(F.col("w.start").alias("window_start"), "vehicle_id", "n", km.alias("km"))
