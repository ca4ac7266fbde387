"""Shapes along the road: distances, one-second resampling, point timestamps, link aggregation, stop flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import clock, geo

def with_distance(shapes: DataFrame, radius: float = geo.GREAT_CIRCLE_KM) -> DataFrame:
    """Adds seg_km to the previous point and cum_km along the shape; one sort per shape serves both."""
    along = Window.partitionBy("shape_id").orderBy("shape_pt_sequence")
    lat, lon = F.lag("shape_pt_lat").over(along), F.lag("shape_pt_lon").over(along)
    seg = F.coalesce(geo.haversine_km(lat, lon, F.col("shape_pt_lat"), F.col("shape_pt_lon"), radius), F.lit(0.0))
    return shapes.withColumn("seg_km", seg).withColumn("cum_km", F.sum("seg_km").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def upsample(shapes: DataFrame, kmh: float = 30.0) -> DataFrame:
    """Points each second at ``kmh``, linear between the shape's points.

    Offsets are rounded over the whole shape; of points that fall on one second the first counts.  A shape without
    length keeps its first point.
    """
    every = Window.partitionBy("shape_id")
    d = with_distance(shapes).withColumn("_km", F.sum("seg_km").over(every)).withColumn("_max", F.max("cum_km").over(every))
    d = d.withColumn("_o", F.when(F.col("_max") > 0, F.bround(F.col("cum_km") / F.when(F.col("_max") > 0, F.col("_max")) * F.bround(F.col("_km") / kmh * 3600))).otherwise(F.lit(0.0)).cast("long"))
    first = d.withColumn("_n", F.row_number().over(Window.partitionBy("shape_id", "_o").orderBy("shape_pt_sequence"))).filter("_n = 1")
    w = Window.partitionBy("shape_id").orderBy("_o")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    seg = first.select("shape_id", F.col("_o").alias("t0"), nxt("_o").alias("t1"), *[e for c in ("shape_pt_lat", "shape_pt_lon", "cum_km") for e in (F.col(c), nxt(c).alias(f"{c}_1"))])
    seg = seg.withColumn("second", F.explode(F.sequence("t0", F.greatest(F.col("t1") - 1, F.col("t0")))))
    part = F.when(F.col("t1") > F.col("t0"), (F.col("second") - F.col("t0")) / F.when(F.col("t1") > F.col("t0"), F.col("t1") - F.col("t0"))).otherwise(F.lit(0.0))
    mid = lambda c: F.col(c) + (F.col(f"{c}_1") - F.col(c)) * part
    return seg.select("shape_id", "second", mid("shape_pt_lat").alias("lat"), mid("shape_pt_lon").alias("lon"), mid("cum_km").alias("shape_dist_traveled"))


def point_timestamps(points: DataFrame) -> DataFrame:
    """Adds timestamp_s, hour and minute (to five minutes) in proportion to the distance travelled.

    ``points``: trip_id, shape_dist_traveled, start_s, end_s.  Days are dropped from the hour.
    """
    most = F.max("shape_dist_traveled").over(Window.partitionBy("trip_id"))
    part = F.col("shape_dist_traveled") / (most + F.lit(0.0001))
    p = points.withColumn("timestamp_s", (F.col("start_s") + F.bround(part * (F.col("end_s") - F.col("start_s")))).cast("long"))
    near = clock.nearest_five_minutes(F.col("timestamp_s"))
    return p.withColumn("hour", clock.hour_of_day(near)).withColumn("minute", clock.minute_of_hour(near))


def aggregate_links(points: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (trip, shape, road): where and when it begins and ends, mean length, mean minutes."""
    first = lambda c: F.min_by(c, order)
    last = lambda c: F.max_by(c, order)
    return points.groupBy("trip_id", "shape_id", "road_id").agg(
        first("lat").alias("start_lat"), first("lon").alias("start_lon"), first("timestamp_s").alias("start_timestamp_s"),
        last("lat").alias("end_lat"), last("lon").alias("end_lon"), last("timestamp_s").alias("end_timestamp_s"),
        F.avg("kilometers").alias("kilometers"), (F.avg("travel_time") / 60.0).alias("travel_time_minutes"),
    )


def stop_flags(points: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds with_stop to points (trip_id, coordinate_id, lat, lon): 1 where a stop of the trip is nearest, ties all.

    Both sides are keyed by trip, so the pairs are those within one trip.
    """
    d2 = (F.col("stop_lat") - F.col("lat")) * (F.col("stop_lat") - F.col("lat")) + (F.col("stop_lon") - F.col("lon")) * (F.col("stop_lon") - F.col("lon"))
    met = stops.select("trip_id", "stop_id", "stop_lat", "stop_lon").join(points.select("trip_id", "coordinate_id", "lat", "lon"), "trip_id").withColumn("_d", d2)
    near = met.groupBy("trip_id", "stop_id").agg(F.min("_d").alias("_m"))
    hit = met.join(near, ["trip_id", "stop_id"]).filter("_d = _m").select("trip_id", "coordinate_id").distinct().withColumn("with_stop", F.lit(1))
    return points.join(hit, ["trip_id", "coordinate_id"], "left").withColumn("with_stop", F.coalesce("with_stop", F.lit(0)))


def bounding_box(points: DataFrame, buffer_deg: float = 0.05, lat: str = "lat", lon: str = "lon") -> DataFrame:
    b = F.lit(buffer_deg)
    return points.agg((F.min(lon) - b).alias("min_lon"), (F.min(lat) - b).alias("min_lat"), (F.max(lon) + b).alias("max_lon"), (F.max(lat) + b).alias("max_lat"))
