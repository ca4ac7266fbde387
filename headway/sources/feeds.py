"""Catalogue of published feeds: which are usable, and what a dataset lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.sources.files import write_csv


def active_feeds(feeds: DataFrame, state: str | None = None) -> DataFrame:
    """Active feeds with a dataset and a bounding box, one row each with the box's centre."""
    f = feeds.filter((F.col("status") == "active") & F.col("latest_dataset.id").isNotNull() & F.col("bounding_box").isNotNull())
    if state is not None:
        f = f.filter(F.col("state") == state)
    b = F.col("bounding_box")
    mid = lambda axis: (b[f"minimum_{axis}"] + b[f"maximum_{axis}"]) / 2
    return f.select("id", "feed_name", "provider", "official", F.col("latest_dataset.id").alias("dataset_id"), mid("latitude").alias("lat"), mid("longitude").alias("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")


def missing_feeds(wanted: DataFrame, feeds: DataFrame) -> DataFrame:
    return wanted.join(feeds.select("id"), "id", "left_anti")


def map_centre(feeds: DataFrame) -> DataFrame:
    return feeds.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def dataset_quality(datasets: DataFrame) -> DataFrame:
    """has_shapes and has_errors, null without a report; ``download`` is true only for shapes without errors."""
    r = F.col("validation_report")
    d = datasets.withColumn("has_shapes", F.array_contains(r["features"], "Shapes")).withColumn("has_errors", r["total_error"] > 0)
    return d.withColumn("download", F.coalesce(F.col("has_shapes") & ~F.col("has_errors"), F.lit(False)))


def trip_quality(trips: DataFrame, routes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bus trips, and whether every one of them has a shape; false where there is no shape column."""
    bus = trips.join(routes.filter("route_type = 3").select("route_id").distinct(), "route_id", "left_semi")
    lacking = F.count_if(F.col("shape_id").isNull()) if "shape_id" in trips.columns else F.count("*") + 1
    return bus.groupBy(*(by or [])).agg(F.count("*").alias("bus_trips"), (lacking == 0).alias("all_shapes")).withColumn("has_bus_trips", F.col("bus_trips") > 0)


def save_catalogue(feeds: DataFrame, datasets: DataFrame, folder: str) -> list[str]:
    """feeds.csv and datasets.csv, read again by read_catalogue; nested columns are left out, a CSV cannot hold them."""
    flat = lambda df: df.select(*[c for c, t in df.dtypes if not t.startswith(("struct", "array", "map"))])
    return [write_csv(flat(feeds), folder, "feeds.csv"), write_csv(flat(datasets), folder, "datasets.csv")]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """feeds.csv with numeric coordinates."""
    f = spark.read.option("header", True).csv(path)
    return f.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon") if c in f.columns})
