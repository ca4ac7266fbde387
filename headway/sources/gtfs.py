"""Schedule feeds: typed scans of a folder of CSV files, calendars included."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import clock
from headway.operators.service import DAYS

_S = lambda names: ", ".join(f"{n} string" for n in names.split())
SCHEMAS = {
    "agency": _S("agency_id agency_name agency_url agency_timezone agency_lang agency_phone agency_fare_url"),
    "routes": _S("route_id agency_id route_short_name route_long_name route_desc") + ", route_type int, " + _S("route_url route_color route_text_color"),
    "trips": _S("trip_id route_id service_id block_id shape_id agency_id"),
    "stop_times": "trip_id string, stop_sequence int, stop_id string, arrival_time string, departure_time string, shape_dist_traveled double",
    "stops": "stop_id string, stop_lat double, stop_lon double",
    "shapes": "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, shape_dist_traveled double",
    "calendar": "service_id string, " + ", ".join(f"{d} int" for d in DAYS) + ", start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
}
REQUIRED = ("trips", "stop_times", "stops", "shapes")


@dataclass(frozen=True)
class Feed:
    """The tables of a feed; every step gives a new one."""

    agency: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    stops: DataFrame
    shapes: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame

    def with_tables(self, **tables: DataFrame) -> Feed:
        return replace(self, **tables)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file with the columns it has, by name; columns it lacks are null.  Ids are text, times are seconds."""
    path = f"{folder.rstrip('/')}/{name}.txt"
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    have = {c.strip().lstrip("﻿"): c for c in raw.columns}
    cols = []
    for part in SCHEMAS[name].split(", "):
        col, kind = part.split()
        cols.append((F.trim(F.col(f"`{have[col]}`")) if col in have else F.lit(None)).cast(kind).alias(col))
    df = raw.select(*cols)
    if name == "stop_times":
        return df.select("trip_id", "stop_sequence", "stop_id", clock.parse_hms(F.col("arrival_time")).alias("arrival_s"), clock.parse_hms(F.col("departure_time")).alias("departure_s"), "shape_dist_traveled")
    for c in ("start_date", "end_date", "date"):
        if c in df.columns:
            df = df.withColumn(c, F.to_date(c, "yyyyMMdd"))
    return df


def read_feed(spark: SparkSession, folder: str) -> Feed:
    """All tables; optional files that are missing are empty."""
    from pyspark.errors import AnalysisException

    tables = {}
    for name, schema in SCHEMAS.items():
        try:
            tables[name] = read_table(spark, folder, name)
        except AnalysisException as e:
            if name in REQUIRED or "PATH_NOT_FOUND" not in str(e):
                raise
            empty = spark.createDataFrame([], schema)
            for c in ("start_date", "end_date", "date"):
                if c in empty.columns:
                    empty = empty.withColumn(c, F.col(c).cast("date"))
            tables[name] = empty
    return Feed(**tables)
