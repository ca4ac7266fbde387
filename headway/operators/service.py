"""Calendars, service filters and trip times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions import clock

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def service_dates(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """Distinct (service_id, date): weekday flags over the period, plus type-1 and minus type-2 exceptions.

    The expansion is bounded by the days of a period, so it stays a narrow explode before the only shuffle.
    """
    day = F.explode(F.sequence("start_date", "end_date")).alias("date")
    base = calendar.filter("start_date <= end_date").select("service_id", *DAYS, day)
    base = base.filter(F.get(F.array(*DAYS), F.weekday("date")) == 1).select("service_id", "date")
    added = calendar_dates.filter("exception_type = 1").select("service_id", "date")
    removed = calendar_dates.filter("exception_type = 2").select("service_id", "date")
    return base.union(added).join(removed, ["service_id", "date"], "left_anti").distinct()


def services_on(dates: DataFrame, date) -> DataFrame:
    return dates.filter(F.col("date") == F.lit(date).cast("date")).select("service_id").distinct()


def service_counts(dates: DataFrame) -> DataFrame:
    return dates.groupBy("service_id").agg(F.count("date").alias("trip_count"))


def trips_of_services(trips: DataFrame, services: DataFrame, routes: DataFrame | None = None, route_type: int | None = 3) -> DataFrame:
    """Trips of the given services, of bus routes only where routes are given; adds trip_type."""
    out = trips.join(services, "service_id", "left_semi")
    if routes is not None:
        keep = routes.select("route_id", *[c for c in ("route_short_name", "route_desc", "route_type") if c not in trips.columns])
        out = out.join(keep, "route_id")
        if route_type is not None:
            out = out.filter(F.col("route_type") == route_type)
    return out.withColumn("trip_type", F.lit("service"))


def blocks_on_routes(trips: DataFrame, routes: list[str], column: str = "route_short_name", method: str = "exclusive") -> DataFrame:
    """Trips of whole blocks: 'exclusive' keeps blocks whose trips are all on the routes, 'inclusive' those with any."""
    on = F.coalesce(F.col(column).isin(routes), F.lit(False))
    test = {"exclusive": F.bool_and(on), "inclusive": F.bool_or(on)}[method]
    blocks = trips.groupBy("block_id").agg(test.alias("_keep")).filter("_keep").select("block_id")
    return trips.join(blocks, "block_id", "left_semi")


def only(rows: DataFrame, trips: DataFrame, key: str) -> DataFrame:
    """Rows of stop_times or shapes that the trips still use."""
    return rows.join(trips.select(key).distinct(), key, "left_semi")


def trip_spans(stop_times: DataFrame, time: str = "arrival_s") -> DataFrame:
    return stop_times.groupBy("trip_id").agg(F.min(time).alias("start_s"), F.max(time).alias("end_s"))


def with_trip_times(trips: DataFrame, stop_times: DataFrame, dates: DataFrame) -> DataFrame:
    """Adds start_time, end_time, trip_duration_minutes and trip_count; trips without stops or dates vanish."""
    span = trip_spans(stop_times).select(
        "trip_id", clock.hms(F.col("start_s")).alias("start_time"), clock.hms(F.col("end_s")).alias("end_time"), ((F.col("end_s") - F.col("start_s")) / 60.0).alias("trip_duration_minutes")
    )
    return trips.join(span, "trip_id").join(service_counts(dates), "service_id")
