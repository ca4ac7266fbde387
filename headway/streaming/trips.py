"""Trips as vehicles make them: state by vehicle over a stream of positions, and the same from a table.

A trip of a vehicle goes on while its positions name it and follow each other within ``gap_s``; it is given out when it has
ended.  Positions are taken in the order of their own time once the watermark has passed them, so what comes late
within it, or twice, changes nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from headway.functions import geo

TRIPS = "vehicle_id string, trip_id string, begun timestamp, ended timestamp, n long, km double"
GAP_S = 900


def _km(a: list, b: list) -> float:
    half = [math.radians(q - p) / 2 for p, q in zip(a, b, strict=True)]
    s = math.sin(half[0]) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(half[1]) ** 2
    return 2 * geo.EARTH_KM * math.atan2(math.sqrt(s), math.sqrt(max(1 - s, 0.0)))


def _usable(positions: DataFrame) -> DataFrame:
    return positions.select("vehicle_id", "trip_id", "lat", "lon", F.col("ts").cast("timestamp").alias("ts")).dropna()


def made_trips(positions: DataFrame, *, late: str = "10 minutes", gap_s: int = GAP_S) -> DataFrame:
    """Ended trips (TRIPS) of a stream of positions (vehicle_id, trip_id, lat, lon, ts); rows that lack one are left out.

    The state of a vehicle is its open trip and the positions that the watermark has not passed.  A vehicle that falls
    silent is looked at again when the watermark has passed its last position by ``gap_s``.  Positions behind the watermark are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # open: trip, first and last time, positions, km, last place; todo: time, trip, place
        trip, waiting, passed = json.loads(state.get[0]) if state.exists else (None, [], -1)
        todo = {ms: at for ms, *at in waiting}
        mark = state.getCurrentWatermarkMs()
        for f in frames:
            stamps = f["ts"].to_numpy("datetime64[ns]").astype("int64") // 1_000_000
            for ms, *at in zip(stamps.tolist(), f["trip_id"].tolist(), f["lat"].tolist(), f["lon"].tolist(), strict=True):
                if ms > passed and (ms not in todo or at < todo[ms]):
                    todo[ms] = at
        out, order = [], sorted(todo)
        for ms in order:
            if ms > mark:
                break
            name, *place = todo.pop(ms)
            passed = ms
            if trip and (trip[0] != name or ms - trip[2] > gap_s * 1000):
                out.append(trip)
                trip = None
            if trip:
                trip = [name, trip[1], ms, trip[3] + 1, trip[4] + _km(trip[5], place), place]
            else:
                trip = [name, ms, ms, 1, 0.0, place]
        # nothing that may still come can continue it
        if trip and mark - trip[2] > gap_s * 1000 and all(ms - trip[2] > gap_s * 1000 for ms in todo):
            out.append(trip)
            trip = None
        if trip or todo:
            state.update((json.dumps((trip, [(ms, *todo[ms]) for ms in order if ms in todo], passed)),))
            next_ms = min([*todo, *([trip[2] + gap_s * 1000 + 1] if trip else [])])
            state.setTimeoutTimestamp(max(next_ms, mark + 1))
        elif state.exists:
            state.remove()
        if out:  # most vehicles have no trip to give in most batches, and a table is dear
            stamp = lambda k: pd.DatetimeIndex(np.array([t[k] for t in out], "datetime64[ms]").astype("datetime64[ns]"), tz="UTC")
            yield pd.DataFrame({"vehicle_id": [key[0]] * len(out), "trip_id": [t[0] for t in out], "begun": stamp(1), "ended": stamp(2), "n": [t[3] for t in out], "km": [t[4] for t in out]})

    p = _usable(positions).withWatermark("ts", late)
    return p.groupBy("vehicle_id").applyInPandasWithState(step, TRIPS, "memory string", "append", GroupStateTimeout.EventTimeTimeout)


def trips_of_table(positions: DataFrame, *, gap_s: int = GAP_S) -> DataFrame:
    """All trips (TRIPS) of a table of positions, those that may go on included; of positions of one vehicle and time the
    smallest counts."""
    w = Window.partitionBy("vehicle_id").orderBy("ts")
    p = _usable(positions).withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))).groupBy("vehicle_id", "ts").agg(F.min(F.struct("trip_id", "lat", "lon")).alias("p")).select("vehicle_id", "ts", "p.*")
    before = lambda c: F.lag(c).over(w)
    new = before("ts").isNull() | (before("trip_id") != F.col("trip_id")) | (F.unix_millis("ts") - F.unix_millis(before("ts")) > gap_s * 1000)
    km = geo.haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon"))
    p = p.withColumns({"_new": new.cast("int"), "_km": F.when(new, 0.0).otherwise(km)}).withColumn("_trip", F.sum("_new").over(w))
    g = p.groupBy("vehicle_id", "_trip").agg(F.first("trip_id").alias("trip_id"), F.min("ts").alias("begun"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.sum("_km").alias("km"))
    return g.drop("_trip").select("vehicle_id", "trip_id", "begun", "ended", "n", "km")


def against_schedule(trips: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Adds kmh, scheduled_kmh and their ratio to trips, from a schedule (trip_id, km, start_s, end_s); null without a duration."""
    s = scheduled.select("trip_id", F.try_divide(F.col("km") * 3600, F.col("end_s") - F.col("start_s")).alias("scheduled_kmh"))
    seen = F.try_divide(F.col("km") * 3_600_000, F.unix_millis("ended") - F.unix_millis("begun"))
    return trips.join(s, "trip_id", "left").withColumn("kmh", seen).withColumn("ratio", F.try_divide("kmh", "scheduled_kmh"))
