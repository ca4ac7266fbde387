"""A streaming source of recorded realtime messages, and what polls them.

A poller writes each message of a feed, as it came, into a file whose name grows with time; the source reads the files in
the order of their names.  Its offset is the last name read, so a stream that starts again from its checkpoint reads every message
once.  Messages are decoded on the executors, a file a task at most.
"""

from __future__ import annotations

import os
import struct
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

VEHICLES = "message string, id string, vehicle_id string, trip_id string, route_id string, lat double, lon double, speed double, ts timestamp"
#: Numbers of the fields of the public realtime format that are read.
ENTITY, ENTITY_ID, VEHICLE = 2, 1, 4
TRIP, POSITION, TIMESTAMP, DESCRIPTOR = 1, 2, 5, 8
TRIP_ID, ROUTE_ID, LATITUDE, LONGITUDE, SPEED, DESCRIPTOR_ID = 1, 5, 1, 2, 5, 1


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return value, at
        shift += 7


def fields(b: bytes) -> dict[int, list]:
    """The fields of a protobuf message by number: numbers for varints, bytes for all else.  Ends that are cut off raise an error."""
    out: dict[int, list] = {}
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        else:
            if kind == 2:
                size, at = _varint(b, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} is not of this format")
            if at + size > len(b):
                raise ValueError("the message is cut off")
            value, at = b[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


def vehicles_of(message: bytes) -> Iterator[tuple]:
    """(id, vehicle_id, trip_id, route_id, lat, lon, speed, seconds) of the entities of a feed message that have a vehicle."""
    last = lambda f, n: f.get(n, [None])[-1]
    text = lambda f, n: None if last(f, n) is None else last(f, n).decode()
    number = lambda f, n: None if last(f, n) is None else struct.unpack("<f", last(f, n))[0]
    for raw in fields(message).get(ENTITY, []):
        entity = fields(raw)
        if VEHICLE not in entity:
            continue
        v = fields(entity[VEHICLE][-1])
        trip, place, own = (fields(last(v, n) or b"") for n in (TRIP, POSITION, DESCRIPTOR))
        yield text(entity, ENTITY_ID), text(own, DESCRIPTOR_ID), text(trip, TRIP_ID), text(trip, ROUTE_ID), number(place, LATITUDE), number(place, LONGITUDE), number(place, SPEED), last(v, TIMESTAMP)


def fetched(fetch: Callable[[], bytes], *, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> bytes:
    """What ``fetch`` gives; after an error it is asked again up to ``retries`` times, after 1, 2, 4, .. seconds."""
    for n in range(retries + 1):
        try:
            return fetch()
        except OSError:
            if n == retries:
                raise
            wait(2.0**n)
    raise AssertionError


def poll(fetch: Callable[[], bytes], folder: str, *, polls: int, every_s: float = 30.0, retries: int = 3, wait: Callable[[float], None] = time.sleep, clock: Callable[[], int] = time.time_ns) -> int:
    """Writes up to ``polls`` messages into ``folder`` and returns how many were; one that cannot be fetched is left out and
    polling goes on.  A file gets its name when it is whole."""
    written = 0
    os.makedirs(folder, exist_ok=True)
    for k in range(polls):
        if k:
            wait(every_s)
        try:
            message = fetched(fetch, retries=retries, wait=wait)
        except OSError:
            continue
        path = os.path.join(folder, f"{clock():020d}.pb")
        with open(path + ".part", "wb") as f:
            f.write(message)
        os.rename(path + ".part", path)
        written += 1
    return written


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".pb")) if os.path.isdir(self.folder) else []

    def latestOffset(self) -> dict:
        return {"upto": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(n) for n in self._names() if start["upto"] < n <= end["upto"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        import datetime

        with open(os.path.join(self.folder, partition.name), "rb") as f:
            message = f.read()
        try:
            rows = list(vehicles_of(message))
        except (ValueError, IndexError):  # a broken message, which a poller may have got from its feed
            return
        for *row, seconds in rows:
            yield (partition.name, *row, None if seconds is None else datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc))


class RecordedVehicles(DataSource):
    """``spark.readStream.format("recorded_vehicles").load(folder)``: the vehicles of recorded messages, as VEHICLES.

    The folder has to be one that driver and executors share.  Files have to come in the order of their names.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_vehicles"

    def schema(self) -> str:
        return VEHICLES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"].removeprefix("file://"))


def read_recorded(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(RecordedVehicles)
    return spark.readStream.format("recorded_vehicles").load(folder)
