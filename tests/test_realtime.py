"""Recorded messages read once, also over restarts; trips from a stream equal those from the table."""

import datetime
import random
import struct

import pandas as pd
import pytest
from headway.streaming import realtime, trips
from pyspark.sql import functions as F


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def message(rows):
    """rows: (entity id, vehicle, trip, lat, lon, seconds); a vehicle of None makes an alert."""
    out = part(1, part(1, "2.0"))
    for i, vehicle, trip, lat, lon, s in rows:
        v = part(1, part(1, trip) + part(5, "R")) + part(2, part(1, lat) + part(2, lon) + part(5, 3.5)) + part(5, s) + part(8, part(1, vehicle or ""))
        out += part(2, part(1, i) + (part(4, v) if vehicle else part(5, b"")))
    return out


def test_decoding():
    rows = list(realtime.vehicles_of(message([("e1", "v", "t", 40.5, -105.25, 1_700_000_000), ("e2", None, "t", 1.0, 1.0, 1)])))
    assert rows == [("e1", "v", "t", "R", 40.5, -105.25, 3.5, 1_700_000_000)]
    assert list(realtime.vehicles_of(part(2, part(1, "e") + part(4, b"")))) == [("e", None, None, None, None, None, None, None)]
    assert list(realtime.vehicles_of(b"")) == []
    with pytest.raises(ValueError):
        list(realtime.vehicles_of(message([("e", "v", "t", 1.0, 1.0, 1)])[:-3]))


def test_polls_wait_longer_after_each_error(tmp_path):
    waits, answers = [], iter([OSError(), OSError(), b"one", OSError(), OSError(), OSError(), OSError(), b"two"])

    def fetch():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    ticks = iter(range(100))
    assert realtime.poll(fetch, str(tmp_path / "in"), polls=3, every_s=30, wait=waits.append, clock=lambda: next(ticks)) == 2
    assert waits == [1, 2, 30, 1, 2, 4, 30]
    assert [p.read_bytes() for p in sorted((tmp_path / "in").iterdir())] == [b"one", b"two"]


def test_a_restart_reads_every_message_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def record(k, body=None):
        folder.mkdir(exist_ok=True)
        (folder / f"{k:020d}.pb").write_bytes(message([(f"e{k}-{j}", f"v{j}", "t", 40.0 + k, -105.0, 1_700_000_000 + k) for j in range(3)]) if body is None else body)

    def run():
        q = realtime.read_recorded(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    for k in range(4):
        record(k)
    record(4, b"\x12\xff")  # broken
    record(5, b"")
    first = run()
    assert first == sorted(f"e{k}-{j}" for k in range(4) for j in range(3))
    assert run() == first
    record(6)
    assert run() == sorted([*first, "e6-0", "e6-1", "e6-2"])
    row = spark.read.parquet(out).filter("id = 'e6-1'").first()
    assert (row.vehicle_id, row.trip_id, row.lat, row.speed) == ("v1", "t", 46.0, 3.5) and row.message == f"{6:020d}.pb"


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(3)
    base, rows = 1_700_000_000, []
    for v in range(4):
        t = base
        for k in range(30):
            t += rng.choice([20, 30, 60, 60, 400, 1500])
            rows.append((f"v{v}", f"t{k // 7}", 40 + rng.random(), -105 + rng.random(), datetime.datetime.fromtimestamp(t, datetime.timezone.utc)))
    rows += rng.sample(rows, 15) + [(None, "t", 1.0, 1.0, rows[0][4]), ("v0", None, 1.0, 1.0, rows[0][4]), ("v0", "t0", None, 1.0, rows[0][4])]
    rows.sort(key=lambda r: r[4].timestamp() + rng.uniform(-200, 200))  # out of order within the watermark
    end = max(r[4] for r in rows)
    rows += [("last", "x", 0.0, 0.0, end + datetime.timedelta(hours=h)) for h in (5, 10)]  # time goes on
    schema = "vehicle_id string, trip_id string, lat double, lon double, ts timestamp"
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:06d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = trips.made_trips(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.vehicle_id, r.trip_id, r.begun, r.ended, r.n, round(r.km, 9))
    got = sorted(map(key, spark.read.parquet(str(tmp_path / "out")).filter("vehicle_id <> 'last'").collect()))
    table = trips.trips_of_table(spark.createDataFrame(rows, schema).filter("vehicle_id <> 'last'"))
    assert got == sorted(map(key, table.collect())) and len(got) > 20


def test_against_schedule(spark):
    made = spark.createDataFrame([("v", "t", 0, 1800, 3, 15.0), ("v", "u", 5, 5, 1, 0.0), ("v", "w", 0, 60, 2, 1.0)], "vehicle_id string, trip_id string, a long, b long, n long, km double").withColumns({"begun": F.timestamp_seconds("a"), "ended": F.timestamp_seconds("b")})
    plan = spark.createDataFrame([("t", 20.0, 0, 3600), ("u", 5.0, 0, 600)], "trip_id string, km double, start_s long, end_s long")
    got = {r.trip_id: (r.kmh, r.scheduled_kmh, r.ratio) for r in trips.against_schedule(made, plan).collect()}
    assert got == {"t": (30.0, 20.0, 1.5), "u": (None, 30.0, None), "w": (60.0, None, None)}


def test_vehicles_without_an_ended_trip_give_no_table(monkeypatch):
    # a table a vehicle and batch is what a stream of many vehicles spends its time on
    step = {}

    class Grouped:
        withWatermark = groupBy = lambda self, *_: self

        def applyInPandasWithState(self, f, *_):
            step["f"] = f

    class State:
        exists, memory = False, None

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, memory):
            self.memory = memory

        def setTimeoutTimestamp(self, _):
            pass

    monkeypatch.setattr(trips, "_usable", lambda _: Grouped())
    trips.made_trips(None)
    state = State()
    f = pd.DataFrame({"trip_id": ["a", "a"], "lat": [1.0, 2.0], "lon": [1.0, 2.0], "ts": pd.to_datetime([5, 6], unit="s")})
    assert not list(step["f"](("v",), iter([f]), state)) and state.memory
