import numpy as np
import pytest
from headway.functions import energy as en
from headway.operators import energy, terrain

GRID = terrain.Grid(-105.0, 40.0, 0.001, 4)


def raster(spark, height, size=14, missing=()):
    rows = [(i, j, float(height(i, j))) for i in range(-2, size) for j in range(size) if (i, j) not in missing]
    return terrain.tiles(spark.createDataFrame([*rows, (3, 3, float(height(3, 3)) + 5.0), (None, 1, 1.0)], "i long, j long, height double"), GRID)


def test_heights_are_bilinear_over_tile_borders(spark):
    rng = np.random.default_rng(3)
    h = rng.random((16, 14)) * 100
    tiles = raster(spark, lambda i, j: h[i + 2, j], missing={(9, 9)})
    pts = [(k, float(40 + y * 0.001), float(-105 + x * 0.001)) for k, (x, y) in enumerate([*(rng.random((200, 2)) * 12.9 + [-1.9, 0]), (4.0, 4.0), (8.0, 3.5), (9.5, 9.5), (50.0, 1.0)])]
    df = spark.createDataFrame([*pts, (999, None, -105.0)], "id long, lat double, lon double").selectExpr("*", "1 as heights", "2 as `a.b`")
    got = {r.id: r.height for r in terrain.heights(df.drop("heights"), tiles, GRID).collect()}
    for k, lat, lon in pts:
        x, y = (lon + 105.0) / 0.001, (lat - 40.0) / 0.001
        i, j = int(np.floor(x)), int(np.floor(y))
        corners = [(i + a, j + b) for a in (0, 1) for b in (0, 1)]
        if any(c == (9, 9) or not (-2 <= c[0] < 14 and 0 <= c[1] < 14) for c in corners):
            assert got[k] is None
        else:
            u, v = x - i, y - j
            want = (h[i + 2, j] * (1 - u) + h[i + 3, j] * u) * (1 - v) + (h[i + 2, j + 1] * (1 - u) + h[i + 3, j + 1] * u) * v
            assert got[k] == pytest.approx(want, abs=1e-6)
    assert got[999] is None and len(got) == len(pts) + 1


def test_grades(spark):
    tiles = raster(spark, lambda i, j: 10.0 * j)  # ten metres up each step to the north
    ends = [(1, 40.001, -104.999, 40.009, -104.999), (2, 40.009, -104.999, 40.001, -104.999), (3, 40.005, -104.999, 40.005, -104.991), (4, 40.001, -104.999, 40.5, -104.999), (5, 40.003, -104.999, 40.003, -104.999), (6, None, 1.0, 1.0, 1.0)]
    e = spark.createDataFrame(ends, "edge_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.edge_id: r for r in terrain.edge_grades(e, tiles, GRID, smooth=0).collect()}
    rise = 10.0 / (0.001 * np.pi / 180 * 6371_000)
    assert got[1].grade == pytest.approx(rise, rel=1e-6) and got[1].climb_m == pytest.approx(80)
    assert got[2].grade == pytest.approx(-rise, rel=1e-6) and got[2].climb_m == 0 and abs(got[3].grade) < 1e-9
    assert got[4].grade is None and got[4].climb_m is None and got[5].grade is None and got[5].climb_m == 0 and 6 not in got
    v = spark.createDataFrame([(1, 40.001, -104.999), (2, 40.009, -104.999), (3, 45.0, -104.999)], "vertex_id long, lat double, lon double")
    roads = spark.createDataFrame([(7, 1, 2, 0.0), (8, 2, 3, 0.5)], "edge_id long, src long, dst long, grade double")
    graded = {r.edge_id: r.grade for r in terrain.with_grades(roads, v, tiles, GRID, smooth=0).collect()}
    assert graded[7] == pytest.approx(rise, rel=1e-6) and graded[8] == 0


def test_trip_charge(spark):
    v = en.vehicle_catalog(spark)
    paths = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 1)], "shape_id string, seq int, edge_id long")
    edges = spark.createDataFrame([(1, 10.0, 30.0, 0.0), (2, 10.0, 30.0, 0.05)], "edge_id long, miles double, speed_mph double, grade double")
    stops = spark.createDataFrame([("s", 1), ("s", 1)], "shape_id string, edge_id long")
    t = spark.createDataFrame([("plain", "s", 50.0, False), ("stops", "s", 50.0, True), ("default", "s", None, None), ("low", "s", 8.0, False), ("none", "other", 1.0, True)], "trip_id string, shape_id string, start_soc double, include_stop_penalty boolean")
    got = {r.trip_id: r for r in energy.trip_charge(t, paths, edges, v, stops).collect()}
    name, _, _, _, _, mass, battery, r0, r1, r2 = en.VEHICLES[0]
    flat, hill, stop = (r0 + 30 * r1) * 10, (r0 + 30 * r1 + 0.05 * r2) * 10, 0.5 * mass * (30 * 0.44704) ** 2 / 3.6e6
    plain = 2 * flat + hill
    assert got["plain"].energy_used == pytest.approx(plain) and got["plain"].end_soc == pytest.approx(50 - 100 * plain / battery) and got["plain"].empty_seq is None
    assert got["stops"].energy_used == pytest.approx(plain + 2 * stop) and got["default"].end_soc == pytest.approx(100 - 100 * (plain + 2 * stop) / battery)
    assert got["low"].end_soc == 0 and got["low"].empty_seq == (2 if flat <= 0.08 * battery else 1) and "none" not in got
