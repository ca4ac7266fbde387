"""Spatial joins of crowded places and of polygons with holes, against plain ones."""

import json
import struct

import numpy as np
import pytest
from headway.operators import spatial
from headway.sources import files

EDGES = "edge_id long, x1 double, y1 double, x2 double, y2 double"


def plain(points, edges):
    out = {}
    for k, x, y in points:
        if x is None or y is None:
            out[k] = None
            continue
        best = None
        for e, x1, y1, x2, y2 in edges:
            dx, dy = x2 - x1, y2 - y1
            t = 0.0 if dx == dy == 0 else min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
            d = np.hypot(x - x1 - t * dx, y - y1 - t * dy)
            if best is None or (round(d, 9), e) < best:
                best = (round(d, 9), e)
        out[k] = best
    return out


@pytest.mark.parametrize("crowd", [20, 250_000])
def test_crowded_places(spark, crowd):
    rng = np.random.default_rng(crowd)
    pts = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.random((40, 2)) * 9000, 1234 + rng.random((120, 2)) * 3, np.full((60, 2), 1235.5), [[50_000, 50_000]]]))]
    pts += [(900, None, 1.0), (901, 2.0, None)]
    ends = np.concatenate([rng.random((40, 2)) * 9000, 1234 + rng.random((90, 2)) * 3, np.full((30, 2), 1236.0)])
    edges = [(i, float(a), float(b), float(a + c), float(b + e)) for i, ((a, b), (c, e)) in enumerate(zip(ends, rng.random((len(ends), 2)) * np.where(np.arange(len(ends)) < 40, 700, 0.4)[:, None]))]
    edges += [(500 + k, *edges[45][1:]) for k in range(20)] + [(-1, *edges[50][1:])]  # equal edges, the lowest id counts
    got = {r.point_id: r for r in spatial.nearest_edge(spark.createDataFrame(pts, "point_id long, x double, y double"), spark.createDataFrame(edges, EDGES), cell_m=200.0, crowd=crowd).collect()}
    for k, best in plain(pts, edges).items():
        assert (got[k].edge_id is None) == (best is None)
        if best:
            assert got[k].distance == pytest.approx(best[0], abs=1e-6)
            assert got[k].edge_id == best[1] or abs(plain([pts[k]], [e for e in edges if e[0] == got[k].edge_id])[k][0] - best[0]) < 1e-9
    assert len(got) == len(pts)


def test_no_edges_and_no_points(spark):
    p, e = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double"), spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], EDGES)
    assert [tuple(r) for r in spatial.nearest_edge(p, e.filter("false"), rounds=2).collect()] == [(1, 0.0, 0.0, None, None)]
    assert spatial.nearest_edge(p.filter("false"), e).count() == 0


SQUARE = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
#: A square with a hole and an island in it, and a county of two parts, one of which shares a border with the square.
FEATURES = [
    {"properties": {"STATEFP": "49", "COUNTYFP": "001"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE(0, 10), SQUARE(2, 8)], [SQUARE(4, 6)]]}},
    {"properties": {"STATEFP": "49", "COUNTYFP": "003"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[10, 0], [20, 0], [20, 10], [10, 10], [10, 0]]], [SQUARE(2.5, 3.5)]]}},
    {"properties": {"STATEFP": "49", "COUNTYFP": "005"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE(30, 31)]}},
]
INSIDE = {(1.0, 1.0): {"001"}, (3.0, 3.0): {"003"}, (5.0, 5.0): {"001"}, (7.0, 7.0): set(), (15.0, 5.0): {"003"}, (25.0, 5.0): set(), (30.5, 30.5): {"005"}}


def shapefile(folder):
    body, rows = b"", b""
    for k, f in enumerate(FEATURES):
        c = f["geometry"]["coordinates"]
        rings = [r for part in (c if f["geometry"]["type"] == "MultiPolygon" else [c]) for r in part]
        starts = np.cumsum([0] + [len(r) for r in rings])
        rec = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), starts[-1]) + struct.pack(f"<{len(rings)}i", *starts[:-1]) + b"".join(struct.pack("<2d", *p) for r in rings for p in r)
        body += struct.pack(">2i", k + 1, len(rec) // 2) + rec
        rows += b" " + f["properties"]["STATEFP"].encode() + b"x " + f["properties"]["COUNTYFP"].encode()
    body += struct.pack(">2i", 9, 2) + struct.pack("<i", 0)  # a record without a shape
    rows += b" 49xx999"
    field = lambda name, size: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15
    head = struct.pack("<B3BIHH", 3, 99, 1, 1, 4, 32 + 3 * 32 + 1, 8) + b"\0" * 20 + field("STATEFP", 2) + field("NAME", 2) + field("COUNTYFP", 3) + b"\r"
    (folder / "c.shp").write_bytes(b"\0" * 100 + body)
    (folder / "c.dbf").write_bytes(head + rows)
    return str(folder / "c.shp")


def test_holes_parts_and_islands(spark, tmp_path):
    (tmp_path / "c.geojson").write_text(json.dumps({"features": FEATURES}))
    pts = spark.createDataFrame([(f"{x},{y}", x, y) for x, y in INSIDE] * 2, "point_id string, x double, y double")
    for path in (str(tmp_path / "c.geojson"), shapefile(tmp_path)):
        counties = files.read_counties(spark, path)
        for cell in (1.0, 100.0):
            got = {(r.point_id, r.polygon_id[4:7]) for r in spatial.containing(pts, counties.withColumnRenamed("county_id", "polygon_id"), cell).collect()}
            assert got == {(f"{x},{y}", c) for (x, y), cs in INSIDE.items() for c in cs}
    near = spatial.nearest_within(pts.filter("x = 7 OR x = 25"), counties.withColumnRenamed("county_id", "polygon_id"), 5.0)
    # the border of the hole is the nearest one of the point in it
    assert {(r.point_id, r.polygon_id[4:7], r.distance) for r in near.collect()} == {("7.0,7.0", "001", 1.0), ("25.0,5.0", "003", 5.0)}
