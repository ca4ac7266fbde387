"""Traces with noise, gaps and detours against a matcher that tries all walks of a small network."""

import numpy as np
import pandas as pd
import pytest
from headway.operators import matching

STEP = 0.002
TRACE = "shape_id string, second int, lat double, lon double"


def grid(rows, cols):
    v = [(i * cols + j, 40 + i * STEP, -105 + j * STEP * 1.3) for i in range(rows) for j in range(cols)]
    e = [(0, 0, 0, 0.0, 0.0)][:0]
    for i in range(rows):
        for j in range(cols):
            for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= i + di < rows and 0 <= j + dj < cols:
                    e.append((len(e), i * cols + j, (i + di) * cols + j + dj, 0.13, 20.0 + (i * 7 + j * 3 + di) % 25))
    return v, e


def trace(v, walk, rng, fixes=5, noise_m=10.0, gaps=()):
    """Fixes along a walk over vertices, up to ``noise_m`` off; streets in ``gaps`` have only the one at their start."""
    at, out = {k: (lat, lon) for k, lat, lon in v}, []
    for n, (a, b) in enumerate(zip(walk, walk[1:])):
        for f in range(1 if n in gaps else fixes):
            out.append([at[a][i] + (at[b][i] - at[a][i]) * f / fixes for i in (0, 1)])
    out.append(list(at[walk[-1]]))
    off = rng.uniform(-noise_m, noise_m, (len(out), 2)) / np.array([111_194.9, 111_194.9 * np.cos(np.radians(40))])
    return np.array(out) + off


def edges_of(e, walk):
    by = {(s, d): k for k, s, d, *_ in e}
    return [by[p] for p in zip(walk, walk[1:])]


def brute(v, e, points, most):
    """Of all walks of up to ``most`` edges the one whose edges, passed in order, lie nearest to the points; each
    edge has to have a point, and a walk of more edges has to be nearer by 20 m at one point."""
    frame = pd.DataFrame(e, columns=["edge_id", "src", "dst", "miles", "mph"]).assign(minutes=1.0)
    at = pd.DataFrame(v, columns=["id", "lat", "lon"]).set_index("id")
    for k, c in (("1", "src"), ("2", "dst")):
        frame[f"lat{k}"], frame[f"lon{k}"] = at.lat[frame[c]].to_numpy(), at.lon[frame[c]].to_numpy()
    s = matching.Streets(frame, points[:, 0].mean())
    d = s.placed(points[:, 1] * s.kx, points[:, 0] * s.ky)[0] ** 2
    best = (np.inf, None)

    def extend(walk, cost):
        # cost[i]: least sum for the first i + 1 points with the last one on the walk's last edge
        nonlocal best
        best = min(best, (cost[-1] + 400.0 * len(walk), walk))
        if len(walk) == most:
            return
        for k in s.out[s.dst[walk[-1]]]:
            now, new = np.inf, np.full(len(cost), np.inf)
            for i in range(1, len(cost)):
                now = min(now, cost[i - 1]) + d[i, k]
                new[i] = now
            if new.min() + 400.0 * len(walk) < best[0]:
                extend([*walk, k], new)

    for k in np.flatnonzero(d[0] < 60**2):
        extend([int(k)], np.cumsum(d[:, k]))
    return best[1]


WALKS = [[0, 1, 2, 6, 10, 11], [0, 4, 5, 1, 2, 3], [8, 9, 5, 6, 2, 3], [3, 2, 1, 5, 9, 8], [0, 1, 5, 4, 8, 9]]


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_walks(spark, seed):
    v, e = grid(3, 4)
    rng = np.random.default_rng(seed)
    traces = {f"w{n}": trace(v, w, rng, gaps=(2,) if n % 2 else ()) for n, w in enumerate(WALKS)}
    rows = [(k, i, *map(float, p)) for k, t in traces.items() for i, p in enumerate(t)]
    got = matched(spark, v, e, rows)
    for n, w in enumerate(WALKS):
        assert got[f"w{n}"] == edges_of(e, w) == brute(v, e, traces[f"w{n}"], 6)


def matched(spark, v, e, rows, **params):
    df = spark.createDataFrame(rows, TRACE)
    out = matching.match_lcss(df, spark.createDataFrame(v, "vertex_id long, lat double, lon double"), spark.createDataFrame(e, "edge_id long, src long, dst long, miles double, speed_mph double"), **params)
    got = {}
    for r in out.orderBy("shape_id", "seq").collect():
        got.setdefault(r.shape_id, []).append(r.edge_id)
    return got


def test_detours_loops_and_long_gaps(spark):
    v, e = grid(8, 8)
    rng = np.random.default_rng(4)
    walks = {
        "spike": [0, 1, 2, 10, 18, 10, 2, 3, 4],  # up a street and back
        "loop": [0, 1, 9, 8, 0, 1, 2],
        "round": [27, 28, 36, 35, 27],  # ends where it begins
        "far": [0, 8, 16, 24, 32, 40, 48, 56, 57, 58, 59, 60, 61, 62, 63, 55, 47, 39, 31, 23, 15, 7],
    }
    rows = [(k, i, *map(float, p)) for k, w in walks.items() for i, p in enumerate(trace(v, w, rng, fixes=8))]
    got = matched(spark, v, e, rows)
    assert got == {k: edges_of(e, w) for k, w in walks.items()}


def test_tiles_reach_and_odd_traces(spark):
    v, e = grid(4, 4)
    # a second town, 30 km away, not connected with the first one
    v += [(100 + k, lat + 0.3, lon) for k, lat, lon in v]
    e += [(1000 + k, 100 + s, 100 + d, m, mph) for k, s, d, m, mph in e]
    e += [(5000, 0, 5, None, 30.0), (5001, 0, 5, 0.1, 0.0), (5002, 0, 777, 0.1, 30.0)]  # without length, speed, end
    rng = np.random.default_rng(1)
    one, two = trace(v, [0, 1, 2, 3], rng), trace(v, [100, 104, 108], rng)
    rows = [("both", i, *map(float, p)) for i, p in enumerate([*one, *two])]
    rows += [("off", i, *map(float, p + 0.03)) for i, p in enumerate(one)]  # 3 km beside, found with the larger reach
    rows += [("nowhere", i, 50.0, 3.0 + i * 1e-4) for i in range(5)] + [("point", 0, 40.0, -105.0 + STEP / 2)]
    rows += [("nulls", 0, None, -105.0), ("nulls", 1, 40.0, -105.0), ("nulls", 2, 40.0, None), ("nulls", 3, 40.0, -105 + STEP * 1.3), ("empty", 0, None, None)]
    got = matched(spark, v, e, rows)
    assert got["both"] == edges_of(e, [0, 1, 2, 3]) + edges_of(e, [100, 104, 108])
    assert got["nulls"] == edges_of(e, [0, 1]) and len(got["point"]) == 1 and len(got["off"]) >= 1
    assert "nowhere" not in got and "empty" not in got
    assert matched(spark, v, e, rows[:0]) == {}


def test_common_share():
    assert matching.common_share(np.array([[0.0, 90.0], [90.0, 0.0]]), 50.0) == 1
    assert matching.common_share(np.array([[90.0, 0.0], [0.0, 90.0]]), 50.0) == 0.5  # in the wrong order
    assert matching.common_share(np.array([[25.0], [90.0]]), 50.0) == 0.5


def test_roads_that_shapes_share_travel_once(spark, monkeypatch):
    # traces along one street of 30 pieces, one beyond a gap: close ones are matched in batches, the same as each by its own tiles
    v = spark.createDataFrame([(k, 40.0, -105.0 + k * 0.002) for k in range(31)], "vertex_id long, lat double, lon double")
    e = spark.createDataFrame([(k, k, k + 1, 0.1, 30.0) for k in range(30)] + [(100 + k, k + 1, k, 0.1, 30.0) for k in range(30)], "edge_id long, src long, dst long, miles double, speed_mph double")
    rows = [(f"s{a}", q, 40.0 + ((q * 7 + a) % 5 - 2) * 4e-5, -105.0 + 0.002 * a + q * 0.0005 + 0.0002) for a in range(5) for q in range(80)]
    rows += [("gap", q, 40.0, -104.9998 + q * 0.01) for q in range(5)]
    trace = spark.createDataFrame(rows, "shape_id string, second int, lat double, lon double")
    alone = []
    monkeypatch.setattr(matching, "roads_of_shapes", lambda t, *a, f=matching.roads_of_shapes: (alone.extend(sorted(r[0] for r in t.select("shape_id").distinct().collect())), f(t, *a))[1])
    got = {}
    for r in matching.match_lcss(trace, v, e).orderBy("shape_id", "seq").collect():
        got.setdefault(r.shape_id, []).append(r.edge_id)
    assert alone == ["gap"]
    assert got == {**{f"s{a}": list(range(a, a + 20)) for a in range(5)}, "gap": list(range(20))}


def test_roads_travel_once_for_traces_with_gaps(spark, monkeypatch):
    # gaps of 300 m are matched with the roads near the trace; for traces with gaps of 850 m, the roads within a kilometre are there once for all
    v = spark.createDataFrame([(k, 40.0, -105.0 + k * 0.002) for k in range(31)], "vertex_id long, lat double, lon double")
    e = spark.createDataFrame([(k, k, k + 1, 0.1, 30.0) for k in range(30)] + [(100 + k, k + 1, k, 0.1, 30.0) for k in range(30)], "edge_id long, src long, dst long, miles double, speed_mph double")
    rows = [(f"short{a}", q, 40.0 + ((q * 7 + a) % 5 - 2) * 4e-5, -104.9998 + q * 0.0005) for a in range(12) for q in range(80) if not 20 <= q < 26]
    rows += [(f"long{a}", q, 40.0 + (a - 6) * 1e-5, -104.9998 + q * 0.01) for a in range(12) for q in range(5)]
    far, sent = [], []

    def watched(t, *a, f=matching.roads_of_shapes):
        far.extend(sorted(r[0] for r in t.select("shape_id").distinct().collect()))
        sent.append(f(t, *a).count())
        return f(t, *a)

    monkeypatch.setattr(matching, "roads_of_shapes", watched)
    got = {}
    for r in matching.match_lcss(spark.createDataFrame(rows, TRACE), v, e).orderBy("shape_id", "seq").collect():
        got.setdefault(r.shape_id, []).append(r.edge_id)
    assert far == sorted(f"long{a}" for a in range(12)) and sent[0] <= 4 * 60
    assert got == {f"{k}{a}": list(range(20)) for k in ("short", "long") for a in range(12)}
