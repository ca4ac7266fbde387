"""Searches against plain ones on small random networks."""

import heapq

import numpy as np
import pytest
from headway.operators import cells, routing, search
from pyspark.sql import functions as F

EDGES = "edge_id long, src long, dst long, miles double, speed_mph double, heading double"


def network(rng, n=14, m=45):
    return [(i, int(a), int(b), float(x) + 0.05, 30.0, float(h)) for i, (a, b, x, h) in enumerate(zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.random(m), rng.integers(0, 36, m) * 10)) if a != b]


def delay(before, after):
    d = (after - before + 180) % 360 - 180
    a, right = abs(d), d >= 0
    return 0 if a <= 20 else (0.5 if right else 1.0) if a <= 45 else (1.0 if right else 2.5) if a <= 135 else (1.5 if right else 3.5) if a <= 160 else 9.5


def test_turns_change_ways(spark):
    rng = np.random.default_rng(6)
    e = network(rng)
    ods = [(f"k{o}-{d}", o, d) for o in (0, 3, 5) for d in range(14)] + [("null", None, 1)]
    df = spark.createDataFrame([*e, (900, 0, 1, None, 30.0, 0.0), (901, 0, 1, 1.0, 0.0, 0.0)], EDGES)
    got = {r.od_key: (r.minutes, r.edges) for r in search.paths_with_turns(spark.createDataFrame(ods, "od_key string, o long, d long"), df).collect()}
    by = {k: (s, d, 2 * m, h) for k, s, d, m, _, h in e}
    changed = 0
    for key, o, d in ods:
        if o is None or o == d:
            assert key not in got
            continue
        best, heap = {}, [(c, k) for k, (s, _, c, _) in by.items() if s == o]
        heapq.heapify(heap)
        while heap:
            c, k = heapq.heappop(heap)
            if k in best:
                continue
            best[k] = c
            for j, (s, _, more, h) in by.items():
                if s == by[k][1] and j not in best:
                    heapq.heappush(heap, (c + more + delay(by[k][3], h) / 60, j))
        ends = [c for k, c in best.items() if by[k][1] == d]
        assert (key in got) == bool(ends)
        if ends:
            minutes, way = got[key]
            assert minutes == pytest.approx(min(ends)) and by[way[0]][0] == o and by[way[-1]][1] == d
            assert all(by[a][1] == by[b][0] for a, b in zip(way, way[1:]))
            assert minutes == pytest.approx(sum(by[k][2] for k in way) + sum(delay(by[a][3], by[b][3]) for a, b in zip(way, way[1:])) / 60)
            changed += minutes > sum(by[k][2] for k in way)
    assert changed


def test_a_turn_diverts(spark):
    # straight on for 2.15 minutes, or over two left turns for 2.0 and five seconds of delay, which is 2.08
    e = [(1, 0, 1, 1.0, 60.0, 0.0), (2, 1, 3, 1.15, 60.0, 0.0), (3, 1, 2, 0.5, 60.0, 270.0), (4, 2, 3, 0.5, 60.0, 180.0)]
    ods = spark.createDataFrame([("k", 0, 3)], "od_key string, o long, d long")
    assert search.paths_with_turns(ods, spark.createDataFrame(e, EDGES)).first().edges == [1, 3, 4]
    e[3] = (4, 2, 3, 0.5, 60.0, 90.0)  # a turn back: 9.5 s
    assert search.paths_with_turns(ods, spark.createDataFrame(e, EDGES)).first().edges == [1, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_charge_limits_ways(spark, seed):
    rng = np.random.default_rng(seed)
    e = [(int(a), int(b), round(float(t), 3) + 0.1, round(float(k), 3) + 0.05) for a, b, t, k in zip(rng.integers(0, 9, 32), rng.integers(0, 9, 32), rng.random(32), rng.random(32)) if a != b]
    ods = [(f"k{o}-{d}-{c}", o, d, c) for o in (0, 4) for d in range(9) for c in (0.3, 0.8, 1.5, 9.0)] + [("null", 1, None, 5.0)]
    df = spark.createDataFrame([*e, (0, 1, None, 0.1), (0, 1, -1.0, 0.1), (0, 1, 0.001, 0.0)], "src long, dst long, minutes double, kwh double")
    got = {r.od_key: (r.minutes, r.kwh, r.path) for r in search.charge_limited_paths(spark.createDataFrame(ods, "od_key string, o long, d long, charge_kwh double"), df).collect()}

    def best(o, d, charge):
        found, todo = None, [(0.0, 0.0, [o])]
        while todo:
            t, k, path = todo.pop()
            if path[-1] == d:
                found = min(found or (9e9,), (t, k, path))
                continue
            todo += [(t + t1, k + k1, [*path, b]) for a, b, t1, k1 in e if a == path[-1] and b not in path and k + k1 <= charge]
        return found

    limited = 0
    for key, o, d, c in ods:
        want = best(o, d, c) if d is not None and o != d else None
        assert (key in got) == bool(want)
        if want:
            assert got[key][:2] == pytest.approx(want[:2]) and got[key][2] == want[2]
            limited += want[0] > best(o, d, 1e9)[0]
    assert limited


@pytest.mark.parametrize("tile", [3, 12, 10_000])
def test_overlay_equals_plain_search(spark, tile):
    rng = np.random.default_rng(tile)
    n = 60
    v = [(k, float(40 + a), float(-105 + b)) for k, (a, b) in enumerate(rng.random((n, 2)))]
    e = [(i, a, b, float(rng.random()) + 0.01, 30.0) for i, (a, b) in enumerate((a, b) for a in range(n) for b in sorted(range(n), key=lambda q: np.hypot(*(np.array(v[a][1:]) - v[q][1:])))[1:4])]
    edges = spark.createDataFrame([*e, (900, 0, 1, None, 30.0), (901, 0, 1, 1.0, 0.0), (902, 0, 999, 1.0, 30.0)], "edge_id long, src long, dst long, miles double, speed_mph double")
    ods = spark.createDataFrame([(f"k{o}-{d}", o, d) for o in (0, 7, 30) for d in range(0, n, 7)] + [("null", None, 1), ("same", 4, 4), ("lost", 1, 999)], "od_key string, o long, d long")
    got = {r.od_key: (r.minutes, r.path) for r in routing.overlay_paths(ods, spark.createDataFrame(v, "vertex_id long, lat double, lon double"), edges, tile).collect()}
    want = {r.od_key: (r.minutes, r.path) for r in routing.fastest_paths(ods, edges.filter("dst < 999")).collect()}
    assert set(got) == set(want) and len(got) > 5
    assert all(got[k][0] == pytest.approx(want[k][0]) and list(got[k][1]) == list(want[k][1]) for k in want)


def test_quadtree(spark):
    rng = np.random.default_rng(9)
    pts = [(float(a), float(b)) for a, b in np.concatenate([rng.random((500, 2)) * 1000, rng.random((1500, 2)) * 0.01 + 7])] + [(3.0, 3.0)] * 400
    p = spark.createDataFrame([(i, *q) for i, q in enumerate(pts)], "id long, x double, y double")
    rows = p.withColumn("code", cells.code(F.col("x"), F.col("y"), cells.box_of(p)))
    tree = cells.leaves(rows, 50)
    placed = cells.placed(rows, tree).collect()
    assert sorted(r.id for r in placed) == list(range(len(pts)))
    full = {}
    for r in placed:
        full.setdefault((r.depth, r.prefix), set()).add((r.x, r.y))
    assert all(len(s) <= 50 for s in full.values())  # equal points are one place, whatever their number
    assert sum(r.n for r in tree.collect()) == len(pts)
    assert cells.placed(rows.filter("false"), cells.leaves(rows.filter("false"), 5)).count() == 0


@pytest.mark.parametrize("tile", [2, 5, 1_000])
def test_turns_over_tiles_equal_rounds_over_edges(spark, tile):
    rng = np.random.default_rng(tile)
    e = network(rng, 20, 70)
    v = [(k, float(40 + a), float(-105 + b)) for k, (a, b) in enumerate(rng.random((19, 2)))] + [(19, None, None)]
    ods = spark.createDataFrame([(f"k{o}-{d}", o, d) for o in (0, 3, 19) for d in range(0, 20, 2)] + [("null", None, 1)], "od_key string, o long, d long")
    df = spark.createDataFrame(e, EDGES)
    plain = {r.od_key: (r.minutes, r.edges) for r in search.paths_with_turns(ods, df).collect()}
    tiled = {r.od_key: (r.minutes, r.edges) for r in search.paths_with_turns(ods, df, spark.createDataFrame(v, "vertex_id long, lat double, lon double"), tile).collect()}
    assert set(tiled) == set(plain) and len(plain) > 5
    assert all(tiled[k][0] == pytest.approx(plain[k][0]) and tiled[k][1] == plain[k][1] for k in plain)


def test_named_ends_in_one_place(spark):
    # 1 and 5 stand in one place; the way from 5 is the one that was asked for
    v = spark.createDataFrame([(1, 40.0, -105.0), (5, 40.0, -105.0), (2, 40.0, -105.1), (3, 40.1, -105.0)], "vertex_id long, lat double, lon double")
    e = spark.createDataFrame([(1, 1, 2, 1.0, 30.0), (2, 5, 3, 1.0, 30.0), (3, 3, 2, 1.0, 30.0)], "edge_id long, src long, dst long, miles double, speed_mph double")
    ods = spark.createDataFrame([("k", 5, 2)], "od_key string, o long, d long")
    shape = routing.shortest_paths(ods, v, e).orderBy("shape_pt_sequence").collect()
    assert [r.shape_pt_lat for r in shape] == [40.0, 40.1, 40.0]


def test_network_without_neighbourhoods(spark):
    rng = np.random.default_rng(4)
    n = 600
    v = spark.createDataFrame([(k, float(40 + a), float(-105 + b)) for k, (a, b) in enumerate(rng.random((n, 2)))], "vertex_id long, lat double, lon double")
    e = spark.createDataFrame([(i, a, (a + s) % n, float(m) + 0.1, 30.0) for i, (a, s, m) in enumerate((a, s, rng.random()) for a in range(n) for s in (1, 7, n - 5))], "edge_id long, src long, dst long, miles double, speed_mph double")
    ods = spark.createDataFrame([("a", 3, 40), ("b", 10, 590)], "od_key string, o long, d long")
    got = {r.od_key: r.path for r in routing.overlay_paths(ods, v, e, 300).collect()}
    assert got == {r.od_key: r.path for r in routing.fastest_paths(ods, e).collect()} and len(got) == 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_plain_search(monkeypatch, seed):
    monkeypatch.setattr(search, "LEAF_MOVES", 10)
    rng = np.random.default_rng(seed)
    n = 120
    at = rng.random((n, 2))
    code = sum((((at * 64).astype(int) >> b & 1) @ [1, 2]) << (2 * b) for b in range(6)) << 2 * (cells.DEPTH - 6)
    roads = [(a, int(b)) for a in range(n) for b in np.argsort(np.hypot(*(at - at[a]).T))[1:4]]
    moves = [(i, j, rng.random() + 0.01, code[v]) for i, (_, v) in enumerate(roads) for j, (u, _) in enumerate(roads) if u == v]
    state, after, cost, cell = (np.array(x) for x in zip(*moves))
    ins, outs = (np.sort(rng.choice(len(roads), 25, replace=False)) for _ in range(2))
    got = search.fold(state, after, cost, cell, ins, outs, len(roads))
    want = {(a, b): c for a, b, c, _ in search.ways_inside(state.tolist(), after.tolist(), cost.tolist(), dict.fromkeys(ins.tolist(), outs.tolist()), paths=False)}
    assert len(want) > 50
    for i, a in enumerate(ins.tolist()):
        for j, b in enumerate(outs.tolist()):
            assert a == b or got[i, j] == pytest.approx(want.get((a, b), np.inf))


def test_origins_pass_through_tiles_together(spark, monkeypatch):
    # no row for each pair of portals and each origin that reached one, but one for each portal and block of origins
    rng = np.random.default_rng(3)
    w = 12
    v = [(k, 40 + (k // w) * 0.002, -105 + (k % w) * 0.002) for k in range(w * w)]
    e = [(a * 4 + q, a, a + dr * w + dc, float(rng.random()) + 0.2, 30.0, (450.0 - q * 90) % 360) for a in range(w * w) for q, (dr, dc) in enumerate(((0, 1), (1, 0), (0, -1), (-1, 0))) if 0 <= a // w + dr < w and 0 <= a % w + dc < w]
    ods = [(f"k{o}", o, w * w - 1 - o) for o in range(0, w, 3)] + [("near", 0, 2)]
    monkeypatch.setattr(search, "least_costs", lambda *a, **k: pytest.fail("joins of labels and pairs of portals"))
    monkeypatch.setattr(search, "BLOCK", 2)
    got = search.paths_with_turns(spark.createDataFrame(ods + [("same", 5, 5)], "od_key string, o long, d long"), spark.createDataFrame(e, EDGES), spark.createDataFrame(v, "vertex_id long, lat double, lon double"), 40)
    got = {r.od_key: (r.minutes, r.edges) for r in got.collect()}
    assert set(got) == {k for k, _, _ in ods}
    by = {x[0]: x for x in e}
    for key, o, d in ods:
        best, heap = {}, [(2 * x[3], x[0], [x[0]]) for x in e if x[1] == o]
        while True:
            c, k, way = heapq.heappop(heap)
            if by[k][2] == d:
                break
            if k not in best:
                best[k] = c
                for x in e:
                    if x[1] == by[k][2] and x[0] not in best:
                        heapq.heappush(heap, (c + 2 * x[3] + delay(by[k][5], x[5]) / 60, x[0], [*way, x[0]]))
        assert got[key][0] == pytest.approx(c) and got[key][1] == way


def test_turns_without_neighbourhoods(spark, monkeypatch):
    # nearly all pairs of edges are portals: the search goes by rounds over edges, with the same ways
    monkeypatch.setattr(search, "TILE_PAIRS", 20)
    e = network(np.random.default_rng(2), 8, 30)
    v = spark.createDataFrame([(k, 40.0 + k, -105.0) for k in range(8)], "vertex_id long, lat double, lon double")
    ods, df = spark.createDataFrame([("a", 0, 5), ("b", 3, 7)], "od_key string, o long, d long"), spark.createDataFrame(e, EDGES)
    assert {tuple(map(str, r)) for r in search.paths_with_turns(ods, df, v, 4).collect()} == {tuple(map(str, r)) for r in search.paths_with_turns(ods, df).collect()}
