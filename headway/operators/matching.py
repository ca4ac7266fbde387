"""Map matching of traces by trajectory segmentation, with the network dealt to the shapes by tiles.

The roads near a shape are found by joining tiles of the plane: those that its trace crosses, widened by a reach, and
those that edges touch.  Shapes of one place meet the roads near any of them in one cogroup, so roads travel once for all shapes
of a batch, and no network travels with the tasks or passes through the driver.  Each shape uses its own roads only.  Shapes
that their roads do not connect are matched again with the next, larger reach.

In a group, a trace is first one segment.  The way between the ends of a segment is the fastest one, scored by
longest common subsequence; segments below the wanted similarity are cut where the trace leaves the way, until no cut
can better them.  The ways of all segments are chosen together, over all edges that their ends may lie on, so that
they connect.
"""

from __future__ import annotations

import copy
import heapq
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions import geo
from headway.operators.spatial import touched_cells
from headway.sources.staging import settle

#: Metres that weigh as much as a minute when an end is put on an edge beside it.
METRES_A_MINUTE = 500.0
_DEGREE = 111_194.9
#: Tiles are numbered row by row, with so many places in a row.
TILE_ROW = 1 << 32
#: Points of the shapes that are matched beside each other; a shape of more is a batch of its own.
BATCH = 100_000
#: Metres of the places that shapes of a batch have their middle in.
PLACE_M = 5_000.0
#: Points after which a dense trace is first cut.
EVERY = 16
#: Gaps, in multiples of the near distance, up to which a trace is matched with the roads near it.
GAPS = 2.0
#: Vertices that the remembered searches of a batch may have reached; beyond, they are begun anew.
REMEMBERED = 500_000


class Search:
    """Fastest ways from one vertex, as far as they have been asked for."""

    def __init__(self, streets: Streets, start: int):
        self.s, self.best, self.back, self.heap, self.done = streets, {start: 0.0}, {}, [(0.0, start)], {}
        self.ways: dict[int, tuple[float, list[int]]] = {start: (0.0, [])}

    def way(self, end: int) -> tuple[float, list[int]] | None:
        """(minutes, edges) to vertex ``end``, if it can be reached."""
        if end in self.ways:
            return self.ways[end]
        best, heap, done, s, own = self.best, self.heap, self.done, self.s, self.s.own
        while heap and end not in done:
            t, u = heapq.heappop(heap)
            if t > best[u]:
                continue
            done[u] = t
            for k in s.out.get(u, ()):
                if own is None or own[k]:
                    v, c = s.dst[k], t + s.minutes[k]
                    if c < best.get(v, np.inf):
                        best[v], self.back[v] = c, k
                        heapq.heappush(heap, (c, v))
        if end not in done:
            return None
        path, v = [], end
        while v in self.back:
            k = self.back[v]
            path.append(k)
            v = s.src[k]
        self.ways[end] = (done[end], path[::-1])
        return self.ways[end]


class Streets:
    """The roads around traces, on a plane in metres; searches over them are remembered."""

    def __init__(self, edges: pd.DataFrame, lat0: float):
        self.ids = edges["edge_id"].to_numpy()
        self.lat1, self.lon1, self.lat2, self.lon2 = (edges[k].to_numpy() for k in ("lat1", "lon1", "lat2", "lon2"))
        self.src, self.dst, self.minutes = edges["src"].tolist(), edges["dst"].tolist(), edges["minutes"].tolist()
        self.costs = edges["minutes"].to_numpy()
        self.out = defaultdict(list)
        for k, s in enumerate(self.src):
            self.out[s].append(k)
        self.searches: dict[int, Search] = {}
        self.tables: dict[tuple[bytes, bytes], tuple[np.ndarray, dict, np.ndarray]] = {}
        self.whole, self.own, self.among, self.reached = self, None, np.arange(len(self.ids)), 0
        self._lay(lat0)

    def _lay(self, lat0: float) -> None:
        self.ky, self.kx = _DEGREE, _DEGREE * np.cos(np.radians(lat0))
        self.x1, self.y1 = self.lon1 * self.kx, self.lat1 * self.ky
        self.dx, self.dy = self.lon2 * self.kx - self.x1, self.lat2 * self.ky - self.y1
        self.metres = np.hypot(self.dx, self.dy)
        self.square = np.maximum(self.dx * self.dx + self.dy * self.dy, 1e-12)

    def of(self, own: np.ndarray, lat0: float) -> Streets:
        """The same roads for one trace, which may use those marked in ``own``."""
        s = copy.copy(self)
        s.own, s.among = own, np.flatnonzero(own)
        s._lay(lat0)
        return s

    def placed(self, x, y, among=slice(None), low=0.0, high=1.0) -> tuple[np.ndarray, np.ndarray]:
        """(metres, share of the edge passed) of points, one row each, from edges, one column each, of which the part from
        share ``low`` to ``high`` is looked at."""
        dx, dy = self.dx[among], self.dy[among]
        x, y = np.atleast_1d(x)[:, None] - self.x1[among], np.atleast_1d(y)[:, None] - self.y1[among]
        t = np.minimum(np.maximum((x * dx + y * dy) / self.square[among], low), high)
        return np.hypot(x - t * dx, y - t * dy), t

    def around(self, x: np.ndarray, y: np.ndarray, metres: float, run: int = 16):
        """(first point, edges) of each run of points and the trace's edges whose box is within ``metres`` of theirs."""
        k = self.among
        x1, y1, x2, y2 = self.x1[k], self.y1[k], self.x1[k] + self.dx[k], self.y1[k] + self.dy[k]
        west, east, south, north = np.minimum(x1, x2) - metres, np.maximum(x1, x2) + metres, np.minimum(y1, y2) - metres, np.maximum(y1, y2) + metres
        for a in range(0, len(x), run):
            p, q = x[a : a + run], y[a : a + run]
            yield a, k[(west <= p.max()) & (east >= p.min()) & (south <= q.max()) & (north >= q.min())]

    def within(self, x: np.ndarray, y: np.ndarray, metres: float) -> np.ndarray:
        """Whether each point has an edge within ``metres``."""
        out = np.zeros(len(x), bool)
        for a, k in self.around(x, y, metres):
            if len(k):
                out[a : a + 16] = self.placed(x[a : a + 16], y[a : a + 16], k)[0].min(1) <= metres
        return out

    def _search(self, start: int) -> Search:
        return self.searches[start] if start in self.searches else self.searches.setdefault(start, Search(self, start))

    def _table(self, ka: np.ndarray, kb: np.ndarray, search) -> tuple[np.ndarray, dict, np.ndarray]:
        """(minutes, ways, edges of these), as ``between``."""
        begin, end = [self.dst[k] for k in ka.tolist()], [self.src[k] for k in kb.tolist()]
        ways = {}
        for v in set(begin):
            found = search(v)
            before = len(found.best)
            ways[v] = {u: way for u in set(end) if (way := found.way(u))}
            self.reached += len(found.best) - before
        used = {k for w in ways.values() for _, path in w.values() for k in path}
        self.reached += len(used) + len(begin) * len(end)
        minutes = np.array([[ways[v][u][0] if u in ways[v] else np.inf for u in end] for v in begin]).reshape(len(ka), len(kb))
        return minutes, ways, np.fromiter(used, int)

    def between(self, ka: np.ndarray, kb: np.ndarray) -> tuple[np.ndarray, dict]:
        """(minutes of the fastest way from the end of each edge of ``ka`` to the start of each of ``kb``, (minutes, edges) by these vertices).

        What was found over all roads serves all traces; where it leaves the trace's own roads, these alone are searched."""
        whole, key = self.whole, (ka.tobytes(), kb.tobytes())
        if key not in whole.tables:
            if whole.reached > REMEMBERED:
                whole.searches.clear()
                whole.tables.clear()
                whole.reached = 0
            whole.tables[key] = whole._table(ka, kb, whole._search)
        minutes, ways, used = whole.tables[key]
        if self.own is not None and not self.own[used].all():
            minutes, ways, _ = self._table(ka, kb, lambda v: Search(self, v))
        return minutes, ways


def common_share(metres: np.ndarray, epsilon: float) -> float:
    """Similarity of points (rows) and edges of a way (columns): the longest common subsequence, in which a point on an edge
    counts 1 and one at ``epsilon`` metres 0, as a share of the shorter of the two."""
    hits = np.maximum(1 - metres / epsilon, 0)
    if metres.shape[1] < 32:  # short rows are quicker as numbers than as arrays
        line = [0.0] * metres.shape[1]
        for hit in hits.tolist():
            before = most = 0.0
            for k, h in enumerate(hit):
                here = line[k]
                most = max(most, here, before + h)
                line[k], before = most, here
        return (line[-1] if line else 0.0) / max(min(metres.shape), 1)
    row = np.zeros(metres.shape[1] + 1)
    for hit in hits:
        row = np.concatenate([[0.0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + hit))])
    return float(row[-1]) / max(min(metres.shape), 1)


class Matcher:
    """One trace on its roads."""

    def __init__(self, streets: Streets, x: np.ndarray, y: np.ndarray, epsilon: float, similarity: float, cutting: float, farthest: float):
        self.s, self.x, self.y = streets, x, y
        self.epsilon, self.similarity, self.cutting, self.farthest = epsilon, similarity, cutting, farthest
        self.ends: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.judged: dict[tuple, list[int]] = {}
        self.links: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, dict]] = {}

    def place_all(self) -> None:
        """The candidates of all points that have a road within epsilon, a run of points at a time with the edges around them."""
        for a, around in self.s.around(self.x, self.y, self.epsilon):
            if len(around):
                d, t = self.s.placed(self.x[a : a + 16], self.y[a : a + 16], around)
                i, k = np.nonzero(d <= self.epsilon)
                edges, shares, metres = around[k], t[i, k], d[i, k]
                to = np.searchsorted(i, np.arange(len(d) + 1)).tolist()
                for p, (u, v) in enumerate(zip(to, to[1:], strict=False), a):
                    if u < v:
                        self.ends[p] = (edges[u:v], shares[u:v], metres[u:v])

    def candidates(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, share passed, metres) that point p may lie on: all within epsilon, else the nearest, if near enough."""
        if p not in self.ends:
            d, t = (v[0] for v in self.s.placed(self.x[p], self.y[p], self.s.among))
            k = np.flatnonzero(d <= max(self.epsilon, min(d.min(), self.farthest)))
            self.ends[p] = (self.s.among[k], t[k], d[k])
        return self.ends[p]

    def between(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray, dict]:
        """(minutes of the fastest way from each candidate of p to each of q, whether both are one edge along which it leads, ways between vertices)."""
        if (p, q) not in self.links:
            (ka, ta, _), (kb, tb, _), s = self.candidates(p), self.candidates(q), self.s
            inside, ways = s.between(ka, kb)
            minutes = ((1 - ta) * s.costs[ka])[:, None] + inside + tb * s.costs[kb]
            # a step back on one edge by less than epsilon is noise
            step = tb - ta[:, None]
            along = (ka[:, None] == kb) & (step * s.metres[ka][:, None] >= -self.epsilon)
            self.links[p, q] = np.where(along, np.maximum(step, 0.0) * s.costs[ka][:, None], minutes), along, ways
        return self.links[p, q]

    def way(self, p: int, q: int, i: int, j: int) -> list[int]:
        """The edges of the way from candidate i of p to candidate j of q, none if there is no way."""
        minutes, along, ways = self.between(p, q)
        a, b = int(self.candidates(p)[0][i]), int(self.candidates(q)[0][j])
        if along[i, j]:
            return [a]
        return [a, *ways[self.s.dst[a]][self.s.src[b]][1], b] if np.isfinite(minutes[i, j]) else []

    def chain(self, cuts: list[int]) -> tuple[list[tuple[list[int], float, float]], int]:
        """((edges, share passed where they begin, share passed where they end) of each segment, segments without a way): the
        best choice of candidates for all cuts together."""
        cost = self.candidates(cuts[0])[2] / METRES_A_MINUTE
        steps, breaks = [], 0
        for p, q in zip(cuts, cuts[1:], strict=False):
            off = self.candidates(q)[2] / METRES_A_MINUTE
            each = cost[:, None] + self.between(p, q)[0]
            back = each.argmin(0)
            now = each[back, np.arange(len(off))]
            if not np.isfinite(now).any():  # no way between: begin anew
                now, back, breaks = np.full(len(off), cost.min()), np.full(len(off), int(cost.argmin())), breaks + 1
            steps.append(back)
            cost = now + off
        j = int(cost.argmin())
        paths = []
        for (p, q), back in zip(list(zip(cuts, cuts[1:], strict=False))[::-1], steps[::-1], strict=True):
            i = int(back[j])
            paths.append((self.way(p, q, i, j), float(self.candidates(p)[1][i]), float(self.candidates(q)[1][j])))
            j = i
        return paths[::-1], breaks

    def cut(self, p: int, q: int, path: list[int], first: float, last: float) -> list[int]:
        """Points at which the segment p..q should be cut."""
        if not path:
            return [(p + q) // 2] if q - p > 1 else []
        # of the edges at the ends only the part that is passed
        low, high = np.zeros(len(path)), np.ones(len(path))
        low[0], high[-1] = first, max(last, first) if len(path) == 1 else last
        far = self.s.placed(self.x[p : q + 1], self.y[p : q + 1], np.array(path), low, high)[0]
        share, d = common_share(far, self.epsilon), far.min(1)
        if share >= self.similarity and d.max() <= self.epsilon:
            return []
        inner = np.arange(p + 1, q)
        d, found = d[1:-1], []
        for k in np.argsort(-d, kind="stable"):
            if d[k] <= self.epsilon:
                break
            if self.candidates(int(inner[k]))[2].min() <= self.epsilon:  # else a cut cannot bring it onto a road
                found.append(int(inner[k]))
                break
        at = np.flatnonzero((np.abs(d - self.epsilon) < self.cutting) & (d > self.cutting))
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            if len(run) and self.candidates(int(inner[run[len(run) // 2]]))[2].min() <= self.epsilon:
                found.append(int(inner[run[len(run) // 2]]))
        return sorted(set(found))

    def match(self, every: int | None = None) -> tuple[list[int], int]:
        """(edges of the way, places where it is broken); with ``every`` the trace is first cut at each such point that lies at a road."""
        near = [p for p in (0, len(self.x) - 1) if len(self.candidates(p)[0])]
        if len(near) < 2:
            return [], 1
        cuts = sorted({0, len(self.x) - 1})
        if len(cuts) < 2:
            k = self.candidates(0)
            return [int(k[0][k[2].argmin()])], 0
        if every:
            cuts = sorted({*cuts, *(p for p in range(every, len(self.x) - every // 2, every) if self.candidates(p)[2].min(initial=np.inf) <= self.epsilon)})
        while True:
            paths, breaks = self.chain(cuts)
            more = set()
            for p, q, (path, first, last) in zip(cuts, cuts[1:], paths, strict=False):
                key = (p, q, first, last, *path)
                if key not in self.judged:
                    self.judged[key] = self.cut(p, q, path, first, last)
                more.update(self.judged[key])
            more -= set(cuts)
            if not more:
                break
            cuts = sorted({*cuts, *more})
        way = [k for path, _, _ in paths for k in path]
        way = [int(k) for i, k in enumerate(way) if not i or way[i - 1] != k]
        # an end edge of which hardly anything is passed was only touched
        touched = lambda k, part: part * self.s.metres[k] < min(self.epsilon, 0.5 * self.s.metres[k])
        if len(way) > 1 and touched(way[0], 1 - paths[0][1]):
            way = way[1:]
        if len(way) > 1 and touched(way[-1], paths[-1][2]):
            way = way[:-1]
        return way, breaks


def located(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, src, dst, minutes, lat1, lon1, lat2, lon2) of usable edges: those with positive minutes and known ends."""
    end = lambda k, n: vertices.select(F.col("vertex_id").alias(k), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    minutes = F.try_divide(60 * F.col("miles"), F.col("speed_mph"))
    return edges.select("edge_id", "src", "dst", minutes.alias("minutes")).filter("minutes > 0").join(end("src", 1), "src").join(end("dst", 2), "dst").dropna()


def line_tiles(lat: np.ndarray, lon: np.ndarray, reach_m: float | np.ndarray, tile_m: float) -> np.ndarray:
    """The tiles within ``reach_m``, for all or for each of the lines to the next point, of one trace, also where it has gaps."""
    x, y = np.radians(lon) * geo.MERCATOR_M, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * geo.MERCATOR_M
    nx, ny = np.append(x[1:], x[-1]), np.append(y[1:], y[-1])
    # along the line to the next point, no two places farther apart than a tile
    n = (np.ceil(np.hypot(nx - x, ny - y) / tile_m) + 1).astype(int)
    at = np.repeat(np.arange(len(x)), n + 1)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    i, j = np.floor((x[at] + (nx - x)[at] * k / n[at]) / tile_m).astype(np.int64), np.floor((y[at] + (ny - y)[at] * k / n[at]) / tile_m).astype(np.int64)
    # a metre on the ground is up to 1.5 on this plane at the latitudes of bus lines
    rings = np.broadcast_to(np.ceil(np.asarray(reach_m) * 1.5 / tile_m).astype(np.int64), len(x))[at]
    out = []
    for r in np.unique(rings):
        passed, ring = np.unique(i[rings == r] * TILE_ROW + j[rings == r]), np.arange(-r, r + 1)
        out.append((passed[:, None] + (ring[:, None] * TILE_ROW + ring).ravel()).ravel())
    return np.unique(np.concatenate(out))


def _tiled(roads: DataFrame, tile_m: float) -> DataFrame:
    """``roads`` with each ``tile`` that they touch."""
    (x1, y1), (x2, y2) = geo.mercator(F.col("lat1"), F.col("lon1")), geo.mercator(F.col("lat2"), F.col("lon2"))
    cells = touched_cells(F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2), tile_m)
    return roads.withColumn("_c", F.explode(cells)).withColumn("tile", F.col("_c.i") * F.lit(TILE_ROW) + F.col("_c.j")).drop("_c")


def packed(trace: DataFrame) -> DataFrame:
    """(shape_id, lat, lon, n, place) of traces (shape_id, second, lat, lon): a row a shape, its points in order, their number, and the
    place that its middle lies in.  Points without coordinates go."""
    kind = trace.schema["shape_id"].dataType.simpleString()

    def pack(shapes):
        for s in shapes:
            lat, lon, place = [], [], []
            for t, a, b in zip(s["second"], s["lat"], s["lon"], strict=True):
                order = np.lexsort((b, a, t))
                lat.append(a[order])
                lon.append(b[order])
                m = len(order) // 2
                place.append(line_tiles(lat[-1][m : m + 1], lon[-1][m : m + 1], 0.0, PLACE_M)[0])
            yield pd.DataFrame({"shape_id": s["shape_id"], "lat": lat, "lon": lon, "n": [len(a) for a in lat], "place": place})

    points = trace.select("shape_id", "second", "lat", "lon").dropna()
    lists = points.groupBy("shape_id").agg(*(F.collect_list(k).alias(k) for k in ("second", "lat", "lon")))
    return lists.mapInPandas(pack, f"shape_id {kind}, lat array<double>, lon array<double>, n int, place long")


def _batched(shapes: DataFrame) -> tuple[DataFrame, int]:
    """``shapes`` with the ``_batch`` that each is matched in, and about how many batches there are."""
    load = settle(shapes.groupBy("place").agg((F.floor(F.sum("n") / BATCH) + 1).alias("_parts")), "load")
    part = F.pmod(F.xxhash64("shape_id"), "_parts")
    return shapes.join(load, "place").withColumn("_batch", F.xxhash64("place", part)).drop("_parts", "place", "n"), load.agg(F.sum("_parts")).first()[0] or 1


def _roads_of(shapes: DataFrame, roads: DataFrame, reach, tile_m: float) -> DataFrame:
    """(_batch, tile, and the columns of ``roads``): the edges of all tiles within ``reach(lat, lon)`` of a shape of the batch."""

    def near(rows):
        for s in rows:
            found = {}
            for b, lat, lon in zip(s["_batch"], s["lat"], s["lon"], strict=True):
                reach_m = reach(lat, lon)
                if reach_m is not None:
                    found.setdefault(b, []).append(line_tiles(lat, lon, reach_m, tile_m))
            for b, tiles in found.items():
                yield pd.DataFrame({"tile": np.unique(np.concatenate(tiles))}).assign(_batch=b)[["_batch", "tile"]]

    tiles = shapes.select("_batch", "lat", "lon").mapInPandas(near, "_batch long, tile long").distinct()
    return tiles.join(_tiled(roads, tile_m), "tile")


def roads_of_shapes(shapes: DataFrame, roads: DataFrame, reach_m: float, tile_m: float = 2_000.0) -> DataFrame:
    """(_batch, tile, and the columns of ``roads``): the edges of all tiles within ``reach_m`` of the shapes of a batch, also where these have gaps."""
    return _roads_of(shapes, roads, lambda lat, lon: reach_m, tile_m)


def _own_streets(near: pd.DataFrame):
    """A function that gives the roads of one trace, by its tiles, out of the roads of its batch."""
    near = near.sort_values(["edge_id", "tile"], ignore_index=True)
    first = ~near.duplicated("edge_id").to_numpy()
    tiles, of_row = np.unique(near["tile"].to_numpy(), return_inverse=True)
    edge = np.cumsum(first) - 1
    streets = Streets(near[first], 0.0)

    def own(passed: np.ndarray, lat0: float) -> Streets:
        hit, mine = np.isin(tiles, passed, assume_unique=True), np.zeros(len(streets.ids), bool)
        mine[edge[hit[of_row]]] = True
        return streets.of(mine, lat0)

    return own


def match_lcss(
    trace: DataFrame,
    vertices: DataFrame,
    edges: DataFrame,
    *,
    epsilon_m: float = 50.0,
    similarity: float = 0.9,
    cutting_m: float = 10.0,
    reaches_m: tuple[float, ...] = (1_000.0, 10_000.0),
    near_m: float = 250.0,
) -> DataFrame:
    """(shape_id, seq, edge_id): the edges along each trace (shape_id, second, lat, lon), over a network of any size.

    A segment is similar enough at ``similarity``; it is cut at its farthest point beyond ``epsilon_m`` and in the middle of
    each run of points whose distance differs from ``epsilon_m`` by less than ``cutting_m``.  Points without a road within the last of
    ``reaches_m`` are left out, as are points without coordinates.  Traces without any road give no rows; where roads do not connect even within
    the last reach, the way goes on behind the break.

    Most traces lie at roads without long gaps, and the roads within ``near_m`` decide, beside a longer gap those within its length: a trace none of
    whose points is farther than ``epsilon_m`` from a road or than GAPS times ``near_m`` from the point before is matched with these first.  The result
    stands if the way has no break.  Shapes whose middles lie in one place are matched beside each other, up to BATCH points, so that roads
    and searches that they share are there once; the batch is one group.
    """
    roads = settle(located(vertices, edges), "roads")
    kind = trace.schema["shape_id"].dataType.simpleString()
    near_tile, wide_tile = max(near_m * 1.5, 1.0), 2_000.0

    def gaps(lat, lon):
        """The reach of each line of a trace without long gaps, else None."""
        kx = np.cos(np.radians(lat.mean())) * _DEGREE
        gap = np.append(np.hypot(np.diff(lon) * kx, np.diff(lat) * _DEGREE), 0.0)
        return np.maximum(gap, near_m) if gap.max() <= GAPS * near_m else None

    def close(own, lat, lon) -> tuple[list[int], int, np.ndarray | None]:
        reach_m = gaps(lat, lon)
        if reach_m is None:
            return [], 1, None
        s = own(line_tiles(lat, lon, reach_m, near_tile), lat.mean())
        one = Matcher(s, lon * s.kx, lat * s.ky, epsilon_m, similarity, cutting_m, near_m)
        one.place_all()
        return (*one.match(EVERY), s.ids) if len(one.ends) == len(lat) else ([], 1, None)

    def wide(reach: float):
        def run(own, lat, lon) -> tuple[list[int], int, np.ndarray | None]:
            s = own(line_tiles(lat, lon, reach, wide_tile), lat.mean())
            x, y = lon * s.kx, lat * s.ky
            on = s.within(x, y, reach)
            return (*Matcher(s, x[on], y[on], epsilon_m, similarity, cutting_m, reach).match(), s.ids) if on.any() else ([], 1, None)

        return run

    def matched(shapes: DataFrame, batches: int, near: DataFrame, one) -> DataFrame:
        """(shape_id, edges, breaks): a row a shape, without edges if no way was found."""

        def run(points: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            rows = []
            own = _own_streets(near) if len(near) else None
            for shape, lat, lon in zip(points["shape_id"], points["lat"], points["lon"], strict=True):
                way, breaks, ids = one(own, lat, lon) if own else ([], 1, None)
                rows.append((shape, ids[way] if len(way) else None, breaks if len(way) else 1))
            return pd.DataFrame(rows, columns=["shape_id", "edges", "breaks"])

        # the least bytes are long work, so tasks are not put together by bytes
        tasks = max(min(batches, 16 * int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
        by_batch = lambda df: df.repartition(tasks, "_batch").groupBy("_batch")
        return settle(by_batch(shapes).cogroup(by_batch(near)).applyInPandas(run, f"shape_id {kind}, edges array<long>, breaks int"), "matched")

    every = settle(packed(trace), "trace")
    shapes, batches = _batched(every)
    found, done = matched(shapes, batches, _roads_of(shapes, roads, gaps, near_tile), close), []
    for reach in reaches_m:
        done.append(found.filter("breaks = 0"))
        again = settle(found.filter("breaks > 0").select("shape_id"), "open")
        if again.isEmpty():
            break
        shapes, batches = _batched(every.join(again, "shape_id", "left_semi"))
        found = matched(shapes, batches, roads_of_shapes(shapes, roads, reach), wide(reach))
    else:
        done.append(found)
    return reduce(DataFrame.union, done).select("shape_id", F.posexplode("edges").alias("seq", "edge_id")).withColumn("seq", F.col("seq") + 1)
