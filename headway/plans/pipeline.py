"""The whole analysis behind one object: feed in, energy per trip and link out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import energy as en
from headway.functions import geo
from headway.operators import deadhead, energy, matching, routing, service, shapes, spatial, thermal
from headway.sources import files, gtfs
from headway.sources.staging import settle

Matcher = Callable[[DataFrame], DataFrame]


@dataclass
class Predictor:
    """Steps chain and are lazy; only checks that must raise, and result files, run jobs.

    ``matcher`` maps points (shape_id, second, lat, lon) to path edges (shape_id, seq, edge_id) and can be replaced,
    as can the vehicle catalogue.  ``rates`` (edge_id, vehicle, rate; see energy.RATE_MODELS) replaces the linear rates of
    the vehicles it names, given as a table or as a function of the edges.  Without ``edges`` a network under
    ``network_path`` is read, cut to the box of the feed.  ``hooks`` are called with each step's name and this object.
    """

    spark: SparkSession
    feed_path: str
    depot_path: str | None = None
    vehicles: DataFrame | None = None
    models: list[str] | None = None
    output_dir: str | None = None
    vertices: DataFrame | None = None
    edges: DataFrame | None = None
    matcher: Matcher | None = None
    counties: DataFrame | None = None
    weather: DataFrame | None = None
    feed: gtfs.Feed | None = None
    dates: DataFrame | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)
    rates: DataFrame | Callable[[DataFrame], DataFrame] | None = None
    network_path: str | None = None
    hooks: list[Callable[[str, Predictor], None]] = field(default_factory=list)

    def _done(self, step: str) -> Predictor:
        for hook in self.hooks:
            hook(step, self)
        return self

    def load(self) -> Predictor:
        f = gtfs.read_feed(self.spark, self.feed_path)
        self.dates = service.service_dates(f.calendar, f.calendar_dates)
        trips = service.trips_of_services(f.trips, self.dates.select("service_id").distinct(), f.routes)
        self.feed = f.with_tables(trips=trips, shapes=service.only(f.shapes, trips, "shape_id"))
        return self

    def _loaded(self) -> gtfs.Feed:
        if self.feed is None:
            raise RuntimeError("load() comes first")
        return self.feed

    def filter_trips(self, date=None, routes: list[str] | None = None, method: str = "exclusive") -> Predictor:
        f = self._loaded()
        trips = f.trips
        if date is not None:
            trips = trips.join(service.services_on(self.dates, date), "service_id", "left_semi")
            if trips.isEmpty():
                raise ValueError(f"no bus trips on {date}")
        if routes is not None:
            trips = service.blocks_on_routes(trips, routes, method=method)
            if trips.isEmpty():
                raise ValueError(f"no trips on routes {routes}")
        self.feed = f.with_tables(trips=trips, shapes=service.only(f.shapes, trips, "shape_id"))
        return self

    def add_trip_times(self) -> Predictor:
        f = self._loaded()
        self.feed = f.with_tables(trips=service.with_trip_times(f.trips, service.only(f.stop_times, f.trips, "trip_id"), self.dates))
        return self

    def box(self) -> tuple[float, float, float, float]:
        """(min_lon, min_lat, max_lon, max_lat) of shapes, stops and depots, widened by 0.05 degrees."""
        f = self._loaded()
        at = f.shapes.select(F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon"))
        used = f.stops.join(service.only(f.stop_times, f.trips, "trip_id").select("stop_id").distinct(), "stop_id", "left_semi")
        at = at.unionByName(used.select(F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")))
        if self.depot_path is not None:
            at = at.unionByName(files.read_depots(self.spark, self.depot_path).select("lat", "lon"))
        b = shapes.bounding_box(at, lat="lat", lon="lon").first()
        return b.min_lon, b.min_lat, b.max_lon, b.max_lat

    def load_network(self) -> Predictor:
        """Reads the network within the feed's box, once."""
        if self.edges is None and self.network_path is not None:
            self.vertices, self.edges = files.read_network(self.spark, self.network_path, self.box())
        return self

    def _router(self):
        self.load_network()
        if self.vertices is None or self.edges is None:
            return None
        return lambda ods: routing.shortest_paths(ods, self.vertices, self.edges)

    def _append(self, trips: DataFrame, legs: DataFrame, prefix: str, count_from: str) -> None:
        """Adds deadhead trips that have a leg, with their stops, shapes and times."""
        f = self._loaded()
        legs = settle(legs, "legs")
        lines, mapping = deadhead.deadhead_shapes(legs, self._router())
        trips = trips.drop("shape_id").join(mapping, "trip_id").join(deadhead.leg_times(legs), "trip_id")
        if "trip_count" in f.trips.columns:
            trips = trips.join(f.trips.select(F.col("trip_id").alias(count_from), "trip_count"), count_from, "left")
        stops = deadhead.leg_stops(legs, prefix)
        self.feed = f.with_tables(
            trips=f.trips.unionByName(trips, allowMissingColumns=True),
            shapes=f.shapes.unionByName(lines, allowMissingColumns=True),
            stop_times=f.stop_times.unionByName(stops.drop("stop_lat", "stop_lon"), allowMissingColumns=True),
            stops=f.stops.unionByName(stops.select("stop_id", "stop_lat", "stop_lon"), allowMissingColumns=True),
        )

    def prepare_mid_block(self) -> tuple[DataFrame, DataFrame]:
        f = self._loaded()
        t = settle(deadhead.midblock_trips(f.trips, f.stop_times), "mid-trips")
        return t, deadhead.midblock_legs(t, f.stop_times, f.stops)

    def prepare_depot(self) -> tuple[DataFrame, DataFrame]:
        f = self._loaded()
        if self.depot_path is None:
            raise ValueError("a depot file is needed for depot deadheads")
        t = settle(deadhead.depot_trips(f.trips, f.stop_times), "depot-trips")
        placed = deadhead.assign_depots(deadhead.block_ends(f.trips, f.stop_times, f.stops), files.read_depots(self.spark, self.depot_path))
        return t, deadhead.depot_legs(t, placed)

    def add_deadheads(self, mid_block: bool = True, depot: bool = True) -> Predictor:
        """Both kinds are derived from service trips before either is added."""
        mid = self.prepare_mid_block() if mid_block else None
        dep = self.prepare_depot() if depot else None
        if mid:
            self._append(*mid, "mid_block_deadhead_", "from_trip")
        if dep:
            self._append(*dep, "depot_deadhead_", "service_trip")
        f = self._loaded()
        self.feed = f.with_tables(**{n: settle(getattr(f, n), n) for n in ("trips", "shapes", "stop_times", "stops")})
        return self

    def trace(self) -> DataFrame:
        return shapes.upsample(self._loaded().shapes)

    def match(self) -> DataFrame:
        if self.matcher is not None:
            return self.matcher(self.trace())
        self.load_network()
        if self.vertices is None or self.edges is None:
            raise RuntimeError("a road network or a matcher is needed")
        return matching.match_lcss(self.trace(), self.vertices, self.edges)

    def _placed_edges(self) -> DataFrame:
        """Edges with the coordinates of their ends (lat1, lon1, lat2, lon2)."""
        if "lat1" in self.edges.columns:
            return self.edges
        end = lambda k, n: self.vertices.select(F.col("vertex_id").alias(k), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
        return self.edges.join(end("src", 1), "src").join(end("dst", 2), "dst")

    def link_level_inputs(self) -> DataFrame:
        """Trips' matched links with where and when each begins and ends: (trip_id, shape_id, road_id, ...).

        Points of the trace take the edge that the matcher gave their shape and that is nearest to them in sequence,
        times follow from the distance travelled between a trip's first and last stop.
        """
        f = self._loaded()
        trace = settle(self.trace(), "trace")
        near = routing.nearest_of_path(trace, settle(self.match(), "links"), self._placed_edges())
        spans = service.trip_spans(service.only(f.stop_times, f.trips, "trip_id"))
        pts = f.trips.select("trip_id", "shape_id").join(spans, "trip_id").join(near, "shape_id")
        timed = shapes.point_timestamps(pts)
        step = F.lit(1.0) / F.lit(3600.0)
        timed = timed.withColumns({"road_id": F.col("edge_id"), "seq": F.col("second"), "kilometers": F.col("miles") / F.lit(en.MI_PER_KM), "travel_time": F.col("miles") / F.col("speed_mph") / step})
        return shapes.aggregate_links(timed)

    def predict(self, hvac: bool = False, *, stop_penalty: bool = False, start_soc: float | None = None) -> Predictor:
        """Trip and link results of the wanted vehicles.  With ``stop_penalty`` stops at a shape's edges cost energy,
        with ``start_soc`` trips get the charge left at their end and whether the battery suffices."""
        f = self._loaded()
        catalog = self.vehicles if self.vehicles is not None else en.vehicle_catalog(self.spark)
        known = {r.vehicle for r in catalog.select("vehicle").collect()}
        wanted = self.models or sorted(known)
        if set(wanted) - known:
            raise ValueError(f"unknown vehicle models {sorted(set(wanted) - known)}; known are {sorted(known)}")
        catalog = catalog.filter(F.col("vehicle").isin(wanted))
        links = settle(self.match(), "links")
        self.load_network()
        energy.check_features(self.edges)
        at = stopped = None
        if stop_penalty:
            stopped = settle(stop_edges(f.with_tables(stop_times=service.only(f.stop_times, f.trips, "trip_id")), self._placed_edges()), "stop-edges")
            at = stopped.join(f.trips.select("trip_id", "shape_id"), "trip_id").select("shape_id", "edge_id").distinct()
        if self.rates is not None:
            given = self.rates(self.edges) if callable(self.rates) else self.rates
            plain = energy.linear_rates(self.edges, catalog.join(given.select("vehicle").distinct(), "vehicle", "left_anti"))
            per_shape = energy.path_energy_by_rate(links, self.edges, catalog, plain.unionByName(given.select("edge_id", "vehicle", "rate")), at)
        elif stop_penalty:
            per_shape = energy.path_energy_with_stops(links, self.edges, catalog, at)
        else:
            per_shape = energy.path_energy(links, self.edges, catalog)
        if start_soc is not None:
            per_shape = energy.charge_left(per_shape, catalog, start_soc)
        extra = None
        if hvac:
            if self.weather is None or self.counties is None:
                raise ValueError("HVAC energy needs weather and counties")
            here = spatial.counties_of_stops(f.stops.join(f.stop_times.select("stop_id").distinct(), "stop_id", "left_semi"), self.counties)
            w = self.weather.join(here.withColumnRenamed("county_id", "county"), "county", "left_semi")
            power = thermal.hourly_power(w, thermal.extreme_days(w))
            extra = thermal.trip_hvac(service.trip_spans(service.only(f.stop_times, f.trips, "trip_id")), power)
        self.results = {"trip": energy.trip_results(per_shape, f.trips, extra), "link": energy.link_results(links, per_shape)}
        self.results["unmatched"] = f.trips.select("trip_id", "shape_id").join(links.select("shape_id").distinct(), "shape_id", "left_anti")
        if stopped is not None:
            self.results["stops"] = stopped
        return self

    def unmatched_trips(self) -> DataFrame:
        """Trips (trip_id, shape_id) that have no result, because no path was found for their shape."""
        return self._result("unmatched", None)

    def _result(self, kind: str, vehicle: str | None) -> DataFrame:
        if kind not in self.results:
            raise KeyError(f"no {kind} predictions yet")
        df = self.results[kind]
        if vehicle is None:
            return df
        mine = df.filter(F.col("vehicle") == vehicle)
        if mine.isEmpty():
            raise KeyError(vehicle)
        return mine

    def trip_predictions(self, vehicle: str | None = None) -> DataFrame:
        return self._result("trip", vehicle)

    def link_predictions(self, vehicle: str | None = None) -> DataFrame:
        return self._result("link", vehicle)

    def save(self, output_dir: str | None = None, inputs: bool = True, geometry: bool = False) -> list[str]:
        """Result tables as CSV; with ``geometry`` the matched edges' lines, with stop penalties the stops' edges."""
        if not self.results:
            raise RuntimeError("nothing has been predicted")
        folder = output_dir or self.output_dir or "."
        out = [files.write_csv(self.results[k], folder, f"{k}_energy_predictions.csv") for k in ("link", "trip")]
        if "stops" in self.results:
            out.append(files.write_csv(self.results["stops"].distinct(), folder, "gtfs_stops.csv"))
        if geometry:
            used = self._placed_edges().join(self.results["link"].select("edge_id").distinct(), "edge_id", "left_semi")
            out.append(files.write_link_geometry(used.withColumn("geometry_wkt", files.line_wkt()), folder))
        return out + ([files.write_csv(self.trace(), folder, "model_inputs.csv")] if inputs else [])

    def run(self, *, date=None, routes=None, mid_block: bool = True, depot: bool = True, hvac: bool = True, save: bool = True) -> DataFrame:
        self.load()._done("load")
        if date is not None or routes is not None:
            self.filter_trips(date, routes)._done("filter_trips")
        self.add_trip_times().add_deadheads(mid_block, depot)._done("add_deadheads").predict(hvac)._done("predict")
        if save:
            self.save()
        return self.trip_predictions()


def stop_edges(feed: gtfs.Feed, edges: DataFrame) -> DataFrame:
    """Distinct (trip_id, edge_id): each stop's nearest edge (edge_id and ends lat1, lon1, lat2, lon2)."""
    x, y = geo.mercator(F.col("stop_lat"), F.col("stop_lon"))
    pts = feed.stops.select(F.col("stop_id").alias("point_id"), x.alias("x"), y.alias("y"))
    (x1, y1), (x2, y2) = geo.mercator(F.col("lat1"), F.col("lon1")), geo.mercator(F.col("lat2"), F.col("lon2"))
    flat = edges.select("edge_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    near = spatial.nearest_edge(pts, flat).select(F.col("point_id").alias("stop_id"), "edge_id")
    return spatial.stop_edges(feed.stop_times, near)
