"""The driver tables seen as a schedule feed, so that every operator has input with a SQL twin.

Texts marked as shared are valid in Spark and in DuckDB alike; they define input, not operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.operators.service import DAYS

STOPS = "SELECT concat('S', s_suppkey) AS stop_id, 40e0 + 1e0 / 3 + ((s_suppkey * 37) % 1000) / 25000e0 AS stop_lat, -112e0 + 1e0 / 7 + ((s_suppkey * 91) % 1000) / 25000e0 AS stop_lon FROM {supplier}"
STOP_TIMES = """SELECT concat('U', user_id, 'D', dayofyear(ts) - 1) AS trip_id,
  concat('U', user_id, 'W', CAST(floor((dayofyear(ts) - 1) / 7e0) AS BIGINT)) AS block_id, user_id, dayofyear(ts) AS doy, event_id,
  CAST(row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts, event_id) AS INT) AS stop_sequence,
  concat('S', event_id % (SELECT count(*) FROM {supplier}) + (SELECT min(s_suppkey) FROM {supplier})) AS stop_id,
  CAST(((dayofyear(ts) - 1) % 7) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS arrival_s
  FROM {events}"""
DEPOTS = "SELECT n_nationkey AS idx, 40e0 + 1e0 / 3 + ((n_nationkey * 53) % 100) / 2500e0 + 1e-5 AS lat, -112e0 + 1e0 / 7 + ((n_nationkey * 29) % 100) / 2500e0 + 1e-5 AS lon FROM {nation}"
EDGES = """SELECT p_partkey AS edge_id, p_retailprice / 1000e0 AS miles, 20e0 + p_size AS speed_mph, ((p_partkey % 13) - 6) / 100e0 AS grade, CAST((p_partkey * 47) % 360 AS DOUBLE) AS heading,
  40e0 + 1e0 / 3 + ((p_partkey * 71) % 997) / 24925e0 AS lat1, -112e0 + 1e0 / 7 + ((p_partkey * 31) % 991) / 24775e0 AS lon1,
  40e0 + 1e0 / 3 + ((p_partkey * 71) % 997) / 24925e0 + ((p_partkey % 7) - 3) / 3000e0 AS lat2, -112e0 + 1e0 / 7 + ((p_partkey * 31) % 991) / 24775e0 + ((p_partkey % 11) - 5) / 3000e0 AS lon2
  FROM {part}"""
PATHS = "SELECT l_orderkey AS shape_id, l_partkey AS edge_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS INT) AS seq FROM {lineitem}"
WEATHER = "SELECT ts, value * 0.1e0 - 29e0 / 3 AS temp_c, concat('G', user_id % 3) AS county FROM {events}"
ROADS = """SELECT s_suppkey * 4 + k AS edge_id, s_suppkey AS src,
  (s_suppkey - lo + step + n) % n + lo AS dst, 5e-1 + ((s_suppkey * 7919 + k * 104729) % 10007) / 5003e0 AS miles, 20e0 + (s_suppkey * 13 + k) % 30 AS speed_mph
  FROM {supplier}, (SELECT min(s_suppkey) AS lo, count(*) AS n FROM {supplier}) AS r, (VALUES (0, 1), (1, 7), (2, -1), (3, -5)) AS w(k, step)"""
ODS = "SELECT concat('N', s_nationkey) AS od_key, min(s_suppkey) AS o, max(s_suppkey) AS d FROM {supplier} GROUP BY s_nationkey HAVING min(s_suppkey) <> max(s_suppkey)"
RATES = """SELECT concat('M', r_regionkey % 2) AS vehicle, 1e1 + n_nationkey * 3e0 AS speed_from, (r_regionkey - 3) / 50e0 AS grade_from,
  1e0 / 3 + sqrt(n_nationkey + 2e0) / 11e0 + sqrt(r_regionkey + 3e0) / 7e0 AS rate FROM {nation}, {region}"""
#: A jittered grid of streets with a vertex for each supplier, two-way streets between neighbours, and bus lines that climb it in stairs.
STREETS = """SELECT k AS vertex_id, w, CAST(floor(k / w) AS BIGINT) AS row_no, k % w AS col_no,
  40.3e0 + floor(k / w) * 0.002e0 + ((k * 37) % 11 - 5) * 3e-5 AS lat, -111.9e0 + (k % w) * 0.0026e0 + ((k * 53) % 13 - 6) * 4e-5 AS lon
  FROM (SELECT s_suppkey - lo AS k, w FROM {supplier}, (SELECT min(s_suppkey) AS lo, CAST(floor(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS w FROM {supplier}) AS m) AS t WHERE k < w * w"""
STREET_EDGES = f"""SELECT a.vertex_id * 4 + q AS edge_id, a.vertex_id AS src, b.vertex_id AS dst, 15e0 + (a.vertex_id * 7 + q * 3) % 31 AS speed_mph, (450e0 - q * 90e0) % 360e0 AS heading,
  sqrt((b.lat - a.lat) * 69e0 * ((b.lat - a.lat) * 69e0) + (b.lon - a.lon) * 52.7e0 * ((b.lon - a.lon) * 52.7e0)) AS miles
  FROM ({STREETS}) AS a, (VALUES (0, 0, 1), (1, 1, 0), (2, 0, -1), (3, -1, 0)) AS d(q, dr, dc), ({STREETS}) AS b WHERE b.row_no = a.row_no + dr AND b.col_no = a.col_no + dc"""
STREET_LINES = f"""SELECT shape, t, w, (floor(shape / 2) % 2 + t - easts) * w + shape % 2 + easts AS vertex_id
  FROM (SELECT s.vertex_id AS shape, u.vertex_id AS t, s.w AS w, CAST(sum(CASE WHEN u.vertex_id > 0 AND (s.vertex_id * 31 + u.vertex_id * u.vertex_id * 17 + u.vertex_id * 7) % 5 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY s.vertex_id ORDER BY u.vertex_id) AS BIGINT) AS easts
  FROM ({STREETS}) AS s, ({STREETS}) AS u WHERE u.row_no = 0 AND u.vertex_id <= s.w - 2) AS steps"""
#: Heights over the streets, a sample for each part; and the ends of streets.
RASTER = """SELECT k % m AS i, CAST(floor(k / m) AS BIGINT) AS j, 13e2 + p_retailprice / 3e1 + (k % 17) * sqrt(2e0) AS height
  FROM (SELECT p_partkey - lo AS k, p_retailprice, m FROM {part}, (SELECT min(p_partkey) AS lo, CAST(floor(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS m FROM {part}) AS c) AS t WHERE k < m * m"""
STREET_ENDS = f"SELECT e.edge_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM ({STREET_EDGES}) AS e JOIN ({STREETS}) AS a ON a.vertex_id = e.src JOIN ({STREETS}) AS b ON b.vertex_id = e.dst"
#: What each user's trips begin with: charge, and whether stops cost energy.
TRIP_PARAMETERS = "SELECT concat('U', user_id, 'D', dayofyear(ts) - 1) AS trip_id, min(user_id) AS shape_id, CAST(min(user_id) % 7 AS DOUBLE) + 1e0 / 3 AS start_soc, min(user_id) % 2 = 0 AS include_stop_penalty FROM {events} GROUP BY concat('U', user_id, 'D', dayofyear(ts) - 1)"
STREET_ODS = f"SELECT concat('K', vertex_id) AS od_key, vertex_id AS o, w * w - 1 - vertex_id AS d FROM ({STREETS}) AS v WHERE row_no = 0"
#: Roads with minutes and energy, and the charge that buses between the ends have.
CHARGE_ROADS = f"SELECT edge_id, src, dst, 60e0 * miles / speed_mph AS minutes, (1 + (src * 31 + edge_id * 17) % 9) / 4e0 AS kwh FROM ({ROADS}) AS r"
CHARGE_ODS = f"SELECT od_key, o, d, (24 + 4 * (o % 7)) / 4e0 AS charge_kwh FROM ({ODS}) AS p"
#: Up to four fixes a street, each up to some 10 metres off in both directions; every fourth street has only the one at its start.
STREET_TRACES = f"""SELECT concat('L', shape) AS shape_id, CAST(t * 4 + q AS INT) AS second,
  lat + coalesce(lat1 - lat, 0e0) * q / 4e0 + ((shape * 13 + t * 29 + q * 7) % 21 - 10) * 9e-6 AS lat, lon + coalesce(lon1 - lon, 0e0) * q / 4e0 + ((shape * 17 + t * 23 + q * 11) % 21 - 10) * 1.2e-5 AS lon
  FROM (SELECT l.shape, l.t, v.lat, v.lon, lead(v.lat) OVER (PARTITION BY l.shape ORDER BY l.t) AS lat1, lead(v.lon) OVER (PARTITION BY l.shape ORDER BY l.t) AS lon1
    FROM ({STREET_LINES}) AS l JOIN ({STREETS}) AS v ON v.vertex_id = l.vertex_id) AS ends, (VALUES (0), (1), (2), (3)) AS f(q) WHERE q = 0 OR lat1 IS NOT NULL AND (shape + t) % 4 > 0"""
#: Where vehicles are seen: an event each.
POSITIONS = """SELECT concat('V', user_id) AS vehicle_id, concat('T', user_id, 'D', dayofyear(ts)) AS trip_id,
  4e1 + ((event_id * 7919) % 997) / 24925e0 AS lat, -112e0 + ((event_id * 104729) % 991) / 24775e0 AS lon, ts FROM {events}"""
SHARED = {"positions": POSITIONS, "raster": RASTER, "street_ends": STREET_ENDS, "trip_parameters": TRIP_PARAMETERS, "street_ods": STREET_ODS, "charge_roads": CHARGE_ROADS, "charge_ods": CHARGE_ODS, "streets": STREETS, "street_edges": STREET_EDGES, "street_lines": STREET_LINES, "street_traces": STREET_TRACES, "roads": ROADS, "ods": ODS, "rates": RATES, "stops": STOPS, "stop_times": STOP_TIMES, "depots": DEPOTS, "edges": EDGES, "paths": PATHS, "weather": WEATHER}
TABLES = ("supplier", "events", "nation", "part", "lineitem", "customer", "orders", "region")

#: Boxes of the invented counties: id, lower left and upper right corner.
COUNTIES = [("G49000010", -111.9, 40.3, -111.84, 40.352), ("G49000020", -111.84, 40.3, -111.8, 40.352), ("G49000030", -111.9, 40.3525, -111.81, 40.4)]


def shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SHARED[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **frames)
    return df.withColumn("departure_s", F.col("arrival_s")) if name == "stop_times" else df


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.dayofyear("ts").alias("doy")).distinct()
    name = F.concat(F.lit("U"), F.col("user_id"), F.lit("D"), F.col("doy") - 1)
    block = F.concat(F.lit("U"), F.col("user_id"), F.lit("W"), F.floor((F.col("doy") - 1) / 7))
    return st.select(name.alias("trip_id"), block.alias("block_id"), name.alias("shape_id"), F.col("user_id").cast("string").alias("service_id"), F.concat(F.lit("R"), (F.col("user_id") + F.col("doy")) % 3).alias("route_id"), F.concat(F.lit("R"), (F.col("user_id") + F.col("doy")) % 3).alias("route_short_name"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 60).cast("int"))
    flags = [F.shiftright(F.col("c_custkey") % 128, i).bitwiseAND(F.lit(1)).cast("int").alias(d) for i, d in enumerate(DAYS)]
    return c.select(F.col("c_custkey").cast("string").alias("service_id"), *flags, start.alias("start_date"), F.date_add(start, 89).alias("end_date"))


def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 150).cast("int"))
    return o.select(F.col("o_custkey").cast("string").alias("service_id"), day.alias("date"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("exception_type"))


def counties(spark: SparkSession) -> DataFrame:
    rows = [(i, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]) for i, x0, y0, x1, y1 in COUNTIES]
    return spark.createDataFrame(rows, "county_id string, ring array<struct<x:double,y:double>>").coalesce(1)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops as the vertices of the roads."""
    s = shared(spark, sf_dir, "stops")
    return s.select(F.substring("stop_id", 2, 20).cast("long").alias("vertex_id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop points of trips as the points of a shape of the same name."""
    st, stops = shared(spark, sf_dir, "stop_times"), shared(spark, sf_dir, "stops")
    p = st.join(stops, "stop_id")
    return p.select(F.col("trip_id").alias("shape_id"), F.col("stop_sequence").alias("shape_pt_sequence"), F.col("stop_lat").alias("shape_pt_lat"), F.col("stop_lon").alias("shape_pt_lon"), "stop_id", "arrival_s", "event_id")


def duck(*names: str) -> str:
    """WITH clause that gives DuckDB the shared inputs."""
    tables = {t: t for t in TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({SHARED[n].format(**tables)})" for n in names)
