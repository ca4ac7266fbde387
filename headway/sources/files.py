"""The other inputs and the outputs: depots, counties, weather, vehicles, networks, stop edges, result files."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import energy

STOP_EDGES = "trip_id string, edge_id long"


def read_depots(spark: SparkSession, path: str) -> DataFrame:
    """(idx, lat, lon) of point features in WGS-84, in file order; GeoJSON, or a shapefile of points.

    A missing file is a FileNotFoundError.  A depot file is a small table by nature.
    """
    rows = spark.read.format("binaryFile").load(path).select("content").collect() if _exists(spark, path) else []
    if not rows:
        raise FileNotFoundError(path)
    content = rows[0].content
    if path.endswith(".shp"):
        points, at = [], 100
        while at + 8 <= len(content):
            size = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
            if struct.unpack("<i", content[at + 8 : at + 12])[0] in (1, 11, 21):
                points.append(struct.unpack("<2d", content[at + 12 : at + 28]))
            at += 8 + size
    else:
        import json

        points = [tuple(f["geometry"]["coordinates"][:2]) for f in json.loads(content)["features"] if (f.get("geometry") or {}).get("type") == "Point"]
    return spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(points)], "idx int, lat double, lon double")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_counties(spark: SparkSession, path: str) -> DataFrame:
    """(county_id, ring, rings) from features with STATEFP and COUNTYFP, one row for each part of a multipolygon: ``ring``
    is its outer ring, ``rings`` are all of its rings, holes included.

    GeoJSON, or a shapefile of polygons with its table beside it; there a feature is one row, and the even-odd rule over ``rings``
    tells its parts and holes apart.
    """
    if path.endswith(".shp"):
        return _county_shapes(spark, path)
    f = spark.read.option("multiLine", True).schema("features array<struct<properties:struct<STATEFP:string,COUNTYFP:string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    f = f.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.*")
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("type") == "Polygon", F.array(one)).otherwise(many)
    r = f.select(F.concat(F.lit("G"), "STATEFP", F.lit("0"), "COUNTYFP", F.lit("0")).alias("county_id"), F.explode(parts).alias("p"))
    opened = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    rings = F.transform("p", lambda r: F.transform(opened(r), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return r.select("county_id", rings.alias("rings")).select("county_id", F.get("rings", F.lit(0)).alias("ring"), "rings")


def _polygons(shp: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """The open rings of each record of a shapefile; None for records of other kinds."""
    out, at = [], 100
    while at + 8 <= len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        body = shp[at + 8 : at + 8 + size]
        rings = None
        if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
            parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            points = list(zip(flat[::2], flat[1::2], strict=True))
            rings = [points[a : b - 1] if points[a] == points[b - 1] else points[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]
        out.append(rings)
        at += 8 + size
    return out


def _records(dbf: bytes) -> list[dict[str, str]]:
    """The rows of a shapefile's table, deleted ones included, as texts without the blanks around them."""
    count, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at : at + 1] not in (b"\r", b""):
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    rows = []
    for k in range(count):
        row, place = {}, head + k * width + 1
        for name, size in fields:
            row[name] = dbf[place : place + size].decode("latin-1").strip()
            place += size
        rows.append(row)
    return rows


def _county_shapes(spark: SparkSession, path: str) -> DataFrame:
    def parsed(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for shp, dbf in zip(pdf["shp"], pdf["dbf"], strict=True):
                for rings, row in zip(_polygons(bytes(shp)), _records(bytes(dbf)), strict=True):
                    if rings:
                        rows.append((f"G{row['STATEFP']}0{row['COUNTYFP']}0", [[{"x": x, "y": y} for x, y in r] for r in rings]))
            yield pd.DataFrame(rows, columns=["county_id", "rings"])

    file = lambda p, name: spark.read.format("binaryFile").load(p).select(F.lit(1).alias("k"), F.col("content").alias(name))
    both = file(path, "shp").join(file(path[:-4] + ".dbf", "dbf"), "k").drop("k")
    rows = both.mapInPandas(parsed, "county_id string, rings array<array<struct<x:double,y:double>>>")
    return rows.select("county_id", F.get("rings", F.lit(0)).alias("ring"), "rings")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """(county, ts, temp_c) of a folder of typical-year files named ``<county>.csv``; only two columns are read."""
    raw = spark.read.option("header", True).csv(path).withColumn("_f", F.input_file_name())
    return raw.select(F.regexp_extract("_f", r"([^/]+?)(?:-tmy3)?\.csv[^/]*$", 1).alias("county"), F.to_timestamp("date_time").alias("ts"), F.col("`Dry Bulb Temperature [°C]`").cast("double").alias("temp_c"))


_VEHICLE_FILE = (
    "name string, type string, battery_capacity double, battery_capacity_unit string, mass_kg double, energy_unit string, gge_per_unit double, "
    "rate0 double, rate_mph double, rate_grade double, rates array<struct<speed_from:double,grade_from:double,rate:double>>"
)


def read_vehicles(spark: SparkSession, path: str) -> DataFrame:
    """The vehicle catalogue (energy.SCHEMA) of JSON vehicle files; a kind that is neither bev nor ice is an error.

    Mass, unit and gallon equivalent that a file lacks are those of the built-in vehicle of its kind; rates it lacks
    stay null, as its bins (``read_rates``) may give them.
    """
    v = spark.read.option("multiLine", True).schema(_VEHICLE_FILE).json(path)
    kwh = F.when(F.lower("battery_capacity_unit").isin("joules", "j"), F.col("battery_capacity") / 3.6e6).otherwise(F.col("battery_capacity"))
    kind = F.lower("type")
    wrong = v.filter(F.coalesce(~kind.isin("bev", "ice"), F.lit(True))).limit(3).collect()
    if wrong:
        raise ValueError(f"vehicle type must be bev or ice: {[(r.name, r.type) for r in wrong]}")
    default = lambda i: F.coalesce(*[F.when(kind == x[1], F.lit(x[i])) for x in energy.VEHICLES])
    own = lambda name, i: F.coalesce(F.col(name), default(i)).alias(name)
    return v.select(
        F.col("name").alias("vehicle"), kind.alias("kind"), default(2).alias("energy_field"), own("energy_unit", 3), own("gge_per_unit", 4),
        own("mass_kg", 5), kwh.alias("battery_kwh"), "rate0", "rate_mph", "rate_grade",
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Bins of rates (vehicle, speed_from, grade_from, rate) of JSON vehicle files; files without bins give none."""
    v = spark.read.option("multiLine", True).schema(_VEHICLE_FILE).json(path)
    return v.select(F.col("name").alias("vehicle"), F.inline("rates"))


def select_models(paths: list[str], models: list[str]) -> list[str]:
    """Model files whose name without its ending is one of ``models``."""
    return [p for p in paths if p.rsplit("/", 1)[-1].rsplit(".", 1)[0] in models]


def read_stop_edges(spark: SparkSession, path: str) -> DataFrame:
    """Stops' edges by trip; a row that does not fit the types fails the read."""
    return spark.read.schema(STOP_EDGES).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_network(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a Parquet network, restricted to (min_lon, min_lat, max_lon, max_lat); the filter is pushed down."""
    v, e = spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
    if box:
        v = v.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
        ids = v.select("vertex_id")
        e = e.join(ids.withColumnRenamed("vertex_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("vertex_id", "dst"), "dst", "left_semi")
    return v, e


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_link_geometry(links: DataFrame, folder: str) -> str:
    """Distinct link geometries (edge_id, geometry_wkt) with one road each, the lowest."""
    return write_csv(links.groupBy("geometry_wkt").agg(F.min("edge_id").alias("edge_id")).select("edge_id", "geometry_wkt"), folder, "link_geometry.csv")


def line_wkt(lat1: str = "lat1", lon1: str = "lon1", lat2: str = "lat2", lon2: str = "lon2") -> Column:
    """A straight edge as text; null where a coordinate is."""
    at = lambda lon, lat: F.concat(F.col(lon).cast("string"), F.lit(" "), F.col(lat).cast("string"))
    return F.concat(F.lit("LINESTRING ("), at(lon1, lat1), F.lit(", "), at(lon2, lat2), F.lit(")"))


def read_zipped(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """(feed, columns...) of the member ``name`` of zipped feeds, all as text; archives are read in tasks, one by one.

    ``feed`` is the archive's name without its ending.  Archives without the member give no rows, columns that a
    member lacks are null.
    """

    def run(frames):
        import csv
        import io
        import zipfile

        import pandas as pd

        for pdf in frames:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if name not in z.namelist():
                        continue
                    with z.open(name) as f:
                        rows = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                        feed = where.rsplit("/", 1)[-1].removesuffix(".zip")
                        block = []
                        for r in rows:
                            block.append((feed, *[r.get(c) for c in columns]))
                            if len(block) == 50_000:
                                yield pd.DataFrame(block, columns=["feed", *columns])
                                block = []
                        yield pd.DataFrame(block, columns=["feed", *columns])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in ["feed", *columns]))
