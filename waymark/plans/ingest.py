"""Readers, mappings and sinks, run over files that Spark writes from the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from waymark.functions.clock import DEFAULT_ANCHOR, parse_time_ms, start_seconds, time_kind_to_ms
from waymark.functions.draw import drawn_sql
from waymark.functions.modes import mode_code, mode_label
from waymark.operators import derive, profile, spatial, stats
from waymark.plans.registry import query
from waymark.plans.views import TASK_ROWS, Views
from waymark.schema import TRIPS, WAYPOINTS
from waymark.shared import shared_path
from waymark.sources import files, mapping, sinks
from waymark.sources.versions import Versions
from waymark.streaming import windows

PAIR = ["vehicle_key", "trip_id"]


def scratch(v: Views, label: str) -> str:
    """A fresh path in the shared folder."""
    return shared_path(v.spark, label)


def written(v: Views, df: DataFrame, label: str, kind: str) -> str:
    path = scratch(v, label)
    w = df.write
    if kind.startswith("xml:"):
        _, root, row = kind.split(":")
        w.format("xml").option("rootTag", root).option("rowTag", row).save(path)
        return path
    (w.option("header", True).csv if kind == "csv" else w.text if kind == "text" else w.json if kind == "json" else w.parquet)(path)
    return path


CSV = ["trip_id", "vehicle_id", "starttime", "start_lon", "start_lat", "end_lon", "end_lat", "mode", "distance_km"]


@query("scan_csv", "SELECT trip_id, vehicle_id, starttime, start_lon, start_lat, end_lon, end_lat, mode, distance_km FROM trips", "start_lon start_lat end_lon end_lat distance_km")
def _(v):
    schema = "trip_id bigint, vehicle_id int, starttime int, start_lon double, start_lat double, end_lon double, end_lat double, mode string, distance_km double"
    return files.scan_csv(v.spark, written(v, v.trips.select(*CSV), "csv", "csv"), schema)


@query("scan_parquet", "SELECT trip_id, unix_time_ms, lon, lat FROM waypoints", "lon lat")
def _(v):
    return files.scan_parquet(v.spark, written(v, v.waypoints.select("trip_id", "unix_time_ms", "lon", "lat"), "parquet", "parquet"))


@query("scan_ndjson", "SELECT vehicle_key AS vehicle, unix_time_ms AS ts, lon, lat FROM pings", "lon lat")
def _(v):
    rows = v.pings.select(F.to_json(F.struct(F.col("vehicle_key").alias("vehicle"), F.col("unix_time_ms").alias("ts"), "lon", "lat")).alias("value"))
    path = written(v, rows.unionByName(v.spark.range(1).select(F.lit("").alias("value"))), "ndjson", "text")
    return files.scan_ndjson(v.spark, path, "vehicle string, ts bigint, lon double, lat double").drop("_props_json")


def _feature(kind: str, coordinates, **props):
    geometry = F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coordinates, F.lit("}"))
    p = F.to_json(F.struct(*[c.alias(n) for n, c in props.items()]))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), p, F.lit("}"))


def _collection(v: Views, features: DataFrame, label: str) -> str:
    """One feature per line: the form that is read in parallel."""
    return written(v, features.select(F.col("feature").alias("value")), label, "text")


def _pair(x, y):
    return F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))


@query("scan_geojson_points", "SELECT poi_id AS _time_ms, lon AS _lon, lat AS _lat FROM pois", "_lon _lat")
def _(v):
    p = v.pois.select(_feature("Point", _pair(F.col("lon"), F.col("lat")), name=F.col("name"), time=F.col("poi_id") / 1000.0).alias("feature"))
    return files.scan_geojson_points(v.spark, _collection(v, p, "points"), False).select("_time_ms", "_lon", "_lat")


@query("scan_geojson_lines", "SELECT vehicle_key, unix_time_ms AS _time_ms, lon AS _lon, lat AS _lat FROM waypoints", "_lon _lat")
def _(v):
    lines = v.waypoints.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("unix_time_ms", "seq", "lon", "lat"))).alias("p"))
    coords = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: _pair(x["lon"], x["lat"])), ","), F.lit("]"))
    f = lines.select(_feature("LineString", coords, vehicle=F.col("vehicle_key"), coordTimes=F.transform("p", lambda x: x["unix_time_ms"])).alias("feature"))
    d = files.scan_geojson_lines(v.spark, _collection(v, f, "lines"), False)
    return d.select(F.get_json_object("_props_json", "$.vehicle").alias("vehicle_key"), "_time_ms", "_lon", "_lat")


@query("scan_zones_geojson", "SELECT trip_id, min_lon, min_lat, max_lon, max_lat FROM (SELECT trip_id, least(start_lon, end_lon) AS min_lon, least(start_lat, end_lat) AS min_lat, greatest(start_lon, end_lon) AS max_lon, greatest(start_lat, end_lat) AS max_lat FROM trips)", "min_lon min_lat max_lon max_lat")
def _(v):
    c = [_pair(F.col(x), F.col(y)) for x, y in (("start_lon", "start_lat"), ("end_lon", "start_lat"), ("end_lon", "end_lat"), ("start_lon", "end_lat"), ("start_lon", "start_lat"))]
    f = v.trips.select(_feature("Polygon", F.concat(F.lit("[["), F.concat_ws(",", *c), F.lit("]]")), name=F.col("trip_id").cast("string"), category=F.col("mode")).alias("feature"))
    d = files.scan_zones_geojson(v.spark, _collection(v, f, "polygons"), "boxes", False)
    return d.select(F.col("name").cast("bigint").alias("trip_id"), "min_lon", "min_lat", "max_lon", "max_lat")


@query("scan_gpx", "SELECT vehicle_key AS _trk_name, unix_time_ms // 1000 * 1000 AS _time_ms, lon AS _lon, lat AS _lat FROM pings", "_lon _lat")
def _(v):
    point = F.struct("unix_time_ms", "event_id", F.struct(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(1.0).alias("ele"), F.date_format(F.timestamp_millis("unix_time_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")).alias("x"))
    t = v.pings.select("vehicle_key", point.alias("p")).groupBy("vehicle_key").agg(F.array_sort(F.collect_list("p")).alias("p"))
    t = t.select(F.col("vehicle_key").alias("name"), F.struct(F.transform("p", lambda x: x["x"]).alias("trkpt")).alias("trkseg"))
    path = written(v, t, "gpx", "xml:gpx:trk")
    return files.scan_gpx(v.spark, path).select("_trk_name", "_time_ms", "_lon", "_lat")


@query("scan_pois", "SELECT source_key, name, category, lon, lat, 1000 + row_number() OVER (PARTITION BY source_key ORDER BY name, lon, lat, category) AS poi_id FROM (SELECT 'part' AS source_key, p_name AS name, p_brand AS category, 139.5e0 + (p_partkey % 500) / 5e2 AS lon, 35.5e0 + (p_partkey % 250) / 4e2 AS lat FROM part)", "lon lat")
def _(v):
    d = v.table("part").selectExpr("p_name", "p_brand", "139.5d + (p_partkey % 500) / 5e2 AS x", "35.5d + (p_partkey % 250) / 4e2 AS y")
    return files.scan_pois(d, "part", {"name": F.col("p_name"), "category": F.col("p_brand"), "lon": F.col("x"), "lat": F.col("y")}, 1000).drop("props_json")


def _runs(v: Views, days: DataFrame, label: str) -> str:
    """A CSV per run folder run_20240101_00000N with totals by mode."""
    root = scratch(v, label)
    d = days.groupBy("simulation_day", F.coalesce("mode", F.lit("none")).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    d = d.withColumn("run", F.concat(F.lit("run_20240101_00000"), F.col("simulation_day").cast("string"))).select("metric", "value", "run", F.col("run").alias("part"))
    for i in range(3):
        d.where(F.col("run") == f"run_20240101_00000{i}").select("metric", "value").write.option("header", True).csv(f"{root}/city/run_20240101_00000{i}")
    return root


@query("scan_validation", "SELECT 'sim/run_20240101_00000' || simulation_day AS run_id, coalesce(mode, 'none') AS metric, count(*)::DOUBLE AS value FROM trips GROUP BY 1, 2", "value")
def _(v):
    return files.scan_validation(v.spark, _runs(v, v.trips, "validation"), "sim").select("run_id", "metric", "value")


@query("discover_files", "SELECT 'run_20240101_00000' || max(simulation_day) AS run, 'city' AS parent FROM trips")
def _(v):
    d = files.discover_files(v.spark, _runs(v, v.trips, "runs"), "part-*.csv")
    return d.select("run", F.regexp_extract("parent", "[^/]*$", 0).alias("parent")).distinct()


@query("discovery_counts", "SELECT 'run_20240101_00000' || d AS source, CASE WHEN d = 2 THEN 1 END AS latest FROM (SELECT DISTINCT simulation_day AS d FROM trips)")
def _(v):
    root = _runs(v, v.trips, "counts")
    every = files.discovery_counts(files.discover_files(v.spark, root, "part-*.csv", False), F.col("run")).select("source")
    last = files.discovery_counts(files.discover_files(v.spark, root, "part-*.csv"), F.col("run")).select("source", F.lit(1).alias("latest"))
    return every.join(last, "source", "left")


def _parts(v: Views, per_trip: int) -> int | None:
    """Partitions of TASK_ROWS rows at most for so many rows a trip; none if the session's are as many."""
    n = -(-per_trip * v.table("orders").count() // TASK_ROWS)
    return n if n > int(v.spark.conf.get("spark.sql.shuffle.partitions")) else None


def _event_files(v: Views) -> tuple[str, str]:
    """Trips as departures and arrivals on links between grid nodes, over all days; a trip within three minutes of the one before is left out."""
    start = F.col("simulation_day") * 86400 + F.col("starttime")
    t = v.trips.select("trip_id", start.alias("starttime"), "vehicle_key", F.concat(F.lit("l"), (F.col("trip_id") % 50).cast("string")).alias("l0"), F.concat(F.lit("l"), (F.col("trip_id") * 7 % 50).cast("string")).alias("l1"))
    n = _parts(v, 1)
    t = t if n is None else t.repartition(n, "vehicle_key")
    before = F.lag("starttime").over(Window.partitionBy("vehicle_key").orderBy("starttime", "trip_id"))
    t = t.withColumn("gap", F.col("starttime") - before).where("gap IS NULL OR gap >= 180")
    line = lambda time, kind, link: F.struct(time.cast("double").alias("_time"), F.lit(kind).alias("_type"), F.col("vehicle_key").alias("_person"), link.alias("_link"), F.lit("car").alias("_legMode"))
    e = t.select(F.explode(F.array(line(F.col("starttime"), "departure", F.col("l0")), line(F.col("starttime") + 60, "entered link", F.col("l1")), line(F.col("starttime") + 120, "arrival", F.col("l1")))).alias("e")).select("e.*")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    nodes = v.spark.range(51).select(name("n", F.col("id")).alias("_id"), (139.5 + F.col("id") / 100.0).alias("_x"), (35.5 + F.col("id") / 200.0).alias("_y"))
    links = v.spark.range(50).select(name("l", F.col("id")).alias("_id"), name("n", F.col("id")).alias("_from"), name("n", F.col("id") + 1).alias("_to"))
    network = scratch(v, "network")
    nodes.write.format("xml").option("rootTag", "network").option("rowTag", "node").save(network)
    links.write.mode("append").format("xml").option("rootTag", "network").option("rowTag", "link").save(network)
    return written(v, e, "events", "xml:events:event"), network


_EVENT_TRIPS = """WITH g AS (SELECT vehicle_key, trip_id, s, s - lag(s) OVER (PARTITION BY vehicle_key ORDER BY s, trip_id) AS gap FROM (SELECT *, simulation_day * 86400 + starttime AS s FROM trips)),
t AS (SELECT *, row_number() OVER (PARTITION BY vehicle_key ORDER BY s) AS n FROM g WHERE gap IS NULL OR gap >= 180)"""


@query("scan_agent_events_xml", f"""{_EVENT_TRIPS}
SELECT n AS trip_id, vehicle_key AS person_id, s AS start_time_sec, 139.5e0 + (t.trip_id % 50 + 0.5e0) / 1e2 AS start_lon, 35.5e0 + (t.trip_id * 7 % 50 + 0.5e0) / 2e2 AS end_lat, 'car' AS mode FROM t""", "start_lon end_lat")
def _(v):
    trips, _pings = files.scan_agent_events(v.spark, *_event_files(v), DEFAULT_ANCHOR * 1000, _parts(v, 3))
    return trips.select("trip_id", "person_id", "start_time_sec", "start_lon", "end_lat", "mode")


@query("scan_agent_pings", f"""{_EVENT_TRIPS}
SELECT vehicle_key AS person_id, n AS trip_id, (1601478000 + s + 60)::BIGINT * 1000 AS time_ms, 'l' || (t.trip_id * 7 % 50) AS link_id FROM t""")
def _(v):
    _trips, pings = files.scan_agent_events(v.spark, *_event_files(v), DEFAULT_ANCHOR * 1000, _parts(v, 3))
    return pings.select("person_id", "trip_id", "time_ms", "link_id")


@query("scan_fcd_xml", "SELECT vehicle_key AS id, unix_time_ms AS time_ms, lon AS x, lat AS y, 'e' || (event_id % 30) AS edge, CASE WHEN event_id % 2 = 0 THEN 'Car' ELSE 'bus' END AS mode FROM pings", "x y")
def _(v):
    n = F.col("event_id")
    car = F.struct(F.col("vehicle_key").alias("_id"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.when(n % 2 == 0, "passenger").otherwise("bus").alias("_type"), F.lit(1.5).alias("_speed"), F.concat(F.lit("e"), (n % 30).cast("string"), F.lit("_1")).alias("_lane"))
    steps = v.pings.select("unix_time_ms", car.alias("x")).groupBy("unix_time_ms").agg(F.collect_list("x").alias("vehicle"))
    steps = steps.select((F.col("unix_time_ms") / 1000).cast("decimal(20,3)").alias("_time"), "vehicle")
    return files.scan_fcd(v.spark, written(v, steps, "fcd", "xml:fcd-export:timestep"), 0, {"passenger": "Car"}).select("id", "time_ms", "x", "y", "edge", "mode")


@query("scan_building_centroids", "SELECT p_partkey::VARCHAR AS key FROM part WHERE p_size % 3 = 1 AND 139.5e0 + (p_partkey % 500) / 5e2 BETWEEN 139.6e0 AND 140.1e0")
def _(v):
    d = v.table("part").selectExpr("concat('c', p_size % 3) AS code", "139.5d + (p_partkey % 500) / 5e2 AS x", "35.5d AS y", "CAST(p_partkey AS DOUBLE) AS area")
    return files.scan_building_centroids(v.spark, written(v, d, "centroids", "csv"), ["c1"], (139.6, 35.0, 140.1, 36.0)).select(F.col("area").cast("bigint").cast("string").alias("key"))


def _footprints(v: Views) -> DataFrame:
    return v.table("part").selectExpr("p_partkey", "139.5d + (p_partkey % 500) / 5e2 AS x", "35.5d + (p_partkey % 250) / 4e2 AS y", "p_size AS h")


@query("scan_building_footprints", "SELECT p_partkey::VARCHAR AS key, 4 AS corners, CASE WHEN p_size % 4 = 0 THEN 8e0 ELSE p_size::DOUBLE END AS height_m FROM part", "height_m")
def _(v):
    x, y = F.col("x"), F.col("y")
    c = [_pair(x + dx, y + dy) for dx, dy in ((0, 0), (0.001, 0), (0.001, 0), (0.001, 0.001), (0, 0.001), (0, 0))]
    height = F.when(F.col("h") % 4 == 0, F.lit("unknown")).otherwise(F.concat(F.col("h").cast("string"), F.lit(";m")))
    f = _footprints(v).select(_feature("Polygon", F.concat(F.lit("[["), F.concat_ws(",", *c), F.lit("]]")), height=height, key=F.col("p_partkey").cast("string")).alias("feature"))
    path = _collection(v, f, "footprints")
    d = files.scan_building_footprints(v.spark, path, False)
    k = files._geo(v.spark, path, False).select("_feature_id", F.get_json_object("_props_json", "$.key").alias("key"))
    return d.join(k, "_feature_id").select("key", F.size("ring").alias("corners"), "height_m")


@query("scan_citygml", "SELECT p_partkey::VARCHAR AS key, p_size::DOUBLE AS height_m, 139.5e0 + (p_partkey % 500) / 5e2 AS lon, 4 AS corners FROM part", "height_m lon")
def _(v):
    at = lambda dx, dy: F.concat_ws(" ", (F.col("y") + dy).cast("string"), (F.col("x") + dx).cast("string"), F.lit("0.0"))
    pos = F.concat_ws(" ", at(0, 0), at(0.001, 0), at(0.001, 0.001), at(0, 0.001), at(0, 0))
    value = F.concat(
        F.lit('<bldg:Building gml:id="'), F.col("p_partkey").cast("string"), F.lit('"><bldg:measuredHeight>'), F.col("h").cast("string"),
        F.lit("</bldg:measuredHeight><bldg:lod0RoofEdge><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), pos,
        F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0RoofEdge></bldg:Building>"),
    )
    # a city model per tile of buildings, in a folder of its own
    tiles = _footprints(v).select(F.floor(F.col("p_partkey") / 500).alias("tile"), value.alias("b")).groupBy("tile").agg(F.array_join(F.collect_list("b"), "").alias("b"))
    head = '<core:CityModel xmlns:core="http://core" xmlns:gml="http://gml" xmlns:bldg="http://bldg">'
    path = scratch(v, "citygml")
    tiles.select("tile", F.concat(F.lit(head), "b", F.lit("</core:CityModel>")).alias("value")).write.partitionBy("tile").text(path)
    d = files.scan_citygml(v.spark, path)
    return d.select("key", "height_m", F.get("ring", F.lit(0))["lon"].alias("lon"), F.size("ring").alias("corners"))


@query("stage_union_schema", "SELECT trip_id, mode, NULL::DOUBLE AS fare_yen FROM trips WHERE dep_hour < 12 UNION ALL SELECT trip_id, NULL, fare_yen FROM trips WHERE dep_hour >= 12", "fare_yen")
def _(v):
    return files.stage_union([v.trips.where("dep_hour < 12").select("trip_id", "mode"), v.trips.where("dep_hour >= 12").select("trip_id", "fare_yen")])


# mappings


SPEC = {
    "vehicle_id": {"csv": "o_custkey", "type": "int"},
    "trip_id": {"csv": "o_orderkey", "type": "bigint"},
    "starttime": {"derived": "CAST((o_orderkey * 7919) % 86400 AS INT)", "type": "int"},
    "start_lon": {"csv": "o_totalprice", "type": "double", "transform": "139.5 + value / 1e6"},
    "start_lat": {"csv": "o_totalprice", "type": "double", "transform": "35.5 + value / 1e6"},
    "end_lon": {"derived": "139.9d", "type": "double"},
    "end_lat": {"derived": "35.9d", "type": "double"},
    "mode": {"csv": "o_orderpriority", "type": "varchar"},
}
_MAPPED = "SELECT o_custkey AS vehicle_id, o_orderkey AS trip_id, ((o_orderkey * 7919) % 86400)::INT AS starttime, 139.5e0 + o_totalprice / 1e6 AS start_lon, o_orderpriority AS mode"


@query("map_columns", f"{_MAPPED} FROM orders", "start_lon")
def _(v):
    return v.table("orders").select([mapping.column_expr(SPEC[c], v.anchor).alias(c) for c in ("vehicle_id", "trip_id", "starttime", "start_lon", "mode")])


def _projected(v: Views) -> DataFrame:
    return mapping.project_source(v.table("orders"), "trips", SPEC, "orders", v.anchor, "{scope}:{vehicle_id}", "tokyo")


@query("project_source", f"{_MAPPED}, 'tokyo:' || o_custkey AS vehicle_key, 'orders' AS source_id, ((o_orderkey * 7919) % 86400 // 3600)::INT AS dep_hour, NULL::DOUBLE AS fare_yen FROM orders", "start_lon fare_yen")
def _(v):
    return _projected(v).select("vehicle_id", "trip_id", "starttime", "start_lon", "mode", "vehicle_key", "source_id", "dep_hour", "fare_yen")


@query("vehicle_key", "SELECT o_orderkey, 'x_' || o_custkey || '@tokyo' AS vehicle_key FROM orders")
def _(v):
    return v.table("orders").select("o_orderkey", mapping.vehicle_key("x_{vehicle_id}@{scope}", F.col("o_custkey"), "tokyo").alias("vehicle_key"))


@query("int_or_hash", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE {drawn_sql('o_orderpriority')} % 2000000000 + 1 END::INT AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE {drawn_sql('o_orderpriority')} % 9000000000000000000 + 1 END::BIGINT AS long_id FROM orders")
def _(v):
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority"))
    return v.table("orders").select("o_orderkey", mapping.int_or_hash(mixed).alias("id"), mapping.int_or_hash(mixed, "bigint").alias("long_id"))


@query("mode_dual_write", """SELECT trip_id, CASE WHEN k = 0 THEN transport_mode WHEN k = 1 THEN NULL ELSE transport_mode END AS code, CASE WHEN k = 0 THEN 'ride' WHEN k = 1 THEN mode ELSE mode END AS label FROM (SELECT *, trip_id % 3 AS k FROM trips)""")
def _(v):
    t, k = v.trips, F.col("trip_id") % 3
    code = F.col("transport_mode").cast("string")
    a, b, c = mapping.mode_columns(code, F.lit("ride")), mapping.mode_columns(F.col("mode"), None), mapping.mode_columns(code, None)
    pick = lambda i: F.when(k == 0, a[i]).when(k == 1, b[i]).otherwise(c[i])
    return t.select("trip_id", pick(0).alias("code"), pick(1).alias("label"))


@query("mode_label", """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'Walk' WHEN 1 THEN 'Bicycle' WHEN 2 THEN 'Bus' WHEN 3 THEN 'Car' WHEN 4 THEN 'Train' WHEN 8 THEN 'Taxi' ELSE 'mode ' || (o_orderkey % 10) END AS label,
 CASE WHEN o_orderkey % 10 IN (0, 2, 3, 4, 8) THEN o_orderkey % 10 WHEN o_orderkey % 10 = 1 THEN 1 END::INT AS code FROM orders""")
def _(v):
    over = {"1": "Bicycle"}
    d = v.table("orders").select("o_orderkey", mode_label((F.col("o_orderkey") % 10).cast("int"), over).alias("label"))
    return d.withColumn("code", mode_code(F.upper("label"), over))


@query("parse_time_ms", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000 END AS ms FROM events")
def _(v):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.floor(ms / 1000).cast("string")).when(k == 1, ms.cast("string")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return v.table("events").select("event_id", parse_time_ms(text).alias("ms"))


@query("time_kind_to_ms", "SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS iso, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 * 1000 AS s, (epoch_us(ts) // 1000000 % 86400)::INT AS clock FROM events")
def _(v):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    iso, sec = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.floor(ms / 1000)
    return v.table("events").select("event_id", time_kind_to_ms(iso, "iso").alias("iso"), time_kind_to_ms(ms, "epoch_ms").alias("ms"), time_kind_to_ms(sec, "epoch_s").alias("s"), start_seconds(sec, "epoch_s", 0).alias("clock"))


# sinks


def _source_counts(d: DataFrame) -> DataFrame:
    return d.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("trip_id").alias("ids"))


_COUNTS = "SELECT source_id, count(*) AS n, sum(trip_id)::BIGINT AS ids FROM {} GROUP BY 1"


@query("write_trips", _COUNTS.format("trips"))
def _(v):
    sinks.write_trips(v.full_trips, path := scratch(v, "trips"))
    return _source_counts(v.spark.read.parquet(path))


@query("write_waypoints", _COUNTS.format("waypoints"))
def _(v):
    sinks.write_waypoints(v.waypoints, path := scratch(v, "waypoints"))
    return _source_counts(v.spark.read.parquet(path))


@query("write_by_place", "SELECT vehicle_key, trip_id, unix_time_ms, lon, lat FROM waypoints WHERE lon BETWEEN 139.9e0 AND 140.1e0 AND lat BETWEEN 35.6e0 AND 35.8e0", "lon lat")
def _(v):
    sinks.write_by_place(v.waypoints, path := scratch(v, "by-place"))
    return sinks.read_box(v.spark, path, (139.9, 35.6, 140.1, 35.8)).select(*PAIR, "unix_time_ms", "lon", "lat")


@query("replace_source", _COUNTS.format("(SELECT * FROM trips WHERE source_id = 'fleet_b' OR dep_hour < 12)"))
def _(v):
    store = Versions(v.spark, scratch(v, "replaced"))
    for source in ("fleet_a", "fleet_b"):
        sinks.replace_source(store, source, v.trips, v.waypoints)
    for _again in range(2):
        sinks.replace_source(store, "fleet_a", v.trips.where("dep_hour < 12"), v.waypoints)
    return _source_counts(store.snapshot().read("trips", TRIPS))


@query("replace_source_emptied", "SELECT 'trips' AS name, source_id, count(*) AS n FROM trips WHERE source_id = 'fleet_b' GROUP BY 2 UNION ALL SELECT 'waypoints', source_id, count(*) FROM waypoints WHERE source_id = 'fleet_b' GROUP BY 2")
def _(v):
    store = Versions(v.spark, scratch(v, "emptied"))
    for source in ("fleet_a", "fleet_b"):
        sinks.replace_source(store, source, v.trips, v.waypoints)
    sinks.replace_source(store, "fleet_a", v.trips.where("false"), v.waypoints.where("false"))
    now = store.snapshot()
    counts = [now.read(name, schema).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, schema in (("trips", TRIPS), ("waypoints", WAYPOINTS))]
    return counts[0].unionByName(counts[1])


@query("replace_resolution", "SELECT r AS resolution, sum(n)::BIGINT AS weight FROM (SELECT 0.005e0 AS r, count(*) AS n FROM waypoints UNION ALL SELECT 0.01e0, count(*) FROM waypoints WHERE source_id = 'fleet_a') GROUP BY 1", "resolution")
def _(v):
    store = Versions(v.spark, scratch(v, "density"))
    d = v.waypoints.withColumn("resolution", F.lit(0.005)).unionByName(v.waypoints.withColumn("resolution", F.lit(0.01))).groupBy("resolution", "source_id").agg(F.count(F.lit(1)).alias("weight"))
    for resolution in (0.005, 0.01):
        sinks.replace_resolution(store, resolution, d)
    sinks.replace_resolution(store, 0.01, d.where("source_id = 'fleet_a'"))
    return store.snapshot().read("density", d.schema).groupBy("resolution").agg(F.sum("weight").alias("weight"))


@query("replace_validation_run", "SELECT 'run_' || simulation_day AS run_id, count(*) AS n FROM trips WHERE simulation_day <> 1 OR dep_hour < 6 GROUP BY 1")
def _(v):
    store = Versions(v.spark, scratch(v, "validation"))
    d = v.trips.withColumn("run_id", F.concat(F.lit("run_"), F.col("simulation_day").cast("string"))).select("run_id", "trip_id", "dep_hour")
    for day in range(3):
        sinks.replace_validation_run(store, f"run_{day}", d)
    sinks.replace_validation_run(store, "run_1", d.where("dep_hour < 6"))
    return store.snapshot().read("validation", d.schema).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def _log(v: Views) -> DataFrame:
    path = scratch(v, "log")
    sinks.append_ingest_log(v.trips.groupBy("source_id").agg(F.count(F.lit(1)).alias("row_count")).select(F.concat("source_id", F.lit(".csv")).alias("file_path"), F.lit("trips").alias("table_name"), "row_count"), path)
    sinks.append_ingest_log(v.trips.select(F.concat("city", F.lit(".csv")).alias("file_path"), F.lit("trips").alias("table_name"), F.lit(-1).cast("bigint").alias("row_count")).distinct(), path)
    return v.spark.read.parquet(path)


@query("append_ingest_log", "SELECT source_id || '.csv' AS file_path, 'trips' AS table_name, count(*) AS row_count FROM trips GROUP BY 1 UNION ALL SELECT DISTINCT city || '.csv', 'trips', -1 FROM trips")
def _(v):
    return _log(v).drop("ingested_at")


@query("ingest_failures", "SELECT DISTINCT city || '.csv' AS file_path FROM trips ORDER BY 1 LIMIT 5")
def _(v):
    return stats.ingest_failures(_log(v)).select("file_path")


@query("write_adapter_csv", "SELECT trip_id, mode FROM trips")
def _(v):
    sinks.write_csv(v.trips.select("trip_id", "mode"), path := scratch(v, "adapter"))
    return files.scan_csv(v.spark, path, "trip_id bigint, mode string")


@query("write_adapter_ndjson", "SELECT event_id, vehicle_key FROM pings")
def _(v):
    sinks.write_ndjson(v.pings.select("event_id", "vehicle_key"), path := scratch(v, "adapter"))
    return v.spark.read.schema("event_id bigint, vehicle_key string").json(path)


@query("census_geometry", "SELECT 0 AS polygons, 0 AS lines, count(*) AS points, 0 AS timed, 'pois' AS role FROM pois")
def _(v):
    p = v.pois.select(_feature("Point", _pair(F.col("lon"), F.col("lat")), name=F.col("name")).alias("feature"))
    g = files._geo(v.spark, _collection(v, p, "census"), False).withColumn("time", F.get_json_object("_props_json", "$.time"))
    return profile.census_geometry(g)


@query("upload_pipeline", """SELECT count(*) AS weight_cells, sum(n)::BIGINT AS weight FROM (SELECT floor((unix_time_ms // 1000 % 86400) / 3600) AS h, round(lon / 0.005e0) AS x, round(lat / 0.005e0) AS y, count(*) AS n FROM pings GROUP BY 1, 2, 3)""")
def _(v):
    """Pings from a file: anchor, trips, metrics, density."""
    rows = v.pings.select(F.to_json(F.struct("vehicle_key", "vehicle_id", "event_id", "unix_time_ms", "lon", "lat")).alias("value"))
    p = files.scan_ndjson(v.spark, written(v, rows, "upload", "text"), "vehicle_key string, vehicle_id int, event_id bigint, unix_time_ms bigint, lon double, lat double").withColumn("source_id", F.lit("upload"))
    anchor = derive.resolve_anchor(p).first()[0]
    trips = derive.synthesize_trips(p, "gap", anchor, 360)
    points = derive.with_trip_ids(p, "gap", anchor, 360).withColumn("seq", F.col("event_id"))
    path = scratch(v, "upload-trips")
    sinks.write_trips(derive.with_metrics(trips, points), path)
    cells = spatial.build_density_hourly(points, v.spark.read.parquet(path), anchor)
    return cells.agg(F.count(F.lit(1)).alias("weight_cells"), F.sum("weight").alias("weight"))


# streams, beyond what is asked: files of pings read as a stream, to the end


def _streamed(v: Views, f, name: str) -> DataFrame:
    """Runs a stream over the pings' files to its end and reads what it wrote."""
    schema = v.pings.schema
    # a last ping far ahead moves the watermark past all windows
    ahead = v.pings.agg(*[F.max(c.name).alias(c.name) for c in schema]).withColumn("unix_time_ms", F.col("unix_time_ms") + 30 * 86_400_000).withColumn("vehicle_key", F.lit("end"))
    path = scratch(v, name)
    v.pings.write.parquet(f"{path}/in")
    ahead.write.mode("append").parquet(f"{path}/in")
    stream = f(v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in"))
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_gap_split", """WITH g AS (SELECT *, sum(CASE WHEN unix_time_ms - t0 >= 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_key ORDER BY unix_time_ms, event_id ROWS UNBOUNDED PRECEDING) AS k
 FROM (SELECT *, lag(unix_time_ms) OVER (PARTITION BY vehicle_key ORDER BY unix_time_ms, event_id) AS t0 FROM pings))
SELECT vehicle_key, count(*) AS pings, min(unix_time_ms) AS first_ms, max(unix_time_ms) AS last_ms FROM g GROUP BY vehicle_key, k""")
def _(v):
    return _streamed(v, lambda s: windows.gap_split(s, 360), "sessions").where("vehicle_key <> 'end'")


@query("stream_density_hourly", "SELECT unix_time_ms // 3600000 * 3600000 AS hour_ms, round(lon / 0.005e0) * 0.005e0 AS grid_lon, round(lat / 0.005e0) * 0.005e0 AS grid_lat, count(*) AS weight FROM pings GROUP BY 1, 2, 3", "grid_lon grid_lat")
def _(v):
    last = v.pings.agg(F.max("unix_time_ms")).first()[0]
    return _streamed(v, windows.density_hourly, "hourly").where(F.col("hour_ms") <= last)
