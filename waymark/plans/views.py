"""Mobility views of the supplied tables, built alike in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.functions.clock import DEFAULT_ANCHOR
from waymark.functions.modes import mode_label
from waymark.operators.derive import with_metrics

PING_ANCHOR = 1704067200
#: A rectangle each, and one polygon with a hole: (zone_id, source_key, name, category, rings of lon/lat pairs).
ZONES = (
    (1, "wards", "west", "ward", (((139.5, 35.5), (139.8, 35.5), (139.8, 35.8), (139.5, 35.8)),)),
    (2, "wards", "east", "ward", (((140.0, 35.6), (140.4, 35.6), (140.4, 36.0), (140.0, 36.0)),)),
    (3, "parks", "ring", "park", (((139.7, 35.6), (140.2, 35.6), (140.2, 36.1), (139.7, 36.1)), ((139.85, 35.75), (140.05, 35.75), (140.05, 35.95), (139.85, 35.95)))),
)
#: Rows of the larger side of a join that one task should sort and hash.
TASK_ROWS = 1_000_000


def parts_of(large: DataFrame) -> int | None:
    """In how many partitions TASK_ROWS rows of ``large`` are in each, if the session's would hold more."""
    n = -(-large.count() // TASK_ROWS)
    return n if n > int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(large: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Their join; where the session's partitions would hold more than TASK_ROWS rows of ``large`` each, both are dealt to as many as it takes.

    What follows by the same key (windows and sums per trip) runs in these
    partitions, so that no task's memory grows with the table.
    """
    n = parts_of(large)
    if n:
        large, other = large.repartition(n, key), other.repartition(n, other_key)
    return large.join(other, F.col(key) == F.col(other_key))


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.anchor = DEFAULT_ANCHOR

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def moves(self) -> DataFrame:
        """What a trip has from its order alone (every order has a customer)."""
        d = self.table("orders").selectExpr(
            "*", "o_orderkey * o_orderkey AS q", "CAST((o_orderkey * 7919) % 86400 AS INT) AS starttime",
            "if(o_orderkey % 2 = 0, 'fleet_a', 'fleet_b') AS source_id", "if(o_orderkey % 11 = 0, NULL, CAST(o_orderkey % 5 AS INT)) AS transport_mode",
        )
        return d.selectExpr(
            "o_custkey", "CAST(o_custkey AS INT) AS vehicle_id", "CAST(o_custkey AS STRING) AS agent_id", "o_orderkey AS trip_id", "starttime",
            "139.5d + CAST((q * 37) % 500 AS DOUBLE) / 5e2 AS start_lon", "35.5d + CAST((q * 53) % 250 AS DOUBLE) / 4e2 AS start_lat",
            "139.5d + CAST((q * 91 + 100) % 500 AS DOUBLE) / 5e2 AS end_lon", "35.5d + CAST((q * 17 + 60) % 250 AS DOUBLE) / 4e2 AS end_lat",
            "transport_mode", "if(o_orderkey % 97 = 0, NULL, o_totalprice / 1e4) AS distance_km", "CAST(starttime DIV 3600 AS INT) AS dep_hour",
            "CAST(o_orderkey % 3 AS INT) AS simulation_day", "source_id", "source_id AS vehicle_type",
            "concat(source_id, ':', o_custkey) AS vehicle_key", "if(o_orderstatus = 'F', o_totalprice / 1e2, NULL) AS fare_yen",
        )

    @cached_property
    def trips(self) -> DataFrame:
        """Orders as trips; metrics that need other rows are null."""
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.expr("replace(lower(r_name), ' ', '_')").alias("city"))
        customers = self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "city", F.lower("c_mktsegment").alias("goods_type"))
        d = self.moves.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
        zone = lambda lon, lat: F.concat(F.lit("Z"), F.floor(F.col(lon) * 10).cast("string"), F.lit("_"), F.floor(F.col(lat) * 10).cast("string"))
        return d.withColumns(
            {
                "mode": mode_label(F.col("transport_mode")),
                "is_night_trip": (F.col("dep_hour") >= 22) | (F.col("dep_hour") < 5),
                "origin_zone": zone("start_lon", "start_lat"),
                "dest_zone": zone("end_lon", "end_lat"),
                "leg_id": F.lit(None).cast("int"),
            }
        )

    @cached_property
    def waypoints(self) -> DataFrame:
        """Line items as waypoints along their trips."""
        t = self.moves.select("trip_id", "vehicle_id", "vehicle_key", "source_id", "simulation_day", "starttime", "start_lon", "start_lat", "end_lon", "end_lat")
        d = dealt(self.table("lineitem"), "l_orderkey", t, "trip_id")
        along = "CAST(l_linenumber AS DOUBLE) / 8e0"
        return d.selectExpr(
            "vehicle_id", "trip_id", "vehicle_key", "source_id", "source_id AS vehicle_type",
            f"({self.anchor} + simulation_day * 86400L + starttime) * 1000L + l_linenumber * 60000L + (l_partkey * 131 + l_suppkey * 17 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 59999 AS unix_time_ms",
            f"start_lon + (end_lon - start_lon) * {along} AS lon", f"start_lat + (end_lat - start_lat) * {along} AS lat",
            "concat('L', l_partkey % 200) AS link_id", "concat('L', l_partkey) AS fine_link_id", "l_linenumber AS seq",
        )

    @cached_property
    def waypoint_parts(self) -> int | None:
        return parts_of(self.table("lineitem"))

    @cached_property
    def full_trips(self) -> DataFrame:
        """Trips with speed, dwell and detour."""
        return with_metrics(self.trips, self.waypoints)

    @cached_property
    def pings(self) -> DataFrame:
        """Events as a source of points only."""
        return self.table("events").selectExpr(
            "concat('ping:', user_id) AS vehicle_key", "CAST(user_id AS INT) AS vehicle_id", "'pings' AS source_id", "event_id",
            "unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000 AS unix_time_ms",
            "139.5d + CAST((event_id * 37) % 1000 AS DOUBLE) / 1e3 AS lon", "35.5d + CAST((event_id * 53) % 700 AS DOUBLE) / 1e3 AS lat",
        )

    @cached_property
    def pois(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS poi_id", "concat('layer', s_suppkey % 2) AS source_key", "s_name AS name",
            "element_at(array('Train station', 'Shopping mall', 'City park', 'unknown'), CAST(s_suppkey % 4 AS INT) + 1) AS category",
            "139.5d + CAST((s_suppkey * 37) % 500 AS DOUBLE) / 5e2 AS lon", "35.5d + CAST((s_suppkey * 53) % 250 AS DOUBLE) / 4e2 AS lat",
        )

    @cached_property
    def zones(self) -> DataFrame:
        rows = [(i, k, n, c, [[[{"lon": x, "lat": y} for x, y in ring] for ring in rings]]) for i, k, n, c, rings in ZONES]
        z = self.spark.createDataFrame(rows, "zone_id long, source_key string, name string, category string, rings array<array<array<struct<lon:double,lat:double>>>>")
        points = F.flatten(F.flatten("rings"))
        lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
        return z.select("*", F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def _zones_sql() -> str:
    rows = []
    for i, key, name, category, rings in ZONES:
        lon, lat = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
        rows.append(f"({i}, '{key}', '{name}', '{category}', {min(lon)}e0, {min(lat)}e0, {max(lon)}e0, {max(lat)}e0)")
    return ", ".join(rows)


#: The same views as common table expressions.
CTE = f"""
WITH trips0 AS (
  SELECT o_orderkey AS k, o_orderkey * o_orderkey AS q, (o_orderkey * 7919) % 86400 AS st, o.*, c.c_mktsegment, replace(lower(r_name), ' ', '_') AS city,
         CASE WHEN o_orderkey % 2 = 0 THEN 'fleet_a' ELSE 'fleet_b' END AS source_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 5 END AS tm
  FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), trips1 AS (
  SELECT o_custkey::INT AS vehicle_id, o_custkey::VARCHAR AS agent_id, k AS trip_id, st::INT AS starttime,
         139.5e0 + CAST((q * 37) % 500 AS DOUBLE) / 5e2 AS start_lon, 35.5e0 + CAST((q * 53) % 250 AS DOUBLE) / 4e2 AS start_lat,
         139.5e0 + CAST((q * 91 + 100) % 500 AS DOUBLE) / 5e2 AS end_lon, 35.5e0 + CAST((q * 17 + 60) % 250 AS DOUBLE) / 4e2 AS end_lat,
         tm::INT AS transport_mode, CASE WHEN k % 97 = 0 THEN NULL ELSE o_totalprice / 1e4 END AS distance_km, (st // 3600)::INT AS dep_hour,
         (k % 3)::INT AS simulation_day, lower(c_mktsegment) AS goods_type, source_id, source_id AS vehicle_type, source_id || ':' || o_custkey AS vehicle_key,
         city, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1e2 END AS fare_yen,
         CASE tm WHEN 0 THEN 'Walk' WHEN 1 THEN 'Bike' WHEN 2 THEN 'Bus' WHEN 3 THEN 'Car' WHEN 4 THEN 'Train' END AS mode
  FROM trips0
), trips AS (
  SELECT *, dep_hour >= 22 OR dep_hour < 5 AS is_night_trip, NULL::INT AS leg_id,
         'Z' || floor(start_lon * 10)::BIGINT || '_' || floor(start_lat * 10)::BIGINT AS origin_zone, 'Z' || floor(end_lon * 10)::BIGINT || '_' || floor(end_lat * 10)::BIGINT AS dest_zone
  FROM trips1
), waypoints AS (
  SELECT vehicle_id, trip_id, vehicle_key, source_id, source_id AS vehicle_type,
         ({DEFAULT_ANCHOR} + simulation_day * 86400 + starttime)::BIGINT * 1000 + l_linenumber * 60000 + (l_partkey * 131 + l_suppkey * 17 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 59999 AS unix_time_ms,
         start_lon + (end_lon - start_lon) * CAST(l_linenumber AS DOUBLE) / 8e0 AS lon, start_lat + (end_lat - start_lat) * CAST(l_linenumber AS DOUBLE) / 8e0 AS lat,
         'L' || (l_partkey % 200) AS link_id, 'L' || l_partkey AS fine_link_id, l_linenumber AS seq
  FROM lineitem JOIN trips ON l_orderkey = trip_id
), spans AS (
  SELECT vehicle_key, trip_id, max(unix_time_ms) - min(unix_time_ms) AS ms FROM waypoints GROUP BY vehicle_key, trip_id
), full_trips AS (
  SELECT t.*, CASE WHEN s.ms > 0 AND distance_km > 0 THEN distance_km / (s.ms / 3.6e6) END AS speed_avg_kmh,
         (lead(starttime) OVER (PARTITION BY t.vehicle_key, simulation_day ORDER BY starttime, t.trip_id) - starttime) / 6e1 AS dwell_minutes,
         CASE WHEN distance_km > 0 AND od >= 0.1 THEN distance_km / od END AS detour_ratio
  FROM (SELECT *, 111.32e0 * sqrt(pow((end_lon - start_lon) * cos(radians(start_lat)), 2) + pow(end_lat - start_lat, 2)) AS od FROM trips) t
  LEFT JOIN spans s USING (vehicle_key, trip_id)
), pings AS (
  SELECT 'ping:' || user_id AS vehicle_key, user_id::INT AS vehicle_id, 'pings' AS source_id, event_id, epoch_us(ts) // 1000 AS unix_time_ms,
         139.5e0 + CAST((event_id * 37) % 1000 AS DOUBLE) / 1e3 AS lon, 35.5e0 + CAST((event_id * 53) % 700 AS DOUBLE) / 1e3 AS lat FROM events
), pois AS (
  SELECT s_suppkey AS poi_id, 'layer' || (s_suppkey % 2) AS source_key, s_name AS name,
         (['Train station', 'Shopping mall', 'City park', 'unknown'])[s_suppkey % 4 + 1] AS category,
         139.5e0 + CAST((s_suppkey * 37) % 500 AS DOUBLE) / 5e2 AS lon, 35.5e0 + CAST((s_suppkey * 53) % 250 AS DOUBLE) / 4e2 AS lat FROM supplier
), zones AS (
  SELECT * FROM (VALUES {_zones_sql()}) z(zone_id, source_key, name, category, min_lon, min_lat, max_lon, max_lat)
)"""
