"""Filters, joins, windows, derivations and retrievals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from waymark.functions import grid
from waymark.functions.clock import clock_of_day, day_index, hour_of_day
from waymark.functions.draw import drawn_sql
from waymark.functions.exact import millionths
from waymark.functions.geo import equirect_km, equirect_mean_km, haversine_km, haversine_m
from waymark.operators import derive, spatial
from waymark.operators import filters as f
from waymark.operators import trajectories as tj
from waymark.operators.filters import PAIR, TripFilter
from waymark.plans.analysis import BOX, IN_BOX
from waymark.plans.registry import query
from waymark.plans.views import PING_ANCHOR, Views
from waymark.shared import saved

def _summary(trips: DataFrame) -> DataFrame:
    """What is left of the trips: number, sums and range of ids."""
    return trips.agg(F.count("*").alias("trips"), F.sum("trip_id").alias("id_sum"), F.min("trip_id").alias("id_min"), F.max("trip_id").alias("id_max"), F.sum("distance_km").alias("km"))


def _filter_query(name: str, flt: TripFilter | Callable[[], TripFilter], where: str, full: bool = False) -> None:
    """``flt`` is made when the query runs if it holds columns, which need a session."""
    table = "full_trips" if full else "trips"
    query(name, f"SELECT count(*) AS trips, sum(trip_id)::BIGINT AS id_sum, min(trip_id) AS id_min, max(trip_id) AS id_max, sum(distance_km) AS km FROM {table} WHERE {where}", "km")(
        lambda v: _summary((flt() if callable(flt) else flt).apply(v.full_trips if full else v.trips, v.waypoints))
    )


_ENTERS = f"(vehicle_key, trip_id) IN (SELECT vehicle_key, trip_id FROM waypoints WHERE {IN_BOX})"
_filter_query("f_source", TripFilter(source_id="fleet_a", vehicle_type="fleet_b"), "source_id = 'fleet_a'")
_filter_query("f_city", TripFilter(city="asia"), "city = 'asia'")
_filter_query("f_day", TripFilter(simulation_day=1), "simulation_day = 1")
_filter_query("f_modes", TripFilter(modes=("Walk", "Car"), transport_modes=(1,)), "mode IN ('Walk', 'Car')")
_filter_query("f_transport_modes", TripFilter(transport_modes=(1, 4)), "transport_mode IN (1, 4)")
_filter_query("f_hours", TripFilter(hour_min=7, hour_max=19), "dep_hour BETWEEN 7 AND 19")
_filter_query("f_goods", TripFilter(goods_type="machinery"), "goods_type = 'machinery'")
_filter_query("f_speed", TripFilter(speed_min=60, speed_max=300), "speed_avg_kmh BETWEEN 60 AND 300", True)
_filter_query("f_dwell", TripFilter(dwell_max=120), "dwell_minutes <= 120", True)
_filter_query("f_detour", TripFilter(detour_min=1, detour_max=2), "detour_ratio BETWEEN 1 AND 2", True)
_filter_query("f_scenario", TripFilter(scenario=BOX), f"NOT (transport_mode = 3 AND {_ENTERS})")
_filter_query("f_zone_pair", TripFilter(origin_zone="Z1396_355", dest_zone="Z1399_359"), "origin_zone = 'Z1396_355' AND dest_zone = 'Z1399_359'")
_filter_query("f_arc_window", lambda: TripFilter(extra=(f.near_clock(43200),)), "starttime BETWEEN 41400 AND 45000")
_filter_query("f_vehicle_prefix", lambda: TripFilter(extra=(f.vehicle_prefix("fleet_a:1_"),)), "starts_with(vehicle_key, 'fleet_a:1_')")
_filter_query("f_vehicle_list", lambda: TripFilter(extra=(f.vehicle_list(["fleet_a:1", "fleet_b:7", "fleet_b:10"]),)), "vehicle_key IN ('fleet_a:1', 'fleet_b:7', 'fleet_b:10')")
_filter_query("f_hide_sources", lambda: TripFilter(extra=(~F.col("source_id").isin("fleet_b"),)), "source_id NOT IN ('fleet_b')")

_POINTS = "SELECT count(*) AS n, count(DISTINCT trip_id) AS trips, sum(unix_time_ms)::BIGINT AS ms FROM waypoints WHERE"


def _points(w: DataFrame) -> DataFrame:
    """One row; the sum of times is exact, and a BIGINT as in the SQL unless it is beyond one, where it stays a DECIMAL."""
    d = saved(w.agg(F.count("*").alias("n"), F.countDistinct("trip_id").alias("trips"), F.sum(F.col("unix_time_ms").cast("decimal(20,0)")).alias("ms")), "points")
    beyond = d.where(F.abs("ms") > 2**63 - 1).count()
    return d if beyond else d.withColumn("ms", F.col("ms").cast("long"))


@query("f_bbox", f"{_POINTS} {IN_BOX}")
def _(v):
    return _points(v.waypoints.where(f.in_box(BOX)))


@query("f_radius", f"{_POINTS} lon BETWEEN 140e0 - 5e0 / 80 AND 140e0 + 5e0 / 80 AND lat BETWEEN 35.7e0 - 5e0 / 80 AND 35.7e0 + 5e0 / 80")
def _(v):
    return _points(v.waypoints.where(f.in_radius(140.0, 35.7, 5.0)))


@query("f_radius_exact", f"{_POINTS} 2 * 6371e0 * asin(sqrt(pow(sin(radians(lat - 35.7e0) / 2), 2) + cos(radians(35.7e0)) * cos(radians(lat)) * pow(sin(radians(lon - 140e0) / 2), 2))) <= 5 AND lon BETWEEN 140e0 - 5e0 / 80 AND 140e0 + 5e0 / 80 AND lat BETWEEN 35.7e0 - 5e0 / 80 AND 35.7e0 + 5e0 / 80")
def _(v):
    return _points(v.waypoints.where(f.in_radius(140.0, 35.7, 5.0, True)))


@query("f_hour_guard", "SELECT count(*) FILTER (dep_hour BETWEEN 0 AND 23) AS in_range, count(*) FILTER (dep_hour IS NULL OR dep_hour NOT BETWEEN 0 AND 23) AS out_of_range FROM (SELECT dep_hour - 2 AS dep_hour FROM trips)")
def _(v):
    return f.hour_guard(v.trips.withColumn("dep_hour", F.col("dep_hour") - 2))


@query("f_poi", "SELECT poi_id FROM pois WHERE category = 'City park' AND source_key = 'layer0' AND lon BETWEEN 139.6e0 AND 140.2e0 AND lat BETWEEN 35.5e0 AND 36e0")
def _(v):
    return v.pois.where((F.col("category") == "City park") & (F.col("source_key") == "layer0") & f.in_box((139.6, 35.5, 140.2, 36.0))).select("poi_id")


@query("f_zone", "SELECT poi_id AS zone_id FROM pois WHERE source_key = 'layer1' AND lon + 0.05e0 >= 139.9e0 AND lon - 0.05e0 <= 140.1e0 AND lat + 0.05e0 >= 35.6e0 AND lat - 0.05e0 <= 35.8e0")
def _(v):
    # a square zone around every point of interest
    half = F.lit(0.05)
    squares = v.pois.select(F.col("poi_id").alias("zone_id"), "source_key", *[(F.col(c) + sign * half).alias(f"{side}_{c}") for c in ("lon", "lat") for side, sign in (("min", -1), ("max", 1))])
    return squares.where((F.col("source_key") == "layer1") & f.zone_overlaps(BOX)).select("zone_id")


_SEG = """SELECT vehicle_key, trip_id, link_id, unix_time_ms, seq, 111.32e0 * sqrt(pow((lon - lon0) * cos(radians((lat0 + lat) / 2)), 2) + pow(lat - lat0, 2)) AS km, (unix_time_ms - t0) / 1e3 AS dt
FROM (SELECT *, lag(unix_time_ms) OVER w AS t0, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM waypoints WINDOW w AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq)) WHERE t0 IS NOT NULL"""
_SEGMENTS = f"SELECT *, CASE WHEN speed_kmh < 1 THEN dt ELSE 0e0 END AS dwell_sec FROM (SELECT *, CASE WHEN dt > 0 THEN km / (dt / 3.6e3) END AS speed_kmh FROM ({_SEG}))"


@query("f_dwell_marker", f"SELECT vehicle_key, trip_id, unix_time_ms FROM ({_SEGMENTS.replace('FROM waypoints', 'FROM (SELECT *, 0::BIGINT AS trip_id, NULL AS link_id, event_id AS seq FROM pings)')}) WHERE dwell_sec > 60")
def _(v):
    # pings of a user as one trip: some stay where they are for hours
    pings = v.pings.withColumns({"trip_id": F.lit(0).cast("long"), "link_id": F.lit(None).cast("string"), "seq": F.col("event_id")})
    return derive.segments(pings).where("dwell_sec > 60").select(*PAIR, "unix_time_ms")


# the same with waypoints of one time and seq in the order of their links and places
_ORDERED = _SEGMENTS.replace("ORDER BY unix_time_ms, seq)", "ORDER BY unix_time_ms, seq, link_id NULLS FIRST, lon NULLS FIRST, lat NULLS FIRST)")
_MILLIONTHS = "floor({} * 1e6 + 0.5e0)"


@query("segments", f"SELECT vehicle_key, trip_id, unix_time_ms, link_id, {_MILLIONTHS.format('km')} / 1e6 AS km, {_MILLIONTHS.format('speed_kmh')} / 1e6 AS speed_kmh, dwell_sec FROM ({_ORDERED})", "km speed_kmh dwell_sec")
def _(v):
    six = lambda c: (millionths(F.col(c)) / 1e6).alias(c)
    return derive.segments(v.waypoints).select(*PAIR, "unix_time_ms", "link_id", six("km"), six("speed_kmh"), "dwell_sec")


# joins


@query("j_waypoint_trip", "SELECT w.trip_id, w.unix_time_ms, t.mode, t.agent_id FROM waypoints w LEFT JOIN (SELECT * FROM trips WHERE dep_hour < 12) t USING (vehicle_key, trip_id)")
def _(v):
    return tj.with_trip(v.waypoints, v.trips.where("dep_hour < 12")).select("trip_id", "unix_time_ms", "mode", "agent_id")


_MORNING = "SELECT * FROM trips WHERE dep_hour < 6 AND source_id = 'fleet_a'"


def _morning(v: Views) -> DataFrame:
    return TripFilter(source_id="fleet_a", hour_max=5).apply(v.trips)


@query("j_pair_scope", f"{_POINTS} (vehicle_key, trip_id) IN (SELECT vehicle_key, trip_id FROM ({_MORNING}))")
def _(v):
    return _points(tj.of_pairs(v.waypoints, _morning(v)))


@query("j_vehicle_scope", f"{_POINTS} vehicle_key IN (SELECT vehicle_key FROM ({_MORNING}))")
def _(v):
    return _points(tj.of_vehicles(v.waypoints, _morning(v)))


@query("j_through_bbox", f"SELECT trip_id, mode FROM trips WHERE {_ENTERS}")
def _(v):
    return v.trips.join(f.entering(v.waypoints, BOX), PAIR, "left_semi").select("trip_id", "mode")


@query("j_scenario_exclusion", f"SELECT trip_id, mode FROM trips WHERE NOT (transport_mode = 3 AND {_ENTERS})")
def _(v):
    return f.without_scenario(v.trips, v.waypoints, BOX).select("trip_id", "mode")


@query("j_missing_waypoints", "SELECT trip_id FROM trips ANTI JOIN waypoints USING (vehicle_key, trip_id)")
def _(v):
    return tj.without_waypoints(v.trips, v.waypoints).select("trip_id")


@query("j_orphan_waypoints", f"SELECT count(*) AS orphans FROM waypoints ANTI JOIN ({_MORNING}) t USING (vehicle_key, trip_id)")
def _(v):
    return tj.orphans(v.waypoints, _morning(v)).agg(F.count("*").alias("orphans"))


@query("j_shared_persons", "SELECT trip_id FROM trips WHERE source_id = 'fleet_b' AND vehicle_id IN (SELECT vehicle_id FROM trips WHERE source_id = 'fleet_a')")
def _(v):
    a, b = (v.trips.where(F.col("source_id") == s) for s in ("fleet_a", "fleet_b"))
    return b.join(a.select("vehicle_id").distinct(), "vehicle_id", "left_semi").select("trip_id")


@query("j_speed_update", "SELECT trip_id, speed_avg_kmh FROM full_trips", "speed_avg_kmh")
def _(v):
    return derive.derive_speed(v.trips, v.waypoints).select("trip_id", "speed_avg_kmh")


@query("j_dwell_update", "SELECT trip_id, dwell_minutes FROM full_trips", "dwell_minutes")
def _(v):
    return derive.derive_dwell(v.trips).select("trip_id", "dwell_minutes")


@query("j_link_mode", "SELECT link_id, t.mode, count(*) AS n FROM waypoints LEFT JOIN trips t USING (vehicle_key, trip_id) WHERE link_id IN ('L1', 'L2', 'L3') GROUP BY 1, 2")
def _(v):
    links = v.waypoints.where(F.col("link_id").isin("L1", "L2", "L3")).select("link_id").distinct()
    return spatial.link_groups(v.waypoints, v.trips, links, "mode").withColumnsRenamed({"value": "mode", "waypoints": "n"})


@query("j_sampled_pairs", f"{_POINTS} (vehicle_key, trip_id) IN (SELECT vehicle_key, trip_id FROM trips ORDER BY vehicle_key, trip_id LIMIT 100)")
def _(v):
    return _points(tj.of_pairs(v.waypoints, v.trips.orderBy(*PAIR).limit(100)))


@query("j_style_lookup", "SELECT source_id, CASE source_id WHEN 'fleet_a' THEN 'Fleet A' ELSE source_id END AS label, count(*) AS trips FROM trips GROUP BY 1")
def _(v):
    labels = F.create_map(F.lit("fleet_a"), F.lit("Fleet A"))
    return v.trips.groupBy("source_id").agg(F.count("*").alias("trips")).withColumn("label", F.coalesce(F.try_element_at(labels, F.col("source_id")), "source_id"))


# derivations


@query("derive_speed", "SELECT vehicle_key, trip_id, speed_avg_kmh FROM full_trips WHERE speed_avg_kmh IS NOT NULL", "speed_avg_kmh")
def _(v):
    return derive.derive_speed(v.trips, v.waypoints).where("speed_avg_kmh is not null").select(*PAIR, "speed_avg_kmh")


@query("derive_dwell", "SELECT vehicle_key, trip_id, dwell_minutes FROM full_trips", "dwell_minutes")
def _(v):
    return derive.derive_dwell(v.trips).select(*PAIR, "dwell_minutes")


@query("derive_detour", "SELECT vehicle_key, trip_id, detour_ratio FROM full_trips", "detour_ratio")
def _(v):
    return derive.derive_detour(v.trips).select(*PAIR, "detour_ratio")


@query("clock_of_day", "SELECT event_id, ((unix_time_ms // 1000 - 1704067200) % 86400 + 86400)::INT % 86400 AS clock, (((unix_time_ms // 1000 - 1704067200) % 86400 + 86400)::INT % 86400) // 3600 AS hour, floor((unix_time_ms // 1000 - 1704067200) / 86400e0)::INT AS day FROM pings")
def _(v):
    ms = F.col("unix_time_ms")
    return v.pings.select("event_id", clock_of_day(ms, PING_ANCHOR).alias("clock"), hour_of_day(ms, PING_ANCHOR).alias("hour"), day_index(ms, PING_ANCHOR).alias("day"))


@query("resolve_anchor", "SELECT (min(unix_time_ms) // 1000 // 86400 * 86400)::BIGINT AS epoch_anchor FROM pings")
def _(v):
    return derive.resolve_anchor(v.pings)


@query("backfill_agent_mode", "SELECT trip_id, vehicle_id::VARCHAR AS agent_id, mode FROM trips")
def _(v):
    from waymark.functions.modes import mode_label

    blank = v.trips.withColumns({"agent_id": F.lit(None).cast("string"), "mode": F.lit(None).cast("string")})
    return derive.backfill(blank, mode_label(F.col("transport_mode"))).select("trip_id", "agent_id", "mode")


@query("downsample_cap", """SELECT vehicle_key, trip_id, unix_time_ms FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq) AS rn, count(*) OVER (PARTITION BY vehicle_key, trip_id) AS n FROM waypoints)
WHERE (rn - 1) % greatest(1, ceil(n / 3e0)) = 0""")
def _(v):
    return derive.downsample_cap(v.waypoints, 3).select(*PAIR, "unix_time_ms")


@query("downsample_frac", f"SELECT vehicle_key, trip_id, unix_time_ms FROM waypoints WHERE {drawn_sql('vehicle_key', 'trip_id', 'unix_time_ms')} % 1000000 < 250000")
def _(v):
    return derive.downsample_frac(v.waypoints, 0.25).select(*PAIR, "unix_time_ms")


def _split_sql(new: str) -> str:
    return f"""SELECT *, sum(CASE WHEN {new} THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_key ORDER BY unix_time_ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS trip_id
 FROM (SELECT *, lag(unix_time_ms) OVER (PARTITION BY vehicle_key ORDER BY unix_time_ms, event_id) AS t0 FROM pings)"""


_DAY = "floor(({} // 1000 - 1704067200) / 86400e0)"
_SPLITS = {"gap": "unix_time_ms - t0 > 21600000", "day": f"{_DAY.format('unix_time_ms')} <> {_DAY.format('t0')}", "single": "false"}


def _trips_sql(new: str) -> str:
    return f"""WITH p AS ({_split_sql(new)}), s AS (SELECT *, 111.32e0 * sqrt(pow((lon - x0) * cos(radians(y0)), 2) + pow(lat - y0, 2)) AS km FROM (
 SELECT *, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, event_id)))
SELECT vehicle_key, trip_id, min(unix_time_ms) AS first_ms, max(unix_time_ms) AS last_ms, count(*) AS pings, sum(km) AS distance_km, min(source_id) AS source_id,
 arg_min(lon, unix_time_ms) AS start_lon, arg_min(lat, unix_time_ms) AS start_lat, arg_max(lon, unix_time_ms) AS end_lon, arg_max(lat, unix_time_ms) AS end_lat,
 ((min(unix_time_ms) // 1000 - 1704067200) % 86400)::INT AS starttime, (((min(unix_time_ms) // 1000 - 1704067200) % 86400) // 3600)::INT AS dep_hour, floor((min(unix_time_ms) // 1000 - 1704067200) / 86400e0)::INT AS simulation_day
FROM s GROUP BY 1, 2"""


for _how, _new in _SPLITS.items():
    _name = {"gap": "synthesize_gap_split", "day": "synthesize_day", "single": "synthesize_single"}[_how]
    query(_name, _trips_sql(_new), "distance_km start_lon start_lat end_lon end_lat")(lambda v, how=_how: derive.synthesize_trips(v.pings, how, PING_ANCHOR, 360))


@query("backfill_trip_ids", f"SELECT event_id, trip_id FROM ({_split_sql(_SPLITS['gap'])})")
def _(v):
    return derive.with_trip_ids(v.pings, "gap", PING_ANCHOR, 360).select("event_id", "trip_id")


@query("stationary_trips", """SELECT vehicle_key, trip_id, start_lon AS lon, start_lat AS lat, seq, (1601478000 + starttime)::BIGINT * 1000 + seq * CASE WHEN starttime % 86400 + 60 >= 86400 THEN 0 ELSE 60000 END AS unix_time_ms
FROM (SELECT * FROM trips ANTI JOIN waypoints USING (vehicle_key, trip_id)), (VALUES (0), (1)) s(seq)""", "lon lat")
def _(v):
    return derive.stationary_trips(v.trips, v.waypoints, v.anchor).select(*PAIR, "lon", "lat", "seq", "unix_time_ms")


@query("position_at_time", """WITH t AS (SELECT *, ((unix_time_ms // 1000 - 1601478000) % 86400)::INT AS t FROM waypoints), w AS (
 SELECT *, lead(t) OVER w AS t1, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1, first_value(t) OVER a AS ta, last_value(t) OVER a AS tz, count(*) OVER a AS n FROM t
 WINDOW w AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq), a AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT vehicle_key, trip_id, CASE WHEN t1 IS NULL THEN lon ELSE lon + (lon1 - lon) * ((43200 - t) / (t1 - t)::DOUBLE) END AS lon, CASE WHEN t1 IS NULL THEN lat ELSE lat + (lat1 - lat) * ((43200 - t) / (t1 - t)::DOUBLE) END AS lat
FROM w WHERE n >= 2 AND tz >= ta AND ta <= 43200 AND tz >= 43200 AND t <= 43200 AND (t1 IS NULL OR t1 > 43200)""", "lon lat")
def _(v):
    return derive.position_at(v.waypoints, 43200, v.anchor)


@query("assemble_trajectories", "SELECT vehicle_key, trip_id, count(*) AS points, min(((unix_time_ms // 1000 - 1601478000) % 86400)::INT) AS least_clock FROM waypoints GROUP BY 1, 2")
def _(v):
    d = tj.assemble(v.waypoints, v.anchor, True)
    return d.select(*PAIR, F.size("path").alias("points"), F.array_min("timestamps").alias("least_clock"))


@query("trajectory_detail", f"""SELECT vehicle_key, trip_id, count(*) AS segments, {_MILLIONTHS.format('max(speed_kmh)')} / 1e6 AS max_kmh,
 ((2 * sum({_MILLIONTHS.format('speed_kmh')}::HUGEINT) + count(speed_kmh)) // nullif(2 * count(speed_kmh), 0)) / 1e6 AS avg_kmh, coalesce(sum(dwell_sec) FILTER (dwell_sec > 0), 0e0) / 60 AS dwell_min,
 coalesce(max(dwell_sec) FILTER (dwell_sec > 0), 0e0) AS longest_dwell_sec, count(DISTINCT link_id) AS links, (ceil(greatest(max(speed_kmh), 10) / 10) * 10)::BIGINT AS hist_top FROM ({_ORDERED}) GROUP BY 1, 2""", "max_kmh avg_kmh dwell_min longest_dwell_sec")
def _(v):
    return tj.trajectory_detail(v.waypoints)


@query("trajectory_speed_bins", f"""WITH s AS (SELECT *, ceil(greatest(max(speed_kmh) OVER (PARTITION BY vehicle_key, trip_id), 10) / 10) * 10 / 10e0 AS width FROM ({_SEGMENTS}) WHERE speed_kmh IS NOT NULL)
SELECT vehicle_key, trip_id, least(floor(speed_kmh / width), 9)::INT AS bin, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def _(v):
    return tj.speed_bins(v.waypoints)


@query("trajectory_top_links", f"SELECT * FROM (SELECT vehicle_key, trip_id, link_id, count(*) AS n, row_number() OVER (PARTITION BY vehicle_key, trip_id ORDER BY count(*) DESC, link_id)::INT AS rank FROM ({_ORDERED}) GROUP BY 1, 2, 3) WHERE rank <= 5")
def _(v):
    return tj.top_links(v.waypoints)


@query("compact_trails", """WITH w AS (SELECT vehicle_key, trip_id, unix_time_ms, seq, lon, lat, ((unix_time_ms // 1000 - 1601478000) % 86400)::INT AS t, min(lon) OVER () AS cx, min(lat) OVER () AS cy FROM waypoints),
l AS (SELECT *, lag(lon) OVER p AS x0, lag(lat) OVER p AS y0, lag(t) OVER p AS t0 FROM w WINDOW p AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq)),
n AS (SELECT *, coalesce(floor(greatest(abs(lon - x0), abs(lat - y0)) / (32000 * 1e-5)), 0)::INT AS n FROM l), k AS (SELECT *, unnest(range(1, n + 2)) AS k FROM n),
f AS (SELECT *, CASE WHEN x0 IS NULL THEN 1e0 ELSE k / (n + 1)::DOUBLE END AS f FROM k),
q AS (SELECT vehicle_key, trip_id, unix_time_ms, seq, k, CASE WHEN f = 1 THEN t ELSE round(t0 + (t - t0) * f) END::BIGINT AS t,
 round((CASE WHEN f = 1 THEN lon ELSE x0 + (lon - x0) * f END - cx) / 1e-5)::BIGINT AS qx, round((CASE WHEN f = 1 THEN lat ELSE y0 + (lat - y0) * f END - cy) / 1e-5)::BIGINT AS qy FROM f)
SELECT vehicle_key, trip_id, row_number() OVER p AS point, qx - coalesce(lag(qx) OVER p, 0) AS dx, qy - coalesce(lag(qy) OVER p, 0) AS dy,
 (CASE WHEN lag(t) OVER p IS NULL THEN t ELSE greatest(0, least(65535, t - lag(t) OVER p)) END)::BIGINT AS dt FROM q WINDOW p AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq, k)""")
def _(v):
    return tj.compact_trails(v.waypoints, v.anchor)


# windows


@query("w_lag_gap", "SELECT event_id, unix_time_ms - lag(unix_time_ms) OVER (PARTITION BY vehicle_key ORDER BY unix_time_ms, event_id) AS gap_ms FROM pings")
def _(v):
    w = Window.partitionBy("vehicle_key").orderBy("unix_time_ms", "event_id")
    return v.pings.select("event_id", (F.col("unix_time_ms") - F.lag("unix_time_ms").over(w)).alias("gap_ms"))


@query("w_running_ordinal", f"SELECT vehicle_key, max(trip_id) AS trips FROM ({_split_sql(_SPLITS['gap'])}) GROUP BY 1")
def _(v):
    return derive.with_trip_ids(v.pings, "gap", PING_ANCHOR, 360).groupBy("vehicle_key").agg(F.max("trip_id").alias("trips"))


@query("w_lag_segment", "SELECT trip_id, seq, lag(lon) OVER w AS prev_lon, lag(lat) OVER w AS prev_lat FROM waypoints WINDOW w AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq)", "prev_lon prev_lat")
def _(v):
    w = Window.partitionBy(*PAIR).orderBy("unix_time_ms", "seq")
    return v.waypoints.select("trip_id", "seq", F.lag("lon").over(w).alias("prev_lon"), F.lag("lat").over(w).alias("prev_lat"))


@query("w_lead_dwell", "SELECT trip_id, lead(starttime) OVER (PARTITION BY vehicle_key, simulation_day ORDER BY starttime, trip_id) AS next_start FROM trips")
def _(v):
    w = Window.partitionBy("vehicle_key", "simulation_day").orderBy("starttime", "trip_id")
    return v.trips.select("trip_id", F.lead("starttime").over(w).alias("next_start"))


@query("w_first_last", """SELECT DISTINCT vehicle_key, first_value(trip_id) OVER w AS first_trip, last_value(trip_id) OVER w AS last_trip FROM trips
WINDOW w AS (PARTITION BY vehicle_key ORDER BY starttime, simulation_day, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(v):
    by = F.struct("starttime", "simulation_day", "trip_id")
    return v.trips.groupBy("vehicle_key").agg(F.min_by("trip_id", by).alias("first_trip"), F.max_by("trip_id", by).alias("last_trip"))


@query("w_count_partition", "SELECT trip_id, count(*) OVER (PARTITION BY vehicle_key) AS chain FROM trips")
def _(v):
    return v.trips.select("trip_id", F.count("*").over(Window.partitionBy("vehicle_key")).alias("chain"))


@query("w_row_number_topk", "SELECT * FROM (SELECT dep_hour, trip_id, row_number() OVER (PARTITION BY dep_hour ORDER BY distance_km DESC NULLS LAST, trip_id) AS rn FROM trips) WHERE rn <= 3")
def _(v):
    rn = F.row_number().over(Window.partitionBy("dep_hour").orderBy(F.col("distance_km").desc_nulls_last(), "trip_id"))
    return v.trips.select("dep_hour", "trip_id", rn.alias("rn")).where("rn <= 3")


@query("w_row_number_seq", "SELECT trip_id, row_number() OVER (PARTITION BY vehicle_key ORDER BY starttime, simulation_day, trip_id) AS seq FROM trips")
def _(v):
    return v.trips.select("trip_id", F.row_number().over(Window.partitionBy("vehicle_key").orderBy("starttime", "simulation_day", "trip_id")).alias("seq"))


@query("w_global_sum", "SELECT dep_hour, n, 1e2 * n / sum(n) OVER () AS pct FROM (SELECT dep_hour, count(*) AS n FROM trips GROUP BY 1)", "pct")
def _(v):
    d = v.trips.groupBy("dep_hour").agg(F.count("*").alias("n"))
    return d.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("w_row_number_global", "SELECT source_key, name, row_number() OVER (PARTITION BY source_key ORDER BY name, lon, lat) AS id FROM pois")
def _(v):
    return v.pois.select("source_key", "name", F.row_number().over(Window.partitionBy("source_key").orderBy("name", "lon", "lat")).alias("id"))


# retrieval


@query("limit_trips", "SELECT vehicle_key, trip_id, starttime FROM trips ORDER BY vehicle_key, trip_id LIMIT 500")
def _(v):
    return v.trips.orderBy(*PAIR).limit(500).select(*PAIR, "starttime")


@query("limit_truncated", "SELECT * FROM (SELECT poi_id, (SELECT count(*) > 20 FROM pois) AS truncated FROM pois ORDER BY source_key, poi_id LIMIT 20)")
def _(v):
    from waymark.operators.zones import list_pois

    return list_pois(v.pois, F.lit(True), 20).select("poi_id", "truncated")


@query("topk_trips", "SELECT trip_id, distance_km FROM trips ORDER BY distance_km DESC NULLS LAST, trip_id LIMIT 100", "distance_km")
def _(v):
    return v.trips.orderBy(F.col("distance_km").desc_nulls_last(), "trip_id").limit(100).select("trip_id", "distance_km")


_DRAWN = drawn_sql("0", "vehicle_key", "trip_id")


@query("sample_trips", f"SELECT vehicle_key, trip_id FROM trips WHERE source_id = 'fleet_a' ORDER BY {_DRAWN}, 1, 2 LIMIT 200")
def _(v):
    return tj.sample_trips(TripFilter(source_id="fleet_a").apply(v.trips), 200).select(*PAIR)


@query("sample_trajectories", f"SELECT vehicle_key, trip_id, unix_time_ms, lon, lat FROM waypoints SEMI JOIN (SELECT vehicle_key, trip_id FROM trips ORDER BY {_DRAWN}, 1, 2 LIMIT 200) s USING (vehicle_key, trip_id)", "lon lat")
def _(v):
    return tj.of_pairs(v.waypoints, tj.sample_pairs(v.trips, 200)).select(*PAIR, "unix_time_ms", "lon", "lat")


@query("sample_random_compat", f"SELECT vehicle_key, trip_id, unix_time_ms FROM waypoints SEMI JOIN (SELECT vehicle_key, trip_id FROM trips ORDER BY {drawn_sql('0', 'vehicle_key')}, 1, 2 LIMIT 200) s USING (vehicle_key, trip_id)")
def _(v):
    return tj.of_pairs(v.waypoints, tj.sample_pairs(v.trips, 200, key=("vehicle_key",))).select(*PAIR, "unix_time_ms")


@query("trajectories_bbox", f"SELECT vehicle_key, trip_id, unix_time_ms FROM waypoints SEMI JOIN (SELECT DISTINCT vehicle_key, trip_id FROM waypoints WHERE {IN_BOX} ORDER BY 1, 2 LIMIT 500) b USING (vehicle_key, trip_id)")
def _(v):
    return tj.trajectories_bbox(v.waypoints, BOX).select(*PAIR, "unix_time_ms")


@query("trajectories_point", "SELECT vehicle_key, trip_id, unix_time_ms FROM waypoints SEMI JOIN (SELECT DISTINCT vehicle_key, trip_id FROM waypoints WHERE lon BETWEEN 140e0 - 2e0 / 80 AND 140e0 + 2e0 / 80 AND lat BETWEEN 35.7e0 - 2e0 / 80 AND 35.7e0 + 2e0 / 80 ORDER BY 1, 2 LIMIT 500) b USING (vehicle_key, trip_id)")
def _(v):
    return tj.trajectories_point(v.waypoints, 140.0, 35.7, 2.0).select(*PAIR, "unix_time_ms")


@query("trajectories_by_vehicle", "SELECT vehicle_key, trip_id, unix_time_ms FROM waypoints WHERE vehicle_key IN ('fleet_a:1', 'fleet_b:7', 'fleet_b:10')")
def _(v):
    return tj.trajectories_by_vehicle(v.waypoints, f.vehicle_list(["fleet_a:1", "fleet_b:7", "fleet_b:10"])).select(*PAIR, "unix_time_ms")


@query("dedup_pairs", f"SELECT DISTINCT vehicle_key, trip_id FROM waypoints WHERE {IN_BOX}")
def _(v):
    return f.entering(v.waypoints, BOX)


# scalar functions


@query("geo_distances", """SELECT trip_id, 111.32e0 * sqrt(pow((end_lon - start_lon) * cos(radians(start_lat)), 2) + pow(end_lat - start_lat, 2)) AS equirect_km,
 111.32e0 * sqrt(pow((end_lon - start_lon) * cos(radians((start_lat + end_lat) / 2)), 2) + pow(end_lat - start_lat, 2)) AS equirect_mean_km,
 2 * 6371e0 * asin(sqrt(pow(sin(radians(end_lat - start_lat) / 2), 2) + cos(radians(start_lat)) * cos(radians(end_lat)) * pow(sin(radians(end_lon - start_lon) / 2), 2))) AS haversine_km,
 2 * 6371e0 * asin(sqrt(pow(sin(radians(end_lat - start_lat) / 2), 2) + cos(radians(start_lat)) * cos(radians(end_lat)) * pow(sin(radians(end_lon - start_lon) / 2), 2))) * 1000 AS haversine_m FROM trips""", "equirect_km equirect_mean_km haversine_km haversine_m")
def _(v):
    p = [F.col(c) for c in ("start_lon", "start_lat", "end_lon", "end_lat")]
    return v.trips.select("trip_id", equirect_km(*p).alias("equirect_km"), equirect_mean_km(*p).alias("equirect_mean_km"), haversine_km(*p).alias("haversine_km"), haversine_m(*p).alias("haversine_m"))


@query("grid_functions", "SELECT trip_id, round(start_lon / 0.005e0) * 0.005e0 AS g_round, round(start_lon * 20) / 20 AS g_20, round(start_lon * 100) / 100 AS g_100, floor(start_lon / 0.005e0)::BIGINT AS ix, (floor(start_lon / 0.005e0) + 0.5e0) * 0.005e0 AS centre FROM trips", "g_round g_20 g_100 centre")
def _(v):
    x = F.col("start_lon")
    return v.trips.select("trip_id", grid.grid_round(x, 0.005).alias("g_round"), grid.grid_per_degree(x, 20).alias("g_20"), grid.grid_per_degree(x, 100).alias("g_100"), grid.cell_floor(x, 0.005).alias("ix"), grid.cell_centre(grid.cell_floor(x, 0.005), 0.005).alias("centre"))
