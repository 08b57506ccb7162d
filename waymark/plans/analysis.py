"""Analyses: summaries, distributions, flows, chains, comparison, mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.functions.classes import poi_class, speed_class
from waymark.functions.draw import drawn_sql
from waymark.operators import chains, compare, density, mining, profile, spatial, stats, temporal, zones
from waymark.operators.cover import count_in_cover, cover
from waymark.operators.derive import with_trip_ids
from waymark.operators.filters import PAIR, TripFilter, entering, vehicle_prefix
from waymark.plans.registry import query
from waymark.plans.views import Views

BOX = (139.9, 35.6, 140.1, 35.8)
IN_BOX = "lon BETWEEN 139.9e0 AND 140.1e0 AND lat BETWEEN 35.6e0 AND 35.8e0"
FLEETS = ["fleet_a", "fleet_b"]


def both(v: Views) -> DataFrame:
    return compare.sides(v.trips, F.col("source_id") == "fleet_a", F.col("source_id") == "fleet_b")


def _mean(c: str) -> str:
    """SQL for the mean of billionths, rounded half up to six digits, in whole numbers."""
    return f"((2 * sum(round({c} * 1e9)::HUGEINT) + 1000 * count({c})) // (2000 * count({c}))) / 1e6"


@query("table_stats", """
SELECT t.*, coalesce(w.waypoints, 0) AS waypoints FROM (
  SELECT source_id, count(*) AS trips, min(start_lon) AS min_lon, max(start_lon) AS max_lon, min(start_lat) AS min_lat, max(start_lat) AS max_lat, min(starttime) AS first_start, max(starttime) AS last_start FROM trips GROUP BY source_id
) t LEFT JOIN (SELECT source_id, count(*) AS waypoints FROM waypoints GROUP BY source_id) w USING (source_id)""", "min_lon max_lon min_lat max_lat")
def _(v):
    return stats.table_stats(v.trips, v.waypoints)


@query("insights_core", "SELECT count(*) AS trips, count(DISTINCT vehicle_key) AS vehicles, avg(distance_km) AS avg_km, median(distance_km) AS median_km, max(distance_km) AS max_km, stddev_samp(distance_km) AS std_km, avg(distance_km) * count(*) AS total_vkt_km FROM trips", "avg_km median_km max_km std_km total_vkt_km")
def _(v):
    return stats.insights_core(v.trips)


@query("insights_fleet", "SELECT avg(n) AS avg_trips, min(n) AS min_trips, max(n) AS max_trips FROM (SELECT count(*) AS n FROM trips GROUP BY vehicle_key)", "avg_trips")
def _(v):
    return stats.insights_fleet(v.trips)


@query("insights_peak", "SELECT dep_hour, trips, 1e2 * trips / sum(trips) OVER () AS pct FROM (SELECT dep_hour, count(*) AS trips FROM trips GROUP BY dep_hour) ORDER BY trips DESC, dep_hour NULLS LAST LIMIT 1", "pct")
def _(v):
    return stats.insights_peak(v.trips)


@query("insights_offpeak", "SELECT dep_hour, trips, (max(trips) OVER ()) / trips::DOUBLE AS ratio FROM (SELECT dep_hour, count(*) AS trips FROM trips GROUP BY dep_hour) ORDER BY trips, dep_hour NULLS LAST LIMIT 1", "ratio")
def _(v):
    return stats.insights_offpeak(v.trips)


@query("insights_fare", "SELECT avg(fare_yen) AS avg_fare, median(fare_yen) AS median_fare, max(fare_yen) AS max_fare, avg(fare_yen) FILTER (is_night_trip) AS night_fare, avg(fare_yen) FILTER (NOT is_night_trip) AS day_fare, 1e2 * count(*) FILTER (is_night_trip) / count(*) AS night_pct FROM trips WHERE fare_yen IS NOT NULL", "avg_fare median_fare max_fare night_fare day_fare night_pct")
def _(v):
    return stats.insights_fare(v.trips)


@query("insights_modes", "SELECT transport_mode, count(*) AS trips FROM trips GROUP BY transport_mode")
def _(v):
    return stats.insights_modes(v.trips)


@query("insights_distance_buckets", "SELECT floor(distance_km / 2) * 2e0 AS bucket_km, count(*) AS trips FROM trips WHERE distance_km IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 25", "bucket_km")
def _(v):
    return stats.distance_buckets(v.trips)


@query("scenario_impact", f"SELECT count(*) AS removed_trips, coalesce(sum(distance_km), 0e0) AS removed_vkt_km FROM trips WHERE transport_mode = 3 AND (vehicle_key, trip_id) IN (SELECT vehicle_key, trip_id FROM waypoints WHERE {IN_BOX})", "removed_vkt_km")
def _(v):
    return stats.scenario_impact(v.trips, entering(v.waypoints, BOX))


@query("options_sources", "SELECT DISTINCT 'source' AS kind, source_id AS value FROM trips UNION SELECT DISTINCT 'day', simulation_day::VARCHAR FROM trips UNION SELECT DISTINCT 'goods', goods_type FROM trips WHERE goods_type IS NOT NULL")
def _(v):
    return stats.options_sources(v.trips)


@query("options_city_centers", f"SELECT city, {_mean('start_lon')} AS lon, {_mean('start_lat')} AS lat FROM trips WHERE city IS NOT NULL GROUP BY city", "lon lat")
def _(v):
    return stats.city_centers(v.trips)


@query("options_modes", "SELECT mode, min(transport_mode) AS code, count(*) AS trips FROM trips WHERE mode IS NOT NULL GROUP BY mode")
def _(v):
    return stats.options_modes(v.trips)


@query("options_metric_availability", "SELECT source_id, count(speed_avg_kmh) > 0 AS has_speed, count(dwell_minutes) > 0 AS has_dwell, count(detour_ratio) > 0 AS has_detour FROM full_trips GROUP BY source_id")
def _(v):
    return stats.metric_availability(v.full_trips)


_CAPS = """SELECT count(*) AS trips, count(DISTINCT vehicle_key) AS agents, count(goods_type) > 0 AS has_goods_type, count(origin_zone) > 0 AS has_origin_zone, count(dest_zone) > 0 AS has_dest_zone,
 count(fare_yen) > 0 AS has_fare_yen, count(distance_km) > 0 AS has_distance_km, count(leg_id) > 0 AS has_legs, count(mode) > 0 AS has_modes, (SELECT count(*) FROM waypoints) AS waypoints FROM trips"""


@query("options_capabilities", _CAPS)
def _(v):
    return stats.capabilities(v.trips, v.waypoints)


@query("detect_scale", f"SELECT *, CASE WHEN agents >= 1000000 OR waypoints >= 10000000 THEN 'macro' WHEN agents < 10000 AND waypoints < 1000000 THEN 'micro' ELSE 'meso' END AS scale FROM ({_CAPS})")
def _(v):
    return stats.detect_scale(stats.capabilities(v.trips, v.waypoints))


@query("options_source_styles", "SELECT DISTINCT source_id, source_id IN (SELECT source_id FROM waypoints) AS has_waypoints FROM trips")
def _(v):
    return stats.source_styles(v.trips, v.waypoints)


@query("departures", """SELECT h::INT AS hour, count(*) FILTER (source_id = 'fleet_a') AS fleet_a, count(*) FILTER (source_id = 'fleet_b') AS fleet_b, count(trip_id) AS total
FROM range(24) r(h) LEFT JOIN trips ON dep_hour = h GROUP BY h""")
def _(v):
    return temporal.departures(v.trips, FLEETS)


@query("peaks", "WITH h AS (SELECT dep_hour, count(*) AS trips FROM trips GROUP BY dep_hour), l AS (SELECT avg(trips) + 0.5e0 * stddev_pop(trips) AS level FROM h) SELECT dep_hour, trips, level FROM h, l WHERE trips > level", "level")
def _(v):
    return temporal.peaks(v.trips)


@query("distance_hist", "SELECT floor(distance_km / 10) * 1e1 AS bin_km, source_id, count(*) AS trips FROM trips WHERE distance_km IS NOT NULL GROUP BY 1, 2", "bin_km")
def _(v):
    return temporal.distance_hist(v.trips)


@query("metric_hist", """WITH s AS (SELECT min(detour_ratio) AS lo, max(detour_ratio) AS hi FROM full_trips), b AS (
 SELECT least(floor((detour_ratio - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM full_trips, s WHERE detour_ratio IS NOT NULL GROUP BY 1)
SELECT g::INT AS bin, lo + g * ((hi - lo) / 20) AS bin_lo, lo + (g + 1) * ((hi - lo) / 20) AS bin_hi, coalesce(n, 0) AS n FROM s, range(20) r(g) LEFT JOIN b ON b.bin = g WHERE hi > lo""", "bin_lo bin_hi")
def _(v):
    return temporal.metric_hist(v.full_trips, "detour_ratio")


@query("od_flows", f"""SELECT round(start_lon * 20) / 20 AS o_lon, round(start_lat * 20) / 20 AS o_lat, round(end_lon * 20) / 20 AS d_lon, round(end_lat * 20) / 20 AS d_lat, count(*) AS volume, {_mean("distance_km")} AS avg_distance_km
FROM trips GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5 ORDER BY volume DESC, 1, 2, 3, 4 LIMIT 50""", "o_lon o_lat d_lon d_lat avg_distance_km")
def _(v):
    return spatial.od_flows(v.trips)


@query("od_flows_zone", f"SELECT origin_zone, dest_zone, count(*) AS volume, {_mean('start_lon')} AS avg_start_lon, {_mean('start_lat')} AS avg_start_lat, {_mean('end_lon')} AS avg_end_lon, {_mean('end_lat')} AS avg_end_lat FROM trips WHERE source_id = 'fleet_a' GROUP BY 1, 2 ORDER BY volume DESC, 1, 2 LIMIT 50", "avg_start_lon avg_start_lat avg_end_lon avg_end_lat")
def _(v):
    return spatial.od_flows_zone(TripFilter(source_id="fleet_a").apply(v.trips))


def _grid(source: str, r: str, limit: int = 5000) -> str:
    return f"SELECT round(lon / {r}) * {r} AS lon, round(lat / {r}) * {r} AS lat, count(*) AS weight FROM ({source}) GROUP BY 1, 2 ORDER BY weight DESC, 1, 2 LIMIT {limit}"


_STARTS, _ENDS = "SELECT start_lon AS lon, start_lat AS lat FROM trips", "SELECT end_lon AS lon, end_lat AS lat FROM trips"


@query("density_grid", _grid(f"{_STARTS} UNION ALL {_ENDS}", "0.01e0"), "lon lat")
def _(v):
    return spatial.density_grid(v.trips, point_type="both")


@query("density_grid_origin", _grid(_STARTS, "0.01e0"), "lon lat")
def _(v):
    return spatial.density_grid(v.trips, point_type="origin")


@query("density_grid_destination", _grid(_ENDS, "0.01e0"), "lon lat")
def _(v):
    return spatial.density_grid(v.trips, point_type="destination")


@query("waypoint_density", _grid("SELECT lon, lat FROM waypoints SEMI JOIN (SELECT * FROM trips WHERE dep_hour BETWEEN 7 AND 9) t USING (vehicle_key, trip_id)", "0.005e0"), "lon lat")
def _(v):
    return spatial.waypoint_density(v.waypoints, TripFilter(hour_min=7, hour_max=9).apply(v.trips))


@query("footfall", _grid("SELECT lon, lat FROM waypoints SEMI JOIN (SELECT * FROM trips WHERE transport_mode = 0) t USING (vehicle_key, trip_id)", "0.002e0"), "lon lat")
def _(v):
    return spatial.footfall(v.trips, v.waypoints)


_LINKS = "SELECT link_id, count(*) AS waypoints, count(DISTINCT vehicle_key) AS vehicles, avg(lon) AS lon, avg(lat) AS lat FROM waypoints GROUP BY link_id HAVING count(*) >= 50 ORDER BY waypoints DESC, link_id LIMIT"


@query("link_density", f"{_LINKS} 500", "lon lat")
def _(v):
    return spatial.link_density(v.waypoints, parts=v.waypoint_parts)


@query("link_total", "SELECT count(DISTINCT link_id) AS links FROM waypoints")
def _(v):
    return spatial.link_total(v.waypoints)


@query("link_groups", f"SELECT link_id, mode AS value, count(*) AS waypoints FROM waypoints JOIN ({_LINKS} 20) l USING (link_id) LEFT JOIN trips USING (vehicle_key, trip_id) GROUP BY 1, 2".replace("mode AS value, count(*)", "trips.mode AS value, count(*)"))
def _(v):
    return spatial.link_groups(v.waypoints, v.trips, spatial.link_density(v.waypoints, 20, parts=v.waypoint_parts), "mode")


_SEGS = "SELECT vehicle_key, trip_id, link_id, unix_time_ms, seq, lon, lat, lag(lon) OVER w AS prev_lon, lag(lat) OVER w AS prev_lat FROM waypoints WINDOW w AS (PARTITION BY vehicle_key, trip_id ORDER BY unix_time_ms, seq)"


@query("link_paths", f"""WITH s AS (SELECT * FROM ({_SEGS}) WHERE prev_lon IS NOT NULL AND link_id IN (SELECT link_id FROM ({_LINKS} 20))), b AS (
 SELECT link_id, vehicle_key, trip_id, row_number() OVER (PARTITION BY link_id ORDER BY count(*) DESC, vehicle_key, trip_id) AS rn FROM s GROUP BY 1, 2, 3)
SELECT link_id, vehicle_key, trip_id, count(*) + 1 AS points FROM s JOIN b USING (link_id, vehicle_key, trip_id) WHERE rn = 1 GROUP BY 1, 2, 3""")
def _(v):
    return spatial.link_paths(v.waypoints, spatial.link_density(v.waypoints, 20, parts=v.waypoint_parts)).drop("path")


@query("j_best_trip_per_link", f"""WITH s AS (SELECT * FROM ({_SEGS}) WHERE prev_lon IS NOT NULL), b AS (
 SELECT link_id, vehicle_key, trip_id, row_number() OVER (PARTITION BY link_id ORDER BY count(*) DESC, vehicle_key, trip_id) AS rn FROM s GROUP BY 1, 2, 3)
SELECT s.link_id, s.vehicle_key, s.trip_id, unix_time_ms, prev_lon, prev_lat, lon, lat FROM s JOIN b USING (link_id, vehicle_key, trip_id) WHERE rn = 1""", "prev_lon prev_lat lon lat")
def _(v):
    s = spatial.link_segments(v.waypoints)
    return s.join(spatial.best_trip_per_link(s), ["link_id", *PAIR]).drop("seq")


@query("hotspots", "SELECT *, row_number() OVER (ORDER BY volume DESC, lon, lat) AS rank FROM (SELECT round(start_lon * 100) / 100 AS lon, round(start_lat * 100) / 100 AS lat, count(*) AS volume, count(DISTINCT vehicle_key) AS vehicles FROM trips GROUP BY 1, 2 ORDER BY volume DESC, 1, 2 LIMIT 20)", "lon lat")
def _(v):
    return spatial.hotspots(v.trips)


_HOUR = "(((unix_time_ms // 1000 - 1601478000) % 86400) // 3600)::INT"
_CELLS = f"""SELECT source_id, city, {_HOUR} AS hour, round(lon / 0.005e0) * 0.005e0 AS grid_lon, round(lat / 0.005e0) * 0.005e0 AS grid_lat, count(*) AS weight, 0.005e0 AS resolution
FROM waypoints LEFT JOIN (SELECT DISTINCT vehicle_key, city FROM trips WHERE city IS NOT NULL) c USING (vehicle_key) GROUP BY 1, 2, 3, 4, 5"""


@query("build_density_hourly", _CELLS, "grid_lon grid_lat resolution")
def _(v):
    return spatial.build_density_hourly(v.waypoints, v.trips, v.anchor)


@query("j_city_dim", "SELECT c.city, count(*) AS waypoints FROM waypoints LEFT JOIN (SELECT DISTINCT vehicle_key, city FROM trips) c USING (vehicle_key) GROUP BY 1")
def _(v):
    return v.waypoints.join(v.trips.select("vehicle_key", "city").distinct(), "vehicle_key", "left").groupBy("city").agg(F.count(F.lit(1)).alias("waypoints"))


_PULSE = f"SELECT *, max(weight) OVER () AS max_weight FROM (SELECT hour, grid_lon, grid_lat, sum(weight)::BIGINT AS weight FROM ({_CELLS}) GROUP BY 1, 2, 3)"


@query("density_hourly", f"SELECT hour, grid_lon, grid_lat, weight, max_weight, n > 300 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY weight DESC, grid_lon, grid_lat) AS rn, count(*) OVER (PARTITION BY hour) AS n FROM ({_PULSE})) WHERE rn <= 300", "grid_lon grid_lat")
def _(v):
    return spatial.density_hourly(spatial.build_density_hourly(v.waypoints, v.trips, v.anchor), max_cells_per_hour=300)


@query("compact_pulse", f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY weight DESC, grid_lon, grid_lat) AS rn FROM ({_PULSE})) WHERE rn <= 200)
SELECT hour, round((grid_lon - min(grid_lon) OVER ()) / 0.005e0)::BIGINT AS ix, round((grid_lat - min(grid_lat) OVER ()) / 0.005e0)::BIGINT AS iy, greatest(1, round(weight / (max(weight) OVER ())::DOUBLE * 65535))::BIGINT AS w FROM t""")
def _(v):
    return spatial.compact_pulse(spatial.build_density_hourly(v.waypoints, v.trips, v.anchor), per_hour=200)


@query("chain_lengths", "SELECT n AS length, count(*) AS vehicles FROM (SELECT count(*) AS n FROM trips GROUP BY vehicle_key) GROUP BY n")
def _(v):
    return chains.chain_lengths(v.trips)


@query("dwell_bins", """SELECT CASE WHEN gap < 600 THEN '0-10min' WHEN gap < 1800 THEN '10-30min' WHEN gap < 3600 THEN '30-60min' WHEN gap < 7200 THEN '1-2hr' WHEN gap < 14400 THEN '2-4hr' ELSE '4hr+' END AS dwell_bin, count(*) AS n
FROM (SELECT lead(starttime) OVER (PARTITION BY vehicle_key ORDER BY starttime, simulation_day, trip_id) - starttime AS gap FROM trips) WHERE gap IS NOT NULL GROUP BY 1""")
def _(v):
    return chains.dwell_bins(v.trips)


@query("round_trips", """WITH f AS (SELECT vehicle_key, count(*) OVER w AS n, first_value(start_lon) OVER w AS x0, first_value(start_lat) OVER w AS y0, last_value(end_lon) OVER w AS x1, last_value(end_lat) OVER w AS y1, row_number() OVER (PARTITION BY vehicle_key ORDER BY starttime, simulation_day, trip_id) AS rn
 FROM trips WINDOW w AS (PARTITION BY vehicle_key ORDER BY starttime, simulation_day, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT n, 111.32e0 * sqrt(pow((x1 - x0) * cos(radians(y0)), 2) + pow(y1 - y0, 2)) <= 2 AS back FROM f WHERE rn = 1 AND n >= 2)
SELECT count(*) FILTER (back) AS round_trip, count(*) FILTER (NOT back) AS open, avg(n) FILTER (back) AS avg_trips_round, avg(n) FILTER (NOT back) AS avg_trips_open FROM g""", "avg_trips_round avg_trips_open")
def _(v):
    return chains.round_trips(v.trips)


@query("commodity_sequences", "SELECT sequence, count(*) AS vehicles FROM (SELECT string_agg(goods_type, ' → ' ORDER BY starttime, simulation_day, trip_id) AS sequence FROM trips WHERE source_id = 'fleet_a' GROUP BY vehicle_key) GROUP BY 1 ORDER BY vehicles DESC, sequence LIMIT 20")
def _(v):
    return chains.commodity_sequences(TripFilter(source_id="fleet_a").apply(v.trips))


_STOPS = """SELECT vehicle_key, stops, row_number() OVER (PARTITION BY vehicle_key ORDER BY starttime, simulation_day, trip_id) AS seq, trip_id, starttime, start_lon, start_lat, end_lon, end_lat, distance_km, goods_type
FROM trips JOIN (SELECT vehicle_key, count(*) AS stops FROM trips GROUP BY 1 HAVING count(*) >= 3 ORDER BY stops DESC, vehicle_key LIMIT 100) t USING (vehicle_key)"""


@query("multi_stop", _STOPS, "start_lon start_lat end_lon end_lat distance_km")
def _(v):
    return chains.multi_stop(v.trips)


@query("j_topk_vehicles", f"SELECT vehicle_key, stops, trip_id FROM ({_STOPS})")
def _(v):
    return chains.multi_stop(v.trips).select("vehicle_key", "stops", "trip_id")


@query("vehicle_search", "SELECT vehicle_key, count(*) AS trips, min(starttime) AS first_start, max(starttime) AS last_start, sum(distance_km) AS total_km FROM trips WHERE starts_with(vehicle_key, 'fleet_a:1') GROUP BY 1 ORDER BY trips DESC, 1 LIMIT 50", "total_km")
def _(v):
    return stats.vehicle_search(v.trips, vehicle_prefix("fleet_a:1"))


@query("poi_categories", "SELECT source_key, category, count(*) AS pois FROM pois GROUP BY 1, 2")
def _(v):
    return stats.poi_categories(v.pois)


@query("attr_legend", """WITH n AS (SELECT link_id AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, link_id) AS rank FROM waypoints GROUP BY 1)
SELECT rank, value, n FROM n WHERE rank <= 12 UNION ALL SELECT 13, '+' || count(*) || ' more', sum(n)::BIGINT FROM n WHERE rank > 12 HAVING count(*) > 0""")
def _(v):
    return stats.attr_legend(v.waypoints, "link_id")


@query("bbox_union", "SELECT min(least(start_lon, end_lon)) AS west, min(south) AS south, max(greatest(start_lon, end_lon)) AS east, max(north) AS north FROM (SELECT *, start_lat AS south, end_lat AS north FROM trips) WHERE south <= north", "west south east north")
def _(v):
    return stats.bbox_union(v.trips.select(F.least("start_lon", "end_lon").alias("west"), F.col("start_lat").alias("south"), F.greatest("start_lon", "end_lon").alias("east"), F.col("end_lat").alias("north")))


@query("uncovered_sources", "SELECT DISTINCT source_id FROM trips WHERE source_id NOT IN (SELECT source_id FROM trips WHERE source_id = 'fleet_a')")
def _(v):
    return stats.uncovered_sources(v.trips, v.trips.where("source_id = 'fleet_a'").select("source_id").distinct())


@query("except_uncovered", "SELECT source_id FROM trips EXCEPT SELECT source_id FROM trips WHERE dep_hour < 0")
def _(v):
    return v.trips.select("source_id").subtract(v.trips.where("dep_hour < 0").select("source_id"))


@query("table_parity", """WITH b AS (SELECT * FROM trips WHERE trip_id % 10 <> 0)
SELECT source_id, count(*) AS rows_a, count(*) FILTER (trip_id % 10 <> 0) AS rows_b, count(*) FILTER (trip_id % 10 = 0) AS only_a, 0 AS only_b FROM trips GROUP BY 1""")
def _(v):
    a = v.trips.select("source_id", "vehicle_key", "trip_id", "distance_km")
    return stats.table_parity(a, a.where("trip_id % 10 <> 0"), "source_id")


# comparison


@query("fleet_summary", "SELECT source_id, count(*) AS trips, count(DISTINCT vehicle_id) AS vehicles, sum(distance_km) AS total_km, avg(distance_km) AS avg_km, median(distance_km) AS median_km, max(distance_km) AS max_km, min(starttime) AS first_start, max(starttime) AS last_start FROM trips GROUP BY 1", "total_km avg_km median_km max_km")
def _(v):
    return compare.fleet_summary(v.trips, "source_id")


_SHARES = """WITH c AS (SELECT mode, count(*) FILTER (source_id = 'fleet_a') AS trips_a, count(*) FILTER (source_id = 'fleet_b') AS trips_b FROM trips GROUP BY 1),
t AS (SELECT *, sum(trips_a) OVER ()::DOUBLE AS na, sum(trips_b) OVER ()::DOUBLE AS nb FROM c), p AS (SELECT *, (trips_a + trips_b) / (na + nb) AS pool FROM t)
SELECT mode, trips_a, trips_b, 1e2 * trips_a / na AS pct_a, 1e2 * trips_b / nb AS pct_b, 1e2 * trips_b / nb - 1e2 * trips_a / na AS delta_pp,
 CASE WHEN pool * (1 - pool) > 0 THEN (trips_b / nb - trips_a / na) / sqrt(pool * (1 - pool) * (1 / na + 1 / nb)) ELSE 0e0 END AS z FROM p"""


@query("mode_shares", _SHARES, "pct_a pct_b delta_pp z")
def _(v):
    return compare.mode_shares(both(v))


@query("two_proportion_z", f"SELECT mode, z FROM ({_SHARES})", "z")
def _(v):
    return compare.mode_shares(both(v)).select("mode", "z")


#: The normal tails by Simpson's rule over 1,000 steps from 0 to abs(z).
_P_VALUES = f"""SELECT *, CASE WHEN z IS NOT NULL THEN round(1 - sqrt(2 / pi()) * abs(z) / 3000 * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs(z) * i / 1000, 2) / 2))), 4) END AS p_value FROM ({_SHARES})"""


@query("mode_share_p_values", _P_VALUES, "pct_a pct_b delta_pp z p_value")
def _(v):
    return compare.with_p_values(compare.mode_shares(both(v)))


@query("union_modes", "SELECT mode FROM trips WHERE source_id = 'fleet_a' UNION SELECT mode FROM trips WHERE source_id = 'fleet_b'")
def _(v):
    return compare.mode_shares(both(v)).select("mode")


_HOURLY = "SELECT h::INT AS hour, count(*) FILTER (source_id = 'fleet_a') AS trips_a, count(*) FILTER (source_id = 'fleet_b') AS trips_b FROM range(24) r(h) LEFT JOIN trips ON dep_hour = h GROUP BY h"


@query("compare_hourly", _HOURLY)
def _(v):
    return compare.compare_hourly(both(v))


_DIST = """WITH m AS (SELECT max(distance_km) AS top FROM trips), b AS (SELECT least(floor(distance_km / (top / 20)), 19)::INT AS bin, count(*) FILTER (source_id = 'fleet_a') AS trips_a, count(*) FILTER (source_id = 'fleet_b') AS trips_b FROM trips, m WHERE distance_km IS NOT NULL GROUP BY 1)
SELECT g::INT AS bin, g * (top / 20) AS lo, coalesce(trips_a, 0) AS trips_a, coalesce(trips_b, 0) AS trips_b FROM m, range(20) r(g) LEFT JOIN b ON bin = g"""


@query("compare_distance_hist", _DIST, "lo")
def _(v):
    return compare.compare_distance_hist(both(v))


_PERSONS = "SELECT vehicle_id, count(*) FILTER (source_id = 'fleet_a') AS trips_a, count(*) FILTER (source_id = 'fleet_b') AS trips_b FROM trips GROUP BY 1"


@query("j_matched_full", _PERSONS)
def _(v):
    return compare.matched_full(v.trips.where("source_id = 'fleet_a'"), v.trips.where("source_id = 'fleet_b'"))


@query("matched_delta", f"SELECT count(*) FILTER (trips_a > 0 AND trips_b > 0) AS matched, avg(d) AS mean_delta, median(d) AS median_delta, quantile_cont(abs(d), 0.9) AS p90_abs, max(abs(d)) AS max_abs FROM (SELECT *, trips_b - trips_a AS d FROM ({_PERSONS}))", "mean_delta median_delta p90_abs")
def _(v):
    return compare.matched_delta(both(v))


@query("matched_top", f"SELECT *, trips_b - trips_a AS delta FROM ({_PERSONS}) ORDER BY abs(trips_b - trips_a) DESC, vehicle_id LIMIT 10")
def _(v):
    return compare.matched_top(both(v))


@query("wilcoxon_signed_rank", f"""WITH d AS (SELECT trips_b - trips_a AS d FROM ({_PERSONS}) WHERE trips_a > 0 AND trips_b > 0), n AS (SELECT count(*) AS n_pairs FROM d), z AS (SELECT * FROM d WHERE d <> 0),
k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r FROM z), s AS (SELECT sum(r) FILTER (d > 0) AS wp, sum(r) FILTER (d < 0) AS wm, count(*)::DOUBLE AS n FROM k),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM z GROUP BY abs(d)))
SELECT n_pairs, least(wp, wm) AS statistic, (least(wp, wm) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s, t, n WHERE n_pairs >= 8""", "statistic z")
def _(v):
    return compare.wilcoxon(both(v))


_RANKED = "SELECT source_id, vehicle_id, starttime, distance_km, row_number() OVER (PARTITION BY source_id, vehicle_id ORDER BY starttime, trip_id) AS rn FROM trips"
_PAIRED = f"SELECT a.vehicle_id, a.rn, a.starttime AS start_a, b.starttime AS start_b, a.distance_km AS dist_a, b.distance_km AS dist_b FROM ({_RANKED}) a JOIN ({_RANKED}) b ON a.vehicle_id = b.vehicle_id AND a.rn = b.rn AND a.source_id = 'fleet_a' AND b.source_id = 'fleet_b'"
_SCORES = f"""SELECT vehicle_id, avg(1 - 0.5e0 * (least(abs(start_b - start_a), 14400) / 14400e0 + CASE WHEN dist_a IS NULL OR dist_b IS NULL THEN 0 ELSE abs(dist_a - dist_b) / greatest(dist_a, dist_b, 1e0) END)) AS score, count(*) AS pairs FROM ({_PAIRED}) GROUP BY 1"""


@query("j_rank_pairs", _PAIRED, "dist_a dist_b")
def _(v):
    return compare.rank_pairs(both(v))


@query("alignment", f"SELECT count(*) AS persons, sum(pairs)::BIGINT AS pairs, avg(score) AS mean, median(score) AS median FROM ({_SCORES})", "mean median")
def _(v):
    return compare.alignment(both(v))


@query("alignment_hist", f"SELECT g::INT AS bucket, count(score) AS persons FROM range(10) r(g) LEFT JOIN ({_SCORES}) ON least(floor(round(score, 9) * 10), 9) = g GROUP BY g")
def _(v):
    return compare.alignment_hist(both(v))


@query("compare_multi", "SELECT source_id, count(*) AS trips, count(DISTINCT vehicle_id) AS vehicles, sum(distance_km) AS total_km, avg(distance_km) AS avg_km, median(distance_km) AS median_km, max(distance_km) AS max_km, min(starttime) AS first_start, max(starttime) AS last_start FROM trips WHERE source_id IN ('fleet_a', 'fleet_b') GROUP BY 1", "total_km avg_km median_km max_km")
def _(v):
    return compare.compare_multi(v.trips, FLEETS)


@query("compare_multi_modes", "SELECT source_id, mode, count(*) AS trips, 1e2 * count(*) / sum(count(*)) OVER (PARTITION BY source_id) AS pct FROM trips GROUP BY 1, 2", "pct")
def _(v):
    return compare.compare_multi_modes(v.trips, FLEETS)


@query("compare_multi_hourly", _HOURLY.replace("trips_a", "fleet_a").replace("trips_b", "fleet_b"))
def _(v):
    return compare.compare_multi_hourly(v.trips, FLEETS)


@query("compare_grid", """SELECT (ix + 0.5e0) * 0.005e0 AS lon, (iy + 0.5e0) * 0.005e0 AS lat, trips_a, trips_b, trips_b - trips_a AS delta FROM (
 SELECT floor(start_lon / 0.005e0) AS ix, floor(start_lat / 0.005e0) AS iy, count(*) FILTER (source_id = 'fleet_a') AS trips_a, count(*) FILTER (source_id = 'fleet_b') AS trips_b FROM trips GROUP BY 1, 2)""", "lon lat")
def _(v):
    return compare.compare_grid(both(v))


@query("compare_fleets", f"""SELECT 'summary' AS part, 'trips' AS key, (count(*) FILTER (source_id = 'fleet_a'))::DOUBLE AS a, (count(*) FILTER (source_id = 'fleet_b'))::DOUBLE AS b FROM trips
UNION ALL SELECT 'modes', mode, pct_a, pct_b FROM ({_SHARES}) UNION ALL SELECT 'hours', hour::VARCHAR, trips_a, trips_b FROM ({_HOURLY}) UNION ALL SELECT 'distance', bin::VARCHAR, trips_a, trips_b FROM ({_DIST})""", "a b")
def _(v):
    return compare.compare_report(both(v))


# mining, zones, profiles

_FEATURES = "SELECT vehicle_key, trip_id, start_lon, start_lat, end_lon, end_lat, distance_km, dep_hour::DOUBLE AS dep_hour FROM trips WHERE distance_km > 0"


@query("feature_scale", "SELECT *, " + ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS f{i}" for i, c in enumerate(mining.FEATURES)) + f" FROM ({_FEATURES})", "start_lon start_lat end_lon end_lat distance_km dep_hour f0 f1 f2 f3 f4 f5")
def _(v):
    return mining.feature_scale(v.trips)


# the trips' own numbers name points and clusters, so that SQL can name them too
_SCALED = "SELECT vehicle_key, trip_id, " + ", ".join(mining.FEATURES) + ", " + ", ".join(f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())) * {w}e0 AS f{i}" for i, (c, w) in enumerate(zip(mining.FEATURES, mining.WEIGHTS))) + f" FROM ({_FEATURES})"
_GAP = " + ".join(f"(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})" for i in range(6))
_NEAR = f"p AS ({_SCALED}), near AS (SELECT a.trip_id AS a, b.trip_id AS b FROM p a JOIN p b ON b.f0 BETWEEN a.f0 - 0.2e0 AND a.f0 + 0.2e0 AND a.trip_id <> b.trip_id WHERE {_GAP} <= 0.15e0 * 0.15e0)"


def _clusters(near: str, ids: str, min_samples: int, steps: int = 100) -> str:
    """SQL for density clusters: labels go from neighbour to neighbour, step by step."""
    return f"""WITH RECURSIVE {near}, core AS (SELECT a AS node FROM near GROUP BY a HAVING count(*) + 1 >= {min_samples}),
link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core) UNION ALL SELECT node, node FROM core),
spread AS (SELECT node, node AS label, 0 AS step FROM core UNION ALL SELECT link.a, min(spread.label), step + 1 FROM spread JOIN link ON spread.node = link.b WHERE step < {steps} GROUP BY link.a, step),
label AS (SELECT node, label FROM spread WHERE step = {steps}),
border AS (SELECT near.a AS node, min(label) AS label FROM near JOIN label ON near.b = label.node GROUP BY near.a)
SELECT i.*, coalesce(label.label, border.label) AS cluster FROM {ids} i LEFT JOIN label ON i.trip_id = label.node LEFT JOIN border ON i.trip_id = border.node"""


_OD_CLUSTERS = _clusters(_NEAR, "p", 5)


@query("cluster_od", f"SELECT vehicle_key, trip_id, cluster, {', '.join(mining.FEATURES)} FROM ({_OD_CLUSTERS})", " ".join(mining.FEATURES))
def _(v):
    return mining.cluster_od(v.trips, min_cluster_size=5, id=F.col("trip_id"))


@query("cluster_od_summary", f"""WITH k AS ({_OD_CLUSTERS}), c AS (SELECT cluster, count(*) AS size, {', '.join(f'avg({c}) AS avg_{c}' for c in mining.FEATURES)} FROM k WHERE cluster IS NOT NULL GROUP BY cluster),
g AS (SELECT k.cluster, vehicle_key, trip_id, round({' + '.join(f'({c} - avg_{c}) * ({c} - avg_{c})' for c in mining.FEATURES)}, 9) AS gap FROM k JOIN c ON k.cluster = c.cluster),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY gap, vehicle_key, trip_id) AS near, row_number() OVER (PARTITION BY cluster ORDER BY vehicle_key, trip_id) AS rn FROM g),
m AS (SELECT cluster, string_agg(trip_id::VARCHAR, ',' ORDER BY vehicle_key, trip_id) AS members FROM o WHERE rn <= 20 GROUP BY cluster)
SELECT c.*, o.vehicle_key, o.trip_id, m.members, (SELECT count(*) FROM k WHERE cluster IS NULL) AS noise FROM c JOIN o ON c.cluster = o.cluster AND o.near = 1 JOIN m ON c.cluster = m.cluster""", " ".join(f"avg_{c}" for c in mining.FEATURES))
def _(v):
    d = mining.cluster_summary(mining.cluster_od(v.trips, min_cluster_size=5, id=F.col("trip_id")))
    return d.withColumn("members", F.array_join(F.transform("members", lambda m: m["trip_id"].cast("string")), ","))


@query("j_eps_neighbours", f"SELECT * FROM (WITH {_NEAR} SELECT a, count(*) AS neighbours FROM near GROUP BY a)")
def _(v):
    d = mining.feature_scale(v.trips)
    points = d.select(F.col("trip_id").alias("id"), *[(F.col(f"f{i}") * w).alias(f"f{i}") for i, w in enumerate(mining.WEIGHTS)])
    return density.neighbour_counts(points, 0.15)


@query("j_jaccard_pairs", """WITH s AS (SELECT DISTINCT vehicle_key, trip_id, fine_link_id AS l FROM waypoints), n AS (SELECT vehicle_key, trip_id, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT a.vehicle_key AS ka, a.trip_id AS ta, b.vehicle_key AS kb, b.trip_id AS tb, count(*) AS c FROM s a JOIN s b ON a.l = b.l AND a.trip_id < b.trip_id GROUP BY 1, 2, 3, 4)
SELECT count(*) AS pairs, sum(c)::BIGINT AS shared FROM p JOIN n x ON ka = x.vehicle_key AND ta = x.trip_id JOIN n y ON kb = y.vehicle_key AND tb = y.trip_id WHERE round(1 - c / (x.n + y.n - c)::DOUBLE, 12) <= 0.8""")
def _(v):
    return mining.jaccard_pairs(mining.link_sets(v.waypoints, "fine_link_id"), 0.8).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"))


_ROUTES = """s AS (SELECT DISTINCT trip_id, fine_link_id AS l FROM waypoints), n AS (SELECT trip_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.trip_id AS a, y.trip_id AS b, count(*) AS c FROM s x JOIN s y ON x.l = y.l AND x.trip_id <> y.trip_id GROUP BY 1, 2),
near AS (SELECT a, b FROM c JOIN n x ON a = x.trip_id JOIN n y ON b = y.trip_id WHERE round(1 - c / (x.n + y.n - c)::DOUBLE, 12) <= 0.5)"""


#: SQL for density clusters of routes (as ``_clusters``, of trips with 2 at least): labels spread until none gets smaller, however long the chains are.
_ROUTE_CLUSTERS = f"""WITH RECURSIVE {_ROUTES}, core AS (SELECT DISTINCT a AS node FROM near),
label(node, label) USING KEY (node) AS (SELECT node, node FROM core UNION
 SELECT near.a, min(label.label) FROM label JOIN near ON label.node = near.b JOIN recurring.label AS own ON own.node = near.a GROUP BY near.a, own.label HAVING min(label.label) < own.label)
SELECT i.*, label.label AS cluster FROM (SELECT DISTINCT vehicle_key, trip_id FROM waypoints) i LEFT JOIN label ON i.trip_id = label.node"""


@query("route_similarity", f"SELECT vehicle_key, trip_id, cluster FROM ({_ROUTE_CLUSTERS})")
def _(v):
    return mining.route_similarity(v.waypoints, "fine_link_id", 0.5, 2, F.col("trip_id"))


@query("j_zone_contains", "SELECT poi_id, zone_id FROM pois JOIN zones ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat")
def _(v):
    return zones.contains(v.pois, v.zones, "bbox").select("poi_id", "zone_id")


@query("zones_of_pois", "SELECT poi_id AS zone_id, count(*) AS trips FROM pois JOIN trips ON abs(start_lon - lon) / 0.0437e0 + abs(start_lat - lat) / 0.0291e0 < 1 GROUP BY 1")
def _(v):
    # a diamond around every point of interest
    x, y = F.col("lon"), F.col("lat")
    corner = lambda i, j: F.struct((x + i * 0.0437).alias("lon"), (y + j * 0.0291).alias("lat"))
    diamonds = v.pois.select(F.col("poi_id").alias("zone_id"), F.array(F.array(F.array(corner(-1, 0), corner(0, -1), corner(1, 0), corner(0, 1)))).alias("rings"))
    starts = v.trips.select("trip_id", F.col("start_lon").alias("lon"), F.col("start_lat").alias("lat"))
    return count_in_cover(starts, cover(diamonds, 0.02), 0.02).withColumnRenamed("n", "trips")


@query("zone_contains_exact", """SELECT poi_id, zone_id FROM pois JOIN zones ON lon > min_lon AND lon < max_lon AND lat > min_lat AND lat < max_lat
WHERE NOT (zone_id = 3 AND lon > 139.85e0 AND lon < 140.05e0 AND lat > 35.75e0 AND lat < 35.95e0)""")
def _(v):
    return zones.contains(v.pois, v.zones, hole_rims=True).select("poi_id", "zone_id")


@query("list_pois", "SELECT poi_id, source_key, name, category, lon, lat, (SELECT count(*) > 10 FROM pois WHERE category = 'City park') AS truncated FROM pois WHERE category = 'City park' ORDER BY source_key, poi_id LIMIT 10", "lon lat")
def _(v):
    return zones.list_pois(v.pois, F.col("category") == "City park", 10)


@query("list_zones", "SELECT zone_id, z.name, (SELECT count(*) FROM pois WHERE lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat) AS pois FROM zones z WHERE max_lon >= 139.9e0 AND min_lon <= 140.1e0 AND max_lat >= 35.6e0 AND min_lat <= 35.8e0")
def _(v):
    z = zones.list_zones(v.zones, BOX)
    n = zones.contains(v.pois, z, "bbox").groupBy("zone_id").agg(F.count(F.lit(1)).alias("pois"))
    return z.join(n, "zone_id", "left").select("zone_id", "name", F.coalesce("pois", F.lit(0)).alias("pois"))


_RING = "array(named_struct('lon', start_lon, 'lat', start_lat), named_struct('lon', end_lon, 'lat', start_lat), named_struct('lon', end_lon, 'lat', end_lat), named_struct('lon', start_lon, 'lat', end_lat))"


def _boxes(v: Views) -> DataFrame:
    """The boxes between starts and ends of trips as buildings."""
    return v.trips.select("trip_id", F.expr(_RING).alias("ring"), F.lit(10.0).alias("height_m"))


_AREA = "abs(end_lon - start_lon) * abs(end_lat - start_lat) * 111320e0 * 111320e0 * cos(radians((start_lat + end_lat) / 2))"


@query("ring_area", f"SELECT trip_id, round({_AREA} / 1e6, 3) AS km2 FROM trips", "km2")
def _(v):
    return _boxes(v).select("trip_id", F.round(zones.ring_area(F.col("ring")) / 1e6, 3).alias("km2"))


@query("building_clip", f"SELECT trip_id FROM trips WHERE (start_lon + end_lon) / 2 BETWEEN 139.9003e0 AND 140.1003e0 AND (start_lat + end_lat) / 2 BETWEEN 35.6003e0 AND 35.8003e0 AND {_AREA} >= 25")
def _(v):
    return zones.building_clip(_boxes(v), (139.9003, 35.6003, 140.1003, 35.8003)).select("trip_id")


def _centroids(v: Views) -> DataFrame:
    return v.table("part").selectExpr("p_partkey AS key", "139.5d + (p_partkey % 500) / 500.0d AS lon", "35.5d + (p_partkey % 250) / 400.0d AS lat", "CAST(p_retailprice AS DOUBLE) * (p_size % 5) AS area_m2")


_PARTS = "SELECT p_partkey AS key, 35.5e0 + (p_partkey % 250) / 4e2 AS lat, p_retailprice * (p_size % 5) AS area_m2 FROM part"
_U = drawn_sql("42", "key", "i", "j")
_BUILT = f"""WITH c AS (SELECT *, area_m2 > 3e3 AS block, CASE WHEN area_m2 > 3e3 THEN greatest(2, round(sqrt(area_m2) / 28e0)) ELSE 1 END::INT AS n FROM ({_PARTS}) WHERE area_m2 >= 25),
g AS (SELECT c.*, i, j, {_U} % 1000000 / 1e6 AS u, {_U} AS h FROM c, unnest(range(n)) AS a(i), unnest(range(n)) AS b(j)),
w AS (SELECT *, CASE WHEN block THEN greatest(sqrt(area_m2) / n - 4, sqrt(area_m2) / n * 0.6e0) ELSE sqrt(area_m2) END AS side,
 CASE WHEN block THEN 8 + 8 * u ELSE greatest(8, least(60, 4 * log2(greatest(area_m2, 2)))) * (0.85e0 + 0.3e0 * u) END AS height_m FROM g)
SELECT key, i, j, height_m, side * side * cos(radians(lat + ((j + 0.5e0) / n - 0.5e0) * sqrt(area_m2) / 111320e0)) / cos(radians(lat)) AS area_m2, h FROM w"""


@query("building_synthesize", f"SELECT key, i, j, height_m, round(area_m2, 3) AS area_m2 FROM ({_BUILT})", "height_m area_m2")
def _(v):
    return zones.building_synthesize(_centroids(v)).select(F.col("key"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "height_m", F.round(zones.ring_area(F.col("ring")), 3).alias("area_m2"))


@query("building_sample", f"SELECT key, i, j, height_m FROM ({_BUILT}) ORDER BY CASE WHEN height_m >= 25 THEN -1 ELSE -ln((h % 1000000007 + 1) / 1000000008e0) / greatest(area_m2, 1) END, key, i, j LIMIT 500", "height_m")
def _(v):
    return zones.building_sample(zones.building_synthesize(_centroids(v)), 500).select("key", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "height_m")


def _profile_sql(c: str, role: str | None, trip_role: str | None) -> str:
    """What is known of a column of the trips by its text, its name's roles given."""
    text = lambda x: f"'{x}'" if x else "NULL::VARCHAR"
    return f"""SELECT *, CASE WHEN filled = 0 THEN 'empty' WHEN numbers = filled THEN 'number' WHEN numbers = 0 THEN 'string' ELSE 'mixed' END AS type_class,
 CASE WHEN filled = 0 THEN NULL WHEN 2 * iso >= filled THEN 'iso' WHEN 2 * numbers < filled THEN NULL WHEN low >= 1e11 THEN 'epoch_ms' WHEN low >= 1e8 THEN 'epoch_s' WHEN low >= 0 AND high < 172800 THEN 'day_seconds' END AS time_kind FROM (
 SELECT '{c}' AS column, count(s) AS filled, count(x) AS numbers, count(*) FILTER (regexp_matches(s, '{profile.ISO}')) AS iso, min(x) AS low, max(x) AS high, {text(role)} AS role, {text(trip_role)} AS trip_role
 FROM (SELECT s, TRY_CAST(s AS DOUBLE) AS x FROM (SELECT {c}::VARCHAR AS s FROM trips)))"""


_PROFILE = (("vehicle_id", "vehicle", None), ("starttime", None, "starttime"), ("start_lon", None, "start_lon"), ("mode", "mode", None), ("leg_id", None, None))


@query("profile_columns", " UNION ALL ".join(_profile_sql(*x) for x in _PROFILE), "low high")
def _(v):
    return profile.profile_columns(v.trips.select(*[x[0] for x in _PROFILE])).drop("sample")


@query("poi_class", "SELECT poi_id, CASE WHEN category = 'Train station' THEN 'transit' WHEN category = 'Shopping mall' THEN 'shop' WHEN category = 'City park' THEN 'park' ELSE 'other' END AS class FROM pois")
def _(v):
    return v.pois.select("poi_id", poi_class(F.col("category")).alias("class"))


@query("speed_class", "SELECT trip_id, CASE WHEN speed_avg_kmh IS NULL THEN NULL WHEN speed_avg_kmh < 5 THEN 0 WHEN speed_avg_kmh < 20 THEN 1 WHEN speed_avg_kmh < 50 THEN 2 WHEN speed_avg_kmh < 80 THEN 3 ELSE 4 END AS class FROM full_trips")
def _(v):
    return v.full_trips.select("trip_id", speed_class(F.col("speed_avg_kmh")).alias("class"))


@query("union_od_density", f"SELECT lon, lat, count(*) AS n FROM ({_STARTS} UNION ALL {_ENDS}) GROUP BY 1, 2", "lon lat")
def _(v):
    ends = lambda p: v.trips.select(F.col(f"{p}_lon").alias("lon"), F.col(f"{p}_lat").alias("lat"))
    return ends("start").unionByName(ends("end")).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))


@query("union_ab_points", "SELECT 0 AS side, count(*) AS n FROM trips WHERE source_id = 'fleet_a' UNION ALL SELECT 1, count(*) FROM trips WHERE source_id = 'fleet_b'")
def _(v):
    return both(v).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("union_sources", "SELECT source_id, count(*) AS n, count(goods_type) AS goods FROM (SELECT source_id, goods_type FROM trips UNION ALL BY NAME SELECT source_id FROM pings) GROUP BY 1")
def _(v):
    d = v.trips.select("source_id", "goods_type").unionByName(with_trip_ids(v.pings, "single").select("source_id"), allowMissingColumns=True)
    return d.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count("goods_type").alias("goods"))
