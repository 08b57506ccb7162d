"""Flows, densities and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions import exact
from waymark.functions.clock import hour_of_day
from waymark.functions.grid import grid_per_degree, grid_round
from waymark.operators.filters import PAIR


def _top(df: DataFrame, by: str, ties: list[str], limit: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(limit)


def od_flows(trips: DataFrame, top_n: int = 50, least: int = 5) -> DataFrame:
    """Pairs of 0.05-degree cells with at least ``least`` trips, the ``top_n`` largest, with their exact mean distance."""
    cells = {"o_lon": "start_lon", "o_lat": "start_lat", "d_lon": "end_lon", "d_lat": "end_lat"}
    g = trips.where("start_lon is not null and end_lon is not null").groupBy(*[grid_per_degree(F.col(c), 20).alias(n) for n, c in cells.items()])
    d = g.agg(F.count("*").alias("volume"), exact.mean(F.col("distance_km")).alias("avg_distance_km")).where(F.col("volume") >= least)
    return _top(d, "volume", list(cells), top_n)


def od_flows_zone(trips: DataFrame, top_n: int = 50) -> DataFrame:
    """Pairs of zones with the means of their ends."""
    d = trips.where("origin_zone is not null and dest_zone is not null").groupBy("origin_zone", "dest_zone")
    d = d.agg(F.count("*").alias("volume"), *[exact.mean(F.col(c)).alias(f"avg_{c}") for c in ("start_lon", "start_lat", "end_lon", "end_lat")])
    return _top(d, "volume", ["origin_zone", "dest_zone"], top_n)


def _ends(trips: DataFrame, point_type: str, lon: Column, lat: Column, prefix: str) -> DataFrame:
    d = trips.where(f"{prefix}_lon is not null").groupBy(lon.alias("lon"), lat.alias("lat"))
    return d.agg(F.count("*").alias("weight"))


def density_grid(trips: DataFrame, resolution: float = 0.01, point_type: str = "origin", limit: int = 5000) -> DataFrame:
    """Trips per rounded cell of origins, destinations or both."""
    one = lambda p: _ends(trips, p, grid_round(F.col(f"{p}_lon"), resolution), grid_round(F.col(f"{p}_lat"), resolution), p)
    if point_type == "both":
        d = one("start").unionByName(one("end")).groupBy("lon", "lat").agg(F.sum("weight").alias("weight"))
    else:
        d = one({"origin": "start", "destination": "end"}[point_type])
    return _top(d, "weight", ["lon", "lat"], limit)


def waypoint_density(waypoints: DataFrame, scope: DataFrame | None = None, resolution: float = 0.005, limit: int = 5000) -> DataFrame:
    """Waypoints per rounded cell, of the trips in ``scope``."""
    w = waypoints if scope is None else waypoints.join(scope.select(*PAIR), PAIR, "left_semi")
    d = w.groupBy(grid_round(F.col("lon"), resolution).alias("lon"), grid_round(F.col("lat"), resolution).alias("lat")).agg(F.count("*").alias("weight"))
    return _top(d, "weight", ["lon", "lat"], limit)


def footfall(trips: DataFrame, waypoints: DataFrame, resolution: float = 0.002, limit: int = 5000) -> DataFrame:
    """Where people walk: waypoints of walking trips, or both ends of these trips if there is no such waypoint."""
    walks = trips.where("transport_mode = 0")
    w = waypoints.join(walks.select(*PAIR), PAIR, "left_semi").select("lon", "lat", F.lit(0).alias("level"))
    ends = walks.select(F.col("start_lon").alias("lon"), F.col("start_lat").alias("lat")).unionByName(walks.select(F.col("end_lon").alias("lon"), F.col("end_lat").alias("lat"))).withColumn("level", F.lit(1))
    d = w.unionByName(ends).groupBy("level", grid_round(F.col("lon"), resolution).alias("lon"), grid_round(F.col("lat"), resolution).alias("lat")).agg(F.count("*").alias("weight"))
    best = d.agg(F.min("level").alias("best"))
    return _top(d.join(F.broadcast(best)).where("level = best").select("lon", "lat", "weight"), "weight", ["lon", "lat"], limit)


def link_density(waypoints: DataFrame, top_n: int = 500, min_waypoints: int = 50, parts: int | None = None) -> DataFrame:
    """Waypoints, vehicles and centre of the busiest links.

    Vehicles are counted after a distinct per (link, vehicle), so that a busy
    link is no single task's work; with ``parts`` they are dealt to as many tasks.
    """
    w = waypoints.where("link_id is not null and link_id <> ''")
    if parts:
        w = w.select("link_id", "vehicle_key", "lon", "lat").repartition(parts, "link_id", "vehicle_key")
    per = w.groupBy("link_id", "vehicle_key").agg(F.count("*").alias("n"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"))
    d = per.groupBy("link_id").agg(F.sum("n").alias("waypoints"), F.count("*").alias("vehicles"), (F.sum("lon") / F.sum("n")).alias("lon"), (F.sum("lat") / F.sum("n")).alias("lat"))
    return _top(d.where(F.col("waypoints") >= min_waypoints), "waypoints", ["link_id"], top_n)


def link_total(waypoints: DataFrame) -> DataFrame:
    return waypoints.where("link_id is not null and link_id <> ''").agg(F.countDistinct("link_id").alias("links"))


def link_groups(waypoints: DataFrame, trips: DataFrame, links: DataFrame, by: str = "source_id") -> DataFrame:
    """Waypoints of the given links, split by source or by the trip's mode."""
    w = waypoints.join(links.select("link_id"), "link_id", "left_semi")
    if by == "mode":
        w = w.join(trips.select(*PAIR, "mode"), PAIR, "left")
    return w.groupBy("link_id", F.col(by).alias("value")).agg(F.count("*").alias("waypoints"))


def link_segments(waypoints: DataFrame) -> DataFrame:
    """Each pair of consecutive waypoints under the link of its second."""
    w = Window.partitionBy(*PAIR).orderBy("unix_time_ms", "seq")
    d = waypoints.select(*PAIR, "link_id", "unix_time_ms", "seq", "lon", "lat", F.lag("lon").over(w).alias("prev_lon"), F.lag("lat").over(w).alias("prev_lat"))
    return d.where("prev_lon is not null")


def best_trip_per_link(segs: DataFrame) -> DataFrame:
    """The trip with most pairs on each link; ties by vehicle and trip."""
    n = segs.groupBy("link_id", *PAIR).agg(F.count("*").alias("n"))
    w = Window.partitionBy("link_id").orderBy(F.col("n").desc(), "vehicle_key", "trip_id")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "n")


def link_paths(waypoints: DataFrame, links: DataFrame) -> DataFrame:
    """A path per link: the first pair's start, then the ends of the best trip's pairs in order, as text of points."""
    segs = link_segments(waypoints).join(links.select("link_id"), "link_id", "left_semi")
    own = segs.join(best_trip_per_link(segs), ["link_id", *PAIR])
    parts = F.array_sort(F.collect_list(F.struct("unix_time_ms", "seq", "prev_lon", "prev_lat", "lon", "lat")))
    text = lambda x, y: F.concat(F.format_number(x, 6), F.lit(" "), F.format_number(y, 6))
    d = own.groupBy("link_id", *PAIR).agg(parts.alias("p"))
    first = F.get("p", F.lit(0))
    return d.select("link_id", *PAIR, (F.size("p") + 1).alias("points"), F.concat(F.array(text(first["prev_lon"], first["prev_lat"])), F.transform("p", lambda s: text(s["lon"], s["lat"]))).alias("path"))


def hotspots(trips: DataFrame, point_type: str = "origin", top_n: int = 20) -> DataFrame:
    """The busiest 0.01-degree cells, ranked."""
    p = {"origin": "start", "destination": "end"}[point_type]
    d = trips.groupBy(grid_per_degree(F.col(f"{p}_lon"), 100).alias("lon"), grid_per_degree(F.col(f"{p}_lat"), 100).alias("lat")).agg(F.count("*").alias("volume"), F.countDistinct("vehicle_key").alias("vehicles"))
    top = _top(d, "volume", ["lon", "lat"], top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("volume").desc(), "lon", "lat")))


def build_density_hourly(waypoints: DataFrame, cities: DataFrame, anchor: int, resolution: float = 0.005) -> DataFrame:
    """Waypoints per source, city, hour and rounded cell.  A vehicle with two cities counts in both.

    Waypoints are counted per vehicle and cell before the city comes in, so that
    a busy vehicle joins with as many rows as it has cells.
    """
    city = cities.where("city is not null").select("vehicle_key", "city").distinct()
    cell = [hour_of_day(F.col("unix_time_ms"), anchor).alias("hour"), grid_round(F.col("lon"), resolution).alias("grid_lon"), grid_round(F.col("lat"), resolution).alias("grid_lat")]
    w = waypoints.groupBy("source_id", "vehicle_key", *cell).agg(F.count("*").alias("n"))
    d = w.join(city, "vehicle_key", "left").groupBy("source_id", "city", "hour", "grid_lon", "grid_lat").agg(F.sum("n").alias("weight"))
    return d.withColumn("resolution", F.lit(float(resolution)))


#: Parts of an hour's cells that are ranked by themselves first.
HOUR_PARTS = 16


def density_hourly(cells: DataFrame, resolution: float = 0.005, max_cells_per_hour: int = 15000) -> DataFrame:
    """Cells over all sources, the heaviest per hour, with the largest weight of all and whether an hour was cut.

    Every part of an hour gives its heaviest cells to the ranking of the hour;
    one more than are kept shows whether the hour is cut.
    """
    d = cells.where(F.col("resolution") == float(resolution)).groupBy("hour", "grid_lon", "grid_lat").agg(F.sum("weight").alias("weight"))
    heaviest = [F.col("weight").desc(), "grid_lon", "grid_lat"]
    some = Window.partitionBy("hour", F.pmod(F.xxhash64("grid_lon", "grid_lat"), F.lit(HOUR_PARTS))).orderBy(*heaviest)
    d = d.withColumn("rn", F.row_number().over(some)).where(F.col("rn") <= max_cells_per_hour + 1)
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("hour").orderBy(*heaviest))).where(F.col("rn") <= max_cells_per_hour + 1)
    d = d.withColumn("truncated", F.max("rn").over(Window.partitionBy("hour")) > max_cells_per_hour).where(F.col("rn") <= max_cells_per_hour)
    # what is left is bounded by the hours of a day
    return d.select("hour", "grid_lon", "grid_lat", "weight", F.max("weight").over(Window.partitionBy()).alias("max_weight"), "truncated")


def compact_pulse(cells: DataFrame, resolution: float = 0.005, per_hour: int = 2000) -> DataFrame:
    """Cells as whole offsets from the least cell, weights scaled to 1..65535."""
    every = Window.partitionBy()  # over the cells that an hour may keep, times 24
    d = density_hourly(cells, resolution, per_hour)
    d = d.select("hour", "grid_lon", "grid_lat", "weight", F.min("grid_lon").over(every).alias("lon0"), F.min("grid_lat").over(every).alias("lat0"), F.max("weight").over(every).alias("top"))
    scaled = F.greatest(F.lit(1), F.round(F.col("weight") / F.col("top") * 65535)).cast("long")
    return d.select("hour", F.round((F.col("grid_lon") - F.col("lon0")) / resolution).cast("long").alias("ix"), F.round((F.col("grid_lat") - F.col("lat0")) / resolution).cast("long").alias("iy"), scaled.alias("w"))
