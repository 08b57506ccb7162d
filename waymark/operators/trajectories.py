"""Whole trajectories: chosen trips first, then all of their waypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.draw import drawn
from waymark.functions.clock import clock_of_day
from waymark.functions.exact import mean_of_millionths, millionths
from waymark.operators.derive import segments
from waymark.operators.filters import PAIR, entering, in_radius


def with_trip(waypoints: DataFrame, trips: DataFrame) -> DataFrame:
    """Waypoints with their trip's mode, agent and leg."""
    return waypoints.join(trips.select(*PAIR, "transport_mode", "mode", "agent_id", "leg_id"), PAIR, "left")


def of_pairs(waypoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """All waypoints of the given trips; few pairs are broadcast by their size, never written into the query."""
    return waypoints.join(pairs.select(*PAIR), PAIR, "left_semi")


def of_vehicles(waypoints: DataFrame, trips: DataFrame) -> DataFrame:
    """Waypoints of vehicles with any of the trips: the coarse scope."""
    return waypoints.join(trips.select("vehicle_key").distinct(), "vehicle_key", "left_semi")


def orphans(waypoints: DataFrame, trips: DataFrame) -> DataFrame:
    return waypoints.join(trips.select(*PAIR), PAIR, "left_anti")


def without_waypoints(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    return trips.join(waypoints.select(*PAIR).distinct(), PAIR, "left_anti")


def assemble(waypoints: DataFrame, anchor: int, with_segments: bool = False) -> DataFrame:
    """One row per trip: path and timestamps (seconds of the day) in order of time, and optionally its segments."""
    p = waypoints.select(*PAIR, F.struct("unix_time_ms", "seq", "lon", "lat").alias("p")).groupBy(*PAIR).agg(F.array_sort(F.collect_list("p")).alias("p"))
    d = p.select(
        *PAIR, F.concat_ws("_", *PAIR).alias("id"), F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("path"),
        F.transform("p", lambda x: clock_of_day(x["unix_time_ms"], anchor)).alias("timestamps"),
    )
    if not with_segments:
        return d
    s = segments(waypoints).groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("unix_time_ms", "seq", "link_id", "speed_kmh", "dwell_sec"))).alias("s"))
    return d.join(s, PAIR, "left").withColumn("segments", F.transform(F.coalesce("s", F.array().cast(s.schema["s"].dataType)), lambda x: F.struct(x["link_id"].alias("link_id"), x["speed_kmh"].alias("speed_kmh"), x["dwell_sec"].alias("dwell_sec")))).drop("s")


def sample_pairs(trips: DataFrame, n: int, seed: int = 0, key: tuple[str, ...] = ("vehicle_key", "trip_id")) -> DataFrame:
    """``n`` trips in the order of a seeded hash: a sample that reruns draw again, taken after the filter."""
    return trips.select(*PAIR).distinct().orderBy(drawn(F.lit(seed), *key), *PAIR).limit(n)


def sample_trips(trips: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return trips.orderBy(drawn(F.lit(seed), *PAIR), *PAIR).limit(n)


def trajectories_bbox(waypoints: DataFrame, box: tuple[float, float, float, float], limit: int = 500) -> DataFrame:
    """Waypoints of the first ``limit`` trips that enter the box."""
    return of_pairs(waypoints, entering(waypoints, box).orderBy(*PAIR).limit(limit))


def trajectories_point(waypoints: DataFrame, lon: float, lat: float, radius_km: float, limit: int = 500, exact: bool = False) -> DataFrame:
    near = waypoints.where(in_radius(lon, lat, radius_km, exact)).select(*PAIR).distinct()
    return of_pairs(waypoints, near.orderBy(*PAIR).limit(limit))


def trajectories_by_vehicle(waypoints: DataFrame, predicate: Column) -> DataFrame:
    return waypoints.where(predicate)


def trajectory_detail(waypoints: DataFrame) -> DataFrame:
    """Per trip: largest and mean speed (in whole millionths), dwell in all and at most, distinct links, and the top of its speed histogram."""
    s = segments(waypoints)
    top = F.ceil(F.greatest(F.max("speed_kmh"), F.lit(10.0)) / 10) * 10
    dwell = F.when(F.col("dwell_sec") > 0, F.col("dwell_sec"))
    return s.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("segments"), (millionths(F.max("speed_kmh")) / 1e6).alias("max_kmh"), mean_of_millionths(F.col("speed_kmh")).alias("avg_kmh"), (F.coalesce(F.sum(dwell), F.lit(0.0)) / 60.0).alias("dwell_min"), F.coalesce(F.max(dwell), F.lit(0.0)).alias("longest_dwell_sec"), F.countDistinct("link_id").alias("links"), top.cast("long").alias("hist_top"))


def speed_bins(waypoints: DataFrame, bins: int = 10) -> DataFrame:
    """Per trip, segments per bin of speed between 0 and the largest speed rounded up to tens."""
    s = segments(waypoints).where("speed_kmh is not null")
    top = F.ceil(F.greatest(F.max("speed_kmh").over(Window.partitionBy(*PAIR)), F.lit(10.0)) / 10) * 10
    s = s.withColumn("width", top / F.lit(float(bins)))
    b = F.least(F.floor(F.col("speed_kmh") / F.col("width")), F.lit(bins - 1)).cast("int")
    return s.groupBy(*PAIR, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_links(waypoints: DataFrame, n: int = 5) -> DataFrame:
    """The links that each trip uses most."""
    d = segments(waypoints).where("link_id is not null").groupBy(*PAIR, "link_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*PAIR).orderBy(F.col("n").desc(), "link_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


SCALE = 1e-5
HOP = 32000 * SCALE


def compact_trails(waypoints: DataFrame, anchor: int) -> DataFrame:
    """Paths as whole steps of 1e-5 degrees from the least corner, and time steps of 0 to 65535 s.

    A hop of over 0.32 degrees is split by points between its ends.  Rows: trip,
    point number, step in x and y from the point before (from the corner for the
    first), time step (clock for the first).
    """
    w = Window.partitionBy(*PAIR).orderBy("unix_time_ms", "seq")
    d = waypoints.select(*PAIR, "lon", "lat", "unix_time_ms", "seq", clock_of_day(F.col("unix_time_ms"), anchor).alias("t"), F.lag("lon").over(w).alias("x0"), F.lag("lat").over(w).alias("y0"))
    d = d.withColumn("t0", F.lag("t").over(w))
    splits = F.coalesce(F.floor(F.greatest(F.abs(F.col("lon") - F.col("x0")), F.abs(F.col("lat") - F.col("y0"))) / HOP), F.lit(0)).cast("int")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1), splits + 1))).withColumn("f", F.when(F.col("x0").isNull(), F.lit(1.0)).otherwise(F.col("k") / (splits + 1)))
    at = lambda a, b: F.when(F.col("f") == 1, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("f"))
    d = d.select(*PAIR, "unix_time_ms", "seq", "k", at("x0", "lon").alias("x"), at("y0", "lat").alias("y"), F.when(F.col("f") == 1, F.col("t")).otherwise(F.round(F.col("t0") + (F.col("t") - F.col("t0")) * F.col("f"))).cast("long").alias("t"))
    corner = waypoints.agg(F.min("lon").alias("cx"), F.min("lat").alias("cy"))
    d = d.join(F.broadcast(corner)).select(*PAIR, "unix_time_ms", "seq", "k", "t", F.round((F.col("x") - F.col("cx")) / SCALE).cast("long").alias("qx"), F.round((F.col("y") - F.col("cy")) / SCALE).cast("long").alias("qy"))
    w = Window.partitionBy(*PAIR).orderBy("unix_time_ms", "seq", "k")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    dt = F.when(F.lag("t").over(w).isNull(), F.col("t")).otherwise(F.greatest(F.lit(0), F.least(F.lit(65535), F.col("t") - F.lag("t").over(w))))
    return d.select(*PAIR, F.row_number().over(w).alias("point"), step("qx").alias("dx"), step("qy").alias("dy"), dt.cast("long").alias("dt"))
