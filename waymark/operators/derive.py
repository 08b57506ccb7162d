"""Columns and tables derived from trips and waypoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.clock import DAY, clock_of_day, day_index, hour_of_day
from waymark.functions.draw import drawn
from waymark.functions.geo import equirect_km, equirect_mean_km
from waymark.operators.filters import PAIR
from waymark.operators.scan import RANGE_ROWS, fullest, scan


def derive_speed(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Adds speed_avg_kmh: distance over the span of the trip's waypoints, where both are above zero."""
    spans = waypoints.groupBy(*PAIR).agg((F.max("unix_time_ms") - F.min("unix_time_ms")).alias("_ms"))
    kmh = F.when((F.col("_ms") > 0) & (F.col("distance_km") > 0), F.col("distance_km") / (F.col("_ms") / 3.6e6))
    return trips.join(spans, PAIR, "left").withColumn("speed_avg_kmh", kmh).drop("_ms")


def derive_dwell(trips: DataFrame) -> DataFrame:
    """Adds dwell_minutes: until the vehicle's next start on the same day; null for its last trip."""
    w = Window.partitionBy("vehicle_key", "simulation_day").orderBy("starttime", "trip_id")
    return trips.withColumn("dwell_minutes", (F.lead("starttime").over(w) - F.col("starttime")) / 60.0)


def derive_detour(trips: DataFrame) -> DataFrame:
    """Adds detour_ratio: distance over the straight line; null without distance or for ends within 0.1 km."""
    od = equirect_km(F.col("start_lon"), F.col("start_lat"), F.col("end_lon"), F.col("end_lat"))
    return trips.withColumn("detour_ratio", F.when((F.col("distance_km") > 0) & (od >= 0.1), F.col("distance_km") / od))


def with_metrics(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    return derive_detour(derive_dwell(derive_speed(trips, waypoints)))


def resolve_anchor(pings: DataFrame) -> DataFrame:
    """One row: midnight (UTC, in seconds) of the first ping's day."""
    first = F.floor(F.min("unix_time_ms") / 1000)
    return pings.agg((F.floor(first / DAY) * DAY).cast("long").alias("epoch_anchor"))


def segments(waypoints: DataFrame) -> DataFrame:
    """Consecutive waypoints of a trip: link of the second, km, km/h (null without time between) and seconds of dwell (below 1 km/h).

    Waypoints of one time and ``seq`` follow by link and place; those left are alike.
    """
    w = Window.partitionBy(*PAIR).orderBy("unix_time_ms", "seq", "link_id", "lon", "lat")
    d = waypoints.select(*PAIR, "link_id", "unix_time_ms", "seq", "lon", "lat", F.lag("unix_time_ms").over(w).alias("t0"), F.lag("lon").over(w).alias("lon0"), F.lag("lat").over(w).alias("lat0")).where("t0 is not null")
    km = equirect_mean_km(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    dt = (F.col("unix_time_ms") - F.col("t0")) / 1000.0
    d = d.select("*", km.alias("km"), dt.alias("dt"))
    d = d.withColumn("speed_kmh", F.when(F.col("dt") > 0, F.col("km") / (F.col("dt") / 3600.0)))
    return d.withColumn("dwell_sec", F.when(F.col("speed_kmh") < 1, F.col("dt")).otherwise(0.0))


def downsample_cap(waypoints: DataFrame, cap: int) -> DataFrame:
    """At most about ``cap`` evenly spaced waypoints per trip."""
    w = Window.partitionBy(*PAIR)
    ranked = waypoints.withColumns({"_rn": F.row_number().over(w.orderBy("unix_time_ms", "seq")), "_n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(cap))))
    return ranked.where(F.pmod(F.col("_rn") - 1, step) == 0).drop("_rn", "_n")


def downsample_frac(waypoints: DataFrame, frac: float) -> DataFrame:
    """The share ``frac`` of waypoints, drawn by a hash of key, trip and time."""
    if not 0 < frac <= 1:
        raise ValueError("frac: above 0, at most 1")
    return waypoints.where(drawn("vehicle_key", "trip_id", "unix_time_ms") % 1_000_000 < int(frac * 1_000_000))


def _starts(how: str, anchor: int, gap_minutes: int) -> Callable[[Column, Column], Column]:
    """Whether a ping starts a new trip, given the one before it."""
    if how == "gap":
        return lambda before, now: now["unix_time_ms"] - before["unix_time_ms"] > gap_minutes * 60_000
    if how == "day":
        return lambda before, now: day_index(now["unix_time_ms"], anchor) != day_index(before["unix_time_ms"], anchor)
    if how == "single":
        return lambda before, now: F.lit(False)
    raise ValueError(f"unknown split: {how}")


def _stretches(pings: DataFrame, how: str, anchor: int, gap_minutes: int, ranges: int | None) -> DataFrame:
    """Pings with ``prev`` (time and place of the vehicle's ping before) and ``ordinal`` (of the stretch), by windows while every vehicle fits in a task, else by ranges."""
    starts, keys, order, looked = _starts(how, anchor, gap_minutes), ["vehicle_key"], ["unix_time_ms", "event_id"], ["unix_time_ms", "lon", "lat"]
    if ranges is not None or fullest(pings, keys) > RANGE_ROWS:
        return scan(pings, keys, order, looked, starts, ranges=ranges)
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*looked)
    d = pings.withColumn("prev", F.lag(now).over(w))
    d = d.withColumn("_new", F.when(F.col("prev").isNotNull() & starts(F.col("prev"), now), 1).otherwise(0))
    return d.withColumn("ordinal", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_new")


def with_trip_ids(pings: DataFrame, how: str = "gap", anchor: int = 0, gap_minutes: int = 30, ranges: int | None = None) -> DataFrame:
    """Pings with trip_id: the ordinal, per vehicle, of the stretch they belong to.

    A vehicle with more pings than a task should hold (a default device id) is
    scanned in ranges of time; ``ranges`` sets their number.
    """
    return _stretches(pings, how, anchor, gap_minutes, ranges).withColumnRenamed("ordinal", "trip_id").drop("prev")


def synthesize_trips(pings: DataFrame, how: str = "gap", anchor: int = 0, gap_minutes: int = 30, ranges: int | None = None) -> DataFrame:
    """Trips from pings alone: a new one after a long gap, at a change of day, or one per vehicle.

    The length is the sum over consecutive pings (null for a single ping).
    Trips are put together from partial results, so that neither a vehicle nor a
    trip has to fit in one task; ``ranges`` is as in ``with_trip_ids``.
    """
    starts = _starts(how, anchor, gap_minutes)
    d = _stretches(pings, how, anchor, gap_minutes, ranges).withColumnRenamed("ordinal", "trip_id")
    same = F.col("prev").isNotNull() & ~starts(F.col("prev"), F.struct("unix_time_ms", "lon", "lat"))
    d = d.withColumn("_km", F.when(same, equirect_km(F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat"))))
    by = F.struct("unix_time_ms", "event_id")
    ends = d.groupBy("vehicle_key", "trip_id").agg(
        F.min("unix_time_ms").alias("first_ms"), F.max("unix_time_ms").alias("last_ms"), F.count(F.lit(1)).alias("pings"), F.sum("_km").alias("distance_km"),
        F.min_by("lon", by).alias("start_lon"), F.min_by("lat", by).alias("start_lat"), F.max_by("lon", by).alias("end_lon"), F.max_by("lat", by).alias("end_lat"),
        F.any_value("source_id", True).alias("source_id"),
    )
    first = F.col("first_ms")
    return ends.withColumns({"starttime": clock_of_day(first, anchor), "dep_hour": hour_of_day(first, anchor), "simulation_day": day_index(first, anchor)})


def stationary_trips(trips: DataFrame, waypoints: DataFrame, anchor: int) -> DataFrame:
    """Two points, 60 s apart at the origin, for trips without waypoints; no time apart where that would cross midnight."""
    none = trips.join(waypoints.select(*PAIR).distinct(), PAIR, "left_anti")
    t0 = (F.lit(anchor) + F.col("starttime")).cast("long") * 1000
    span = F.when(F.col("starttime") % DAY + 60 >= DAY, 0).otherwise(60_000)
    points = F.array(F.struct(F.lit(0).alias("seq"), t0.alias("unix_time_ms")), F.struct(F.lit(1).alias("seq"), (t0 + span).alias("unix_time_ms")))
    return none.select(*PAIR, "vehicle_id", "source_id", "mode", F.col("start_lon").alias("lon"), F.col("start_lat").alias("lat"), F.explode(points).alias("p")).select("*", "p.seq", "p.unix_time_ms").drop("p")


def position_at(waypoints: DataFrame, clock: int, anchor: int) -> DataFrame:
    """Where every trip is at a clock time: interpolated within its span, absent outside, over midnight, or with one point only."""
    t = clock_of_day(F.col("unix_time_ms"), anchor)
    w = Window.partitionBy(*PAIR).orderBy("unix_time_ms", "seq")
    whole = Window.partitionBy(*PAIR).orderBy("unix_time_ms", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = waypoints.select(*PAIR, t.alias("t"), "lon", "lat", "unix_time_ms", "seq")
    d = d.select(*PAIR, "t", "lon", "lat", F.lead("t").over(w).alias("t1"), F.lead("lon").over(w).alias("lon1"), F.lead("lat").over(w).alias("lat1"), F.first("t").over(whole).alias("ta"), F.last("t").over(whole).alias("tz"), F.count(F.lit(1)).over(whole).alias("n"))
    d = d.where((F.col("n") >= 2) & (F.col("tz") >= F.col("ta")) & (F.col("ta") <= clock) & (F.col("tz") >= clock))
    # the last point at or before the clock
    d = d.where((F.col("t") <= clock) & (F.col("t1").isNull() | (F.col("t1") > clock)))
    f = F.when(F.col("t1").isNull(), F.lit(0.0)).otherwise((F.lit(clock) - F.col("t")) / (F.col("t1") - F.col("t")))
    at = lambda a, b: F.when(F.col("t1").isNull(), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * f)
    return d.select(*PAIR, at("lon", "lon1").alias("lon"), at("lat", "lat1").alias("lat"))


def backfill(trips: DataFrame, label: Column) -> DataFrame:
    """agent_id from vehicle_id and mode from its code where they are null."""
    return trips.withColumns({"agent_id": F.coalesce("agent_id", F.col("vehicle_id").cast("string")), "mode": F.coalesce(F.col("mode"), label)})
