"""Counts, summaries and options over trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions import exact
from waymark.operators.quantiles import aggregate

#: Scale classes by numbers of agents and waypoints.
MACRO_AGENTS, MACRO_WAYPOINTS, MICRO_AGENTS, MICRO_WAYPOINTS = 1_000_000, 10_000_000, 10_000, 1_000_000
#: Columns that not every source fills.
SPARSE = ("purpose", "goods_type", "vehicle_size", "cargo_loaded", "origin_zone", "dest_zone", "fare_yen", "passenger_in", "distance_km")


def table_stats(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Per source: trips, bounds of their starts, range of starts, and waypoints."""
    t = trips.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("trips"), F.min("start_lon").alias("min_lon"), F.max("start_lon").alias("max_lon"), F.min("start_lat").alias("min_lat"),
        F.max("start_lat").alias("max_lat"), F.min("starttime").alias("first_start"), F.max("starttime").alias("last_start"),
    )
    w = waypoints.groupBy("source_id").agg(F.count(F.lit(1)).alias("waypoints"))
    return t.join(w, "source_id", "left").withColumn("waypoints", F.coalesce("waypoints", F.lit(0)))


def insights_core(trips: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Number, vehicles and distances of trips; total_vkt_km is the mean times the number, so unknown distances count as the mean.  ``accuracy``: see ``quantiles.aggregate``."""
    d = F.col("distance_km")
    columns = [F.count(F.lit(1)).alias("trips"), F.countDistinct("vehicle_key").alias("vehicles"), F.avg(d).alias("avg_km"), F.max(d).alias("max_km"), F.stddev_samp(d).alias("std_km"), (F.avg(d) * F.count(F.lit(1))).alias("total_vkt_km")]
    return aggregate(trips, [], columns, {"median_km": (d, 0.5)}, accuracy)


def insights_fleet(trips: DataFrame) -> DataFrame:
    n = trips.groupBy("vehicle_key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.avg("n").alias("avg_trips"), F.min("n").alias("min_trips"), F.max("n").alias("max_trips"))


def hour_counts(trips: DataFrame) -> DataFrame:
    return trips.groupBy("dep_hour").agg(F.count(F.lit(1)).alias("trips"))


def insights_peak(trips: DataFrame) -> DataFrame:
    """The busiest hour and its share in percent; the window is over at most 25 grouped rows."""
    h = hour_counts(trips).withColumn("pct", 100.0 * F.col("trips") / F.sum("trips").over(Window.partitionBy()))
    return h.orderBy(F.col("trips").desc(), F.col("dep_hour").asc_nulls_last()).limit(1)


def insights_offpeak(trips: DataFrame) -> DataFrame:
    """The quietest hour and how many times busier the busiest is."""
    h = hour_counts(trips).withColumn("top", F.max("trips").over(Window.partitionBy()))
    return h.orderBy("trips", F.col("dep_hour").asc_nulls_last()).limit(1).select("dep_hour", "trips", (F.col("top") / F.col("trips")).alias("ratio"))


def insights_fare(trips: DataFrame, accuracy: int | None = None) -> DataFrame:
    fare, night = F.col("fare_yen"), F.col("is_night_trip")
    columns = [F.avg(fare).alias("avg_fare"), F.max(fare).alias("max_fare"), F.avg(F.when(night, fare)).alias("night_fare"), F.avg(F.when(~night, fare)).alias("day_fare"), (100.0 * F.count_if(night) / F.count(F.lit(1))).alias("night_pct")]
    return aggregate(trips.where(fare.isNotNull()), [], columns, {"median_fare": (fare, 0.5)}, accuracy)


def insights_modes(trips: DataFrame) -> DataFrame:
    return trips.groupBy("transport_mode").agg(F.count(F.lit(1)).alias("trips"))


def distance_buckets(trips: DataFrame, width: float = 2.0, first: int = 25) -> DataFrame:
    """Trips per ``width`` km of distance, the ``first`` buckets."""
    b = (F.floor(F.col("distance_km") / width) * width).cast("double")
    return trips.where("distance_km is not null").groupBy(b.alias("bucket_km")).agg(F.count(F.lit(1)).alias("trips")).orderBy("bucket_km").limit(first)


def scenario_impact(trips: DataFrame, hits: DataFrame) -> DataFrame:
    """Number and distance of the car trips that enter a box."""
    gone = trips.where("transport_mode = 3").join(hits, ["vehicle_key", "trip_id"], "left_semi")
    return gone.agg(F.count(F.lit(1)).alias("removed_trips"), F.coalesce(F.sum("distance_km"), F.lit(0.0)).alias("removed_vkt_km"))


def distinct_values(trips: DataFrame, column: str) -> DataFrame:
    return trips.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def options_sources(trips: DataFrame) -> DataFrame:
    """Distinct sources, days and goods types as (kind, value)."""
    one = lambda kind, c: trips.where(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")).distinct()
    return one("source", "source_id").unionByName(one("day", "simulation_day")).unionByName(one("goods", "goods_type"))


def city_centers(trips: DataFrame) -> DataFrame:
    return trips.where("city is not null").groupBy("city").agg(exact.mean(F.col("start_lon")).alias("lon"), exact.mean(F.col("start_lat")).alias("lat"))


def options_modes(trips: DataFrame) -> DataFrame:
    """Label, a code and number of trips of every mode."""
    return trips.where("mode is not null").groupBy("mode").agg(F.min("transport_mode").alias("code"), F.count(F.lit(1)).alias("trips"))


def metric_availability(trips: DataFrame) -> DataFrame:
    known = lambda c: (F.count(c) > 0).alias(f"has_{c.split('_')[0]}")
    return trips.groupBy("source_id").agg(*[known(c) for c in ("speed_avg_kmh", "dwell_minutes", "detour_ratio")])


def capabilities(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    """One row: sizes, distinct agents, and which sparse columns are filled; one pass over each table."""
    have = [c for c in SPARSE if c in trips.columns]
    t = trips.agg(F.count(F.lit(1)).alias("trips"), F.countDistinct("vehicle_key").alias("agents"), *[(F.count(c) > 0).alias(f"has_{c}") for c in have], (F.count("leg_id") > 0).alias("has_legs"), (F.count("mode") > 0).alias("has_modes"))
    return t.join(waypoints.agg(F.count(F.lit(1)).alias("waypoints")))


def detect_scale(row: DataFrame, override: str | None = None) -> DataFrame:
    """micro, meso or macro by the numbers of agents and waypoints, unless it is set by name."""
    names = {"micro": "micro", "small": "micro", "meso": "meso", "medium": "meso", "macro": "macro", "large": "macro"}
    if override:
        return row.withColumn("scale", F.lit(names[override]))
    a, w = F.col("agents"), F.col("waypoints")
    scale = F.when((a >= MACRO_AGENTS) | (w >= MACRO_WAYPOINTS), "macro").when((a < MICRO_AGENTS) & (w < MICRO_WAYPOINTS), "micro").otherwise("meso")
    return row.withColumn("scale", scale)


def source_styles(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Sources, and whether they have waypoints."""
    have = waypoints.select("source_id").distinct().withColumn("_w", F.lit(True))
    return trips.select("source_id").distinct().join(have, "source_id", "left").select("source_id", F.coalesce("_w", F.lit(False)).alias("has_waypoints"))


def vehicle_search(trips: DataFrame, predicate: Column, limit: int = 50) -> DataFrame:
    """Trips, first and last start and distance of the vehicles that match."""
    d = trips.where(predicate).groupBy("vehicle_key").agg(F.count(F.lit(1)).alias("trips"), F.min("starttime").alias("first_start"), F.max("starttime").alias("last_start"), F.sum("distance_km").alias("total_km"))
    return d.orderBy(F.col("trips").desc(), "vehicle_key").limit(limit)


def poi_categories(pois: DataFrame) -> DataFrame:
    return pois.groupBy("source_key", "category").agg(F.count(F.lit(1)).alias("pois"))


def attr_legend(rows: DataFrame, column: str, top: int = 12) -> DataFrame:
    """The most frequent values, and one row for the others together if there are more."""
    n = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    first = n.orderBy(F.col("n").desc(), "value").limit(top)
    shown = first.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "value")).alias("rank"), "value", "n")  # over ``top`` rows
    every = n.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    rest = every.join(first.agg(F.count(F.lit(1)).alias("k0"), F.sum("n").alias("n0")))  # one row beside one row
    rest = rest.select((F.col("k") - F.col("k0")).alias("k"), (F.col("n") - F.col("n0")).alias("n")).where("k > 0")
    return shown.unionByName(rest.select(F.lit(top + 1).alias("rank"), F.concat(F.lit("+"), F.col("k").cast("string"), F.lit(" more")).alias("value"), "n"))


def bbox_union(boxes: DataFrame) -> DataFrame:
    """Union of the valid boxes (west, south, east, north); others are skipped."""
    names = ("west", "south", "east", "north")
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = ok & (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north"))
    return boxes.where(ok).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def ingest_failures(log: DataFrame, last: int = 5) -> DataFrame:
    return log.where("row_count < 0").orderBy(F.col("ingested_at").desc(), "file_path").limit(last)


def uncovered_sources(trips: DataFrame, registered: DataFrame) -> DataFrame:
    """Sources that have trips but are not registered."""
    return trips.select("source_id").distinct().join(registered, "source_id", "left_anti")


def table_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two builds of a table: rows per key on both sides, and rows that only one side has."""
    count = lambda d, n: d.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    only = lambda x, y, n: x.exceptAll(y).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    out = count(a, "rows_a").join(count(b, "rows_b"), key, "full").join(only(a, b, "only_a"), key, "left").join(only(b, a, "only_b"), key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_a", "rows_b", "only_a", "only_b")])
