"""Chains of a vehicle's trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from waymark.functions.geo import equirect_km

#: Order of a vehicle's trips; day and id decide between equal starts.
ORDER = ("starttime", "simulation_day", "trip_id")


def chain_lengths(trips: DataFrame, min_length: int = 1) -> DataFrame:
    n = trips.groupBy("vehicle_key").agg(F.count(F.lit(1)).alias("length"))
    return n.where(F.col("length") >= min_length).groupBy("length").agg(F.count(F.lit(1)).alias("vehicles"))


def dwell_bins(trips: DataFrame) -> DataFrame:
    """Times from start to next start in six bins, over all vehicles of two trips or more."""
    gap = F.lead("starttime").over(Window.partitionBy("vehicle_key").orderBy(*ORDER)) - F.col("starttime")
    d = trips.withColumn("gap", gap).where("gap is not null")
    b = F.when(F.col("gap") < 600, "0-10min").when(F.col("gap") < 1800, "10-30min").when(F.col("gap") < 3600, "30-60min").when(F.col("gap") < 7200, "1-2hr").when(F.col("gap") < 14400, "2-4hr").otherwise("4hr+")
    return d.groupBy(b.alias("dwell_bin")).agg(F.count(F.lit(1)).alias("n"))


def round_trips(trips: DataFrame, threshold_km: float = 2.0) -> DataFrame:
    """Vehicles of two trips or more whose last end is near their first start."""
    by = F.struct(*ORDER)
    v = trips.groupBy("vehicle_key").agg(F.count(F.lit(1)).alias("n"), F.min_by("start_lon", by).alias("x0"), F.min_by("start_lat", by).alias("y0"), F.max_by("end_lon", by).alias("x1"), F.max_by("end_lat", by).alias("y1")).where("n >= 2")
    back = equirect_km(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= threshold_km
    return v.agg(F.count_if(back).alias("round_trip"), F.count_if(~back).alias("open"), F.avg(F.when(back, F.col("n"))).alias("avg_trips_round"), F.avg(F.when(~back, F.col("n"))).alias("avg_trips_open"))


def commodity_sequences(trips: DataFrame, top_n: int = 20) -> DataFrame:
    """The most common orders of goods over a vehicle's trips."""
    parts = F.array_sort(F.collect_list(F.struct(*ORDER, "goods_type")))
    s = trips.where("goods_type is not null").groupBy("vehicle_key").agg(parts.alias("p")).select(F.array_join(F.transform("p", lambda x: x["goods_type"]), " → ").alias("sequence"))
    return s.groupBy("sequence").agg(F.count(F.lit(1)).alias("vehicles")).orderBy(F.col("vehicles").desc(), "sequence").limit(top_n)


def multi_stop(trips: DataFrame, min_stops: int = 3, limit: int = 100) -> DataFrame:
    """The trips, in order, of the vehicles with most of them."""
    n = trips.groupBy("vehicle_key").agg(F.count(F.lit(1)).alias("stops")).where(F.col("stops") >= min_stops)
    top = n.orderBy(F.col("stops").desc(), "vehicle_key").limit(limit)
    seq = F.row_number().over(Window.partitionBy("vehicle_key").orderBy(*ORDER))
    return trips.join(F.broadcast(top), "vehicle_key").select("vehicle_key", "stops", seq.alias("seq"), "trip_id", "starttime", "start_lon", "start_lat", "end_lon", "end_lat", "distance_km", "goods_type")
