"""Gap splitting and hourly density over streams of pings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.functions.grid import grid_round


def _timed(pings: DataFrame) -> DataFrame:
    return pings.withColumn("ts", F.timestamp_millis("unix_time_ms"))


def gap_split(pings: DataFrame, gap_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Stretches of pings per vehicle that no gap of ``gap_minutes`` breaks; late pings are taken within ``late``."""
    s = F.session_window("ts", f"{gap_minutes} minutes")
    d = _timed(pings).withWatermark("ts", late).groupBy("vehicle_key", s.alias("w")).agg(F.count(F.lit(1)).alias("pings"), F.min("unix_time_ms").alias("first_ms"), F.max("unix_time_ms").alias("last_ms"))
    return d.drop("w")


def density_hourly(pings: DataFrame, resolution: float = 0.005, late: str = "1 hour") -> DataFrame:
    """Pings per hour and rounded cell."""
    cell = [grid_round(F.col("lon"), resolution).alias("grid_lon"), grid_round(F.col("lat"), resolution).alias("grid_lat")]
    d = _timed(pings).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), *cell).agg(F.count(F.lit(1)).alias("weight"))
    return d.select((F.unix_seconds("w.start") * 1000).alias("hour_ms"), "grid_lon", "grid_lat", "weight")
