"""Distributions over hours and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.operators.stats import hour_counts


def hours(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def departures(trips: DataFrame, sources: list[str]) -> DataFrame:
    """Trips per hour and source, all 24 hours, and their total; one column per listed source."""
    inside = trips.where("dep_hour between 0 and 23")
    n = inside.groupBy(F.col("dep_hour").alias("hour")).agg(*[F.count_if(F.col("source_id") == s).alias(s) for s in sources], F.count(F.lit(1)).alias("total"))
    filled = hours(trips.sparkSession).join(n, "hour", "left")
    return filled.select("hour", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*sources, "total"]]).orderBy("hour")


def peaks(trips: DataFrame) -> DataFrame:
    """Hours above the mean of the hourly counts plus half their (population) deviation; unknown and odd hours count as hours."""
    h = hour_counts(trips)
    level = h.agg((F.avg("trips") + 0.5 * F.stddev_pop("trips")).alias("level"))
    return h.join(F.broadcast(level)).where(F.col("trips") > F.col("level")).select("dep_hour", "trips", "level")


def distance_hist(trips: DataFrame, bin_km: float = 10.0) -> DataFrame:
    b = (F.floor(F.col("distance_km") / bin_km) * bin_km).cast("double")
    return trips.where("distance_km is not null").groupBy(b.alias("bin_km"), "source_id").agg(F.count(F.lit(1)).alias("trips"))


def metric_hist(trips: DataFrame, metric: str, bins: int = 20) -> DataFrame:
    """Equal bins over the metric's range, all of them; the largest value is in the last; no rows if there is one value or none."""
    x = F.col(metric).cast("double")
    known = trips.where(x.isNotNull()).select(x.alias("x"))
    span = known.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    n = known.join(F.broadcast(span)).groupBy(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select("lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n"))
