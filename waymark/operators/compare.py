"""One fleet against another: one scan of both, conditional aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.grid import cell_centre, cell_floor
from waymark.operators.quantiles import aggregate

#: Fixed values of the alignment score.
TIME_CAP_S, LEAST_KM, BUCKETS = 4 * 3600, 1.0, 10


def sides(trips: DataFrame, a: Column, b: Column) -> DataFrame:
    """Trips of either fleet with ``side`` 0 (A) or 1 (B)."""
    return trips.withColumn("side", F.when(a, 0).when(b, 1)).where("side is not null")


def _a(x: Column) -> Column:
    return F.when(F.col("side") == 0, x)


def _b(x: Column) -> Column:
    return F.when(F.col("side") == 1, x)


def fleet_summary(trips: DataFrame, by: str, accuracy: int | None = None) -> DataFrame:
    """Numbers and distances per fleet; ``accuracy``: see ``quantiles.aggregate``."""
    d = F.col("distance_km")
    columns = [F.count(F.lit(1)).alias("trips"), F.countDistinct("vehicle_id").alias("vehicles"), F.sum(d).alias("total_km"), F.avg(d).alias("avg_km"), F.max(d).alias("max_km"), F.min("starttime").alias("first_start"), F.max("starttime").alias("last_start")]
    return aggregate(trips, [by], columns, {"median_km": (d, 0.5)}, accuracy)


def two_proportion_z(x_a: Column, n_a: Column, x_b: Column, n_b: Column) -> Column:
    """Pooled z of two shares; null if a side is empty, 0 if there is no spread."""
    pool = (x_a + x_b) / (n_a + n_b)
    se = F.sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b))
    return F.when((n_a > 0) & (n_b > 0), F.when(se > 0, (x_b / n_b - x_a / n_a) / se).otherwise(0.0))


def mode_shares(both: DataFrame) -> DataFrame:
    """Counts and shares of each mode on both sides, their difference in points, and z."""
    d = both.groupBy("mode").agg(F.count(_a(F.lit(1))).alias("trips_a"), F.count(_b(F.lit(1))).alias("trips_b"))
    w = Window.partitionBy()
    d = d.withColumns({"n_a": F.sum("trips_a").over(w), "n_b": F.sum("trips_b").over(w)})
    share = lambda x, n: 100.0 * F.try_divide(F.col(x), F.col(n))
    z = two_proportion_z(F.col("trips_a").cast("double"), F.col("n_a").cast("double"), F.col("trips_b").cast("double"), F.col("n_b").cast("double"))
    return d.select("mode", "trips_a", "trips_b", share("trips_a", "n_a").alias("pct_a"), share("trips_b", "n_b").alias("pct_b"), (share("trips_b", "n_b") - share("trips_a", "n_a")).alias("delta_pp"), z.alias("z"))


def with_p_values(shares: DataFrame) -> DataFrame:
    """Adds the two-sided p of z: erfc(|z| / sqrt 2), by a rational approximation within 1.2e-7."""
    x = F.abs(F.col("z")) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    #: Coefficients of the approximation, constant term first.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = poly * t + c
    return shares.withColumn("p_value", F.round(F.least(F.lit(1.0), t * F.exp(-x * x + poly)), 4))


def compare_hourly(both: DataFrame) -> DataFrame:
    """All 24 hours with the counts of both sides."""
    n = both.where("dep_hour between 0 and 23").groupBy(F.col("dep_hour").alias("hour")).agg(F.count(_a(F.lit(1))).alias("trips_a"), F.count(_b(F.lit(1))).alias("trips_b"))
    hours = both.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(n, "hour", "left").select("hour", F.coalesce("trips_a", F.lit(0)).alias("trips_a"), F.coalesce("trips_b", F.lit(0)).alias("trips_b"))


def compare_distance_hist(both: DataFrame, bins: int = 20) -> DataFrame:
    """``bins`` equal bins over 0 to the largest distance of either side; below 0 is left out, the largest is in the last bin."""
    known = both.where("distance_km is not null")
    top = known.agg(F.max("distance_km").alias("top")).where("top > 0")
    b = F.least(F.floor(F.col("distance_km") / (F.col("top") / bins)), F.lit(bins - 1)).cast("int")
    n = known.join(F.broadcast(top)).groupBy(b.alias("bin")).agg(F.count(_a(F.lit(1))).alias("trips_a"), F.count(_b(F.lit(1))).alias("trips_b")).where("bin >= 0")
    grid = top.select((F.col("top") / bins).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(n, "bin", "left").select("bin", (F.col("bin") * F.col("width")).alias("lo"), F.coalesce("trips_a", F.lit(0)).alias("trips_a"), F.coalesce("trips_b", F.lit(0)).alias("trips_b"))


def person_counts(both: DataFrame) -> DataFrame:
    """Trips of each person on both sides; persons are matched by bare vehicle_id, on purpose."""
    return both.groupBy("vehicle_id").agg(F.count(_a(F.lit(1))).alias("trips_a"), F.count(_b(F.lit(1))).alias("trips_b"))


def matched_full(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same from two tables: a full outer join, a missing side counts 0."""
    one = lambda d, n: d.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias(n))
    d = one(a, "trips_a").join(one(b, "trips_b"), "vehicle_id", "full")
    return d.select("vehicle_id", F.coalesce("trips_a", F.lit(0)).alias("trips_a"), F.coalesce("trips_b", F.lit(0)).alias("trips_b"))


def matched_delta(both: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Persons on both sides, and how their numbers of trips differ over all persons; ``accuracy``: see ``quantiles.aggregate``."""
    d = person_counts(both).withColumn("delta", F.col("trips_b") - F.col("trips_a"))
    columns = [F.count_if((F.col("trips_a") > 0) & (F.col("trips_b") > 0)).alias("matched"), F.avg("delta").alias("mean_delta"), F.max(F.abs("delta")).alias("max_abs")]
    return aggregate(d, [], columns, {"median_delta": (F.col("delta"), 0.5), "p90_abs": (F.abs("delta"), 0.9)}, accuracy, both.count())


def matched_top(both: DataFrame, n: int = 10) -> DataFrame:
    d = person_counts(both).withColumn("delta", F.col("trips_b") - F.col("trips_a"))
    return d.orderBy(F.abs("delta").desc(), "vehicle_id").limit(n)


def wilcoxon(both: DataFrame) -> DataFrame:
    """Signed-rank statistic (the lesser rank sum) of persons on both sides, with ties at their mean rank, and the normal z.

    No row below 8 persons or if nobody differs.  Ranks of equal differences
    come from counts per difference, so no window spans all persons: it has a
    row per size of difference, which one person's trips bound.
    """
    d = person_counts(both).where("trips_a > 0 and trips_b > 0").withColumn("delta", F.col("trips_b") - F.col("trips_a"))
    persons = d.agg(F.count(F.lit(1)).alias("n_pairs"))
    per = d.where("delta <> 0").groupBy(F.abs("delta").alias("size")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("delta") > 0).alias("plus"))
    below = F.sum("k").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("k") + 1) / 2)
    s = per.agg(F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("k") - F.col("plus"))).alias("w_minus"), F.sum("k").cast("double").alias("n"), F.sum(F.pow(F.col("k").cast("double"), F.lit(3.0)) - F.col("k")).alias("ties"))
    n = F.col("n")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    w = F.least("w_plus", "w_minus")
    return s.join(persons).where("n_pairs >= 8 and n > 0").select("n_pairs", w.alias("statistic"), ((w - n * (n + 1) / 4) / se).alias("z"))


def rank_pairs(both: DataFrame) -> DataFrame:
    """The k-th trip of a person in A beside the k-th in B, by start."""
    rn = F.row_number().over(Window.partitionBy("side", "vehicle_id").orderBy("starttime", "trip_id"))
    r = both.select("side", "vehicle_id", "starttime", "distance_km", rn.alias("rn"))
    pair = r.groupBy("vehicle_id", "rn").agg(
        F.max(_a(F.col("starttime"))).alias("start_a"), F.max(_b(F.col("starttime"))).alias("start_b"), F.max(_a(F.col("distance_km"))).alias("dist_a"), F.max(_b(F.col("distance_km"))).alias("dist_b"),
    )
    return pair.where("start_a is not null and start_b is not null")


def pair_scores(both: DataFrame) -> DataFrame:
    late = F.least(F.abs(F.col("start_b") - F.col("start_a")), F.lit(TIME_CAP_S)) / F.lit(float(TIME_CAP_S))
    far = F.when(F.col("dist_a").isNull() | F.col("dist_b").isNull(), 0.0).otherwise(F.abs(F.col("dist_a") - F.col("dist_b")) / F.greatest("dist_a", "dist_b", F.lit(LEAST_KM)))
    return rank_pairs(both).withColumn("score", 1.0 - 0.5 * (late + far))


def person_scores(both: DataFrame) -> DataFrame:
    return pair_scores(both).groupBy("vehicle_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("pairs"))


def alignment(both: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Persons, pairs, and mean and median of the persons' mean scores; ``accuracy``: see ``quantiles.aggregate``."""
    columns = [F.count(F.lit(1)).alias("persons"), F.sum("pairs").alias("pairs"), F.avg("score").alias("mean")]
    return aggregate(person_scores(both), [], columns, {"median": (F.col("score"), 0.5)}, accuracy, both.count())


def alignment_hist(both: DataFrame) -> DataFrame:
    b = F.least(F.floor(F.round(F.col("score"), 9) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    n = person_scores(both).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("persons"))
    grid = both.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return grid.join(n, "bucket", "left").select("bucket", F.coalesce("persons", F.lit(0)).alias("persons"))


def compare_multi(trips: DataFrame, sources: list[str]) -> DataFrame:
    """Summaries of two to four sources in one pass."""
    if not 2 <= len(sources) <= 4:
        raise ValueError("two to four sources")
    return fleet_summary(trips.where(F.col("source_id").isin(*sources)), "source_id")


def compare_multi_modes(trips: DataFrame, sources: list[str]) -> DataFrame:
    d = trips.where(F.col("source_id").isin(*sources)).groupBy("source_id", "mode").agg(F.count(F.lit(1)).alias("trips"))
    return d.withColumn("pct", 100.0 * F.col("trips") / F.sum("trips").over(Window.partitionBy("source_id")))


def compare_multi_hourly(trips: DataFrame, sources: list[str]) -> DataFrame:
    from waymark.operators.temporal import departures

    return departures(trips.where(F.col("source_id").isin(*sources)), sources).drop("total")


def compare_grid(both: DataFrame, cell_deg: float = 0.005) -> DataFrame:
    """Starts per floored cell on both sides, and B less A."""
    d = both.where("start_lon is not null").groupBy(cell_floor(F.col("start_lon"), cell_deg).alias("ix"), cell_floor(F.col("start_lat"), cell_deg).alias("iy"))
    d = d.agg(F.count(_a(F.lit(1))).alias("trips_a"), F.count(_b(F.lit(1))).alias("trips_b"))
    return d.select(cell_centre(F.col("ix"), cell_deg).alias("lon"), cell_centre(F.col("iy"), cell_deg).alias("lat"), "trips_a", "trips_b", (F.col("trips_b") - F.col("trips_a")).alias("delta"))


def compare_report(both: DataFrame) -> DataFrame:
    """The parts of a comparison as rows of (part, key, value of A, value of B)."""
    row = lambda d, part, key, a, b: d.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    whole = both.agg(F.count(_a(F.lit(1))).alias("a"), F.count(_b(F.lit(1))).alias("b")).withColumn("k", F.lit("trips"))
    return row(whole, "summary", "k", "a", "b").unionByName(row(mode_shares(both), "modes", "mode", "pct_a", "pct_b")).unionByName(row(compare_hourly(both), "hours", "hour", "trips_a", "trips_b")).unionByName(row(compare_distance_hist(both), "distance", "bin", "trips_a", "trips_b"))
