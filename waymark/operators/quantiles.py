"""Exact quantiles of any number of values: a few rounds of counts, no task with all different values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions import exact
from waymark.shared import saved

#: Rows up to which one aggregation state may hold all different values, and counters per quantile and round beyond.
ROWS, BUCKETS = 2_000_000, 1024


def _bucket(scale: int) -> Column:
    """Which of the BUCKETS parts of lo to hi a value is in: of even width, or in every other round of even width of its logarithm."""
    f = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if scale % 2 else (lambda c: c / 2)
    v, lo, hi = f(F.col("v")), f(F.col("lo")), f(F.col("hi"))
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0).cast("int")


def selected(df: DataFrame, by: list[str], value: Column, share: float, name: str) -> DataFrame:
    """One row per group: its columns ``by`` and, as ``name``, the quantile ``share`` of ``value``, as Spark's percentile has it; nulls are left out.

    Every round counts the values of the range in which a quantile lies, by
    BUCKETS parts of that range, and goes on with the part that holds it, until
    all values of the part are the same.  A task holds a counter per part.
    """
    d = saved(df.select(*by, value.cast("double").alias("v")).where("v is not null"), "values")
    known = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = F.array_distinct(F.array(F.floor(share * (F.col("n") - 1)), F.ceil(share * (F.col("n") - 1))))
    state = saved(known.withColumn("k", F.explode(ends)).select(*by, "n", "k", "lo", "hi", F.lit(0).cast("long").alias("below")), "quantiles")
    same = lambda s: [F.col(f"d.{c}").eqNullSafe(F.col(f"{s}.{c}")) for c in by]
    scale = 0
    while state.where("lo < hi").limit(1).count():
        todo = state.where("lo < hi").alias("s")
        inside = d.alias("d").join(todo, [*same("s"), F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")])
        key = [*[F.col(f"s.{c}").alias(c) for c in by], "n", "k", "below", _bucket(scale).alias("bucket")]
        parts = inside.select(*key, "v").groupBy(*by, "n", "k", "below", "bucket").agg(F.count(F.lit(1)).alias("own"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("own").over(Window.partitionBy(*by, "k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # BUCKETS rows at most
        parts = parts.withColumn("upto", upto).withColumn("before", F.col("below") + F.col("upto") - F.col("own"))
        found = parts.where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("upto"))).select(*by, "n", "k", "lo", "hi", F.col("before").alias("below"))
        state = saved(state.where("lo >= hi").unionByName(found), "quantiles")
        scale += 1
    low, high = F.min_by("lo", "k"), F.max_by("lo", "k")
    place = F.first(share * (F.col("n") - 1))
    mixed = F.when(F.min("k") == F.max("k"), low).otherwise((F.max("k") - place) * low + (place - F.min("k")) * high)
    return state.groupBy(*by).agg(mixed.alias(name))


def aggregate(df: DataFrame, by: list[str], columns: list[Column], quantiles: dict[str, tuple[Column, float]], accuracy: int | None = None, rows: int | None = None) -> DataFrame:
    """``columns`` and ``quantiles`` (a value and a share each) per group, or of all rows without ``by``.

    Quantiles are exact.  Up to ROWS rows (``rows``, or counted) they are part
    of the one aggregation; beyond, each is found in rounds (see ``selected``).
    With ``accuracy`` they come from sketches of bounded size, their rank off by
    at most 1 / accuracy.
    """
    if accuracy is not None or (df.count() if rows is None else rows) <= ROWS:
        return df.groupBy(*by).agg(*columns, *[exact.quantile(c, share, accuracy).alias(name) for name, (c, share) in quantiles.items()])
    out = df.groupBy(*by).agg(*columns)
    for name, (c, share) in quantiles.items():
        q = selected(df, by, c, share, name)
        if by:
            named = q.select(*[F.col(x).alias(f"_{x}") for x in by], name)
            out = out.join(named, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in by], "left").drop(*[f"_{x}" for x in by])
        else:
            one = out.join(F.broadcast(q), F.lit(True), "left")  # one row each
            out = one
    return out
