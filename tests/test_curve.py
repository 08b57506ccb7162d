"""The curve's ranges hold every place of a box, and leave most files out."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import curve
from waymark.operators.filters import in_box
from waymark.schema import WAYPOINTS, conform
from waymark.sources import sinks


def test_ranges_hold_the_box(spark):
    rnd = random.Random(2)
    boxes = [(139.9, 35.6, 140.1, 35.8), (-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 0.0, 0.0), (-0.1, -0.1, 0.1, 0.1), (179.9, 89.9, 200.0, 95.0)]
    boxes += [(x, y, x + rnd.random() * 3, y + rnd.random() * 3) for x, y in ((rnd.uniform(-180, 177), rnd.uniform(-90, 87)) for _ in range(12))]
    points = [(rnd.uniform(w, e), rnd.uniform(s, n)) for w, s, e, n in boxes for _ in range(40)] + [(x, y) for w, s, e, n in boxes for x in (w, e) for y in (s, n)] + [(None, 1.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    keyed = df.withColumn("place", curve.place_key(F.col("lon"), F.col("lat"))).cache()
    for box in boxes:
        assert len(curve.box_ranges(box)) <= curve.RANGES
        assert keyed.where(in_box(box) & ~curve.in_ranges(F.col("place"), box)).count() == 0
    assert curve.box_ranges((1.0, 0.0, 0.0, 1.0)) == []
    small = sum(b - a + 1 for a, b in curve.box_ranges(boxes[0]))
    assert small < 1e-5 * 4**curve.BITS


@pytest.mark.parametrize("crowd", [0.0, 0.5])
def test_a_small_box_reads_few_files(spark, tmp_path, crowd):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    lon = F.when(u(3) < crowd, F.lit(10.0)).otherwise(139 + u(1) * 2)
    w = conform(spark.range(40_000).select(F.lit("s").alias("source_id"), F.lit("v").alias("vehicle_key"), F.col("id").alias("trip_id"), F.col("id").alias("unix_time_ms"), lon.alias("lon"), (35 + u(2)).alias("lat")), WAYPOINTS)
    path = str(tmp_path / "w")
    sinks.write_by_place(w, path, files=64)
    box = (139.5, 35.4, 139.6, 35.5)
    got, want = sinks.read_box(spark, path, box), w.where(in_box(box))
    assert sorted(map(tuple, got.select("trip_id", "lon").collect())) == sorted(map(tuple, want.select("trip_id", "lon").collect())) and want.count() > 50
    # row groups whose statistics meet a range: these alone are read
    stats = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    read = [r for r in stats if any(r["a"] <= b and r["b"] >= a for a, b in curve.box_ranges(box))]
    assert len(stats) >= 40 and len(read) <= len(stats) / 10
    assert max(r["n"] for r in stats) < 3 * 40_000 / len(stats)
    assert "GreaterThanOrEqual(place" in got._jdf.queryExecution().toString()
