"""Quantiles found in rounds are those of one aggregation, to the bit."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import compare, quantiles, stats
from waymark.plans import analysis
from waymark.plans.views import Views


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(3)
    rows = [("even", rnd.random() * 100) for _ in range(501)] + [("log", 10 ** rnd.uniform(-300, 300) * rnd.choice([-1, 1])) for _ in range(400)]
    rows += [("copies", rnd.choice([1.0, 1.0, 1.0, 2.5])) for _ in range(300)] + [("one", -0.0)] + [("two", 1.1), ("two", 0.3)] + [("edge", x) for x in (1.7e308, -1.7e308, 5e-324, 0.0)]
    rows += [("near", 1 + i * 2.0**-52) for i in range(64)] + [(None, float(i)) for i in range(10)] + [("none", None), ("even", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


@pytest.mark.parametrize("share", [0.5, 0.9, 0.0, 1.0, 0.123])
def test_rounds_are_percentiles(spark, values, monkeypatch, share):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    want = {r["g"]: r["q"] for r in values.groupBy("g").agg(F.percentile("v", F.lit(share)).alias("q")).collect()}
    got = {r["g"]: r["q"] for r in quantiles.selected(values, ["g"], F.col("v"), share, "q").collect()}
    assert got == {g: q for g, q in want.items() if q is not None}


@pytest.mark.parametrize("rows", [10**9, 0])
def test_aggregate_is_the_same_at_any_size(spark, values, monkeypatch, rows):
    monkeypatch.setattr(quantiles, "ROWS", rows)
    for by in ([], ["g"]):
        got = quantiles.aggregate(values, by, [F.count(F.lit(1)).alias("n")], {"m": (F.col("v"), 0.5), "p": (F.abs("v"), 0.9)}).collect()
        want = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("m"), F.percentile(F.abs("v"), F.lit(0.9)).alias("p")).collect()
        key = lambda r: tuple(map(str, (r.asDict().get("g"), r["n"], r["m"], r["p"])))
        assert sorted(map(key, got)) == sorted(map(key, want))


def test_reports_are_the_same_in_rounds(spark, monkeypatch):
    v = Views(spark, "/root/testdata/sf0.001")
    both = analysis.both(v)
    for report in (lambda: stats.insights_core(v.trips), lambda: stats.insights_fare(v.trips), lambda: compare.fleet_summary(v.trips, "source_id"), lambda: compare.matched_delta(both), lambda: compare.alignment(both)):
        monkeypatch.setattr(quantiles, "ROWS", 10**9)
        plain = report()
        want = sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in plain.collect())
        monkeypatch.setattr(quantiles, "ROWS", 0)
        assert sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in report().select(plain.columns).collect()) == want
