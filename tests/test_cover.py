"""Points in zones by the quadtree cover against all edges of all rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import cover, zones

ZONE = "zone_id long, name string, rings array<array<array<struct<lon:double,lat:double>>>>"


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def star(rnd, x, y, r, n, closed=False):
    """A jagged ring around a place."""
    points = [(x + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return ring(points + points[:1] if closed else points)


@pytest.fixture(scope="module")
def many():
    rnd = random.Random(5)
    out = [(1, "square", [[ring([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), ring([(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5)])]])]
    out.append((2, "dented", [[star(rnd, 0.5, 0.5, 0.45, 400, True), star(rnd, 0.5, 0.5, 0.1, 60)]]))
    out.append((3, "two", [[star(rnd, 0.2, 0.7, 0.2, 9)], [star(rnd, 0.7, 0.2, 0.25, 150), ring([(0.7, 0.2), (0.72, 0.2), (0.71, 0.23)])]]))
    out.append((4, "thin", [[ring([(0.0, 0.3), (1.0, 0.3000001), (1.0, 0.3000002)])]]))
    out.append((5, "grid", [[ring([(0.1, 0.1), (0.4, 0.1), (0.4, 0.2), (0.2, 0.2), (0.2, 0.4), (0.1, 0.4)])]]))
    out.append((6, "point", [[ring([(0.6, 0.6)])]]))
    return out + [(10 + i, "small", [[star(rnd, rnd.random(), rnd.random(), 0.06, rnd.choice([3, 5, 40]))]]) for i in range(40)]


@pytest.fixture(scope="module")
def places(many):
    rnd = random.Random(6)
    out = [(rnd.random(), rnd.random()) for _ in range(1500)] + [(i / 20, j / 20) for i in range(21) for j in range(21)]
    corners = [(p["lon"], p["lat"]) for _, _, polygons in many for polygon in polygons for r in polygon for p in r]
    out += rnd.sample(corners, 200) + [(x, rnd.random()) for x, _ in rnd.sample(corners, 50)] + [(rnd.random(), y) for _, y in rnd.sample(corners, 50)]
    return [(i, *p) for i, p in enumerate(out)]


@pytest.mark.parametrize("size,edges,rims", [(0.1, 32, False), (0.37, 8, True)])
def test_cover_is_all_edges(spark, many, places, monkeypatch, size, edges, rims):
    monkeypatch.setattr(cover, "EDGES", edges)
    z = spark.createDataFrame(many, ZONE)
    p = spark.createDataFrame(places, "i long, lon double, lat double")
    want = p.crossJoin(z).where(zones.inside(F.col("rings"), F.col("lon"), F.col("lat"), rims)).select("i", "zone_id").collect()
    covered = cover.cover(z, size)
    got = cover.in_cover(p, covered, size, rims).select("i", "zone_id").collect()
    assert len(want) > 1500 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    held = covered.select(F.explode("polys").alias("p"), "level").select(F.size("p.edges").alias("n"), "level")
    assert held.where(f"level < {cover.DEEPEST}").agg(F.max("n")).first()[0] <= edges


def test_most_points_look_at_no_edge(spark):
    rnd = random.Random(7)
    z = spark.createDataFrame([(1, "coast", [[star(rnd, 0.0, 0.0, 1.0, 5000)]])], ZONE)
    c = cover.cover(z, 0.1)
    assert c.where("inner").count() > 30
    assert c.where("not inner").select(F.explode("polys").alias("p")).agg(F.avg(F.size("p.edges"))).first()[0] <= cover.EDGES


def test_no_zones_no_points(spark, many):
    z, p = spark.createDataFrame(many[:2], ZONE), spark.createDataFrame([(1, 0.6, 0.1)], "i long, lon double, lat double")
    assert cover.in_cover(p, cover.cover(z.where("false")), 0.1).count() == 0
    assert cover.in_cover(p.where("false"), cover.cover(z), 0.1).count() == 0


@pytest.mark.parametrize("size,edges,rims", [(0.1, 32, False), (0.37, 8, True)])
def test_counts_are_those_of_points_one_by_one(spark, many, places, monkeypatch, size, edges, rims):
    monkeypatch.setattr(cover, "EDGES", edges)
    covered = cover.cover(spark.createDataFrame(many, ZONE), size)
    p = spark.createDataFrame(places, "i long, lon double, lat double").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("i") % 3)))
    want = cover.in_cover(p, covered, size, rims).groupBy("zone_id").count().collect()
    assert sorted(map(tuple, cover.count_in_cover(p, covered, size, rims).collect())) == sorted(map(tuple, want))
    # many points of one place meet the zones as one
    crowd = spark.range(100_000).select(F.lit(0.6).alias("lon"), F.lit(0.1).alias("lat"))
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(cover, "_by_cell", lambda d, c, s, f=cover._by_cell: (seen.add(d.count()), f(d, c, s))[1])
    assert (1, 100_000) in set(map(tuple, cover.count_in_cover(crowd, covered, size, rims).collect())) and seen.value == 1
