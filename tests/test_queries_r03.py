"""Queries at sizes and ties that the supplied tables do not show."""

import re

import duckdb
from pyspark.sql import functions as F

from waymark.functions.exact import mean_of_millionths
from waymark.operators import derive, mining, profile, trajectories
from waymark.plans import analysis, ingest, joins, registry, views


def test_sum_of_times_beyond_a_long(spark):
    w = spark.range(10).select(F.col("id").alias("trip_id"), F.lit(2**62).alias("unix_time_ms"))
    assert tuple(joins._points(w).first()) == (10, 10, 10 * 2**62)
    few = joins._points(w.where("id < 1"))
    assert tuple(few.first()) == (1, 1, 2**62) and dict(few.dtypes)["ms"] == "bigint"
    assert tuple(joins._points(w.where("false")).first()) == (0, 0, None)


def test_profile_sql_states_the_rule_of_the_kind_of_time(spark):
    # numbers beyond two days are no seconds of a day, at whatever size of the tables
    for ids in ([5, 200_000], [5, 7], [200_000_000, 300_000_000], [200_000_000_000], [None]):
        con = duckdb.connect()
        con.execute("CREATE TABLE trips (vehicle_id BIGINT)")
        con.executemany("INSERT INTO trips VALUES (?)", [[i] for i in ids])
        got = profile.profile_columns(spark.createDataFrame([(i,) for i in ids], "vehicle_id long")).drop("sample")
        rows = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in got.columns)} FROM ({analysis._profile_sql('vehicle_id', 'vehicle', None)})").fetchall()
        assert [tuple(r) for r in got.collect()] == rows


WAYPOINTS = "vehicle_key string, trip_id long, link_id string, unix_time_ms long, seq int, lon double, lat double"
TIED = [("v", 1, "L2", 1000, 1, 139.5, 35.5), ("v", 1, "L1", 1000, 1, 139.5, 35.5), ("v", 1, "L4", 9000, 2, 139.6, 35.5), ("v", 1, "L3", 9000, 2, 139.6, 35.5)]


def tied(spark, rows):
    return spark.createDataFrame(rows, WAYPOINTS).coalesce(1)


def test_segments_of_waypoints_of_one_time(spark):
    for rows in (TIED, TIED[::-1]):
        got = derive.segments(tied(spark, rows)).orderBy("unix_time_ms", "link_id").select("link_id", "speed_kmh").collect()
        assert [(r.link_id, r.speed_kmh is None) for r in got] == [("L2", True), ("L3", False), ("L4", True)]


def test_mean_speed_is_exact(spark):
    # a double sum in this order loses the 0.3
    rows = spark.createDataFrame([(1, 1e17 / 1e6), (1, 0.3), (1, 0.000001), (2, None)], "k int, x double")
    got = {r.k: r.m for r in rows.groupBy("k").agg(mean_of_millionths(F.col("x")).alias("m")).collect()}
    assert got == {1: (2 * (10**17 + 300_001) + 3) // 6 / 1e6, 2: None}
    detail = trajectories.trajectory_detail(tied(spark, TIED)).collect()
    assert detail == trajectories.trajectory_detail(tied(spark, TIED[::-1])).collect() and detail[0].links == 3


def test_top_links_of_waypoints_of_one_time(spark):
    for rows in (TIED, TIED[::-1]):
        assert [r.link_id for r in trajectories.top_links(tied(spark, rows)).orderBy("rank").collect()] == ["L2", "L3", "L4"]


def test_route_clusters_of_long_chains(spark):
    # each trip shares half of its links with the next one: one cluster, 300 steps long
    con = duckdb.connect()
    con.execute("CREATE TABLE waypoints AS SELECT 'v' AS vehicle_key, i AS trip_id, 'L' || (i + k) AS fine_link_id FROM range(300) a(i), range(3) b(k) UNION ALL SELECT 'v', 1000, 'M'")
    w = spark.createDataFrame(con.execute("SELECT * FROM waypoints").fetchall(), "vehicle_key string, trip_id long, fine_link_id string")
    rows = sorted(con.execute(f"SELECT trip_id, cluster FROM ({analysis._ROUTE_CLUSTERS})").fetchall())
    assert rows == [*((i, 0) for i in range(300)), (1000, None)]
    got = mining.route_similarity(w, "fine_link_id", 0.5, 2, F.col("trip_id")).select("trip_id", "cluster")
    assert sorted(map(tuple, got.collect())) == rows


def test_large_joins_are_dealt_by_rows(spark, monkeypatch):
    small = views.Views(spark, "/root/testdata/sf0.001").waypoints
    assert small.count() == 6000
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    v = views.Views(spark, "/root/testdata/sf0.001")
    rows = v.waypoints.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 12 and max(r["count"] for r in rows) < 1500
    assert v.waypoints.exceptAll(small).count() == 0 and v.waypoints.count() == 6000


def test_agent_events_are_dealt_by_rows(spark, monkeypatch):
    run = registry.queries()["scan_agent_events_xml"]
    want = sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(ingest, "TASK_ROWS", 500)
    got = run(spark, "/root/testdata/sf0.001")
    assert ingest._parts(views.Views(spark, "/root/testdata/sf0.001"), 3) == 9 and got.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, got.collect())) == want


def test_sets_that_share_one_link_are_not_compared(spark, monkeypatch):
    # any two of 7 sets of 6 links share one link: 4 would make them near
    met, compared = [], mining._compared
    monkeypatch.setattr(mining, "_compared", lambda d, most: (met.append(d.count()), compared(d, most))[1])
    rows = [("v", i, f"L{min(i, j)}_{max(i, j)}") for i in range(7) for j in range(7) if i != j]
    for links in (rows, [*rows, *(("v", 7, x) for _, i, x in rows if i == 0)]):
        got = mining.jaccard_pairs(spark.createDataFrame(links, "vehicle_key string, trip_id long, link_id string"), 0.5, F.col("trip_id"))
        assert [(r.a, r.b, r.shared) for r in got.collect()] == ([] if links is rows else [(0, 7, 6)])
    assert met[0] == 0  # 6 pairs by sizes and places alone


def test_sums_per_link_and_vehicle_are_dealt_by_rows(spark, monkeypatch):
    run = registry.queries()["link_density"]
    want = sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    got = run(spark, "/root/testdata/sf0.001")
    assert re.search(r"RepartitionByExpression \[link_id#\d+, vehicle_key#\d+\], 12", got._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(tuple, got.collect())) == want
