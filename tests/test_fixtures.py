"""Operators on small hand-made rows with values worked out by hand."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.functions import classes, clock, draw, exact, geo, modes
from waymark.operators import chains, compare, derive, graphs, mining, profile, stats, temporal, zones
from waymark.operators.filters import TripFilter, hour_guard, in_radius, radius_box, vehicle_list, vehicle_prefix
from waymark.operators.trajectories import assemble, compact_trails
from waymark.schema import TRIPS, conform
from waymark.sources import files, mapping, sinks

TRIP = "vehicle_key string, trip_id long, source_id string, vehicle_id int, starttime int, simulation_day int, dep_hour int, transport_mode int, mode string, start_lon double, start_lat double, end_lon double, end_lat double, distance_km double, goods_type string"


@pytest.fixture(scope="module")
def trips(spark):
    """Two fleets that share bare ids; a NULL mode, an odd hour, an unknown distance."""
    rows = [
        ("a:1", 1, "a", 1, 28800, 0, 8, 3, "Car", 139.0, 35.0, 139.1, 35.0, 12.0, "food"),
        ("a:1", 2, "a", 1, 36000, 0, 10, 3, "Car", 139.1, 35.0, 139.2, 35.0, 9.0, "steel"),
        ("a:1", 3, "a", 1, 46800, 0, 13, 0, "Walk", 139.2, 35.0, 139.001, 35.0, None, "food"),
        ("a:2", 1, "a", 2, 30000, 0, 8, None, None, 139.5, 35.5, 139.5, 35.5, 3.0, None),
        ("b:1", 1, "b", 1, 30000, 0, 8, 3, "Car", 139.0, 35.0, 139.3, 35.0, 20.0, "food"),
        ("b:1", 2, "b", 1, 39600, 1, -2, 0, "Walk", 139.3, 35.0, 139.0, 35.0, 1.0, "food"),
    ]
    return spark.createDataFrame(rows, TRIP)


@pytest.fixture(scope="module")
def waypoints(spark):
    t = 1_601_478_000_000
    rows = [("a:1", 1, t, 139.0, 35.0, "L1", 1), ("a:1", 1, t + 1_800_000, 139.05, 35.0, "L2", 2), ("a:1", 1, t + 3_600_000, 139.1, 35.0, "L2", 3), ("b:1", 1, t, 139.05, 35.0, "L1", 1), ("a:2", 1, t, 139.05, 35.0, "L9", 1)]
    return spark.createDataFrame(rows, "vehicle_key string, trip_id long, unix_time_ms long, lon double, lat double, link_id string, seq int")


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_filter_checks_its_values():
    for bad in ({"source_id": "A"}, {"hour_min": 24}, {"speed_max": 301.0}, {"detour_min": 0.5}, {"city": "1"}, {"origin_zone": "x" * 33}, {"modes": ("m",) * 17}, {"scenario": (1, 1, 0, 2)}):
        with pytest.raises(ValueError):
            TripFilter(**bad)
    with pytest.raises(ValueError):
        radius_box(0, 0, 51)


def test_filter_precedence(spark, trips):
    assert TripFilter(source_id="a", vehicle_type="b").apply(trips).count() == 4
    assert TripFilter(modes=("Walk",), transport_modes=(3,)).apply(trips).count() == 2
    assert TripFilter().apply(trips) is trips


def test_scenario_drops_unknown_modes_that_enter(trips, waypoints):
    box = (139.04, 34.9, 139.06, 35.1)
    left = TripFilter(scenario=box).apply(trips, waypoints)
    assert values(left, "vehicle_key", "trip_id") == [("a:1", 2), ("a:1", 3), ("b:1", 2)]
    with pytest.raises(ValueError):
        TripFilter(scenario=box).apply(trips)


def test_prefix_is_literal_and_list_is_bounded(spark, trips):
    assert trips.where(vehicle_prefix("a:_")).count() == 0 and trips.where(vehicle_prefix("a:")).count() == 4
    with pytest.raises(ValueError):
        vehicle_list([])


def test_hour_guard(trips):
    assert hour_guard(trips).first().asDict() == {"in_range": 5, "out_of_range": 1}


def test_metrics(trips, waypoints):
    d = {(r.vehicle_key, r.trip_id): r for r in derive.with_metrics(trips, waypoints).collect()}
    assert d["a:1", 1].dwell_minutes == 120 and d["a:1", 2].dwell_minutes == 180 and d["a:1", 3].dwell_minutes is None
    assert d["a:1", 1].speed_avg_kmh == 12 and d["b:1", 1].speed_avg_kmh is None  # one ping has no span
    assert d["a:2", 1].detour_ratio is None and d["a:1", 3].detour_ratio is None  # no way between the ends; no distance
    assert d["a:1", 1].detour_ratio == pytest.approx(12 / 9.1188, rel=1e-4)


def test_clock_floors_before_the_anchor(spark):
    df = spark.createDataFrame([(-1,), (0,), (86_400_000,)], "ms long")
    got = df.select(clock.clock_of_day(F.col("ms"), 0).alias("c"), clock.day_index(F.col("ms"), 0).alias("d"), clock.hour_of_day(F.col("ms"), 0).alias("h")).collect()
    assert [tuple(r) for r in got] == [(86399, -1, 23), (0, 0, 0), (0, 1, 0)]


def test_parse_time(spark):
    df = spark.createDataFrame([("2020-10-01T00:00:00Z",), ("2020-10-01T09:00:00+09:00",), ("2020-10-01 00:00:00",), ("1601510400",), ("1601510400000",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(clock.parse_time_ms(F.col("t"))).collect()] == [1601510400000] * 5 + [None, None]


def test_distances(spark):
    one = spark.range(1)
    p = [F.lit(x) for x in (139.0, 35.0, 140.0, 36.0)]
    r = one.select(geo.equirect_km(*p).alias("a"), geo.equirect_mean_km(*p).alias("b"), geo.haversine_km(*p).alias("c")).first()
    assert r.a == pytest.approx(143.91, abs=0.05) and r.b == pytest.approx(143.55, abs=0.05) and r.c == pytest.approx(143.4, abs=0.3)


def test_modes(spark):
    df = spark.createDataFrame([(0, "walk"), (7, "MODE 7"), (None, None), (3, "Auto")], "c int, l string")
    got = df.select(modes.mode_label(F.col("c"), {"3": "Auto"}).alias("l"), modes.mode_code(F.col("l"), {"3": "Auto"}).alias("c")).collect()
    assert [tuple(r) for r in got] == [("Walk", 0), ("mode 7", None), (None, None), ("Auto", 3)]
    odd = {"x": "Sled", "9": "taxi", "10": "Ferry", "11": "ferry"}  # a code that is no number, a label of a default code, a label twice
    codes = spark.createDataFrame([("SLED",), ("Taxi",), ("FERRY",), ("car",)], "l string").select(modes.mode_code(F.col("l"), odd)).collect()
    assert [r[0] for r in codes] == [None, 8, 10, 3]


def test_classes(spark):
    df = spark.createDataFrame([("Central Station", 4.9), ("Art Museum", 5.0), ("thing", None), ("Coffee bar", 80.0)], "c string, s double")
    got = df.select(classes.poi_class(F.col("c")).alias("c"), classes.speed_class(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("transit", 0), ("culture", 1), ("other", None), ("food", 4)]


def test_departures_are_dense(trips):
    rows = temporal.departures(trips, ["a", "b", "none"]).collect()
    assert len(rows) == 24 and rows[8].asDict() == {"hour": 8, "a": 2, "b": 1, "none": 0, "total": 3}
    assert sum(r.total for r in rows) == 5


def test_metric_hist_of_one_value_is_empty(trips):
    assert temporal.metric_hist(trips.where("trip_id = 3"), "distance_km").count() == 0
    rows = temporal.metric_hist(trips, "distance_km", 4).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 1, 1, 1] and rows[0].bin_lo == 1 and rows[-1].bin_hi == 20


def test_chains(trips):
    assert values(chains.chain_lengths(trips), "length", "vehicles") == [(1, 1), (2, 1), (3, 1)]
    r = chains.round_trips(trips).first()
    assert (r.round_trip, r.open, r.avg_trips_round) == (2, 0, 2.5)
    assert values(chains.commodity_sequences(trips), "sequence", "vehicles") == [("food → food", 1), ("food → steel → food", 1)]
    assert values(chains.dwell_bins(trips), "dwell_bin", "n") == [("2-4hr", 3)]


def test_compare(spark, trips):
    both = compare.sides(trips, F.col("source_id") == "a", F.col("source_id") == "b")
    m = {r.mode: r for r in compare.mode_shares(both).collect()}
    assert (m["Car"].pct_a, m["Car"].pct_b, m[None].trips_b) == (50.0, 50.0, 0) and m["Car"].z == 0
    assert {r.mode: r.p_value for r in compare.with_p_values(compare.mode_shares(both)).collect()}["Car"] == 1.0
    assert compare.wilcoxon(both).count() == 0  # too few persons
    a = compare.alignment(both).first()
    # person 1: first trips 1200 s and 8 of 20 km apart, second ones 3600 s and 8 of 9 km apart
    want = ((1 - 0.5 * (1200 / 14400 + 8 / 20)) + (1 - 0.5 * (3600 / 14400 + 8 / 9))) / 2
    assert (a.persons, a.pairs) == (1, 2) and a.mean == pytest.approx(want)


def test_wilcoxon_matches_worked_example(spark):
    pairs = [(5, 7), (3, 3), (2, 6), (8, 5), (1, 2), (4, 9), (6, 4), (2, 5), (3, 4)]
    rows = [(i, s) for i, p in enumerate(pairs) for s in (0, 1) for _ in range(p[s])]
    r = compare.wilcoxon(spark.createDataFrame(rows, "vehicle_id int, side int")).first()
    # differences 2, 4, -3, 1, 5, -2, 3, 1: ranks 3.5, 7, 5.5, 1.5, 8, 3.5, 5.5, 1.5
    assert (r.n_pairs, r.statistic) == (9, 9.0)


def test_segments_and_assembly(waypoints):
    s = derive.segments(waypoints).orderBy("unix_time_ms").collect()
    assert len(s) == 2 and s[0].link_id == "L2" and s[0].speed_kmh == pytest.approx(9.1188, rel=1e-3) and s[0].dwell_sec == 0
    t = {r.vehicle_key: r for r in assemble(waypoints, 1601478000, True).collect()}
    assert t["a:1"].timestamps == [0, 1800, 3600] and len(t["a:1"].segments) == 2 and t["b:1"].segments == []


def test_long_hops_are_split(spark):
    w = spark.createDataFrame([("v", 1, 0, 0.0, 0.0, 1), ("v", 1, 100_000, 1.0, 0.0, 2)], "vehicle_key string, trip_id long, unix_time_ms long, lon double, lat double, seq int")
    r = compact_trails(w, 0).orderBy("point").collect()
    assert [(x.dx, x.dt) for x in r] == [(0, 0), (25000, 25), (25000, 25), (25000, 25), (25000, 25)]


def test_downsample(spark):
    w = spark.createDataFrame([("v", 1, i, i) for i in range(10)], "vehicle_key string, trip_id long, unix_time_ms long, seq int")
    assert [r.seq for r in derive.downsample_cap(w, 4).orderBy("seq").collect()] == [0, 3, 6, 9]
    assert derive.downsample_frac(w, 1.0).count() == 10
    with pytest.raises(ValueError):
        derive.downsample_frac(w, 0)


PING = "vehicle_key string, event_id long, source_id string, unix_time_ms long, lon double, lat double"


def test_synthesis(spark):
    m = 60_000
    p = spark.createDataFrame([("v", i, "s", t, 139.0 + i / 100, 35.0) for i, t in enumerate((0, 10 * m, 35 * m, 70 * m, 1500 * m))] + [("u", 9, "s", 5, 1.0, 1.0)], PING)
    gap = {(r.vehicle_key, r.trip_id): r for r in derive.synthesize_trips(p, "gap", 0, 30).collect()}
    assert {k: r.pings for k, r in gap.items()} == {("v", 1): 3, ("v", 2): 1, ("v", 3): 1, ("u", 1): 1}
    assert gap["v", 2].distance_km is None and gap["v", 1].distance_km == pytest.approx(1.8238, rel=1e-3) and gap["v", 3].simulation_day == 1
    assert derive.synthesize_trips(p, "day", 0).count() == 3 and derive.synthesize_trips(p, "single", 0).count() == 2
    assert derive.resolve_anchor(p).first()[0] == 0


def test_stationary_and_position(spark, trips, waypoints):
    s = derive.stationary_trips(trips.withColumn("starttime", F.when(F.col("trip_id") == 3, 86390).otherwise(F.col("starttime"))), waypoints, 0)
    assert s.count() == 6
    late = [r.unix_time_ms for r in s.where("trip_id = 3").collect()]
    assert late[0] == late[1]
    r = derive.position_at(waypoints, 2700, 1601478000).collect()
    assert len(r) == 1 and r[0].lon == pytest.approx(139.075)
    assert derive.position_at(waypoints, 3601, 1601478000).count() == 0


def test_zones_leave_out_edges(spark):
    ring = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    outer, hole = ring((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)), ring((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))
    z = spark.createDataFrame([(1, "z", [[outer, hole], [ring((6.0, 6.0), (8.0, 8.0), (6.0, 8.0))]], 0.0, 0.0, 8.0, 8.0)], "zone_id long, name string, rings array<array<array<struct<lon:double,lat:double>>>>, min_lon double, min_lat double, max_lon double, max_lat double")
    points = {"west": (0.0, 3.0), "south": (3.0, 0.0), "east": (4.0, 3.0), "north": (3.0, 4.0), "corner": (0.0, 0.0), "hole": (2.0, 1.5), "hole_corner": (1.0, 1.0), "slope": (7.0, 7.0), "in": (3.0, 1.0), "in_second": (6.5, 7.0)}
    p = spark.createDataFrame([(k, *xy) for k, xy in points.items()], "k string, lon double, lat double")
    assert values(zones.contains(p, z), "k") == [("in",), ("in_second",)]
    assert values(zones.contains(p, z, hole_rims=True), "k") == [("hole",), ("hole_corner",), ("in",), ("in_second",)]


def test_zones_with_a_hole(spark):
    ring = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    outer, hole = ring((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)), ring((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))
    z = spark.createDataFrame([(1, "z", [[outer, hole], [ring((10.0, 10.0), (11.0, 10.0), (10.5, 11.0))]], 0.0, 0.0, 11.0, 11.0)], "zone_id long, name string, rings array<array<array<struct<lon:double,lat:double>>>>, min_lon double, min_lat double, max_lon double, max_lat double")
    p = spark.createDataFrame([("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("second", 10.5, 10.3), ("between", 7.0, 7.0), ("out", 20.0, 1.0)], "k string, lon double, lat double")
    assert values(zones.contains(p, z), "k") == [("in",), ("second",)]
    assert values(zones.contains(p, z, "bbox"), "k") == [("between",), ("hole",), ("in",), ("second",)]
    with pytest.raises(ValueError):
        zones.contains(p, z, "other")


def test_buildings(spark):
    d = 100 / 111_320
    ring = [{"lon": 0.0, "lat": 0.0}, {"lon": d, "lat": 0.0}, {"lon": d, "lat": d}, {"lon": 0.0, "lat": d}]
    r = spark.createDataFrame([(ring,)], "ring array<struct<lon:double,lat:double>>")
    assert r.select(zones.ring_area(F.col("ring"))).first()[0] == pytest.approx(10_000, rel=1e-4)
    far = spark.createDataFrame([([{"lon": p["lon"] + 139.5, "lat": p["lat"]} for p in ring],)], "ring array<struct<lon:double,lat:double>>")
    assert far.select(zones.ring_area(F.col("ring"))).first()[0] == pytest.approx(10_000, rel=1e-9)
    c = spark.createDataFrame([("small", 0.0, 0.0, 20.0), ("house", 0.0, 0.0, 256.0), ("block", 0.0, 0.0, 7840.0)], "key string, lon double, lat double, area_m2 double")
    b = zones.building_synthesize(c)
    assert {r["key"]: r["count"] for r in b.groupBy("key").count().collect()} == {"house": 1, "block": 9}
    assert all(8 <= r.height_m <= 16 for r in b.where("key = 'block'").collect()) and 27 <= b.where("key = 'house'").first().height_m <= 37
    assert zones.building_sample(b, 4).count() == 4 and zones.building_sample(b, 4).where("key = 'house'").count() == 1


def test_components(spark):
    nodes = spark.range(1, 40).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(35, 33), (33, 38)], "a long, b long")
    got = {r.node: r.label for r in graphs.min_label(nodes, edges).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[35] == got[38] == 33 and got[31] == 31


def test_dbscan(spark):
    rows = [(i, i / 10) for i in range(6)] + [(10, 5.0), (11, 5.05), (12, 0.62)]
    p = spark.createDataFrame(rows, "id long, f0 double")
    got = {r.id: r.cluster for r in mining.dbscan(p, mining.eps_neighbours(p, 0.13, 1), 3).collect()}
    assert [got[i] for i in range(6)] == [1, 1, 1, 1, 1, 1] and got[12] == 1 and got[10] is None and got[11] is None


def test_jaccard_pairs(spark):
    rows = [("v", t, link) for t, links in ((1, "abcd"), (2, "abce"), (3, "xyz"), (4, "xyzw")) for link in links]
    s = spark.createDataFrame(rows, "vehicle_key string, trip_id long, link_id string")
    assert sorted(r.distance for r in mining.jaccard_pairs(s, 0.4).collect()) == pytest.approx([0.25, 0.4])


@pytest.mark.parametrize("rows", [4096, 2])
def test_jaccard_pairs_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(mining, "LINK_ROWS", rows)  # 2: every link is salted
    rnd = random.Random(4)
    sets = {t: {"motorway"} | {f"l{rnd.randrange(12)}" for _ in range(rnd.randrange(0, 7))} for t in range(60)}
    s = spark.createDataFrame([("v", t, link) for t, links in sets.items() for link in links], "vehicle_key string, trip_id long, link_id string")
    for most in (0.0, 0.3, 0.5, 0.8):
        want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and round(1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 12) <= most}
        assert {(r.a, r.b): r.shared for r in mining.jaccard_pairs(s, most, F.col("trip_id")).collect()} == want


def similar_routes(seed=11):
    """Waypoints of trips on a few roads: copies, variants with some links changed, a motorway in all, and a link that is everybody's rarest."""
    rnd = random.Random(seed)
    roads = [[f"r{k}_{i}" for i in range(14)] for k in range(12)]
    rows = []
    for t in range(400):
        links = set(rnd.choice(roads))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            links ^= {rnd.choice(rnd.choice(roads))}
        rows += [("v", t, link) for link in links | {"motorway"}]
    rows += [("w", 1000 + t, link) for t in range(200) for link in ("only", *rnd.sample([f"m{i}" for i in range(5)], 3))]
    return rows


def test_routes_with_copies_and_one_rare_link(spark):
    rows = similar_routes()
    sets = {}
    for _, t, link in rows:
        sets.setdefault(t, set()).add(link)
    near = {a: [b for b in sets if b != a and round(1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 12) <= 0.3] for a in sets}
    core = {a for a in sets if len(near[a]) + 1 >= 5}
    label = {}
    for a in sorted(core):
        todo = [a] if a not in label else []
        while todo:
            b = todo.pop()
            if b not in label:
                label[b] = a
                todo += [c for c in near[b] if c in core]
    for a in sets.keys() - core:
        label[a] = min((label[b] for b in near[a] if b in core), default=None)
    w = spark.createDataFrame(rows, "vehicle_key string, trip_id long, link_id string")
    assert {r.trip_id: r.cluster for r in mining.route_similarity(w, min_samples=5, id=F.col("trip_id")).collect()} == label


def test_bands_find_most_pairs(spark):
    """The option's recall against the exact pairs; what it finds is right."""
    sets = spark.createDataFrame(similar_routes(), "vehicle_key string, trip_id long, link_id string").groupBy(F.col("trip_id").alias("id")).agg(F.collect_set("link_id").alias("links"))
    pairs = lambda d: {(r.a, r.b): r.shared for r in d.collect()}
    exact, banded = pairs(mining.set_pairs(sets, 0.3)), pairs(mining.banded_pairs(sets, 0.3, 20, 4))
    assert len(exact) > 3000 and banded.items() <= exact.items() and len(banded) >= 0.9 * len(exact)


def test_cluster_members(spark):
    rows = [("v", i, 139.0 + i / 1000, 35.0, 139.5, 35.5, 5.0 + i / 100, 8) for i in range(30)] + [("w", 99, 145.0, 40.0, 130.0, 30.0, 90.0, 1)]
    d = mining.cluster_od(spark.createDataFrame(rows, "vehicle_key string, trip_id long, start_lon double, start_lat double, end_lon double, end_lat double, distance_km double, dep_hour int"), id=F.col("trip_id"))
    r = mining.cluster_summary(d).first()
    assert (r["size"], r.noise, r.cluster) == (30, 1, 0) and [m.trip_id for m in r.members] == list(range(20))


def test_exact_mean(spark):
    half = spark.createDataFrame([(0.1,), (0.1000005,), (0.100001,), (None,)], "x double").repartition(3)  # half of the seventh digit
    assert half.select(exact.mean(F.col("x"))).first()[0] == 0.100001
    assert abs(half.select(exact.median(F.col("x"), 100)).first()[0] - 0.1000005) < 1e-9


def test_roles_by_name():
    assert [profile.guess_role(x) for x in ("gps_lon", "Epoch", " device_id ", "mmsi", "label", "speed")] == ["lon", "time", "vehicle", "vehicle", "name", None]
    assert profile.guess_role("trip_id") == "vehicle" and profile.guess_role("trip_id", profile.TRIP_ROLES) == "trip"


def test_draws_are_the_same_elsewhere(spark):
    con = duckdb.connect()
    for keys in (("7", "fleet_a:1", "12"), ("0", "", "-3")):
        sql = draw.drawn_sql(*[f"'{k}'" for k in keys])
        assert spark.range(1).select(draw.drawn(*[F.lit(k) for k in keys])).first()[0] == con.sql(f"SELECT {sql}").fetchall()[0][0]


def test_legend_overflow(spark):
    d = spark.createDataFrame([(f"v{i % 15:02d}",) for i in range(16)], "x string")
    rows = stats.attr_legend(d, "x").orderBy("rank").collect()
    assert len(rows) == 13 and rows[0].value == "v00" and (rows[-1].value, rows[-1].n) == ("+3 more", 3)


def test_bbox_union_skips_odd_boxes(spark):
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (2.0, 2.0, 3.0, 3.0), (nan, 0.0, 9.0, 9.0), (9.0, 0.0, 5.0, 1.0), (0.0, 0.0, inf, 1.0)], "west double, south double, east double, north double")
    assert tuple(stats.bbox_union(d).first()) == (0.0, 0.0, 3.0, 3.0)


def test_detect_scale(spark):
    d = spark.createDataFrame([(9_999, 999_999), (10_000, 5), (1_000_000, 5), (5, 10_000_000)], "agents long, waypoints long")
    assert [r.scale for r in stats.detect_scale(d).collect()] == ["micro", "meso", "macro", "macro"]
    assert stats.detect_scale(d, "small").first().scale == "micro"


def test_mapping(spark):
    d = spark.createDataFrame([("7", "10:00", "1.5"), ("bus-9", "x", "bad")], "id string, t string, x string")
    cols = {"vehicle_id": {"csv": "id", "type": "int"}, "starttime": {"derived": "3600 + {epoch_anchor}", "type": "int"}, "transport_mode": {"csv": "id"}} | {c: {"csv": "x", "type": "double"} for c in ("start_lon", "start_lat", "end_lon", "end_lat")}
    r = mapping.project_source(d, "trips", cols, "src", 100, "{scope}/{vehicle_id}", "tokyo").collect()
    assert (r[0].vehicle_id, r[0].vehicle_key, r[0].starttime, r[0].start_lon, r[0].mode, r[0].dep_hour) == (7, "tokyo/7", 3700, 1.5, "mode 7", 1)
    assert 0 < r[1].vehicle_id <= 2_000_000_000 and r[1].start_lon is None and r[1].mode == "bus-9" and r[1].transport_mode is None
    with pytest.raises(ValueError):
        mapping.project_source(d, "trips", {}, "src", 0)
    with pytest.raises(ValueError):
        mapping.column_expr({"csv": "a", "derived": "b"}, 0)


def test_sinks_replace_one_source(spark, trips, tmp_path):
    path = str(tmp_path / "trips")
    sinks.write_trips(trips, path)
    sinks.write_trips(trips.where("source_id = 'a' and trip_id = 1"), path)
    back = conform(spark.read.parquet(path), TRIPS)
    assert values(back, "vehicle_key", "trip_id") == [("a:1", 1), ("a:2", 1), ("b:1", 1), ("b:1", 2)]


def test_geojson(spark, tmp_path):
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4, 9]]}, "properties": {"coordTimes": ["2020-10-01T00:00:00Z"], "time": 5}}
    point = {"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {"time": 1601510400, "name": "x"}}
    poly = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 0]]]}, "properties": {"name": "z"}}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line, point]}, indent=1))
    path = str(tmp_path / "f")
    assert values(files.scan_geojson_lines(spark, path), "_lon", "_lat", "_time_ms") == [(1.0, 2.0, 1601510400000), (3.0, 4.0, 5000)]
    assert values(files.scan_geojson_points(spark, path), "_lon", "_lat", "_time_ms", "_feature_id") == [(5.0, 6.0, 1601510400000, "p")]
    with pytest.raises(Exception, match="no polygon"):
        files.scan_zones_geojson(spark, path, "k").collect()
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [poly]}))
    z = files.scan_zones_geojson(spark, str(tmp_path / "g"), "k").first()
    assert (z.zone_id, z.name, z.min_lon, z.max_lat) == (1, "z", 0.0, 1.0)


def test_gpx(spark, tmp_path):
    (tmp_path / "t.gpx").write_text(
        '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>one</name><trkseg><trkpt lat="1" lon="2"><ele>3</ele><time>2020-10-01T00:00:00Z</time></trkpt></trkseg>'
        '<trkseg><trkpt lat="4" lon="5"><time>2020-10-01T09:00:00+09:00</time></trkpt></trkseg></trk><trk><trkseg><trkpt lat="6" lon="7"><time>2020-10-01T00:00:00</time></trkpt></trkseg></trk></gpx>'
    )
    got = values(files.scan_gpx(spark, str(tmp_path)), "_trk_name", "_feature_id", "_seq", "_lon", "_time_ms")
    assert got == [("one", "0:0", 0, 2.0, 1601510400000), ("one", "0:1", 1, 5.0, 1601510400000), ("trk1", "1:0", 0, 7.0, 1601510400000)]


def test_ndjson_refuses_what_is_no_object(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a": 1, "b": {"c": 2}}\n\n{"a": 2}\n')
    d = files.scan_ndjson(spark, str(tmp_path), "a int, b struct<c:int>")
    assert [(r.a, r.b and r.b.c) for r in d.collect()] == [(1, 2), (2, None)]
    (tmp_path / "b.ndjson").write_text("[1]\n")
    with pytest.raises(Exception):
        files.scan_ndjson(spark, str(tmp_path), "a int").select("a").collect()


def test_radius_exact_is_within_square(spark):
    p = spark.createDataFrame([(139.0, 35.0), (139.012, 35.012), (139.02, 35.0)], "lon double, lat double")
    assert p.where(in_radius(139.0, 35.0, 1.0)).count() == 2 and p.where(in_radius(139.0, 35.0, 1.0, True)).count() == 1
