"""Scans over ranges against plain loops and windows, with borders forced into keys."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import derive, scan
from waymark.plans.views import PING_ANCHOR, Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(rnd.choice(["a", "a", "a", "a", None, "b", "c"]), rnd.randrange(10_000), i, None if rnd.random() < 0.2 else rnd.randrange(1 << 40)) for i in range(3000)]


def expected(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[1], r[2]))
        prev, ordinal, xor, total, union = None, 1, None, None, None
        after = [(t, v) for _, t, _, v in own[1:]] + [None]
        for (_, t, i, v), nxt in zip(own, after):
            ordinal += prev is not None and t - prev[0] > 3
            if v is not None:
                xor, total = (v, v) if xor is None else (xor ^ v, total + v)
                union = v if union is None else union | v
            out[i] = (prev, nxt, ordinal, xor, total, union)
            prev = (t, v)
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 60])
def test_scan_is_a_loop(spark, rows, ranges):
    df = spark.createDataFrame(rows, "k string, t long, i long, v long").repartition(5)
    got = scan.scan(df, ["k"], ["t", "i"], ["t", "v"], lambda a, b: b["t"] - a["t"] > 3, {"x": ("xor", "v"), "s": ("sum", "v"), "o": ("or", "v")}, ahead=True, ranges=ranges)
    assert got.columns == ["k", "t", "i", "v", "prev", "next", "ordinal", "x", "s", "o"]
    plain = lambda r: r and tuple(r)
    assert {r["i"]: (plain(r["prev"]), plain(r["next"]), r["ordinal"], r["x"], r["s"], r["o"]) for r in got.collect()} == expected(rows)


def test_scan_of_nothing_and_clashes(spark, rows):
    df = spark.createDataFrame(rows[:3], "k string, t long, i long, v long")
    assert scan.scan(df.where("false"), ["k"], ["t", "i"], ["t"], lambda a, b: b["t"] > a["t"], {"x": ("xor", "v")}).count() == 0
    with pytest.raises(ValueError):
        scan.scan(df, ["k"], ["t"], totals={"v": ("sum", "v")})
    with pytest.raises(ValueError):
        scan.scan(df, ["k"], ["t"], totals={"m": ("max", "v")})
    with pytest.raises(ValueError):
        scan.scan(df, ["k"], ["t"], starts=lambda a, b: F.lit(True))


@pytest.mark.parametrize("how", ["gap", "day", "single"])
def test_trips_are_the_same_by_ranges(spark, how):
    pings = Views(spark, SF).pings
    # half of all pings come from one device
    pings = pings.withColumn("vehicle_key", F.when(F.col("event_id") % 2 == 0, F.lit("ping:0")).otherwise(F.col("vehicle_key")))
    exact = lambda d: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in d.collect())
    plain, ranged = (derive.synthesize_trips(pings, how, PING_ANCHOR, 60, ranges=n) for n in (None, 23))
    assert exact(plain) == exact(ranged.select(plain.columns))
    ids = [derive.with_trip_ids(pings, how, PING_ANCHOR, 60, ranges=n).select("event_id", "trip_id") for n in (None, 23)]
    assert exact(ids[0]) == exact(ids[1])


def test_one_key_lies_in_many_tasks(spark, monkeypatch):
    seen = []
    kept = scan.saved
    monkeypatch.setattr(scan, "saved", lambda df, label: seen.append(kept(df, label)) or seen[-1])
    monkeypatch.setattr(derive, "RANGE_ROWS", 1000)
    monkeypatch.setattr(scan, "RANGE_ROWS", 1000)
    pings = Views(spark, SF).pings.limit(20_000)
    n = pings.count()
    pings = pings.withColumn("vehicle_key", F.when(F.col("event_id") % 2 == 0, F.lit("ping:0")).otherwise(F.col("vehicle_key")))
    assert n > 900 and derive.with_trip_ids(pings, ranges=None if n > 2100 else 12).count() == n
    parts = seen[0].where("vehicle_key = 'ping:0'").groupBy("_part").count().collect()
    assert len(parts) >= 5 and max(r["count"] for r in parts) < n / 4
