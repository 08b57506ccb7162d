"""The trip filter: one vocabulary of predicates that every analysis takes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions.geo import haversine_km

PAIR = ["vehicle_key", "trip_id"]
CAR = 3


@dataclass(frozen=True)
class TripFilter:
    """Predicates on trips; unset ones hold for all.

    ``modes`` (labels) go before ``transport_modes`` (codes), ``source_id``
    before its alias ``vehicle_type``.  ``scenario`` (west, south, east, north)
    leaves out car trips whose waypoints enter the box and, as three-valued
    logic has it, trips of unknown mode that do.
    """

    source_id: str | None = None
    vehicle_type: str | None = None
    city: str | None = None
    simulation_day: int | None = None
    modes: tuple[str, ...] = ()
    transport_modes: tuple[int, ...] = ()
    hour_min: int | None = None
    hour_max: int | None = None
    goods_type: str | None = None
    speed_min: float | None = None
    speed_max: float | None = None
    dwell_max: float | None = None
    detour_min: float | None = None
    detour_max: float | None = None
    origin_zone: str | None = None
    dest_zone: str | None = None
    scenario: tuple[float, float, float, float] | None = None
    extra: tuple = field(default=())

    def __post_init__(self):
        for name, pattern in (("source_id", "[a-z][a-z0-9_]*"), ("vehicle_type", "[a-z][a-z0-9_]*"), ("city", "[a-z_]+"), ("goods_type", "[a-z_]+"), ("origin_zone", "[A-Za-z0-9_-]{1,32}"), ("dest_zone", "[A-Za-z0-9_-]{1,32}")):
            value = getattr(self, name)
            if value is not None and not re.fullmatch(pattern, value):
                raise ValueError(f"{name}: {value!r}")
        if len(self.modes) > 16 or len(self.transport_modes) > 16:
            raise ValueError("at most 16 modes")
        for name, low, high in (("hour_min", 0, 23), ("hour_max", 0, 23), ("simulation_day", 0, None), ("speed_min", 0, 300), ("speed_max", 0, 300), ("dwell_max", 0, 10080), ("detour_min", 1, 20), ("detour_max", 1, 20)):
            value = getattr(self, name)
            if value is not None and (value < low or high is not None and value > high):
                raise ValueError(f"{name}: {value} is out of range")
        if self.scenario is not None:
            west, south, east, north = self.scenario
            if not (west < east and south < north):
                raise ValueError("scenario: west < east and south < north")

    def but(self, **changes) -> TripFilter:
        return replace(self, **changes)

    @property
    def is_empty(self) -> bool:
        return all(getattr(self, f.name) in (None, ()) for f in fields(self))

    def column(self) -> Column:
        """All predicates but the scenario as one column."""
        c = F.col
        parts: list[Column] = list(self.extra)
        source = self.source_id or self.vehicle_type
        for name, value in (("source_id", source), ("city", self.city), ("simulation_day", self.simulation_day), ("goods_type", self.goods_type), ("origin_zone", self.origin_zone), ("dest_zone", self.dest_zone)):
            if value is not None:
                parts.append(c(name) == value)
        if self.modes:
            parts.append(c("mode").isin(*self.modes))
        elif self.transport_modes:
            parts.append(c("transport_mode").isin(*self.transport_modes))
        for name, low, high in (("dep_hour", self.hour_min, self.hour_max), ("speed_avg_kmh", self.speed_min, self.speed_max), ("dwell_minutes", None, self.dwell_max), ("detour_ratio", self.detour_min, self.detour_max)):
            if low is not None:
                parts.append(c(name) >= low)
            if high is not None:
                parts.append(c(name) <= high)
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out

    def apply(self, trips: DataFrame, waypoints: DataFrame | None = None) -> DataFrame:
        """The trips that pass.  A scenario needs the waypoints."""
        kept = trips if replace(self, scenario=None).is_empty else trips.where(self.column())
        if self.scenario is None:
            return kept
        if waypoints is None:
            raise ValueError("a scenario needs waypoints")
        return without_scenario(kept, waypoints, self.scenario)


def in_box(box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> Column:
    west, south, east, north = box
    return F.col(lon).between(west, east) & F.col(lat).between(south, north)


def entering(waypoints: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Distinct (vehicle_key, trip_id) with a waypoint in the box."""
    return waypoints.where(in_box(box)).select(*PAIR).distinct()


def without_scenario(trips: DataFrame, waypoints: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """NOT (transport_mode = 3 AND enters the box), with SQL's nulls; a flag join, which plans as a hash or merge join."""
    hits = entering(waypoints, box).withColumn("_hit", F.lit(True))
    flagged = trips.join(hits, PAIR, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return flagged.where(~((F.col("transport_mode") == CAR) & hit)).drop("_hit")


def radius_box(lon: float, lat: float, radius_km: float) -> tuple[float, float, float, float]:
    """The square of radius / 80 degrees around a point."""
    if not 0.1 <= radius_km <= 50:
        raise ValueError("radius_km: 0.1 to 50")
    d = radius_km / 80.0
    return (lon - d, lat - d, lon + d, lat + d)


def in_radius(lon: float, lat: float, radius_km: float, exact: bool = False) -> Column:
    """Waypoints in the square; with ``exact`` also within the great-circle distance."""
    square = in_box(radius_box(lon, lat, radius_km))
    return square & (haversine_km(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= radius_km) if exact else square


def vehicle_prefix(prefix: str) -> Column:
    """Literal prefix of the vehicle key; no character of it is a wildcard."""
    if len(prefix) > 80:
        raise ValueError("prefix: at most 80 characters")
    return F.col("vehicle_key").startswith(prefix)


def vehicle_list(keys: list[str]) -> Column:
    if not 1 <= len(keys) <= 20:
        raise ValueError("1 to 20 vehicle keys")
    return F.col("vehicle_key").isin(*keys)


def hour_guard(trips: DataFrame) -> DataFrame:
    """One row: trips whose hour is within 0 to 23, and the others (unknown ones included)."""
    ok = F.coalesce(F.col("dep_hour").between(0, 23), F.lit(False))
    return trips.agg(F.count_if(ok).alias("in_range"), F.count_if(~ok).alias("out_of_range"))


def near_clock(clock: int, half: int = 1800) -> Column:
    """Trips that start within ``half`` seconds of the clock."""
    return F.col("starttime").between(clock - half, clock + half)


def zone_overlaps(box: tuple[float, float, float, float]) -> Column:
    """Zones whose bounds intersect the box."""
    west, south, east, north = box
    return (F.col("max_lon") >= west) & (F.col("min_lon") <= east) & (F.col("max_lat") >= south) & (F.col("min_lat") <= north)
