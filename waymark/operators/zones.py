"""Zones, points of interest and buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions.draw import drawn
from waymark.operators.cover import cover, in_cover
from waymark.operators.filters import zone_overlaps

KM = 111.32
#: Fixed values of synthesized buildings, in metres and square metres.
LEAST_AREA, BLOCK_AREA, BLOCK_PITCH, BLOCK_GAP, BLOCK_LOW, BLOCK_HIGH, TALL, M_PER_DEGREE = 25.0, 3000.0, 28.0, 4.0, 8.0, 16.0, 25.0, 111_320.0


def _edges(ring: Column) -> Column:
    """Edges of a ring, which may be open or closed."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.get(ring, (i + 1) % n).alias("q")))


def on_edge(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a point is on an edge of a ring."""

    def on(e: Column) -> Column:
        (x1, y1), (x2, y2) = ((e[k]["lon"], e[k]["lat"]) for k in ("p", "q"))
        return ((x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1)) & lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))

    return F.exists(_edges(ring), on)


def _crossings(ring: Column, lon: Column, lat: Column) -> Column:
    """Edges of a ring that a ray to the east crosses."""

    def cross(count: Column, e: Column) -> Column:
        (x1, y1), (x2, y2) = ((e[k]["lon"], e[k]["lat"]) for k in ("p", "q"))
        spans = (y1 > lat) != (y2 > lat)
        return count + F.when(spans & (lon < (x2 - x1) * (lat - y1) / F.when(spans, y2 - y1).otherwise(1.0) + x1), 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), cross)


def inside(rings: Column, lon: Column, lat: Column, hole_rims: bool = False) -> Column:
    """Whether a point is in a multipolygon (polygons of rings, the first ring outside, the others holes), by counting crossings.

    A point on an edge of the outer ring is not in the polygon.  One on an edge
    of a hole is not either, or with ``hole_rims`` it is: what a hole takes away
    is then only its open inside.
    """

    def within(polygon: Column) -> Column:
        odd = F.aggregate(polygon, F.lit(0), lambda n, ring: n + _crossings(ring, lon, lat)) % 2 == 1
        if not hole_rims:
            return odd & ~F.exists(polygon, lambda ring: on_edge(ring, lon, lat))
        outer, holes = F.get(polygon, 0), F.slice(polygon, F.lit(2), F.size(polygon))
        return (odd | F.exists(holes, lambda ring: on_edge(ring, lon, lat))) & ~on_edge(outer, lon, lat)

    return F.exists(rings, within)


def contains(points: DataFrame, zones: DataFrame, mode: str = "exact", cell: float = 0.1, hole_rims: bool = False) -> DataFrame:
    """Points (with lon, lat) and the zones that hold them.

    With ``bbox`` the bounds decide: zones are dealt to the grid cells of their
    bounds, points to their own cell, and the two meet by cell.  With ``exact``
    the rings decide, edges as in ``inside``: zones become a cover of cells (see
    ``cover``), so that most points are told by their cell alone, and the others
    look at the few edges there.
    """
    hit = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    bounds = ["min_lon", "min_lat", "max_lon", "max_lat"]
    named = zones.select("zone_id", F.col("name").alias("zone_name"), *bounds)
    if mode == "exact":
        found = in_cover(points, cover(zones, cell), cell, hole_rims).join(named, "zone_id").where(hit)
        return found.select(*points.columns, "zone_id", "zone_name")
    if mode != "bbox":
        raise ValueError(f"unknown mode: {mode}")
    z = named.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("min_lon") / cell), F.floor(F.col("max_lon") / cell))))
    z = z.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("min_lat") / cell), F.floor(F.col("max_lat") / cell))))
    p = points.withColumns({"_cx": F.floor(F.col("lon") / cell), "_cy": F.floor(F.col("lat") / cell)})
    return p.join(z, ["_cx", "_cy"]).where(hit).drop("_cx", "_cy", *bounds)


def list_pois(pois: DataFrame, predicate: Column, limit: int = 1000) -> DataFrame:
    """The first ``limit`` places that match, with whether there are more."""
    if not 1 <= limit <= 100_000:
        raise ValueError("limit: 1 to 100000")
    more = pois.where(predicate).orderBy("source_key", "poi_id").limit(limit + 1)
    n = more.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return more.orderBy("source_key", "poi_id").limit(limit).join(F.broadcast(n))


def list_zones(zones: DataFrame, box: tuple[float, float, float, float], source_key: str | None = None, limit: int = 1000) -> DataFrame:
    if not 1 <= limit <= 20_000:
        raise ValueError("limit: 1 to 20000")
    d = zones.where(zone_overlaps(box))
    d = d if source_key is None else d.where(F.col("source_key") == source_key)
    return d.orderBy("source_key", "zone_id").limit(limit)


def ring_area(ring: Column) -> Column:
    """Square metres of a ring by the shoelace formula, at the mean latitude; from the first point, as products of whole coordinates would cancel out."""
    n = F.size(ring)
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    nxt = F.transform(ring, lambda p, i: F.get(ring, (i + 1) % n))
    x0, y0 = F.get(ring, 0)["lon"], F.get(ring, 0)["lat"]
    cross = lambda p, q: (p["lon"] - x0) * (q["lat"] - y0) - (q["lon"] - x0) * (p["lat"] - y0)
    twice = F.aggregate(F.zip_with(ring, nxt, cross), F.lit(0.0), lambda s, x: s + x)
    return F.when(n >= 3, F.abs(twice) / 2 * M_PER_DEGREE * M_PER_DEGREE * F.cos(F.radians(mean))).otherwise(0.0)


def building_clip(buildings: DataFrame, box: tuple[float, float, float, float], least_area: float = LEAST_AREA) -> DataFrame:
    """Buildings (ring, height_m) whose vertex mean is in the box and that are not too small."""
    n = F.size("ring")
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[c]) / n
    x, y = mean("lon"), mean("lat")
    west, south, east, north = box
    return buildings.where(x.between(west, east) & y.between(south, north) & (ring_area(F.col("ring")) >= least_area))


def _square(cx: Column, cy: Column, hx: Column, hy: Column) -> Column:
    corner = lambda sx, sy: F.struct((cx + sx * hx).alias("lon"), (cy + sy * hy).alias("lat"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def building_synthesize(centroids: DataFrame, seed: int = 42) -> DataFrame:
    """Square buildings of the same area for rows of key, lon, lat, area_m2.

    Heights are 4 log2(area) within 8 and 60 m, jittered by a hash; blocks of over
    3000 square metres become a grid of low cells with gaps; under 25 goes.
    """
    d = centroids.where(F.col("area_m2") >= LEAST_AREA).withColumn("side", F.sqrt("area_m2"))
    block = F.col("area_m2") > BLOCK_AREA
    n = F.when(block, F.greatest(F.lit(2), F.round(F.col("side") / BLOCK_PITCH))).otherwise(1).cast("int")
    d = d.withColumns({"n": n, "block": block}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pitch = F.col("side") / F.col("n")
    cell = F.when(F.col("block"), F.greatest(pitch - BLOCK_GAP, pitch * 0.6)).otherwise(F.col("side"))
    lon_m = M_PER_DEGREE * F.cos(F.radians(F.col("lat")))
    cx = F.col("lon") + ((F.col("i") + 0.5) / F.col("n") - 0.5) * F.col("side") / lon_m
    cy = F.col("lat") + ((F.col("j") + 0.5) / F.col("n") - 0.5) * F.col("side") / M_PER_DEGREE
    u = drawn(F.lit(seed), "key", "i", "j") % 1_000_000 / 1_000_000.0
    height = F.when(F.col("block"), BLOCK_LOW + (BLOCK_HIGH - BLOCK_LOW) * u).otherwise(F.greatest(F.lit(8.0), F.least(F.lit(60.0), 4.0 * F.log2(F.greatest(F.col("area_m2"), F.lit(2.0))))) * (0.85 + 0.3 * u))
    return d.select("key", "i", "j", height.alias("height_m"), _square(cx, cy, cell / 2 / lon_m, cell / 2 / M_PER_DEGREE).alias("ring"))


def building_sample(buildings: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """All tall buildings, and the others by weight of area up to ``most`` in all (keys -ln(u) / weight, the least first)."""
    u = (drawn(F.lit(seed), "key", "i", "j") % 1_000_000_007 + 1) / 1_000_000_008.0
    key = F.when(F.col("height_m") >= TALL, F.lit(-1.0)).otherwise(-F.log(u) / F.greatest(ring_area(F.col("ring")), F.lit(1.0)))
    return buildings.withColumn("_k", key).orderBy("_k", "key", "i", "j").limit(most).drop("_k")
