"""Zones as cells of a quadtree: whole cells inside, and cells on the border with the edges that touch them.

Inside a cell, a ray to the east crosses edges that touch the cell, which are
looked at, and edges east of it.  How many of the latter it crosses changes
parity only at corners where one of them meets an edge that touches the cell, so
one bit and the heights of these corners stand for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.shared import saved

#: Edges of a border cell beyond which it is split, and how often at most.
EDGES, DEEPEST = 32, 8
#: A share of a cell by which it is widened when its edges are chosen.
SLACK = 1e-9
CELL = ["zone_id", "poly", "cx", "cy"]
EDGE = ["hole", "x1", "y1", "x2", "y2", "ox", "oy", "rx", "ry"]


def zone_edges(zones: DataFrame) -> DataFrame:
    """zone_id, poly, hole, and an edge (1 to 2) with the corners before (o) and after (r) it, of rings that are open or closed."""
    d = zones.select("zone_id", F.posexplode("rings").alias("poly", "polygon")).select("zone_id", "poly", F.posexplode("polygon").alias("ring_no", "ring"))
    n = F.size("ring")
    at = lambda i, k: F.get("ring", (i + k + n) % n)
    edges = F.transform("ring", lambda p, i: F.struct(p.alias("p"), at(i, 1).alias("q"), at(i, -1).alias("o"), at(i, 2).alias("r")))
    d = d.select("zone_id", "poly", (F.col("ring_no") > 0).alias("hole"), F.explode(edges).alias("e"))
    return d.select("zone_id", "poly", "hole", *[F.col(f"e.{c}.{lonlat}").alias(f"{axis}{k}") for c, k in (("p", "1"), ("q", "2")) for axis, lonlat in (("x", "lon"), ("y", "lat"))],
                    *[F.col(f"e.{c}.{lonlat}").alias(f"{c}{axis}") for c in ("o", "r") for axis, lonlat in (("x", "lon"), ("y", "lat"))])


def _cells_of(a: Column, b: Column, size: float) -> tuple[Column, Column]:
    """First and last cell, along one axis, of what lies from a to b."""
    return F.floor((F.least(a, b) - size * SLACK) / size), F.floor((F.greatest(a, b) + size * SLACK) / size)


def crosses(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the east crosses an edge."""
    spans = (y1 > lat) != (y2 > lat)
    return spans & (lon < (x2 - x1) * (lat - y1) / F.when(spans, y2 - y1).otherwise(1.0) + x1)


def _middle(size: float) -> tuple[Column, Column, float]:
    """Middle of a cell (cx, cy), and half its width, a little widened."""
    return (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, size * (0.5 + SLACK)


def _touches(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Whether an edge touches a cell: their bounds overlap, and the cell is not on one side of the edge's line."""
    x, y, h = _middle(size)
    bounds = (F.least(x1, x2) <= x + h) & (F.greatest(x1, x2) >= x - h) & (F.least(y1, y2) <= y + h) & (F.greatest(y1, y2) >= y - h)
    return bounds & (F.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= h * (F.abs(x2 - x1) + F.abs(y2 - y1)) * (1 + SLACK))


def _corners(size: float) -> Column:
    """Heights of the corners at which an edge of a cell meets one that does not touch it but passes east of it."""
    x, y, h = _middle(size)

    def east(*names: str) -> Column:
        x1, y1, x2, y2 = map(F.col, names)
        low, high = F.greatest(F.least(y1, y2), y - h), F.least(F.greatest(y1, y2), y + h)
        at = F.when(y1 == y2, x1).otherwise(x1 + (x2 - x1) * ((low + high) / 2 - y1) / F.when(y1 == y2, 1.0).otherwise(y2 - y1))
        return (low <= high) & ~_touches(x1, y1, x2, y2, size) & (at > x)

    return F.array_compact(F.array(F.when(east("ox", "oy", "x1", "y1"), F.col("y1")), F.when(east("x2", "y2", "rx", "ry"), F.col("y2"))))


def _above(corners: Column, lat: Column) -> Column:
    return F.size(F.filter(corners, lambda y: y > lat))


def _parity(edges: DataFrame, lon: Column, lat: Column) -> Column:
    """Per row, how much an edge of a cell and its corners add at a point."""
    return crosses(lon, lat, *[F.col(c) for c in ("x1", "y1", "x2", "y2")]).cast("int") + _above(F.col("corners"), lat)


def _base(zones: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Edges by the cells that they touch, and all cells of every polygon's bounds with ``at_ref``: the parity at their middle."""
    e = saved(zone_edges(zones), "zone-edges")
    (x0, x9), (y0, y9) = _cells_of(F.col("x1"), F.col("x2"), size), _cells_of(F.col("y1"), F.col("y2"), size)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    touched = e.withColumn("cx", F.explode(F.sequence(x0, x9))).withColumn("cy", F.explode(F.sequence(y0, y9))).where(_touches(*ends, size))
    span = e.groupBy("zone_id", "poly").agg(*[f(F.least(f"{a}1", f"{a}2") if f is F.min else F.greatest(f"{a}1", f"{a}2")).alias(f"{f.__name__}_{a}") for a in "xy" for f in (F.min, F.max)])
    (bx0, bx9), (by0, by9) = _cells_of(F.col("min_x"), F.col("max_x"), size), _cells_of(F.col("min_y"), F.col("max_y"), size)
    cells = span.withColumn("cx", F.explode(F.sequence(bx0, bx9))).withColumn("cy", F.explode(F.sequence(by0, by9))).select(*CELL)
    # along the middle of a row of cells: edges from the east, counted up to each middle
    lat = (F.col("cy") + 0.5) * size
    rows = e.withColumn("cy", F.explode(F.sequence(y0, y9)))
    met = rows.where((F.col("y1") > lat) != (F.col("y2") > lat)).select("zone_id", "poly", "cy", F.lit(None).cast("long").alias("cx"), ((F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"), F.lit(1).alias("edge"))
    middles = cells.select("zone_id", "poly", "cy", "cx", ((F.col("cx") + 0.5) * size).alias("x"), F.lit(0).alias("edge"))
    east = F.sum("edge").over(Window.partitionBy("zone_id", "poly", "cy").orderBy(F.col("x").desc(), "edge"))
    counted = met.unionByName(middles).withColumn("at_ref", east).where("edge = 0")
    return touched, counted.select(*CELL, F.col("at_ref").cast("int"))


def cover(zones: DataFrame, size: float = 0.1) -> DataFrame:
    """zone_id, level, cx, cy, inner and polys of every cell that has something of a zone.

    ``zones`` has zone_id and rings (polygons of rings, the first one outside).
    ``inner`` cells lie within the zone.  The others hold, per polygon, the edges
    that touch them, the heights of their corners and the bit that stands for all
    further edges.  Cells of level 0 have ``size`` degrees; border cells with many
    edges are split in four, level by level, so that no ring is copied whole.
    """
    edges, cells = _base(zones, size)
    leaves = []
    for level in range(DEEPEST + 1):
        s = size / 2**level
        edges = saved(edges.withColumn("corners", _corners(s)), "cell-edges")
        lon, lat = (F.col("cx") + 0.5) * s, (F.col("cy") + 0.5) * s
        own = edges.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum(_parity(edges, lon, lat)).alias("of_edges"))
        cells = cells.join(own, CELL, "left").select(*CELL, F.coalesce("n", F.lit(0)).alias("n"), F.pmod(F.col("at_ref") - F.coalesce("of_edges", F.lit(0)), F.lit(2)).cast("int").alias("bit"))
        cells = saved(cells, "cover-cells")
        many = (F.col("n") > EDGES) if level < DEEPEST else F.lit(False)
        leaf = cells.where(~many & ((F.col("n") > 0) | (F.col("bit") == 1)))
        held = edges.join(leaf.select(*CELL), CELL, "left_semi").groupBy(*CELL).agg(F.collect_list(F.struct("hole", "x1", "y1", "x2", "y2")).alias("edges"), F.flatten(F.collect_list("corners")).alias("corners"))
        full = leaf.join(held, CELL, "left")
        polys = F.collect_list(F.when(F.col("n") > 0, F.struct("bit", "edges", "corners")))
        leaves.append(full.groupBy("zone_id", "cx", "cy").agg((F.count_if(F.col("n") == 0) > 0).alias("inner"), polys.alias("polys")).withColumn("level", F.lit(level)))
        heavy = saved(cells.where(many).select(*CELL, "bit"), "heavy-cells")
        if level == DEEPEST or not heavy.limit(1).count():
            break
        # four cells for one, each judged at its middle by what is known of the one
        s /= 2
        child = F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("kx"), (F.col("cy") * 2 + j).alias("ky")) for i in (0, 1) for j in (0, 1)])).alias("k")
        inside = edges.join(heavy, CELL)
        parts = inside.select("*", child).select("zone_id", "poly", "bit", "x1", "y1", "x2", "y2", "corners", "k.*")
        at = _parity(parts, (F.col("kx") + 0.5) * s, (F.col("ky") + 0.5) * s)
        cells = parts.groupBy("zone_id", "poly", F.col("kx").alias("cx"), F.col("ky").alias("cy")).agg((F.sum(at) + F.first("bit")).cast("int").alias("at_ref"))
        smaller = inside.select("zone_id", "poly", *EDGE, child).select("zone_id", "poly", F.col("k.kx").alias("cx"), F.col("k.ky").alias("cy"), *EDGE)
        edges = smaller.where(_touches(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], s))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return saved(out, "cover")


def _on(e: Column, lon: Column, lat: Column) -> Column:
    x1, y1, x2, y2 = (e[c] for c in ("x1", "y1", "x2", "y2"))
    return ((x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1)) & lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))


def holds(lon: Column, lat: Column, hole_rims: bool = False) -> Column:
    """Whether the zone of a cover's cell holds a point of the cell; edges as in ``zones.inside``."""

    def within(p: Column) -> Column:
        odd = (F.aggregate(p["edges"], p["bit"], lambda n, e: n + crosses(lon, lat, e["x1"], e["y1"], e["x2"], e["y2"]).cast("int")) + _above(p["corners"], lat)) % 2 == 1
        if not hole_rims:
            return odd & ~F.exists(p["edges"], lambda e: _on(e, lon, lat))
        on_hole = F.exists(p["edges"], lambda e: e["hole"] & _on(e, lon, lat))
        return (odd | on_hole) & ~F.exists(p["edges"], lambda e: ~e["hole"] & _on(e, lon, lat))

    return F.col("inner") | F.exists("polys", within)


def _by_cell(points: DataFrame, covered: DataFrame, size: float) -> DataFrame:
    """Points (with lon, lat) with their cell ``_cell`` of every level that the cover has."""
    levels = sorted(r["level"] for r in covered.select("level").distinct().collect())  # DEEPEST + 1 at most
    cell = lambda n: F.struct(F.lit(n).alias("level"), F.floor(F.col("lon") / (size / 2**n)).alias("cx"), F.floor(F.col("lat") / (size / 2**n)).alias("cy"))
    return points.withColumn("_cell", F.explode(F.array(*[cell(n) for n in levels]))) if levels else points.where("false").withColumn("_cell", cell(0))


def in_cover(points: DataFrame, covered: DataFrame, size: float, hole_rims: bool = False) -> DataFrame:
    """Points (with lon, lat) beside the zone_id of every zone that holds them."""
    c = covered.select(F.struct("level", "cx", "cy").alias("_cell"), "zone_id", "inner", "polys")
    return _by_cell(points, covered, size).join(c, "_cell").where(holds(F.col("lon"), F.col("lat"), hole_rims)).drop("_cell", "inner", "polys")


def count_in_cover(points: DataFrame, covered: DataFrame, size: float, hole_rims: bool = False) -> DataFrame:
    """zone_id and n, the number of points (with lon, lat) that each zone holds, of zones that hold any.

    As many as ``in_cover`` gives rows, but no point meets its zones one by one:
    an inner cell adds its points as a number, and in a border cell each place
    is looked at once, however many points are there.
    """
    places = _by_cell(saved(points.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n")), "places"), covered, size)
    c = covered.select(F.struct("level", "cx", "cy").alias("_cell"), "zone_id", "inner", "polys")
    whole = places.groupBy("_cell").agg(F.sum("n").alias("n")).join(c.where("inner"), "_cell").select("zone_id", "n")
    border = places.join(c.where("not inner"), "_cell").where(holds(F.col("lon"), F.col("lat"), hole_rims)).select("zone_id", "n")
    return whole.unionByName(border).groupBy("zone_id").agg(F.sum("n").alias("n"))
