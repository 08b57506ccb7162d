"""Density clustering of trips by their ends, and of routes by their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.operators.density import cell_dbscan
from waymark.operators.filters import PAIR
from waymark.operators.graphs import min_label
from waymark.shared import saved

FEATURES = ("start_lon", "start_lat", "end_lon", "end_lat", "distance_km", "dep_hour")
#: Weights of the features.
WEIGHTS = (2.0, 2.0, 2.0, 2.0, 1.0, 0.5)


def feature_scale(trips: DataFrame) -> DataFrame:
    """Trips with distance, their features and f0 to f5: each scaled to 0..1 (0 if it has one value)."""
    d = trips.where("distance_km > 0 and start_lon is not null and end_lon is not null")
    d = d.select(*PAIR, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])
    span = d.agg(*[x for c in FEATURES for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    scaled = [((F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(1.0)).alias(f"f{i}") for i, c in enumerate(FEATURES)]
    return d.join(F.broadcast(span)).select(*PAIR, *FEATURES, *scaled)


def eps_neighbours(points: DataFrame, eps: float, dims: int = 6) -> DataFrame:
    """Pairs (a, b), a <> b, of ids within ``eps`` in f0..: points meet in grid cells over the first four features.

    One side is copied to the 81 cells around its own, so each pair meets once;
    a fourth feature leaves a crowded cell a few times fewer points to compare.
    """
    g = min(4, dims)
    cell = [F.floor(F.col(f"f{i}") / eps) for i in range(g)]
    left = points.select(F.col("id").alias("a"), *[F.col(f"f{i}").alias(f"a{i}") for i in range(dims)], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    right = points.select(F.col("id").alias("b"), *[F.col(f"f{i}").alias(f"b{i}") for i in range(dims)], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    for i in range(g):
        right = right.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + d for d in (-1, 0, 1)])))
    gap = sum(((F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in range(1, dims)), (F.col("a0") - F.col("b0")) * (F.col("a0") - F.col("b0")))
    return left.join(right, [f"c{i}" for i in range(g)]).where((F.col("a") != F.col("b")) & (gap <= eps * eps)).select("a", "b")


def dbscan(ids: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """id and cluster (its smallest core point; null for noise) by ``pairs`` (a, b), each in one direction or both.

    A point counts itself; a border point joins its smallest cluster.  With a
    column ``weight``, an id stands for so many points that are all alike.
    """
    own = ids.select(F.col("id").alias("node"), (F.col("weight") if "weight" in ids.columns else F.lit(1)).alias("w"))
    near = pairs.select("a", "b")
    near = saved(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    around = near.join(own, near["b"] == own["node"]).groupBy("a").agg(F.sum("w").alias("n"))
    core = own.join(around, own["node"] == around["a"], "left").where(F.col("w") + F.coalesce("n", F.lit(0)) >= min_samples).select("node")
    core = saved(core)
    inner = near.where("a > b").join(core, near["a"] == core["node"], "left_semi").join(core, near["b"] == core["node"], "left_semi")
    labels = saved(min_label(core, inner))
    border = near.join(labels, near["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("border"))
    d = ids.select("id").join(labels, F.col("id") == labels["node"], "left").join(border, F.col("id") == border["a"], "left")
    return d.select("id", F.coalesce("label", "border").alias("cluster"))


def pair_id() -> Column:
    """A number for a trip's identity."""
    return F.xxhash64(*PAIR)


def cluster_od(trips: DataFrame, eps: float = 0.15, min_cluster_size: int = 20, id: Column | None = None) -> DataFrame:
    """Each trip's cluster (the least ``id`` of its core points; null for noise) by its weighted, scaled features; ``id`` numbers the trips, by a hash if not given."""
    d = feature_scale(trips)
    points = saved(d.select((pair_id() if id is None else id).alias("id"), *PAIR, *FEATURES, *[(F.col(f"f{i}") * w).alias(f"f{i}") for i, w in enumerate(WEIGHTS)]))
    return cell_dbscan(points, eps, min_cluster_size).select(*PAIR, "cluster", *FEATURES)


def cluster_summary(clustered: DataFrame, members: int = 20) -> DataFrame:
    """Size, centre, representative (nearest to the centre in raw features; ties by key) and first members of every cluster, and how much is noise."""
    clustered = saved(clustered, "clustered")  # read four times
    c = clustered.where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f"avg_{f}") for f in FEATURES])
    gap = sum(((F.col(f) - F.col(f"avg_{f}")) * (F.col(f) - F.col(f"avg_{f}")) for f in FEATURES), F.lit(0.0))
    rep = clustered.join(c, "cluster").groupBy("cluster").agg(F.min_by(F.struct(*PAIR), F.struct(F.round(gap, 9), *PAIR)).alias("rep"))
    first = clustered.where("cluster is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("cluster").orderBy(*PAIR))).where(F.col("_rn") <= members)
    first = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(*PAIR))).alias("members"))
    noise = clustered.agg(F.count_if(F.col("cluster").isNull()).alias("noise"))  # one row
    d = c.join(rep, "cluster").join(first, "cluster").join(F.broadcast(noise))
    return d.select("cluster", "size", *[f"avg_{f}" for f in FEATURES], F.col("rep.vehicle_key").alias("vehicle_key"), F.col("rep.trip_id").alias("trip_id"), "members", "noise")


def link_sets(waypoints: DataFrame, link: str = "link_id") -> DataFrame:
    """Distinct (trip, link)."""
    return waypoints.where(F.col(link).isNotNull() & (F.col(link) != "")).select(*PAIR, F.col(link).alias("link_id")).distinct()


#: Sets of one link, or of one band, that one task pairs with the others there.
LINK_ROWS = 4096


def by_rarity(sets: DataFrame) -> DataFrame:
    """id, n, links, parts and marks of ``sets`` (id and links, an array without repeats): the links, as numbers, those of the fewest sets first.

    ``parts`` tells for each link in how many parts its sets are dealt; ``marks``
    has one of 64 bits per link.
    """
    each = sets.select("id", F.explode("links").alias("link"))
    held = saved(each.groupBy("link").agg(F.count(F.lit(1)).alias("sets")).withColumn("number", F.monotonically_increasing_id()), "links")
    ranked = each.join(held, "link").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sets", "number"))).alias("r"), F.bit_or(F.expr("shiftleft(1L, CAST(pmod(xxhash64(number), 64L) AS INT))")).alias("marks"))
    parts = F.transform("r", lambda x: F.ceil(x["sets"] / LINK_ROWS))
    return ranked.select("id", F.size("r").alias("n"), F.transform("r", lambda x: x["number"]).alias("links"), parts.alias("parts"), "marks")


def _met(rows: DataFrame, key: str) -> DataFrame:
    """Structs x and y of all ``rows`` that share a ``key``, x of the smaller id; rows of a frequent key are spread by salts, over ``parts`` if they tell how many."""
    salted = rows.select(key, "parts", F.struct(*[c for c in rows.columns if c != "parts"]).alias("row")) if "parts" in rows.columns else None
    if salted is None:
        parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / LINK_ROWS).alias("parts"))
        salted = rows.select(key, F.struct("*").alias("row")).join(parts, key)
    x = salted.select(key, F.col("row").alias("x"), F.pmod(F.xxhash64("row.id"), F.col("parts")).alias("salt"))
    y = salted.select(key, F.col("row").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    return x.join(y, [key, "salt"]).where("x.id < y.id")


def _compared(met: DataFrame, max_distance: float) -> DataFrame:
    """a, b, na, nb, shared and distance of pairs x and y (id, n, links) that are near enough, with ``first``, the rarest link they share."""
    d = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.array_intersect("x.links", "y.links").alias("both"), *[c for c in met.columns if c not in ("x", "y", "salt")])
    d = d.withColumns({"shared": F.size("both").cast("long"), "first": F.get("both", 0)})
    return d.withColumn("distance", 1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.round("distance", 12) <= max_distance)


def set_pairs(sets: DataFrame, max_distance: float) -> DataFrame:
    """a, b, na, nb, shared and distance of all pairs of ``sets`` (id and links) that share a link and are at most so far apart (Jaccard).

    Two such sets share one of their rarest links: of n links, all but the last
    ceil(similarity * n) - 1 in order of how many sets have them.  Only these are
    joined, each with its place in that order.  A pair is looked at where the
    sizes of its sets, the links that either still has after the place, and the
    marks that only one of them has, let it be near enough, and is kept at the
    rarest link that both have; so no pair comes twice, and sets are not fetched
    again.
    """
    least = 1 - max_distance
    ranked = saved(by_rarity(sets), "ranked-sets")
    prefix = (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int")
    posted = ranked.select("id", "n", "links", "marks", F.posexplode(F.slice(F.arrays_zip(F.col("links").alias("link"), F.col("parts").alias("of")), F.lit(1), F.least(prefix, F.col("n")))).alias("place", "at"))
    posted = posted.select("id", "n", "links", "marks", "place", F.col("at.link").alias("link"), F.col("at.of").alias("parts"))
    nx, ny = F.col("x.n"), F.col("y.n")
    need = F.ceil(least / (1 + least) * (nx + ny) - 1e-9)
    sizes = F.least(nx, ny) >= least * F.greatest(nx, ny) - 1e-9
    ahead = F.least(nx - F.col("x.place"), ny - F.col("y.place")) >= need  # this link and those after it
    alone = lambda s, t: F.bit_count(F.col(f"{s}.marks").bitwiseAND(F.bitwise_not(F.col(f"{t}.marks"))))  # noqa: E731 each such mark is of a link that the other has not
    marked = F.least(nx - alone("x", "y"), ny - alone("y", "x")) >= need
    near = _compared(_met(posted, "link").where(sizes & ahead & marked), max_distance)
    return near.where("first = link").select("a", "b", "na", "nb", "shared", "distance")


def banded_pairs(sets: DataFrame, max_distance: float, bands: int, rows: int) -> DataFrame:
    """The pairs of ``set_pairs``, found by min-hashes: those that agree in all ``rows`` hashes of one of ``bands`` are compared.

    A pair of similarity s is found with a probability of 1 - (1 - s^rows)^bands;
    none is found that is too far apart.
    """
    d = saved(sets.select("id", F.size("links").alias("n"), "links"), "sets")
    least = lambda k: F.array_min(F.transform("links", lambda x: F.xxhash64(x, F.lit(k))))
    band = lambda i: F.xxhash64(F.lit(i), *[least(i * rows + j) for j in range(rows)])
    keyed = d.select("*", F.explode(F.array(*[band(i) for i in range(bands)])).alias("band"))
    return _compared(_met(keyed, "band"), max_distance).select("a", "b", "na", "nb", "shared", "distance").distinct()


def jaccard_pairs(sets: DataFrame, max_distance: float, id: Column | None = None) -> DataFrame:
    """Pairs of trips (a < b by ``id``) that share a link and whose link sets (rows of trip and link) are at most so far apart: see ``set_pairs``."""
    own = sets.select((pair_id() if id is None else id).alias("id"), "link_id")
    return set_pairs(own.groupBy("id").agg(F.collect_set("link_id").alias("links")), max_distance)


def route_similarity(waypoints: DataFrame, link: str = "link_id", eps: float = 0.3, min_samples: int = 3, id: Column | None = None, bands: tuple[int, int] | None = None) -> DataFrame:
    """Each trip's cluster by the Jaccard distance of its links; clusters are named by the least ``id`` (a hash if not given) of their core trips.

    Trips with the same links are one set that counts as many times.  Near sets
    are found exactly, or with ``bands`` (a number of bands and of hashes in
    each) by min-hashes, which may miss some: see ``banded_pairs``.
    """
    per = waypoints.where(F.col(link).isNotNull() & (F.col(link) != "")).groupBy(*PAIR).agg(F.sort_array(F.collect_set(link)).alias("links"))
    trips = saved(per.withColumn("id", pair_id() if id is None else id), "route-trips")
    sets = saved(trips.groupBy("links").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "route-sets")
    pairs = set_pairs(sets, eps) if bands is None else banded_pairs(sets, eps, *bands)
    found = dbscan(sets, pairs, min_samples)
    named = sets.join(found, "id").select("links", "cluster")
    return trips.join(named, "links").select(*PAIR, "cluster")
