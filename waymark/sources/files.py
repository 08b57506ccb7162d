"""Readers of tabular files, point and line features, tracks, simulator logs, overlays and buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from waymark.functions.clock import parse_time_ms
from waymark.functions.geo import haversine_m
from waymark.shared import saved

GEOMETRY = "struct<type:string,coordinates:string>"
STAGED = ("_lon", "_lat", "_time_ms", "_seq", "_feature_id", "_trk_name", "_props_json")


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line: the declared first-level columns, and the line as ``_props_json``.  Blank lines are skipped; a line that is no object fails."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.col("value").alias("_props_json")).select("r.*", "_props_json")


#: Where a collection read in parts is cut: the type of a feature, which comes first in it.
FEATURE = '"Feature"'


def _feature_parts(spark: SparkSession, path: str) -> DataFrame:
    """Features of collections, each file read by as many tasks as it has splits.

    Files are cut at the type of each feature, which has to be its first member;
    of a part, the one feature that it starts with is read.  What is cut
    otherwise (a type that comes later, or the same word within a property)
    fails.  Features are numbered as they stand in their file: by their number
    in a split, and the features of the splits before it.
    """
    d = spark.read.option("lineSep", FEATURE).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    d = saved(d, "feature-parts")
    blocks = d.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = d.join(F.broadcast(blocks.withColumn("before", before)), ["file", "block"])  # a row per split
    at = F.col("before") + F.col("id") - F.col("first")  # 0: what comes before the first feature
    text = F.concat(F.lit('{"type":"Feature"'), F.col("value"))
    # what comes before a feature's type is its opening brace alone; the last part ends the file
    clean = F.col("value").rlike(r'(\{\s*"type"\s*:|\})\s*$') & ((at == 0) | F.get_json_object(text, "$").isNotNull())
    failed = F.raise_error(F.concat(F.lit("not a feature that begins with its type: "), F.substring(text, 1, 80)))
    # both columns fail, so that no filter on one of them passes over a part that is none
    number, feature = F.when(clean, at - 1).otherwise(failed.cast("long")), F.when(clean, text).otherwise(failed)
    return placed.select(number.cast("int").alias("_seq"), feature.alias("feature")).where("_seq >= 0")


def _features(spark: SparkSession, path: str, multiline: bool | str) -> DataFrame:
    """Features of a collection (one document per file, or with ``"split"`` in parts) or one feature per line (which files are split by)."""
    if multiline == "split":
        return _feature_parts(spark, path)
    if multiline:
        docs = spark.read.text(path, wholetext=True)
        found = F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>"))
        return docs.select(found.alias("_seq", "feature"))
    return spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("feature"))


def _geo(spark: SparkSession, path: str, multiline: bool | str) -> DataFrame:
    j = lambda p: F.get_json_object("feature", p)
    return _features(spark, path, multiline).select("_seq", j("$.geometry.type").alias("geometry_type"), j("$.geometry.coordinates").alias("coordinates"), j("$.properties").alias("_props_json"), F.coalesce(j("$.id"), F.col("_seq").cast("string")).alias("_feature_id"))


def scan_geojson_points(spark: SparkSession, path: str, multiline: bool | str = True) -> DataFrame:
    """A row per Point feature; its time is the property ``time``."""
    d = _geo(spark, path, multiline).where("geometry_type = 'Point'").withColumn("c", F.from_json("coordinates", "array<double>"))
    return d.select(F.get("c", F.lit(0)).alias("_lon"), F.get("c", F.lit(1)).alias("_lat"), parse_time_ms(F.get_json_object("_props_json", "$.time")).alias("_time_ms"), "_seq", "_feature_id", "_props_json")


def scan_geojson_lines(spark: SparkSession, path: str, multiline: bool | str = True, times: str = "coordTimes") -> DataFrame:
    """A row per coordinate of each LineString; time from the list of times, else the feature's, else null."""
    d = _geo(spark, path, multiline).where("geometry_type = 'LineString'")
    d = d.select("*", F.from_json(F.get_json_object("_props_json", f"$.{times}"), "array<string>").alias("ts"), F.posexplode(F.from_json("coordinates", "array<array<double>>")).alias("pos", "c"))
    at = F.coalesce(F.try_element_at("ts", F.col("pos") + 1), F.get_json_object("_props_json", "$.time"))
    return d.select(F.get("c", F.lit(0)).alias("_lon"), F.get("c", F.lit(1)).alias("_lat"), parse_time_ms(at).alias("_time_ms"), F.col("pos").alias("_seq"), "_feature_id", "_props_json")


def scan_zones_geojson(spark: SparkSession, path: str, source_key: str, multiline: bool | str = True) -> DataFrame:
    """Polygons and multipolygons as zones with rings and bounds; other geometries fail."""
    d = _geo(spark, path, multiline)
    good = F.col("geometry_type").isin("Polygon", "MultiPolygon")
    d = d.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("no polygon: "), F.coalesce("geometry_type", F.lit("null")))).cast("boolean")))
    text = F.when(F.col("geometry_type") == "Polygon", F.concat(F.lit("["), "coordinates", F.lit("]"))).otherwise(F.col("coordinates"))
    raw = F.from_json(text, "array<array<array<array<double>>>>")
    rings = F.transform(raw, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat")))))
    d = d.select((F.col("_seq") + 1).cast("long").alias("zone_id"), F.lit(source_key).alias("source_key"), F.get_json_object("_props_json", "$.name").alias("name"), F.get_json_object("_props_json", "$.category").alias("category"), rings.alias("rings"), "_props_json")
    flat = F.flatten(F.flatten("rings"))
    x, y = F.transform(flat, lambda p: p["lon"]), F.transform(flat, lambda p: p["lat"])
    return d.select("*", F.array_min(x).alias("min_lon"), F.array_min(y).alias("min_lat"), F.array_max(x).alias("max_lon"), F.array_max(y).alias("max_lat"))


GPX = "name string, trkseg array<struct<trkpt:array<struct<_lat:double,_lon:double,ele:double,time:string>>>>"


def scan_gpx(spark: SparkSession, path: str) -> DataFrame:
    """A row per track point: ``_feature_id`` track:segment, name of the track (``trkN`` if it has none), ``_seq`` over the track."""
    t = spark.read.format("xml").option("rowTag", "trk").schema(GPX).load(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), "name", "trkseg")
    index = F.row_number().over(Window.partitionBy("file").orderBy("row")) - 1
    t = t.withColumn("trk", index)
    s = t.select("file", "trk", "name", F.posexplode("trkseg").alias("seg", "s")).select("file", "trk", "name", "seg", F.posexplode("s.trkpt").alias("pos", "p"))
    seq = F.row_number().over(Window.partitionBy("file", "trk").orderBy("seg", "pos")) - 1
    name = F.coalesce("name", F.concat(F.lit("trk"), F.col("trk").cast("string")))
    return s.select(F.col("p._lon").alias("_lon"), F.col("p._lat").alias("_lat"), parse_time_ms(F.col("p.time")).alias("_time_ms"), seq.alias("_seq"), F.concat_ws(":", "trk", "seg").alias("_feature_id"), name.alias("_trk_name"), F.to_json(F.struct("p.ele")).alias("_props_json"))


def scan_pois(df: DataFrame, source_key: str, columns: dict[str, Column], offset: int = 0) -> DataFrame:
    """Places of any input: ids count on from ``offset`` within the layer, by name, place and category."""
    d = df.select(F.lit(source_key).alias("source_key"), *[c.alias(n) for n, c in columns.items()])
    w = Window.partitionBy("source_key").orderBy("name", "lon", "lat", "category")
    return d.withColumns({"poi_id": F.lit(offset) + F.row_number().over(w), "props_json": F.to_json(F.struct("name", "category"))})


def scan_validation(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Metrics of runs: the run id from the source and the folder run_YYYYMMDD_HHMMSS, whose name gives the time."""
    d = spark.read.option("header", True).schema("metric string, value double").option("recursiveFileLookup", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    run = F.regexp_extract("file", r"(run_\d{8}_\d{6})", 1)
    return d.select(F.concat_ws("/", F.lit(source_id), run).alias("run_id"), F.try_to_timestamp(F.substring(run, 5, 15), F.lit("yyyyMMdd_HHmmss")).alias("run_at"), "metric", "value")


def scan_agent_events(spark: SparkSession, events: str, network: str, epoch_ms: int, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(trips, link pings) of a simulator's event log.

    Departures and arrivals of a person pair up in order; a ping takes the
    number of arrivals before it plus one, and the middle of its link.
    ``partitions`` says to how many tasks the persons are dealt, if not to the
    session's shuffle partitions.
    """
    xml = spark.read.format("xml")
    e = xml.option("rowTag", "event").schema("_time double, _type string, _person string, _link string, _legMode string, _vehicle string").load(events)
    e = e.select(F.col("_time").alias("time"), F.col("_type").alias("type"), F.coalesce("_person", "_vehicle").alias("person"), F.col("_link").alias("link"), F.col("_legMode").alias("leg_mode"))
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _x double, _y double").load(network)
    links = spark.read.format("xml").option("rowTag", "link").schema("_id string, _from string, _to string").load(network)
    a, b = (nodes.select(F.col("_id").alias(f"{p}_id"), F.col("_x").alias(f"{p}x"), F.col("_y").alias(f"{p}y")) for p in "ab")
    mid = links.join(a, F.col("_from") == F.col("a_id")).join(b, F.col("_to") == F.col("b_id")).select(F.col("_id").alias("link"), ((F.col("ax") + F.col("bx")) / 2).alias("lon"), ((F.col("ay") + F.col("by")) / 2).alias("lat"))
    order = F.when(F.col("type") == "arrival", 1).otherwise(0)
    w = Window.partitionBy("person").orderBy("time", order, "link")
    e = e.where("person is not null").join(mid, "link", "left")
    e = e if partitions is None else e.repartition(partitions, "person")
    e = e.withColumn("seq", F.coalesce(F.sum(order).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    s = F.struct("time", "lon", "lat", "leg_mode")
    t = e.groupBy("person", "seq").agg(F.min(F.when(F.col("type") == "departure", s)).alias("d"), F.max(F.when(F.col("type") == "arrival", s)).alias("a")).where("d is not null and a is not null")
    trips = t.select(F.col("seq").alias("trip_id"), F.col("person").alias("person_id"), F.col("d.time").cast("int").alias("start_time_sec"), F.col("d.lon").alias("start_lon"), F.col("d.lat").alias("start_lat"), F.col("a.lon").alias("end_lon"), F.col("a.lat").alias("end_lat"), F.col("d.leg_mode").alias("mode"), haversine_m(F.col("d.lon"), F.col("d.lat"), F.col("a.lon"), F.col("a.lat")).alias("trip_length_m"))
    pings = e.where("type in ('entered link', 'left link') and lon is not null").select(F.col("person").alias("person_id"), F.col("seq").alias("trip_id"), (F.lit(epoch_ms) + F.col("time") * 1000).cast("long").alias("time_ms"), "lon", "lat", F.col("link").alias("link_id"))
    return trips, pings


def scan_fcd(spark: SparkSession, path: str, epoch_ms: int, types: dict[str, str]) -> DataFrame:
    """Floating-car data as pings; the edge is given or the lane without its number."""
    schema = "_time double, vehicle array<struct<_id:string,_x:double,_y:double,_angle:double,_type:string,_speed:double,_pos:double,_lane:string,_edge:string>>"
    d = spark.read.format("xml").option("rowTag", "timestep").schema(schema).load(path).select("_time", F.explode("vehicle").alias("v"))
    labels = F.create_map(*[F.lit(x) for kv in types.items() for x in kv]) if types else None
    kind = F.coalesce(F.try_element_at(labels, F.col("v._type")), F.col("v._type")) if types else F.col("v._type")
    return d.select(F.col("v._id").alias("id"), (F.lit(epoch_ms) + F.round(F.col("_time") * 1000)).cast("long").alias("time_ms"), F.col("v._x").alias("x"), F.col("v._y").alias("y"), F.coalesce("v._edge", F.regexp_replace("v._lane", r"_\d+$", "")).alias("edge"), kind.alias("mode"), F.col("v._speed").alias("speed"))


def scan_building_centroids(spark: SparkSession, path: str, codes: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = box
    d = spark.read.option("header", True).schema("code string, x double, y double, area double").csv(path)
    return d.where(F.col("code").isin(*codes) & F.col("x").between(west, east) & F.col("y").between(south, north))


#: Names under which heights are found, in order.
HEIGHTS = ("measuredHeight", "measured_height", "height", "bldg:measuredHeight", "HEIGHT")


def _tidy(ring: Column) -> Column:
    """A ring without its closing vertex and without repeats of the one before."""
    kept = F.filter(ring, lambda p, i: (i == 0) | (F.get(ring, i - 1) != p))
    n = F.size(kept)
    return F.when((n > 1) & (F.get(kept, n - 1) == F.get(kept, F.lit(0))), F.slice(kept, 1, n - 1)).otherwise(kept)


def scan_building_footprints(spark: SparkSession, path: str, multiline: bool | str = True) -> DataFrame:
    """Outer rings of footprints with three vertices or more, and heights: the first number before ``;``, 8 m if there is none above 0.5."""
    d = _geo(spark, path, multiline).where("geometry_type = 'Polygon'")
    found = F.coalesce(*[F.trim(F.get(F.split(F.get_json_object("_props_json", f"$['{h}']"), ";"), F.lit(0))).try_cast("double") for h in HEIGHTS])
    raw = F.get(F.from_json("coordinates", "array<array<array<double>>>"), F.lit(0))
    ring = F.transform(raw, lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat")))
    return d.select("_feature_id", _tidy(ring).alias("ring"), F.when(found > 0.5, found).otherwise(8.0).alias("height_m")).where(F.size("ring") >= 3)


def scan_citygml(spark: SparkSession, path: str) -> DataFrame:
    """Roof-edge or footprint rings of buildings with their heights; positions are latitude, longitude and maybe altitude."""
    surface = "struct<`gml:MultiSurface`:struct<`gml:surfaceMember`:array<struct<`gml:Polygon`:struct<`gml:exterior`:struct<`gml:LinearRing`:struct<`gml:posList`:string>>>>>>>"
    d = spark.read.format("xml").option("rowTag", "bldg:Building").schema(f"`_gml:id` string, `bldg:measuredHeight` double, `bldg:lod0RoofEdge` {surface}, `bldg:lod0FootPrint` {surface}").load(path)
    member = lambda c: F.col(f"`{c}`.`gml:MultiSurface`.`gml:surfaceMember`")
    d = d.select(F.col("`_gml:id`").alias("key"), F.col("`bldg:measuredHeight`").alias("height_m"), F.explode(F.coalesce(member("bldg:lod0RoofEdge"), member("bldg:lod0FootPrint"))).alias("m"))
    v = F.transform(F.split(F.trim(F.col("m.`gml:Polygon`.`gml:exterior`.`gml:LinearRing`.`gml:posList`")), r"\s+"), lambda x: x.try_cast("double"))
    d = d.withColumn("v", v).withColumn("step", F.when(F.size("v") % 3 == 0, 3).otherwise(2))
    ring = F.expr("transform(sequence(0, size(v) div step - 1), i -> named_struct('lon', v[i * step + 1], 'lat', v[i * step]))")
    return d.select("key", "height_m", _tidy(ring).alias("ring"))


def discover_files(spark: SparkSession, root: str, pattern: str, latest_only: bool = True) -> DataFrame:
    """Paths that match, of the latest ``run_*`` folder per parent; only names are listed, no content is read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    d = d.select("path", F.regexp_extract("path", r"^(.*?)/(run_[^/]*)/", 1).alias("parent"), F.regexp_extract("path", r"^(.*?)/(run_[^/]*)/", 2).alias("run"))
    if not latest_only:
        return d
    last = F.max("run").over(Window.partitionBy("parent"))
    return d.withColumn("last", last).where((F.col("run") == F.col("last")) | (F.col("run") == "")).drop("last")


def discovery_counts(found: DataFrame, name: Column) -> DataFrame:
    return found.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("files"))


def stage_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of differing columns: the union of the columns, null where missing."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
