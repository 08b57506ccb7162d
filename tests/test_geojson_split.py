"""A collection read in parts has the rows of the collection read whole."""

import json
import random

import pytest

from waymark.sources import files


def feature(i, rnd):
    name = rnd.choice(["plain", "quoted \" {\"type\": ", "ünï", "a Feature", "]}", "Feature\\n"]) + str(i)
    if i % 3 == 0:
        return {"type": "Feature", "id": f"f{i}", "geometry": {"type": "LineString", "coordinates": [[i / 10, 1], [i / 10, 2.5, 9]]}, "properties": {"name": name, "time": 5}}
    return {"type": "Feature", "properties": {"name": name, "time": i, "nested": {"a": [1, {"b": 2}]}}, "geometry": {"type": "Point", "coordinates": [i / 10, -i / 20]}}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("indent", [None, 1])
def test_parts_are_the_whole(spark, tmp_path, indent):
    rnd = random.Random(1)
    docs = [{"type": "FeatureCollection", "features": [feature(i, rnd) for i in range(n)], "crs": {"type": "name"}} for n in (700, 1, 0)]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.geojson").write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    path = str(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        parts = files._features(spark, path, "split")
        assert parts.count() == 701 and spark.read.option("lineSep", files.FEATURE).text(path).rdd.getNumPartitions() > 10
        for scan in (files.scan_geojson_points, files.scan_geojson_lines):
            assert rows(scan(spark, path, "split")) == rows(scan(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("odd", [{"geometry": None, "type": "Feature", "properties": {}}, {"type": "Feature", "properties": {"kind": "Feature"}, "geometry": None}])
def test_other_layouts_fail(spark, tmp_path, odd):
    good = feature(1, random.Random(2))
    for k, features in enumerate(([good, odd, good], [odd, good])):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}/x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        with pytest.raises(Exception, match="begins with its type"):
            files.scan_geojson_points(spark, f"{tmp_path}/{k}", "split").collect()
