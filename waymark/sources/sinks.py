"""Writers of the canonical tables; parts of them are replaced as new versions (see ``versions``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.functions.curve import in_ranges, place_key
from waymark.operators.filters import in_box
from waymark.schema import TRIPS, WAYPOINTS, conform
from waymark.sources.versions import Versions


def write_table(df: DataFrame, path: str, by: str, sort: tuple[str, ...] = ()) -> None:
    """Replace, in the table at ``path``, the partitions of ``by`` that ``df`` has; others stay."""
    d = df.sortWithinPartitions(by, *sort) if sort else df
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_trips(trips: DataFrame, path: str) -> None:
    write_table(conform(trips, TRIPS), path, "source_id", ("vehicle_key", "trip_id"))


def write_waypoints(waypoints: DataFrame, path: str) -> None:
    write_table(conform(waypoints, WAYPOINTS), path, "source_id", ("vehicle_key", "trip_id", "unix_time_ms"))


def write_by_place(waypoints: DataFrame, path: str, files: int | None = None, rows: int = 5_000_000) -> None:
    """Write waypoints sorted along a space-filling curve (column ``place``), for questions about boxes: see ``read_box``.

    Rows are dealt to files by ranges of the curve, about ``rows`` to a file
    (or as many ``files``), so that a crowded place is spread over several.
    """
    d = conform(waypoints, WAYPOINTS).withColumn("place", place_key(F.col("lon"), F.col("lat")))
    n = files or 1 + waypoints.count() // rows
    d.repartitionByRange(n, "place", "vehicle_key", "trip_id").sortWithinPartitions("place", "vehicle_key", "trip_id", "unix_time_ms").write.mode("overwrite").parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """The waypoints of ``write_by_place`` that are in a box (west, south, east, north).

    Ranges of the curve leave out row groups of other places by their
    statistics; the box itself decides.
    """
    return spark.read.parquet(path).where(in_ranges(F.col("place"), box) & in_box(box)).drop("place")


def replace_source(store: Versions, source_id: str, trips: DataFrame, waypoints: DataFrame) -> int:
    """Write a source again, as often as it is run: trips and waypoints change together, and a source without rows is gone."""
    tables = {"trips": ("source_id", conform(trips, TRIPS)), "waypoints": ("source_id", conform(waypoints, WAYPOINTS))}
    return store.replace(source_id, tables, {"trips": ("vehicle_key", "trip_id"), "waypoints": ("vehicle_key", "trip_id", "unix_time_ms")})


def replace_resolution(store: Versions, resolution: float, cells: DataFrame) -> int:
    """Replace the cells of one resolution; without cells it is gone."""
    return store.replace(resolution, {"density": ("resolution", cells)})


def replace_validation_run(store: Versions, run_id: str, rows: DataFrame) -> int:
    """Replace the rows of one validation run; without rows it is gone."""
    return store.replace(run_id, {"validation": ("run_id", rows)})


def append_ingest_log(rows: DataFrame, path: str) -> None:
    """Append files and their row counts (-1 for a failure) with the time."""
    rows.withColumn("ingested_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
