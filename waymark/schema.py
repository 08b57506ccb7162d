"""Fixed schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "varchar": StringType(), "bool": BooleanType()}


def _struct(text: str) -> StructType:
    return StructType([StructField(n, _TYPES[t]) for n, t in (x.split(":") for x in text.split())])


TRIPS = _struct(
    "vehicle_id:int agent_id:varchar trip_id:bigint starttime:int start_lon:double start_lat:double end_lon:double end_lat:double "
    "transport_mode:int mode:varchar purpose:int vehicle_type:varchar distance_km:double dep_hour:int simulation_day:int goods_type:varchar "
    "vehicle_size:varchar cargo_loaded:bool origin_zone:varchar dest_zone:varchar fare_yen:double is_night_trip:bool passenger_in:bool "
    "taxi_id:int city:varchar vehicle_key:varchar source_id:varchar leg_id:int speed_avg_kmh:double dwell_minutes:double detour_ratio:double"
)
WAYPOINTS = _struct(
    "vehicle_id:int agent_id:varchar trip_id:bigint unix_time_ms:bigint lon:double lat:double link_id:varchar vehicle_type:varchar "
    "transport_mode:int mode:varchar purpose:int goods_type:varchar vehicle_size:varchar passenger_in:varchar fare_yen:double "
    "is_night_trip:varchar vehicle_key:varchar source_id:varchar leg_id:int"
)
POIS = _struct("poi_id:bigint source_key:varchar name:varchar category:varchar lon:double lat:double props_json:varchar")
INGEST_LOG = _struct("file_path:varchar table_name:varchar row_count:bigint")

#: Columns that a mapping has to declare.
REQUIRED = {"trips": {"starttime", "start_lon", "start_lat", "end_lon", "end_lat"}, "waypoints": {"unix_time_ms", "lon", "lat"}}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: cast, in order, null where undeclared."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
