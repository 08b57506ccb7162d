"""Column specs: how a source's columns become those of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions.draw import drawn
from waymark.functions.modes import mode_code, mode_label
from waymark.schema import REQUIRED, TRIPS, WAYPOINTS, conform

TYPES = {"int": "int", "bigint": "bigint", "double": "double", "varchar": "string", "bool": "boolean"}


def column_expr(spec: dict, anchor: int) -> Column:
    """A column of a spec: ``csv`` (a source column) with a ``type`` and optionally a ``transform`` of ``value``, or ``derived`` SQL.

    SQL is Spark's; ``{epoch_anchor}`` in it is the anchor.
    """
    if ("csv" in spec) == ("derived" in spec):
        raise ValueError("a column is either csv or derived")
    kind = TYPES[spec.get("type", "varchar")]
    if "derived" in spec:
        return F.expr(spec["derived"].replace("{epoch_anchor}", str(anchor))).cast(kind)
    name = "`" + spec["csv"].replace("`", "``") + "`"
    if "transform" in spec:
        return F.expr(spec["transform"].replace("{epoch_anchor}", str(anchor)).replace("value", name)).cast(kind)
    return F.col(name).try_cast(kind) if kind != "string" else F.col(name).cast(kind)


def vehicle_key(template: str, vehicle: Column, scope: str = "") -> Column:
    """A key by template with {vehicle_id} and {scope}."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("{scope}", scope).split("{vehicle_id}")):
        if i:
            parts.append(vehicle.cast("string"))
        if piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def int_or_hash(x: Column, kind: str = "int") -> Column:
    """The number, or for other text a positive hash below 2e9 (int) or 9e18 (bigint)."""
    space = 2_000_000_000 if kind == "int" else 9_000_000_000_000_000_000
    hashed = drawn(x) % space + 1
    return F.coalesce(x.try_cast(TYPES[kind]).cast("bigint"), hashed).cast(TYPES[kind])


def mode_columns(code: Column | None, label: Column | None, overrides: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(transport_mode, mode): a declared label wins; text codes give labels, and their numbers the code; numbers give labels."""
    if label is not None:
        number = code.try_cast("int") if code is not None else mode_code(label, overrides)
        return number, label
    if code is None:
        return F.lit(None).cast("int"), F.lit(None).cast("string")
    number = code.try_cast("int")
    return number, F.when(number.isNotNull(), mode_label(number, overrides)).otherwise(code.cast("string"))


def project_source(df: DataFrame, table: str, columns: dict[str, dict], source_id: str, anchor: int, key_template: str = "{vehicle_id}", scope: str = "", points_only: bool = False) -> DataFrame:
    """A source in a table's columns: declared ones by their specs, implied ones filled, others null."""
    if missing := REQUIRED[table] - set(columns):
        raise ValueError(f"{table} needs {sorted(missing)}")
    made = {n: column_expr(s, anchor) for n, s in columns.items()}
    if "vehicle_id" in columns and "csv" in columns["vehicle_id"]:
        raw = F.col(columns["vehicle_id"]["csv"]).cast("string")
        made["vehicle_id"], made["vehicle_key"] = int_or_hash(raw), vehicle_key(key_template, raw, scope)
        made.setdefault("agent_id", raw)
    made["transport_mode"], made["mode"] = mode_columns(made.get("transport_mode"), made.get("mode"))
    made.setdefault("trip_id", F.lit(0 if points_only else None).cast("bigint"))
    if table == "trips" and "dep_hour" not in made:
        made["dep_hour"] = F.floor(made["starttime"] / 3600).cast("int")
    made["source_id"] = made["vehicle_type"] = F.lit(source_id)
    return conform(df.select([c.alias(n) for n, c in made.items()]), TRIPS if table == "trips" else WAYPOINTS)
