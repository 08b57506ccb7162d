"""Absolute milliseconds, seconds of the day and days, relative to an epoch anchor in seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86400
DEFAULT_ANCHOR = 1601478000


def seconds(ms: Column, anchor: int | Column) -> Column:
    """Whole seconds since the anchor, rounded down also before it."""
    return F.floor(ms / 1000).cast("long") - (F.lit(anchor) if isinstance(anchor, int) else anchor)


def clock_of_day(ms: Column, anchor: int | Column = DEFAULT_ANCHOR) -> Column:
    return F.pmod(seconds(ms, anchor), F.lit(DAY)).cast("int")


def hour_of_day(ms: Column, anchor: int | Column = DEFAULT_ANCHOR) -> Column:
    return F.floor(clock_of_day(ms, anchor) / 3600).cast("int")


def day_index(ms: Column, anchor: int | Column = DEFAULT_ANCHOR) -> Column:
    return F.floor(seconds(ms, anchor) / DAY).cast("int")


def parse_time_ms(text: Column) -> Column:
    """Milliseconds of an ISO time (UTC unless it states an offset) or of a number (seconds below 1e11); null for anything else."""
    number = text.try_cast("double")
    iso = F.try_to_timestamp(text)
    return F.when(number.isNotNull(), F.when(F.abs(number) < 1e11, F.round(number * 1000)).otherwise(F.round(number)).cast("long")).otherwise(F.floor(F.unix_micros(iso) / 1000).cast("long"))


def time_kind_to_ms(x: Column, kind: str) -> Column:
    """Milliseconds of a time column of a declared kind: iso, epoch_ms or epoch_s."""
    if kind == "iso":
        return F.floor(F.unix_micros(F.try_to_timestamp(x)) / 1000).cast("long")
    if kind == "epoch_ms":
        return x.cast("long")
    if kind == "epoch_s":
        return F.round(x.cast("double") * 1000).cast("long")
    raise ValueError(f"unknown kind of time: {kind}")


def start_seconds(x: Column, kind: str, anchor: int) -> Column:
    """Seconds of the day at which a trip starts, from a column of a declared kind (day_seconds: as it is)."""
    return x.cast("int") if kind == "day_seconds" else clock_of_day(time_kind_to_ms(x, kind), anchor)
