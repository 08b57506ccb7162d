"""Distances in kilometres or metres between points in degrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KM_PER_DEGREE = 111.32
EARTH_KM = 6371.0


def equirect_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, at: Column | None = None) -> Column:
    """Equirectangular distance; longitudes shrink by the cosine of ``at`` (default: the first latitude)."""
    scale = F.cos(F.radians(lat1 if at is None else at))
    return KM_PER_DEGREE * F.sqrt(F.pow((lon2 - lon1) * scale, F.lit(2.0)) + F.pow(lat2 - lat1, F.lit(2.0)))


def equirect_mean_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """As ``equirect_km``, with the cosine of the mean latitude."""
    return equirect_km(lon1, lat1, lon2, lat2, (lat1 + lat2) / 2)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine_km(lon1, lat1, lon2, lat2) * 1000
