"""Grid cells of coordinates.  Rounded grids and floored cells are never mixed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def grid_round(x: Column, resolution: float) -> Column:
    """The nearest multiple of ``resolution``."""
    return F.round(x / F.lit(float(resolution))) * F.lit(float(resolution))


def grid_per_degree(x: Column, cells: int) -> Column:
    """The nearest of ``cells`` grid lines per degree (20: 0.05 degrees, 100: 0.01)."""
    return F.round(x * F.lit(float(cells))) / F.lit(float(cells))


def cell_floor(x: Column, size: float) -> Column:
    """Index of the cell that holds ``x``."""
    return F.floor(x / F.lit(float(size))).cast("long")


def cell_centre(index: Column, size: float) -> Column:
    return (index.cast("double") + F.lit(0.5)) * F.lit(float(size))
