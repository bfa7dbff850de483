"""Web-Mercator pixels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256.0


def pixel_x(lon: Column, zoom: int) -> Column:
    return (lon + 180.0) / 360.0 * (TILE * 2.0**zoom)


def pixel_y(lat: Column, zoom: int) -> Column:
    """Null at the poles and beyond, where the projection has no value."""
    s = F.sin(lat * math.pi / 180.0)
    return F.when(F.abs(lat) < 90.0, (0.5 - F.ln((1.0 + s) / (1.0 - s)) / (4 * math.pi)) * (TILE * 2.0**zoom))


def longitude(x: Column, zoom: int) -> Column:
    return x / (TILE * 2.0**zoom) * 360.0 - 180.0


def latitude(y: Column, zoom: int) -> Column:
    return F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / (TILE * 2.0**zoom)))) * 180.0 / math.pi


def cell(pixel: Column, grid: int, floor: bool = False) -> Column:
    """Number of the grid cell: toward zero, or down."""
    q = pixel / float(grid)
    return (F.floor(q) if floor else F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))).cast("bigint")
