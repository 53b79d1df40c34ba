"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM, METRES = 6371.0, 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = KM) -> Column:
    """Great-circle distance; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # greatest and least pass over nulls, so a null has to be kept out of them
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between timestamps, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("int")
