"""Distances, bins and calibration curves as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The half-open bins of distance in km and of facet coverage.
DISTANCE_EDGES = (0, 0.5, 1, 2, 3, 5, 7.5, 10, 15, 25, 40, 60, 100, 200, 500, 1000, 3000, float("inf"))
FACET_EDGES = (0, 0.25, 0.5, 0.75, 0.999, 1.01)
SMOOTHING = 20.0


def number(c: str | Column) -> Column:
    """A double with NaN as null."""
    col = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(col), col)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km of degrees; null where any is null."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0))
    b = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    inner = a + b
    return F.when(inner.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner)))))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin, clipped to the first and last; null for null."""
    inner = [F.when(value >= float(e), 1).otherwise(0) for e in edges[1:-1]]
    total = inner[0]
    for term in inner[1:]:
        total = total + term
    return F.when(value.isNotNull(), total)


def curve(bin_: Column, scores: Sequence[float], missing: float = 0.0) -> Column:
    """The score of a bin; ``missing`` where there is none."""
    # Not coalesce: element_at of a literal array gives its last entry for a null place.
    return F.when(bin_.isNull(), F.lit(missing)).otherwise(F.element_at(F.array(*[F.lit(float(s)) for s in scores]), bin_ + 1))
