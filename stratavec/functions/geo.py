"""Distance on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; the radius of the sphere that the service's distances are taken on (fixed value).
EARTH_RADIUS = 6378168.0


def great_circle(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres between points given in degrees, by the haversine formula."""
    half_lat, half_lon = F.radians(lat - F.lit(lat0)) / 2, F.radians(lon - F.lit(lon0)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
