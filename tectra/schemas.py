"""Fixed shapes of the catalog and of what it is compared with."""

from __future__ import annotations

from dataclasses import dataclass

CATALOG = "id string, time timestamp, latitude double, longitude double, depth double, mag double, magType string, place string"
RAW_CATALOG = CATALOG.replace("time timestamp", "time string")
CATALOG_COLUMNS = [x.split()[0] for x in CATALOG.split(", ")]
REQUIRED = ["time", "latitude", "longitude", "mag"]

DAY_US = 86_400_000_000
YEAR_DAYS = 365.25


@dataclass(frozen=True)
class Region:
    name: str
    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float


# The national box and the four fault zones.
NATIONAL = Region("national", 35.5, 42.5, 25.5, 45.0)
ZONES = [Region("KAF", 39.5, 41.5, 26.0, 41.0), Region("DAF", 36.0, 39.0, 35.5, 40.0), Region("Ege", 36.0, 39.5, 25.5, 28.5), Region("Van", 37.5, 39.5, 42.0, 45.0)]


class CatalogError(ValueError):
    """An input or a result that a gate refuses."""
