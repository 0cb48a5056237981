"""Sensor drivers and their registry."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class QaSpec:
    """How a producer's quality layer is read: flag bits and 2-bit confidences, or class codes."""

    kind: str
    asset: str
    bits: Mapping[str, int] = field(default_factory=dict)
    confidence: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    classes: Mapping[str, int] = field(default_factory=dict)
    clear: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("bitmask", "categorical"):
            raise ValueError("kind is bitmask or categorical")


@dataclass(frozen=True)
class Platform:
    name: str
    start: date
    end: date | None = None


@dataclass(frozen=True)
class Sensor:
    id: str
    name: str
    bands: Mapping[str, str]
    resolution: Mapping[str, float | None]
    platforms: tuple[Platform, ...] = ()
    footprint: str = "none"
    revisit: float | None = None
    qa: QaSpec | None = None
    scale: float = 1.0
    offset: float = 0.0
    collections: Mapping[str, str | None] = field(default_factory=dict)
    cloud_property: str = "eo:cloud_cover"
    has_thermal: bool = False
    has_cirrus: bool = False
    notes: str = ""


_sensors: dict[str, Sensor] = {}

# Short names of sensors.
ALIASES = {
    "landsat8": "landsat-8-9-oli", "landsat9": "landsat-8-9-oli", "l8": "landsat-8-9-oli", "l9": "landsat-8-9-oli", "oli": "landsat-8-9-oli", "landsat": "landsat-8-9-oli",
    "landsat5": "landsat-4-7-tm-etm", "landsat7": "landsat-4-7-tm-etm", "l5": "landsat-4-7-tm-etm", "l7": "landsat-4-7-tm-etm", "tm": "landsat-4-7-tm-etm", "etm": "landsat-4-7-tm-etm",
    "s2": "sentinel-2-msi", "sentinel2": "sentinel-2-msi", "msi": "sentinel-2-msi",
    "modis": "modis-mod09ga", "mod09": "modis-mod09ga",
    "uav": "generic-multispectral", "generic": "generic-multispectral",
}


def register(driver: Sensor, overwrite: bool = False) -> Sensor:
    if driver.id in _sensors and not overwrite:
        raise ValueError(f"sensor {driver.id!r} is registered already")
    _sensors[driver.id] = driver
    return driver


def resolve(name: str) -> str:
    """The id of a sensor from its id or an alias, whatever its case and punctuation."""
    if name in _sensors:
        return name
    key = re.sub("[^a-z0-9]", "", name.lower())
    if key not in ALIASES:
        raise ValueError(f"unknown sensor {name!r}; known: {', '.join(_sensors)}")
    return ALIASES[key]


def sensor(name: str | Sensor) -> Sensor:
    return name if isinstance(name, Sensor) else _sensors[resolve(name)]


def check_bands(driver: Sensor, needed: list[str]) -> None:
    """Raise if the driver lacks a band."""
    if missing := [b for b in needed if b not in driver.bands]:
        raise ValueError(f"{driver.id} has no band {', '.join(missing)}")


def sensors(spark: SparkSession) -> DataFrame:
    """A row for each registered sensor."""
    rows = [(s.id, s.name, s.footprint, None if s.revisit is None else float(s.revisit), len(s.bands), len(s.platforms), s.has_thermal, s.has_cirrus, s.qa.kind if s.qa else None) for s in _sensors.values()]
    return spark.createDataFrame(rows, "id string, name string, footprint string, revisit double, n_bands int, n_platforms int, has_thermal boolean, has_cirrus boolean, qa string")


def platforms(spark: SparkSession, names: list[str]) -> DataFrame:
    """sensor, platform, start, end and revisit of the platforms of the sensors: a table of a few rows."""
    rows = [(s.id, p.name, p.start, p.end, float(s.revisit)) for s in map(sensor, names) for p in s.platforms]
    return spark.createDataFrame(rows, "sensor string, platform string, start date, end date, revisit double")


# Fixed values of the missions: band names of the catalogues, resolutions in metres, operating dates, QA bits and class codes.
register(Sensor(
    "landsat-8-9-oli", "Landsat 8/9 OLI-TIRS",
    {"coastal": "coastal", "blue": "blue", "green": "green", "red": "red", "nir": "nir08", "swir16": "swir16", "swir22": "swir22", "cirrus": "cirrus", "tir1": "lwir11"},
    {"coastal": 30, "blue": 30, "green": 30, "red": 30, "nir": 30, "swir16": 30, "swir22": 30, "cirrus": 30, "tir1": 100},
    (Platform("landsat-8", date(2013, 4, 11)), Platform("landsat-9", date(2021, 11, 1))), "wrs2", 16,
    QaSpec("bitmask", "qa_pixel", {"fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "cloud_shadow": 4, "snow": 5, "clear": 6, "water": 7}, {"cloud": (8, 9), "cloud_shadow": (10, 11), "snow": (12, 13), "cirrus": (14, 15)}),
    2.75e-05, -0.2, {"element84": "landsat-c2-l2", "planetary": "landsat-c2-l2", "cdse": None}, has_thermal=True, has_cirrus=True, notes="Quality bits come from CFMask.",
))
register(Sensor(
    "landsat-4-7-tm-etm", "Landsat 4/5 TM and Landsat 7 ETM+",
    {"blue": "blue", "green": "green", "red": "red", "nir": "nir08", "swir16": "swir16", "swir22": "swir22", "tir1": "lwir"},
    {"blue": 30, "green": 30, "red": 30, "nir": 30, "swir16": 30, "swir22": 30, "tir1": 120},
    (Platform("landsat-4", date(1982, 8, 22), date(1993, 12, 14)), Platform("landsat-5", date(1984, 3, 1), date(2013, 6, 5)), Platform("landsat-7", date(1999, 4, 15), date(2022, 4, 6))), "wrs2", 16,
    QaSpec("bitmask", "qa_pixel", {"fill": 0, "dilated_cloud": 1, "cloud": 3, "cloud_shadow": 4, "snow": 5, "clear": 6, "water": 7}, {"cloud": (8, 9), "cloud_shadow": (10, 11), "snow": (12, 13)}),
    2.75e-05, -0.2, {"element84": "landsat-c2-l2", "planetary": "landsat-c2-l2"}, has_thermal=True, notes="No cirrus band.",
))
register(Sensor(
    "sentinel-2-msi", "Sentinel-2 MSI",
    {"coastal": "coastal", "blue": "blue", "green": "green", "red": "red", "rededge1": "rededge1", "rededge2": "rededge2", "rededge3": "rededge3", "nir": "nir", "nir08": "nir08", "watervapour": "nir09", "cirrus": "cirrus", "swir16": "swir16", "swir22": "swir22"},
    {"coastal": 60, "blue": 10, "green": 10, "red": 10, "rededge1": 20, "rededge2": 20, "rededge3": 20, "nir": 10, "nir08": 20, "watervapour": 60, "cirrus": 60, "swir16": 20, "swir22": 20},
    (Platform("sentinel-2a", date(2015, 6, 23)), Platform("sentinel-2b", date(2017, 3, 7)), Platform("sentinel-2c", date(2024, 9, 5))), "mgrs", 10,
    QaSpec("categorical", "scl", classes={"no_data": 0, "saturated": 1, "cast_shadow": 2, "cloud_shadow": 3, "vegetation": 4, "bare_soil": 5, "water": 6, "unclassified": 7, "cloud_medium": 8, "cloud_high": 9, "cirrus": 10, "snow": 11}, clear=("vegetation", "bare_soil", "water", "unclassified")),
    1e-04, 0.0, {"element84": "sentinel-2-l2a", "planetary": "sentinel-2-l2a", "cdse": "SENTINEL-2"}, has_cirrus=True, notes="Scene classes change with processing baselines.",
))
register(Sensor(
    "modis-mod09ga", "MODIS Terra/Aqua surface reflectance (MOD09GA/MYD09GA)",
    {"red": "sur_refl_b01", "nir": "sur_refl_b02", "blue": "sur_refl_b03", "green": "sur_refl_b04", "swir13": "sur_refl_b05", "swir16": "sur_refl_b06", "swir22": "sur_refl_b07"},
    {"red": 500, "nir": 500, "blue": 500, "green": 500, "swir13": 500, "swir16": 500, "swir22": 500},
    (Platform("terra", date(2000, 2, 24)), Platform("aqua", date(2002, 7, 4))), "sinusoidal", 1,
    QaSpec("bitmask", "state_1km", {"cloud": 0, "cloud_shadow": 2, "cirrus": 8, "snow": 12, "internal_cloud": 10}),
    1e-04, 0.0, {"planetary": "modis-09A1-061"}, notes="Daily and coarse.",
))
register(Sensor(
    "generic-multispectral", "Generic multispectral raster (UAV, PlanetScope, WorldView, SPOT)",
    {"blue": "blue", "green": "green", "red": "red", "nir": "nir"}, {"blue": None, "green": None, "red": None, "nir": None}, notes="For rasters of one's own.",
))
