"""Scenes, cubes and masks as tables: band access, ordering, attached geometry, summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyobs import sensors
from skyobs.config import Manifest
from skyobs.functions.exprs import solar_position
from skyobs.operators.detect import CLASSES


@dataclass(frozen=True)
class MaskSet:
    """A pixel table with p_cloud, is_cloud or class, and how it was made."""

    pixels: DataFrame
    method: str
    threshold: float = 0.5
    params: dict = field(default_factory=dict)
    manifest: Manifest = field(default_factory=Manifest.create)

    def mask(self) -> DataFrame:
        """scene, row, col, is_cloud. A class table counts its cloud classes alone, not every code above 0."""
        if "is_cloud" in self.pixels.columns:
            return self.pixels.select("scene", "row", "col", "is_cloud")
        if "class" in self.pixels.columns:
            cloudy = F.col("class").isin(CLASSES["cloud_thin"], CLASSES["cloud_thick"])
        else:
            cloudy = F.col("p_cloud") >= self.threshold
        return self.pixels.select("scene", "row", "col", cloudy.cast("int").alias("is_cloud"))


def bands(pixels: DataFrame, sensor: str) -> list[str]:
    """The sensor's bands that the table has."""
    return [b for b in sensors.sensor(sensor).bands if b in pixels.columns]


def band(pixels: DataFrame, name: str, required: bool = True) -> Column | None:
    """A band's column; without it, an error or None."""
    if name in pixels.columns:
        return F.col(name)
    if required:
        raise ValueError(f"there is no band {name}; there are {', '.join(pixels.columns)}")
    return None


def cube(scenes: DataFrame) -> DataFrame:
    """scenes(id, datetime, ...) with their position in time, from 1 by sensor: an ordered, lazy collection."""
    from pyspark.sql import Window

    return scenes.withColumn("position", F.row_number().over(Window.partitionBy("sensor").orderBy("datetime", "id")))


def with_geometry(scenes: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """scenes(datetime, sun_zenith, sun_azimuth) with missing angles computed from time and place, and where each came from."""
    zenith, azimuth = solar_position(F.col("datetime"), F.col(lon), F.col(lat))
    given = F.col("sun_zenith").isNotNull() & F.col("sun_azimuth").isNotNull()
    return scenes.withColumns({
        "geometry_source": F.when(given, "metadata").when(zenith.isNotNull(), "computed"),
        "sun_zenith": F.when(given, F.col("sun_zenith")).otherwise(zenith),
        "sun_azimuth": F.when(given, F.col("sun_azimuth")).otherwise(azimuth),
    })


def observation_summary(obs: DataFrame) -> DataFrame:
    """Rows, cells, dates, and mean cloud by sensor."""
    return obs.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cell").alias("n_cells"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("cloud_fraction").alias("mean_cloud")
    )


def class_counts(pixels: DataFrame, code: str = "class") -> DataFrame:
    """Pixels by scene and class name."""
    names = F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (v, k)])
    return pixels.groupBy("scene", F.try_element_at(names, F.col(code)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
