"""A resumable harvest: tiles of work, ownership of cells, idempotent parts, consolidation."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Degrees of a band, and the latitudes that tiles cover.
BAND, SOUTH, NORTH = 10, -60, 80


def tiles(spark: SparkSession, sensors: list[str], first_year: int, last_year: int) -> DataFrame:
    """tile_id, west, south, sensor, year: bands of longitude by latitude, sensors and years, generated in parallel."""
    cols, rows, years = 360 // BAND, (NORTH - SOUTH) // BAND, last_year - first_year + 1
    k = F.col("id")
    named = F.element_at(F.array(*[F.lit(s) for s in sensors]), (F.floor(k / (cols * rows * years)) + 1).cast("int"))
    out = spark.range(cols * rows * years * len(sensors)).select(
        ((k % cols) * BAND - 180).cast("int").alias("west"), ((F.floor(k / cols) % rows) * BAND + SOUTH).cast("int").alias("south"), named.alias("sensor"), (F.floor(k / (cols * rows)) % years + first_year).cast("int").alias("year")
    )
    return out.select(F.concat_ws("_", "sensor", F.col("year").cast("string"), F.col("west").cast("string"), F.col("south").cast("string")).alias("tile_id"), "west", "south", "sensor", "year")


def tiles_sql() -> str:
    """The same table for DuckDB, for two sensors and the years 2020 and 2021."""
    return (
        f"tiles AS (SELECT sensor || '_' || CAST(year AS VARCHAR) || '_' || CAST(west AS VARCHAR) || '_' || CAST(south AS VARCHAR) AS tile_id, CAST(west AS INT) AS west, CAST(south AS INT) AS south, sensor, year"
        f" FROM (SELECT unnest(generate_series(-180, 179, {BAND})) AS west), (SELECT unnest(generate_series({SOUTH}, {NORTH - 1}, {BAND})) AS south), (VALUES ('landsat-8-9-oli'), ('sentinel-2-msi')) s(sensor), (VALUES (2020), (2021)) y(year))"
    )


def owned(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points in the harvested latitudes with the half-open band of longitude and latitude that owns each: no join."""
    return points.filter((F.col(lat) >= SOUTH) & (F.col(lat) < NORTH)).withColumn("tile_col", F.floor((F.col(lon) + 180) / BAND)).withColumn("tile_row", F.floor((F.col(lat) - SOUTH) / BAND))


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The tiles of a plan that aren't done."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def write_parts(table: DataFrame, folder: str, key: str = "tile_id") -> None:
    """Write rows under their tile; a tile that is written again replaces its former rows."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def consolidate(parts: DataFrame) -> DataFrame:
    """Merge the statistics of all tiles; rows that no rule can merge raise."""
    from skyobs.operators.statistics import merge, validate

    return validate(merge(parts.drop("tile_id")))


def run(spark: SparkSession, folder: str, plan: DataFrame, grid, by: str = "year", name: str | None = None, **search) -> DataFrame:
    """Harvest the tiles of a plan into a folder and return the statistics of all that is there.

    Only tiles without a mark are searched. Their items are written before anything is made of them, so that no
    request is repeated for a task that is lost; each tile keeps the observations of the cells whose centre it
    owns, whichever tile found the scene; statistics are written by tile and replace a former attempt's; marks come
    last. A run that is broken off goes on where it was. search: what stac.search_tiles takes.
    """
    from skyobs.operators import grid as g
    from skyobs.operators.availability import gaps
    from skyobs.sources import stac

    todo = remaining(plan, _marks(spark, folder), ["tile_id"])
    raw = f"{folder}/items/{uuid.uuid4().hex}"
    todo.write.mode("overwrite").parquet(f"{folder}/todo")
    todo = spark.read.schema(todo.schema).parquet(f"{folder}/todo")
    stac.search_tiles(todo, name=name, **search).write.parquet(raw)
    found = spark.read.schema("tile_id string, sensor string, year int, feature string").parquet(raw)
    for sensor in [r[0] for r in found.select("sensor").distinct().collect()]:  # a row a sensor
        of_tile = found.filter(F.col("sensor") == sensor)
        seen = stac.to_observations(stac.items(of_tile, sensor, keep=["tile_id"]), grid, strict=False, keep=["tile_id"])
        placed = g.unproject(seen.withColumn("_cx", grid.centre_x((F.col("cell") - 1) % grid.ncol + 1)).withColumn("_cy", grid.centre_y(F.floor((F.col("cell") - 1) / grid.ncol) + 1)), "_cx", "_cy")
        tile = todo.select(F.col("tile_id").alias("_tile"), F.col("west").alias("_w"), F.col("south").alias("_s"), F.col("year").alias("_y"))
        mine = owned(placed).join(tile, F.col("tile_id") == F.col("_tile")).filter((F.col("tile_col") == F.floor((F.col("_w") + 180) / BAND)) & (F.col("tile_row") == F.floor((F.col("_s") - SOUTH) / BAND)))
        # a cell has one owner a year, so a tile's statistics are those of its cells and year
        yearly = mine.withColumn("cell", F.col("cell") * 10_000 + F.col("_y"))
        stats = gaps(yearly, by).join(yearly.select(F.col("cell").alias("_cell"), "tile_id").distinct(), F.col("cell") == F.col("_cell")).drop("_cell")
        write_parts(stats.withColumn("cell", F.floor(F.col("cell") / 10_000)), f"{folder}/stats")
    todo.select("tile_id").write.mode("append").parquet(f"{folder}/done")
    return consolidate(spark.read.parquet(f"{folder}/stats"))


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    """tile_id of the tiles that are done; none before the first run."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "tile_id string")
    return spark.read.schema("tile_id string").parquet(f"{folder}/done")


def retry(call: Callable, attempts: int = 5, base: float = 1.0, retryable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """call(), again after exponentially longer waits with jitter while it raises something retryable."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if k == attempts - 1 or not retryable(e):
                raise
            sleep(base * 2**k * (1 + random.random() / 4))


def site_boxes(named: DataFrame, replicas: int = 1, step: float = 37.0, half: float = 0.25) -> DataFrame:
    """Boxes around named(name, lon, lat, regime), repeated along their parallels: site, lon, lat, regime and bounds."""
    out = named.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    lon = F.pmod(F.col("lon") + F.col("replica") * step + 180, F.lit(360.0)) - 180
    return out.select(F.concat_ws("#", "name", F.col("replica").cast("string")).alias("site"), lon.alias("lon"), "lat", "regime", (lon - half).alias("west"), (F.col("lat") - half).alias("south"), (lon + half).alias("east"), (F.col("lat") + half).alias("north"))
