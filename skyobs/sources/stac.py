"""Scene catalogues: STAC features to item tables, and items to observations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs import sensors
from skyobs.config import choice, number, options, warn
from skyobs.operators import grid as g


@dataclass(frozen=True)
class Backend:
    name: str
    url: str
    sign: bool
    note: str


# Public catalogue endpoints.
BACKENDS = {
    "element84": Backend("element84", "https://earth-search.aws.element84.com/v1", False, "open"),
    "planetary": Backend("planetary", "https://planetarycomputer.microsoft.com/api/stac/v1", True, "asset links are signed and expire"),
    "cdse": Backend("cdse", "https://catalogue.dataspace.copernicus.eu/stac", True, "needs an account"),
}

# The property names of STAC extensions that are read.
PROPERTIES = {
    "datetime": "string", "start_datetime": "string", "platform": "string", "eo:cloud_cover": "double", "landsat:cloud_cover_land": "double", "landsat:wrs_path": "string", "landsat:wrs_row": "string",
    "view:sun_elevation": "double", "view:sun_azimuth": "double", "view:off_nadir": "double", "mgrs:utm_zone": "int", "mgrs:latitude_band": "string", "mgrs:grid_square": "string",
}
FEATURE = f"id string, collection string, properties struct<{', '.join(f'`{k}`: {v}' for k, v in PROPERTIES.items())}>, assets map<string, struct<href: string, type: string>>, geometry struct<type: string, coordinates: string>"


def backend(name: str | None = None) -> Backend:
    name = name or options().catalog
    choice(name, "backend", BACKENDS)
    return BACKENDS[name]


def request(bbox: tuple[float, float, float, float], sensor: str, start: str, end: str, max_cloud: float = 100, limit: int = 500, name: str | None = None) -> dict:
    """The body of a catalogue search."""
    number(max_cloud, "max_cloud", 0, 100)
    driver, be = sensors.sensor(sensor), backend(name)
    collection = driver.collections.get(be.name)
    if not collection:
        raise ValueError(f"{be.name} has no collection for {driver.id}")
    body: dict = {"collections": [collection], "bbox": list(bbox), "datetime": f"{start}T00:00:00Z/{end}T23:59:59Z", "limit": min(limit, options().max_page)}
    if max_cloud < 100:
        body["query"] = {driver.cloud_property: {"lte": max_cloud}}
    return body


def http_post(url: str, body: dict) -> dict:
    """A catalogue's answer to a search, within the session's time limit."""
    import urllib.request

    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(ask, timeout=options().timeout) as answer:  # noqa: S310
        return json.load(answer)


def pages(post: Callable[[str, dict], dict], url: str, body: dict, limit: int | None = None) -> Iterator[list[dict]]:
    """The features of each page of a search, by the links to the next; never more than limit in all."""
    left = limit
    while url and (left is None or left > 0):
        page = post(url, body)
        found = page.get("features", [])[:left]
        left = None if left is None else left - len(found)
        yield found
        link = next((x for x in page.get("links", []) if x.get("rel") == "next"), None)
        url, body = (link["href"], body | link.get("body", {})) if link else (None, body)


def search_tiles(tiles: DataFrame, post: Callable[[str, dict], dict] = http_post, max_cloud: float = 100, name: str | None = None, attempts: int = 5, wait: float = 1.0, sign: Callable[[dict], dict] | None = None) -> DataFrame:
    """tile_id, sensor, year and feature (JSON) of the items of each tile(tile_id, west, south, sensor, year).

    The tiles are searched on the executors, options().workers at a time, a page in memory at once. A request that
    fails is made again after growing waits. `sign` is applied to the features of a backend whose links need it. Only
    searches for which the backend has a collection are made. post and sign have to be picklable.
    """
    from skyobs.sources.harvest import BAND, retry

    be = backend(name)
    known = {s: sensors.sensor(s).collections.get(be.name) for s in (r[0] for r in tiles.select("sensor").distinct().collect())}  # a row a sensor
    asked = tiles.filter(F.col("sensor").isin([s for s, c in known.items() if c])).select("tile_id", "west", "south", "sensor", "year")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                body = request((t["west"], t["south"], t["west"] + BAND, t["south"] + BAND), t["sensor"], f"{t['year']}-01-01", f"{t['year']}-12-31", max_cloud, name=be.name)
                patient = lambda url, b: retry(lambda: post(url, b), attempts, wait)
                for found in pages(patient, f"{be.url}/search", body):
                    made = [json.dumps(sign(f) if sign and be.sign else f) for f in found]
                    same = lambda k, kind: pa.array([t[k]] * len(made), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same("tile_id", pa.string()), same("sensor", pa.string()), same("year", pa.int32()), pa.array(made, pa.string())], names=["tile_id", "sensor", "year", "feature"])

    return asked.repartition(max(1, options().workers), "tile_id").mapInArrow(run, "tile_id string, sensor string, year int, feature string")


def search(spark: SparkSession, post: Callable[[str, dict], dict], bbox: tuple[float, float, float, float], sensor: str, start: str, end: str, max_cloud: float = 100, limit: int = 500, name: str | None = None) -> DataFrame:
    """Items found by paging through a catalogue with post(url, body); never more than limit."""

    url = f"{backend(name).url}/search"
    found = pages(post, url, request(bbox, sensor, start, end, max_cloud, limit, name), limit)
    return items(spark.createDataFrame([(json.dumps(f),) for page in found for f in page], "feature string"), sensor)


def mgrs_tile(zone: Column, band: Column, square: Column) -> Column:
    """Two digits, band and square; null if any part is."""
    return F.concat(F.lpad(zone.cast("string"), 2, "0"), band, square)


def rings(geometry: Column) -> Column:
    """Exterior rings of a geometry (type, and coordinates as text), as arrays of lon and lat; null for other types than polygons. Holes are left out."""
    kind, text = geometry["type"], geometry["coordinates"]
    polygons = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).when(kind == "MultiPolygon", text), "array<array<array<array<double>>>>")
    return F.transform(polygons, lambda p: F.transform(p[0], lambda v: F.struct(v[0].alias("lon"), v[1].alias("lat"))))


def items(features: DataFrame, sensor: str, column: str = "feature", keep: list[str] | None = None) -> DataFrame:
    """A row for each JSON feature: id, datetime, sensor, platform, cloud covers in percent, angles, path, row, tile, rings, assets.

    Each feature is parsed once: a generator stands between the parsing and the fields, so that no projection
    repeats it. Columns of `keep` come first. The start stands in for a missing time, the zenith comes from the elevation.
    """
    kept = [F.col(c) for c in keep or []]
    parsed = features.select(*kept, F.explode(F.array(F.from_json(F.col(column), FEATURE))).alias("_f"))
    f = F.col("_f")
    p = lambda name: f["properties"][name]
    when = F.coalesce(p("datetime"), p("start_datetime"))
    return parsed.select(
        *kept, f["id"].alias("id"), F.try_to_timestamp(when).alias("datetime"), F.lit(sensors.sensor(sensor).id).alias("sensor"), p("platform").alias("platform"),
        p("eo:cloud_cover").alias("cloud_cover"), p("landsat:cloud_cover_land").alias("cloud_cover_land"), (F.lit(90.0) - p("view:sun_elevation")).alias("sun_zenith"), p("view:sun_azimuth").alias("sun_azimuth"),
        p("view:off_nadir").alias("view_zenith"), p("landsat:wrs_path").try_cast("int").alias("path"), p("landsat:wrs_row").try_cast("int").alias("row"),
        mgrs_tile(p("mgrs:utm_zone"), p("mgrs:latitude_band"), p("mgrs:grid_square")).alias("tile"), rings(f["geometry"]).alias("rings"), f["assets"].alias("assets"),
    )


def items_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_items"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.median("cloud_cover").alias("median_cloud"))


def to_observations(table: DataFrame, grid: g.Grid, strict: bool = True, keep: list[str] | None = None) -> DataFrame:
    """A row for each item and cell under any of its rings: an observation table of tier metadata.

    Items without cloud cover are left out, with a warning; strict raises if nothing is left. Columns of `keep` come first.
    """
    known = table.filter("cloud_cover is not null")
    if strict:
        n = table.agg(F.count_if(F.col("cloud_cover").isNull()).alias("without"), F.count(F.lit(1)).alias("n")).first()
        if n["without"]:
            warn(f"{n['without']} of {n['n']} items have no cloud cover and were left out")
        if n["n"] == n["without"]:
            raise ValueError("no item has a cloud cover")
    hit = g.index_any(known.select(*(keep or []), "id", "datetime", "sensor", "platform", "cloud_cover", "rings"), grid)
    return hit.select(*(keep or []), "cell", F.to_date("datetime").alias("date"), "sensor", "platform", (F.col("cloud_cover") / 100).alias("cloud_fraction"), F.lit(None).cast("double").alias("shadow_fraction"), F.lit(None).cast("double").alias("snow_fraction"), F.lit("metadata").alias("tier"))
