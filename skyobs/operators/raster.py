"""Neighbourhood operators on pixel tables, as equi-joins on shifted coordinates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.config import number, warn
from skyobs.functions.exprs import clamp


def shadow_offset(height: float, zenith: float, azimuth: float, view_zenith: float = 0, view_azimuth: float = 0, parallax: bool = True) -> tuple[float, float]:
    """Metres east and north from a cloud at a height to its shadow."""
    number(height, "height", lower=0)
    number(zenith, "zenith", 0, 89.9)
    number(azimuth, "azimuth", -360, 360)
    d, a = height * math.tan(math.radians(zenith)), math.radians(azimuth)
    dx, dy = -d * math.sin(a), -d * math.cos(a)
    if parallax and view_zenith:
        p, v = height * math.tan(math.radians(view_zenith)), math.radians(view_azimuth)
        dx, dy = dx - p * math.sin(v), dy - p * math.cos(v)
    return dx, dy


def pixel_shift(height: float, res: float, zenith: float, azimuth: float, view_zenith: float = 0, view_azimuth: float = 0) -> tuple[int, int]:
    """Whole columns and rows of a shadow's shift, halves to the even number; rows grow southwards."""
    dx, dy = shadow_offset(height, zenith, azimuth, view_zenith, view_azimuth)
    return round(dx / res), round(-dy / res)


def shift(pixels: DataFrame, value: str, dcol: float, drow: float, fill: float | None = 0, scene: str = "scene") -> DataFrame:
    """scene, row, col and the value that stood dcol columns and drow rows before; fill where nothing did."""
    moved = pixels.select(F.col(scene), (F.col("row") + round(drow)).alias("row"), (F.col("col") + round(dcol)).alias("col"), F.col(value).alias("_v"))
    kind = pixels.schema[value].dataType
    return pixels.select(scene, "row", "col").join(moved, [scene, "row", "col"], "left").select(scene, "row", "col", F.coalesce("_v", F.lit(fill).cast(kind)).alias(value))


def dilate(pixels: DataFrame, value: str, radius: int = 1, scene: str = "scene") -> DataFrame:
    """scene, row, col, value: 1 within radius steps (left, right, up, down) of a pixel above 0; outside counts as 0.

    Set pixels alone are spread to their diamond; only their distinct places meet the raster.
    """
    steps = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius + abs(r), radius - abs(r) + 1)]
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    spread = pixels.filter(F.col(value) > 0).select(scene, "row", "col", near.alias("d")).select(scene, (F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col")).distinct()
    return pixels.select(scene, "row", "col").join(spread.withColumn("_on", F.lit(1)), [scene, "row", "col"], "left").select(scene, "row", "col", F.coalesce("_on", F.lit(0)).alias(value))


def erode(pixels: DataFrame, value: str, radius: int = 1, scene: str = "scene") -> DataFrame:
    """The complement's dilation, complemented: the raster's border itself does not erode."""
    flipped = pixels.select(scene, "row", "col", (F.lit(1) - (F.col(value) > 0).cast("int")).alias(value))
    return dilate(flipped, value, radius, scene).withColumn(value, F.lit(1) - F.col(value))


def darkness(pixels: DataFrame, nir: str = "nir", swir: str | None = None, water: str | None = None, cloud: str | None = None, scene: str = "scene") -> DataFrame:
    """pixels with darkness: the share of reflectance lost against the median of the scene's cloudless pixels, the lesser of both bands."""
    bands = [b for b in (nir, swir) if b]
    keep = F.lit(True) if cloud is None else F.col(cloud) == 0
    refs = pixels.groupBy(F.col(scene).alias("_scene")).agg(*[F.coalesce(F.median(F.when(keep, F.col(b))), F.median(b)).alias(f"_{b}") for b in bands])
    out = pixels.join(refs, F.col(scene).eqNullSafe(F.col("_scene")))
    ref = F.col(f"_{nir}")
    d = F.when(ref > 0, clamp((ref - F.col(nir)) / ref)).otherwise(F.when(ref.isNull() | (ref <= 0), F.lit(0.0)))
    if swir:
        ref = F.col(f"_{swir}")
        s = clamp((ref - F.col(swir)) / ref)
        d = F.when(ref > 0, F.when(s.isNotNull() & d.isNotNull(), F.least(d, s))).otherwise(d)
    if water:
        d = F.when(F.col(water) > 0, F.lit(0.0)).otherwise(d)
    return out.withColumn("darkness", d).drop("_scene", *[f"_{b}" for b in bands])


def cloud_height(pixels: DataFrame, bt: str = "tir1", cloud: str = "cloud", clear: str | None = None, lapse: float = 0.0065, limits: tuple[float, float] = (200, 12000), default: tuple[float, float] = (200, 12000), scene: str = "scene") -> DataFrame:
    """scene, height, low, high: from how much colder clouds are than warm clear ground; without either, null and the default range."""
    is_cloud = F.col(cloud) > 0
    is_clear = ~is_cloud if clear is None else F.col(clear) > 0
    q = pixels.groupBy(scene).agg(F.percentile(F.when(is_clear, F.col(bt)), 0.825).alias("_warm"), F.percentile(F.when(is_cloud, F.col(bt)), F.array(F.lit(0.175), F.lit(0.825))).alias("_cold"))
    h = lambda k: clamp((F.col("_warm") - F.col("_cold")[k]) / lapse, *limits)
    a, b = h(0), h(1)
    return q.select(scene, ((a + b) / 2).alias("height"), F.coalesce(F.when(b.isNotNull(), F.least(a, b)), F.lit(float(default[0]))).alias("low"), F.coalesce(F.when(b.isNotNull(), F.greatest(a, b)), F.lit(float(default[1]))).alias("high"))


@dataclass(frozen=True)
class ShadowSearch:
    """profile: scene, height, score, retained; best: a row a scene; shadow: scene, row, col of the shadow's pixels."""

    profile: DataFrame
    best: DataFrame
    shadow: DataFrame


HEIGHTS = tuple(range(200, 12001, 200))


def _projected(pixels: DataFrame, cloud: str, heights, res: float, zenith: float, azimuth: float, view_zenith: float, view_azimuth: float, scene: str) -> DataFrame:
    """scene, height, row, col of cloud pixels moved by each height's shift. The shifts are literals: one row a height."""
    shifts = F.array(*[F.struct(F.lit(float(h)).alias("height"), F.lit(s[0]).alias("dc"), F.lit(s[1]).alias("dr")) for h in heights for s in [pixel_shift(h, res, zenith, azimuth, view_zenith, view_azimuth)]])
    moved = pixels.filter(F.col(cloud) > 0).select(scene, "row", "col", F.explode(shifts).alias("s"))
    return moved.select(scene, F.col("s.height").alias("height"), (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))


def shadow_union(pixels: DataFrame, cloud: str = "cloud", res: float = 30, zenith: float = 40, azimuth: float = 180, view_zenith: float = 0, view_azimuth: float = 0, heights=HEIGHTS, scene: str = "scene") -> DataFrame:
    """scene, row, col, shadow: 1 where the shadow of any height may fall."""
    spots = _projected(pixels, cloud, heights, res, zenith, azimuth, view_zenith, view_azimuth, scene).select(scene, "row", "col").distinct()
    return pixels.select(scene, "row", "col").join(spots.withColumn("_s", F.lit(1)), [scene, "row", "col"], "left").select(scene, "row", "col", F.coalesce("_s", F.lit(0)).alias("shadow"))


def shadow_search(pixels: DataFrame, cloud: str = "cloud", dark: str = "darkness", res: float = 30, zenith: float = 40, azimuth: float = 180, view_zenith: float = 0, view_azimuth: float = 0, heights=HEIGHTS, dark_threshold: float = 0.12, scene: str = "scene", ranges: DataFrame | None = None) -> ShadowSearch:
    """Find each scene's cloud height whose projected shadow is darkest.

    A height scores the share of its projected pixels, off the cloud itself and within the raster, that are
    dark. Heights that keep a tenth of the cloud and 25 pixels are eligible; if none is, all are. The first
    of the best wins. ranges(scene, low, high) narrows the heights. Cloud pixels times heights are joined with
    the raster on coordinates and summed by scene and height; the join's output is summed at once.
    """
    moved = _projected(pixels, cloud, heights, res, zenith, azimuth, view_zenith, view_azimuth, scene)
    if ranges is not None:
        within = ranges.select(F.col(scene).alias("_s"), "low", "high")
        moved = moved.join(within, F.col(scene) == F.col("_s")).filter(F.col("height").between(F.col("low"), F.col("high"))).drop("_s", "low", "high")
    raster = pixels.select(scene, "row", "col", (F.col(cloud) > 0).alias("_c"), (F.col(dark) >= dark_threshold).alias("_d"))
    totals = pixels.groupBy(F.col(scene).alias("_t")).agg(F.count_if(F.col(cloud) > 0).alias("_n"), F.max("row").alias("_nr"), F.max("col").alias("_nc"))
    hits = moved.join(raster, [scene, "row", "col"])
    sums = hits.groupBy(scene, "height").agg(F.count(F.lit(1)).alias("kept"), F.count_if(~F.col("_c")).alias("free"), F.count_if(~F.col("_c") & F.col("_d")).alias("hit"))
    every = totals.filter("_n > 0").select(F.col("_t").alias(scene), "_n", "_nr", "_nc", F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("height"))
    if ranges is not None:
        every = every.join(within, F.col(scene) == F.col("_s")).filter(F.col("height").between(F.col("low"), F.col("high"))).drop("_s", "low", "high")
    full = every.join(sums, [scene, "height"], "left")
    score = F.try_divide(F.coalesce("hit", F.lit(0)).cast("double"), F.col("free"))
    profile = full.select(scene, "height", "_n", "_nr", "_nc", score.alias("score"), (F.coalesce("kept", F.lit(0)) / F.col("_n")).alias("retained"), (F.coalesce("kept", F.lit(0)) >= 25).alias("_enough"))
    ok = (F.col("retained") >= 0.10) & F.col("_enough") & F.col("score").isNotNull()
    rank = F.struct((~ok).cast("int").alias("a"), F.coalesce(-F.col("score"), F.lit(1.0)).alias("b"), F.col("height").alias("h"))
    best = profile.groupBy(scene).agg(F.min_by(F.struct("height", "score", "retained"), rank).alias("b"), F.first("_nr").alias("nr"), F.first("_nc").alias("nc"), F.max("height").alias("top"))
    tan = math.tan(math.radians(zenith))
    window = F.least("nr", "nc") * F.lit(float(res))
    resolvable = window * F.lit(0.5 / tan) if tan > 0 else F.lit(float("1e308"))
    best = best.select(scene, "b.height", "b.score", "b.retained", window.alias("window_m"), (F.col("top") * F.lit(tan)).alias("required_m"), resolvable.alias("resolvable_m"), (F.col("top") > resolvable).alias("truncated"))
    chosen = moved.join(best.select(F.col(scene).alias("_s"), F.col("height").alias("_h")), (F.col(scene) == F.col("_s")) & (F.col("height") == F.col("_h")), "left_semi")
    shadow = chosen.join(raster.filter(~F.col("_c")), [scene, "row", "col"], "left_semi").select(scene, "row", "col")
    return ShadowSearch(profile.drop("_n", "_nr", "_nc", "_enough"), best, shadow)


def shadow(pixels: DataFrame, method: str = "geometric", cloud: str = "cloud", nir: str = "nir", swir: str | None = "swir16", bt: str | None = None, water: str | None = None, buffer: int = 0, dark_threshold: float = 0.12, heights=HEIGHTS, scene: str = "scene", **geometry) -> DataFrame:
    """scene, row, col, shadow by geometry and darkness, darkness alone, or the union of all heights.

    A brightness temperature narrows the heights; water is taken out; buffer dilates.
    """
    if method not in ("geometric", "darkness", "union"):
        raise ValueError("method is geometric, darkness or union")
    if method == "union":
        out = shadow_union(pixels, cloud, heights=heights, scene=scene, **geometry)
    else:
        dark = darkness(pixels, nir, swir, water, cloud, scene)
        if method == "darkness":
            out = dark.select(scene, "row", "col", F.coalesce((F.col("darkness") >= dark_threshold).cast("int"), F.lit(0)).alias("shadow"))
        else:
            ranges = None if bt is None else cloud_height(pixels, bt, cloud, scene=scene)
            found = shadow_search(dark, cloud, heights=heights, dark_threshold=dark_threshold, scene=scene, ranges=ranges, **geometry)
            out = pixels.select(scene, "row", "col").join(found.shadow.withColumn("_s", F.lit(1)), [scene, "row", "col"], "left").select(scene, "row", "col", F.coalesce("_s", F.lit(0)).alias("shadow"))
    if water:
        wet = pixels.filter(F.col(water) > 0).select(scene, "row", "col", F.lit(1).alias("_w"))
        out = out.join(wet, [scene, "row", "col"], "left").select(scene, "row", "col", F.when(F.col("_w") == 1, 0).otherwise(F.col("shadow")).alias("shadow"))
    return dilate(out, "shadow", buffer, scene) if buffer > 0 else out


def terrain_steps(zenith: float, azimuth: float, res: float, max_distance: float, rows: int, cols: int) -> list[tuple[int, int, int]]:
    """(k, columns, rows) of the steps towards the sun that can still meet a raster of this size."""
    a, out = math.radians(azimuth), []
    for k in range(1, max(1, round(max_distance / res)) + 1):
        dc, dr = math.sin(a) * k, -math.cos(a) * k
        if abs(dc) >= cols and abs(dr) >= rows:
            break
        if abs(round(dc)) < cols and abs(round(dr)) < rows:
            out.append((k, round(dc), round(dr)))
    return out


def terrain_shadow(dem: DataFrame, zenith: float, azimuth: float, rows: int, cols: int, res: float = 30, max_distance: float = 20000, z: str = "z", scene: str = "scene") -> DataFrame:
    """scene, row, col, shadow: 1 where ground towards the sun rises above the ray to it. A sun at the zenith casts none.

    A pixel goes no further than the ray takes to fall from it to the scene's lowest ground, so the rows that are
    shuffled grow with the relief, not with max_distance.
    """
    number(zenith, "zenith", 0, 89.9)
    steps = terrain_steps(zenith, azimuth, res, max_distance, rows, cols)
    base = dem.select(scene, "row", "col", F.col(z).alias("z"))
    if zenith == 0 or not steps:
        return base.select(scene, "row", "col", F.lit(0).alias("shadow"))
    rise = res / math.tan(math.radians(zenith))
    every = F.array(*[F.struct(F.lit(k * rise).alias("up"), F.lit(dc).alias("dc"), F.lit(dr).alias("dr")) for k, dc, dr in steps])
    lows = base.groupBy(F.col(scene).alias("_scene")).agg(F.min("z").alias("_low"))
    reached = base.join(lows, F.col(scene) == F.col("_scene"))
    shifts = F.explode(F.filter(every, lambda s: s["up"] < F.col("z") - F.col("_low")))
    # ground pixels look from where they stand back along each step: the pixel that they may shade, and the height it would need
    high = reached.select(scene, "row", "col", "z", shifts.alias("s")).select(scene, (F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), (F.col("z") - F.col("s.up")).alias("ray"))
    top = high.groupBy(scene, "row", "col").agg(F.max("ray").alias("ray"))
    return base.join(top, [scene, "row", "col"], "left").select(scene, "row", "col", F.coalesce((F.col("ray") > F.col("z")).cast("int"), F.lit(0)).alias("shadow"))


def warn_truncated(best: DataFrame) -> None:
    """Warn if the search range of any scene exceeds what its window resolves."""
    if n := best.filter("truncated").count():
        warn(f"in {n} scenes the window can't resolve the highest heights searched; enlarge it or cap the heights")
