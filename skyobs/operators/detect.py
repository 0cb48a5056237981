"""Cloud detection over pixel tables: a registry of detectors that are column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs import sensors
from skyobs.functions.exprs import EPS, clamp, logistic, normalized_difference

# Codes of pixel classes.
CLASSES = {"fill": 0, "clear_land": 1, "clear_water": 2, "cloud_thin": 3, "cloud_thick": 4, "cloud_shadow": 5, "snow_ice": 6, "terrain_shadow": 7}


@dataclass(frozen=True)
class Method:
    """fn(bands, driver, **options) gives a column of cloud probability; bands are the columns at hand."""

    name: str
    fn: Callable[..., Column]
    requires: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    kind: str = "physical"
    reference: str = ""


_methods: dict[str, Method] = {}


def register(method: Method, overwrite: bool = False) -> Method:
    if method.name in _methods and not overwrite:
        raise ValueError(f"method {method.name!r} is registered already")
    _methods[method.name] = method
    return method


def methods(spark: SparkSession, sensor: str | None = None) -> DataFrame:
    """A row for each method; with a sensor, those whose bands its driver has."""
    bands = set(sensors.sensor(sensor).bands) if sensor else None
    rows = [(m.name, m.kind, list(m.requires), list(m.optional), m.reference) for m in _methods.values() if bands is None or set(m.requires) <= bands]
    return spark.createDataFrame(rows, "name string, kind string, requires array<string>, optional array<string>, reference string")


def _whiteness(vis: Column) -> Column:
    return (F.abs(F.col("blue") - vis) + F.abs(F.col("green") - vis) + F.abs(F.col("red") - vis)) / F.greatest(vis, F.lit(EPS))


def _threshold(bands: set[str], driver, bright: float = 0.25, white: float = 0.25, **_) -> Column:
    vis = (F.col("blue") + F.col("green") + F.col("red")) / 3
    p = F.sqrt(logistic(vis, bright, 0.08) * (F.lit(1.0) - logistic(_whiteness(vis), white, 0.10)))
    if {"nir", "swir16"} <= bands:
        for a, b in (("nir", "red"), ("green", "swir16")):  # plants and snow are bright, too
            p = p * (F.lit(1.0) - logistic(normalized_difference(F.col(a), F.col(b)), 0.4, 0.1) * 0.7)
    return p


def _fmask(bands: set[str], driver, quantiles: tuple[Column, Column] | None = None, **_) -> Column:
    ndsi, ndvi = normalized_difference(F.col("green"), F.col("swir16")), normalized_difference(F.col("nir"), F.col("red"))
    vis = (F.col("blue") + F.col("green") + F.col("red")) / 3
    one = F.lit(1.0)
    p = (
        logistic(F.col("swir22"), 0.03, 0.01) * (one - logistic(ndsi, 0.8, 0.05)) * (one - logistic(ndvi, 0.8, 0.05))
        * (one - logistic(_whiteness(vis), 0.7, 0.1))
        * logistic(F.col("blue") - F.col("red") * 0.5 - 0.08, 0.0, 0.02)
        * logistic(F.col("nir") / F.greatest(F.col("swir16"), F.lit(EPS)), 0.75, 0.15)
    )
    if "cirrus" in bands and driver.has_cirrus:
        p = F.greatest(p, logistic(F.col("cirrus"), 0.01, 0.005))
    if quantiles is not None:
        low, high = quantiles
        cold = one - logistic(F.col("tir1"), low, F.greatest(F.lit(1.0), (high - low) / 4))
        p = F.least(one, p * (F.lit(0.6) + cold * 0.6))
    return p


def _qa(bands: set[str], driver, qa: str | None = None, include_cirrus: bool = True, **_) -> Column:
    if qa is None or driver.qa is None:
        raise ValueError("the qa method needs the qa column's name and a sensor with a QA specification")
    return qa_flags(F.col(qa), driver, include_cirrus)["cloud"].cast("double")


def _learned(name: str) -> Callable[..., Column]:
    def fn(bands: set[str], driver, model: Callable[[set[str]], Column] | None = None, **_) -> Column:
        if model is None:
            raise ValueError(f"{name} has no weights here; pass model=, a function of the band names that returns a column")
        return model(bands)

    return fn


register(Method("threshold", _threshold, ("blue", "green", "red"), ("nir", "swir16"), reference="brightness and whiteness"))
register(Method("fmask", _fmask, ("blue", "green", "red", "nir", "swir16", "swir22"), ("cirrus", "tir1"), reference="decision cascade after Zhu and Woodcock"))
register(Method("qa", _qa, reference="the producer's quality layer"))
for _name in ("s2cloudless", "randomforest", "xgboost", "unet"):
    register(Method(_name, _learned(_name), ("blue", "red", "nir"), kind="learned", reference="needs a model"))


def probability(pixels: DataFrame, method: str = "fmask", sensor: str = "landsat-8-9-oli", threshold: float = 0.5, buffer: int = 0, scene: str = "scene", thermal: bool = True, **options) -> DataFrame:
    """pixels with p_cloud (0 to 1) and is_cloud (0 or 1), dilated by buffer pixels.

    A column expression in one stage; only the thermal test of fmask needs the scene's quantiles, which are
    aggregated by scene and joined, and a buffer needs the neighbours.
    """
    m, driver, bands = _methods[method], sensors.sensor(sensor), set(pixels.columns)
    if missing := [b for b in m.requires if b not in bands]:
        raise ValueError(f"{method} needs the bands {', '.join(missing)}")
    kept = pixels.columns
    if method == "fmask" and thermal and "tir1" in bands and driver.has_thermal:
        q = pixels.groupBy(F.col(scene).alias("_scene")).agg(F.percentile("tir1", F.array(F.lit(0.175), F.lit(0.825))).alias("_q"))
        pixels = pixels.join(q, F.col(scene).eqNullSafe(F.col("_scene")))
        options["quantiles"] = (F.col("_q")[0], F.col("_q")[1])
    out = pixels.select(*kept, clamp(m.fn(bands, driver, **options)).alias("p_cloud")).withColumn("is_cloud", (F.col("p_cloud") >= threshold).cast("int"))
    if buffer > 0:
        from skyobs.operators.raster import dilate

        grown = dilate(out.select(scene, "row", "col", "is_cloud"), "is_cloud", buffer, scene)
        out = out.drop("is_cloud").join(grown, [scene, "row", "col"])
    return out


def qa_flags(qa: Column, sensor: str | sensors.Sensor, include_cirrus: bool = True, confidence: str = "medium") -> dict[str, Column]:
    """cloud, shadow, snow, water and fill of a quality value, by flag bits and confidences or by class codes."""
    spec = sensors.sensor(sensor).qa
    if spec is None:
        raise ValueError("the sensor has no QA specification")
    q = qa.cast("int")
    if spec.kind == "bitmask":
        bit = lambda name: q.bitwiseAND(F.lit(1 << spec.bits[name])) > 0 if name in spec.bits else F.when(q.isNotNull(), F.lit(False))
        cloud = bit("cloud") | bit("dilated_cloud")
        if include_cirrus:
            cloud = cloud | bit("cirrus")
        if "cloud" in spec.confidence:
            level = {"low": 1, "medium": 2, "high": 3}[confidence]
            cloud = cloud | (F.shiftright(q, spec.confidence["cloud"][0]).bitwiseAND(F.lit(3)) >= level)
        return {"cloud": cloud, "shadow": bit("cloud_shadow"), "snow": bit("snow"), "water": bit("water"), "fill": bit("fill")}
    among = lambda *names: q.isin([spec.classes[n] for n in names if n in spec.classes])
    return {"cloud": among("cloud_medium", "cloud_high", *(["cirrus"] if include_cirrus else [])), "shadow": among("cloud_shadow"), "snow": among("snow"), "water": among("water"), "fill": among("no_data")}


def qa_decode(pixels: DataFrame, qa: str, sensor: str, include_cirrus: bool = True, confidence: str = "medium") -> DataFrame:
    """pixels with is_cloud, is_shadow, is_snow, is_water, is_fill and class; a null value has a null class."""
    f = qa_flags(F.col(qa), sensor, include_cirrus, confidence)
    order = [("fill", "fill"), ("cloud", "cloud_thick"), ("shadow", "cloud_shadow"), ("snow", "snow_ice"), ("water", "clear_water")]
    code = F.when(F.col(qa).isNull(), F.lit(None).cast("int"))
    for flag, name in order:
        code = code.when(f[flag], CLASSES[name])
    return pixels.withColumns({f"is_{k}": v.cast("int") for k, v in f.items()} | {"class": code.otherwise(CLASSES["clear_land"])})


def reliability(pixels: DataFrame, terrain: str | None = None) -> DataFrame:
    """pixels with flags of surfaces that mislead detectors, and reliability = 1 less their penalties, within 0 to 1."""
    b = set(pixels.columns)
    c = F.col
    flags: dict[str, tuple[float, Column]] = {}
    if {"green", "swir16"} <= b:
        flags["snow_ice"] = (0.45, normalized_difference(c("green"), c("swir16")) > 0.4)
    if {"red", "nir", "swir16"} <= b:
        flags["bright_bare"] = (0.25, (normalized_difference(c("nir"), c("red")) < 0.1) & (c("swir16") > 0.3))
    if {"green", "nir"} <= b:
        ndwi = normalized_difference(c("green"), c("nir"))
        flags["water_edge"] = (0.2, (ndwi > 0) & (ndwi < 0.3))
        flags["sun_glint"] = (0.3, (ndwi > 0.3) & (c("nir") > 0.12))
    if terrain:
        flags["terrain_shadow"] = (0.4, c(terrain) > 0)
    out = pixels.withColumns({k: v.cast("int") for k, (_, v) in flags.items()})
    return out.withColumn("reliability", clamp(F.lit(1.0) - sum((c(k) * w for k, (w, _) in flags.items()), F.lit(0.0))))
