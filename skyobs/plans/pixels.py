"""Queries on pixel tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.functions import exprs
from skyobs.operators import detect, raster
from skyobs.plans.registry import registry
from skyobs.sources import driver_tables as dt

QUERIES, SQL, query = registry()
_PX = f"px AS ({dt.px_sql()})"
_DEM = f"dem AS (SELECT {dt.DEM} FROM part)"
_GEO = {"res": dt.RES, "zenith": dt.ZENITH, "azimuth": dt.AZIMUTH}
_HEIGHTS = tuple(range(200, 2001, 200))


def _sig(x: str, mid: float | str, sc: float | str) -> str:
    return f"(1/(1 + exp(-(({x}) - ({mid}))/({sc}))))"


def _nd(a: str, b: str) -> str:
    return f"(({a} - {b})/greatest({a} + {b}, CAST(1e-6 AS DOUBLE)))"


_VIS = "((blue + green + red)/3)"
_WHITE = f"((abs(blue - {_VIS}) + abs(green - {_VIS}) + abs(red - {_VIS}))/greatest({_VIS}, CAST(1e-6 AS DOUBLE)))"
_KEY = "scene, row, col"


@query("indices", f"WITH {_PX} SELECT {_KEY}, round({_nd('nir', 'red')}, 6) AS ndvi, round({_nd('green', 'swir16')}, 6) AS ndsi, round({_nd('green', 'nir')}, 6) AS ndwi, round({_WHITE}, 6) AS whiteness, round(blue - red*CAST(0.5 AS DOUBLE) - CAST(0.08 AS DOUBLE), 6) AS hot FROM px")
def indices(spark: SparkSession, d: str) -> DataFrame:
    px = dt.pixels(spark, d)
    return px.select("scene", "row", "col", *[c.alias(k) for k, c in exprs.indices(set(px.columns)).items()])


_THR = f"sqrt({_sig(_VIS, 0.25, 0.08)}*(1 - {_sig(_WHITE, 0.25, 0.10)}))*(1 - CAST(0.7 AS DOUBLE)*{_sig(_nd('nir', 'red'), 0.4, 0.1)})*(1 - CAST(0.7 AS DOUBLE)*{_sig(_nd('green', 'swir16'), 0.4, 0.1)})"
_FM = f"{_sig('swir22', 0.03, 0.01)}*(1 - {_sig(_nd('green', 'swir16'), 0.8, 0.05)})*(1 - {_sig(_nd('nir', 'red'), 0.8, 0.05)})*(1 - {_sig(_WHITE, 0.7, 0.1)})*{_sig('blue - red*CAST(0.5 AS DOUBLE) - CAST(0.08 AS DOUBLE)', 0, 0.02)}*{_sig('nir/greatest(swir16, CAST(1e-6 AS DOUBLE))', 0.75, 0.15)}"
_FMC = f"greatest({_FM}, {_sig('cirrus', 0.01, 0.005)})"


def _mask(p: str, extra: str = "") -> str:
    return f"WITH {_PX}{extra}, m AS (SELECT {_KEY}, least(1, greatest(0, {p})) AS p FROM px{' JOIN q USING (scene)' if extra else ''}) SELECT {_KEY}, round(p, 6) AS p_cloud, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS is_cloud FROM m"


_OUT = ["scene", "row", "col", "p_cloud", "is_cloud"]
query("detect_threshold", _mask(_THR))(lambda spark, d: detect.probability(dt.pixels(spark, d), "threshold").select(*_OUT))
query("detect_fmask", _mask(_FMC))(lambda spark, d: detect.probability(dt.pixels(spark, d), "fmask", thermal=False).select(*_OUT))
query("detect_fmask_thermal", _mask(f"least(1, {_FMC}*(CAST(0.6 AS DOUBLE) + CAST(0.6 AS DOUBLE)*(1 - {_sig('tir1', 'lo', 'greatest(1, (hi - lo)/4)')})))", ", q AS (SELECT scene, quantile_cont(tir1, 0.175) AS lo, quantile_cont(tir1, 0.825) AS hi FROM px GROUP BY scene)"))(
    lambda spark, d: detect.probability(dt.pixels(spark, d), "fmask").select(*_OUT)
)
query("detect_buffered", f"""WITH {_PX}, m AS (SELECT {_KEY}, CASE WHEN {_THR} >= 0.5 THEN 1 ELSE 0 END AS c FROM px)
SELECT a.scene, a.row, a.col, max(b.c) AS is_cloud FROM m a JOIN m b ON a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) <= 1 GROUP BY 1,2,3""")(
    lambda spark, d: detect.probability(dt.pixels(spark, d), "threshold", buffer=1).select("scene", "row", "col", "is_cloud")
)

_QA = f"""WITH {_PX}, f AS (SELECT {_KEY}, qa & 1 > 0 AS fill, ((qa & 8) > 0 OR (qa & 2) > 0 OR (qa & 4) > 0 OR ((qa >> 8) & 3) >= 2) AS cloud, (qa & 16) > 0 AS shadow, (qa & 32) > 0 AS snow, (qa & 128) > 0 AS water FROM px)"""
_SCL = f"""WITH {_PX}, f AS (SELECT {_KEY}, scl = 0 AS fill, scl IN (8, 9, 10) AS cloud, scl = 3 AS shadow, scl = 11 AS snow, scl = 6 AS water FROM px)"""
_CLS = f" SELECT {_KEY}, CAST(cloud AS INT) AS is_cloud, CAST(shadow AS INT) AS is_shadow, CASE WHEN fill THEN 0 WHEN cloud THEN 4 WHEN shadow THEN 5 WHEN snow THEN 6 WHEN water THEN 2 ELSE 1 END AS class FROM f"
_DEC = ["scene", "row", "col", "is_cloud", "is_shadow", "class"]
query("qa_bitmask", _QA + _CLS)(lambda spark, d: detect.qa_decode(dt.pixels(spark, d), "qa", "landsat-8-9-oli").select(*_DEC))
query("qa_scl", _SCL + _CLS)(lambda spark, d: detect.qa_decode(dt.pixels(spark, d), "scl", "sentinel-2-msi").select(*_DEC))
query("detect_qa", f"{_QA} SELECT {_KEY}, CASE WHEN cloud THEN 1.0 ELSE 0.0 END AS p_cloud, CAST(cloud AS INT) AS is_cloud FROM f")(lambda spark, d: detect.probability(dt.pixels(spark, d), "qa", qa="qa").select(*_OUT))

_FLAGS = f"{_nd('green', 'swir16')} > 0.4 AS snow_ice, ({_nd('nir', 'red')} < 0.1 AND swir16 > 0.3) AS bright_bare, ({_nd('green', 'nir')} > 0 AND {_nd('green', 'nir')} < 0.3) AS water_edge, ({_nd('green', 'nir')} > 0.3 AND nir > 0.12) AS sun_glint"


@query("reliability", f"""WITH {_PX}, f AS (SELECT {_KEY}, {_FLAGS} FROM px), g AS (SELECT {_KEY}, CAST(snow_ice AS INT) AS snow_ice, CAST(bright_bare AS INT) AS bright_bare, CAST(water_edge AS INT) AS water_edge, CAST(sun_glint AS INT) AS sun_glint FROM f)
SELECT *, round(greatest(0, least(1, CAST(1 AS DOUBLE) - snow_ice*CAST(0.45 AS DOUBLE) - bright_bare*CAST(0.25 AS DOUBLE) - water_edge*CAST(0.2 AS DOUBLE) - sun_glint*CAST(0.3 AS DOUBLE))), 6) AS reliability FROM g""")  # fmt: skip
def reliability(spark: SparkSession, d: str) -> DataFrame:
    return detect.reliability(dt.pixels(spark, d)).select("scene", "row", "col", "snow_ice", "bright_bare", "water_edge", "sun_glint", "reliability")


@query("scale_reflectance", f"WITH {_PX} SELECT {_KEY}, round(greatest(0, least(CAST(1.6 AS DOUBLE), qa*CAST(2.75e-05 AS DOUBLE) + CAST(-0.2 AS DOUBLE))), 8) AS reflectance FROM px", 8)
def scale_reflectance(spark: SparkSession, d: str) -> DataFrame:
    return dt.pixels(spark, d).select("scene", "row", "col", exprs.scaled(F.col("qa"), 2.75e-05, -0.2).alias("reflectance"))


@query("shift", f"WITH {_PX} SELECT a.scene, a.row, a.col, coalesce(b.cloud, 0) AS cloud FROM px a LEFT JOIN px b ON a.scene = b.scene AND a.row = b.row - 2 AND a.col = b.col + 3")
def shift(spark: SparkSession, d: str) -> DataFrame:
    return raster.shift(dt.pixels(spark, d), "cloud", 3, -2)


_NEAR = "a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) <= 2"
query("dilate", f"WITH {_PX} SELECT a.scene, a.row, a.col, max(b.cloud) AS cloud FROM px a JOIN px b ON {_NEAR} GROUP BY 1,2,3")(lambda spark, d: raster.dilate(dt.pixels(spark, d), "cloud", 2))
query("erode", f"WITH {_PX} SELECT a.scene, a.row, a.col, min(b.cloud) AS cloud FROM px a JOIN px b ON {_NEAR} GROUP BY 1,2,3")(lambda spark, d: raster.erode(dt.pixels(spark, d), "cloud", 2))

_DARK = f"""{_PX}, ref AS (SELECT scene, coalesce(median(nir) FILTER (WHERE cloud = 0), median(nir)) AS rn, coalesce(median(swir16) FILTER (WHERE cloud = 0), median(swir16)) AS rs FROM px GROUP BY scene),
dk AS (SELECT px.*, least(least(1, greatest(0, (rn - nir)/rn)), least(1, greatest(0, (rs - swir16)/rs))) AS darkness FROM px JOIN ref USING (scene))"""


@query("darkness", f"WITH {_DARK} SELECT {_KEY}, round(darkness, 6) AS darkness FROM dk")
def darkness(spark: SparkSession, d: str) -> DataFrame:
    return raster.darkness(dt.pixels(spark, d), "nir", "swir16", cloud="cloud").select("scene", "row", "col", "darkness")


_H = "greatest(200, least(12000, (w - {q})/CAST(0.0065 AS DOUBLE)))"


@query("cloud_height", f"""WITH {_PX}, q AS (SELECT scene, quantile_cont(tir1, 0.825) FILTER (WHERE cloud = 0) AS w, quantile_cont(tir1, 0.175) FILTER (WHERE cloud = 1) AS c0, quantile_cont(tir1, 0.825) FILTER (WHERE cloud = 1) AS c1 FROM px GROUP BY scene),
h AS (SELECT scene, {_H.format(q='c0')} AS a, {_H.format(q='c1')} AS b FROM q) SELECT scene, round((a + b)/2, 6) AS height, round(least(a, b), 6) AS low, round(greatest(a, b), 6) AS high FROM h""")  # fmt: skip
def cloud_height(spark: SparkSession, d: str) -> DataFrame:
    return raster.cloud_height(dt.pixels(spark, d))


_SHIFTS = ", ".join(f"(CAST({h} AS DOUBLE), {s[0]}, {s[1]})" for h in _HEIGHTS for s in [raster.pixel_shift(h, dt.RES, dt.ZENITH, dt.AZIMUTH)])
_SEARCH = f"""WITH {_DARK}, s(height, dc, dr) AS (VALUES {_SHIFTS}), mv AS (SELECT scene, height, row + dr AS row, col + dc AS col FROM px, s WHERE cloud = 1),
sums AS (SELECT mv.scene, height, count(*) AS kept, count(*) FILTER (WHERE cloud = 0) AS free, count(*) FILTER (WHERE cloud = 0 AND darkness >= 0.12) AS hit FROM mv JOIN dk ON mv.scene = dk.scene AND mv.row = dk.row AND mv.col = dk.col GROUP BY 1, 2),
tot AS (SELECT scene, CAST(count(*) FILTER (WHERE cloud = 1) AS DOUBLE) AS n, max(row) AS nr, max(col) AS nc FROM px GROUP BY scene HAVING n > 0),
prof AS (SELECT tot.scene, s.height, CAST(coalesce(hit, 0) AS DOUBLE)/nullif(free, 0) AS score, coalesce(kept, 0)/n AS retained, coalesce(kept, 0) AS kept, nr, nc FROM tot CROSS JOIN s LEFT JOIN sums ON sums.scene = tot.scene AND sums.height = s.height),
best AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY CASE WHEN retained >= 0.1 AND kept >= 25 AND score IS NOT NULL THEN 0 ELSE 1 END, score DESC NULLS LAST, height) AS k FROM prof) """


def _search(spark: SparkSession, d: str) -> raster.ShadowSearch:
    dark = raster.darkness(dt.pixels(spark, d), "nir", "swir16", cloud="cloud")
    return raster.shadow_search(dark, heights=_HEIGHTS, **_GEO)


query("shadow_profile", _SEARCH + "SELECT scene, height, round(score, 6) AS score, round(retained, 6) AS retained FROM prof")(lambda spark, d: _search(spark, d).profile)
query("shadow_search", _SEARCH + f"SELECT scene, height, round(score, 6) AS score, round(retained, 6) AS retained, least(nr, nc)*CAST({dt.RES} AS DOUBLE) AS window_m, CASE WHEN 2000 > 0.5*least(nr, nc)*{dt.RES} THEN TRUE ELSE FALSE END AS truncated FROM best WHERE k = 1")(
    lambda spark, d: _search(spark, d).best.drop("required_m", "resolvable_m")
)
query("shadow_mask", _SEARCH + """, sh AS (SELECT b.scene, px.row + s.dr AS row, px.col + s.dc AS col FROM best b JOIN s ON s.height = b.height JOIN px ON px.scene = b.scene AND px.cloud = 1 WHERE k = 1)
SELECT DISTINCT sh.scene, sh.row, sh.col FROM sh JOIN px ON px.scene = sh.scene AND px.row = sh.row AND px.col = sh.col AND px.cloud = 0""")(lambda spark, d: _search(spark, d).shadow)  # fmt: skip
query("shadow_union", f"WITH {_PX}, s(height, dc, dr) AS (VALUES {_SHIFTS}), mv AS (SELECT DISTINCT scene, row + dr AS row, col + dc AS col FROM px, s WHERE cloud = 1) SELECT px.scene, px.row, px.col, CASE WHEN mv.scene IS NULL THEN 0 ELSE 1 END AS shadow FROM px LEFT JOIN mv ON px.scene = mv.scene AND px.row = mv.row AND px.col = mv.col")(
    lambda spark, d: raster.shadow_union(dt.pixels(spark, d), heights=_HEIGHTS, **_GEO)
)


@query("shadow_offset", f"SELECT height, round(dx, 6) AS dx, round(dy, 6) AS dy FROM (SELECT CAST(unnest(generate_series(200, 12000, 200)) AS DOUBLE) AS height) h, LATERAL (SELECT -height*tan(radians({dt.ZENITH}))*sin(radians({dt.AZIMUTH})) AS dx, -height*tan(radians({dt.ZENITH}))*cos(radians({dt.AZIMUTH})) AS dy) o")
def shadow_offset(spark: SparkSession, d: str) -> DataFrame:
    h = spark.range(200, 12001, 200).select(F.col("id").cast("double").alias("height"))
    away = F.col("height") * F.tan(F.radians(F.lit(dt.ZENITH)))
    a = F.radians(F.lit(dt.AZIMUTH))
    return h.select("height", (-away * F.sin(a)).alias("dx"), (-away * F.cos(a)).alias("dy"))


_STEPS = raster.terrain_steps(60.0, 110.0, 30.0, 600.0, 10, 20)
_TS = ", ".join(f"(CAST({k * 30.0 / raster.math.tan(raster.math.radians(60.0))!r} AS DOUBLE), {dc}, {dr})" for k, dc, dr in _STEPS)


@query("terrain_shadow", f"WITH {_DEM}, t(up, dc, dr) AS (VALUES {_TS}), b AS (SELECT DISTINCT a.scene, a.row, a.col FROM dem a, t, dem h WHERE h.scene = a.scene AND h.row = a.row + t.dr AND h.col = a.col + t.dc AND h.z > a.z + t.up) SELECT dem.scene, dem.row, dem.col, CASE WHEN b.scene IS NULL THEN 0 ELSE 1 END AS shadow FROM dem LEFT JOIN b ON dem.scene = b.scene AND dem.row = b.row AND dem.col = b.col")
def terrain_shadow(spark: SparkSession, d: str) -> DataFrame:
    return raster.terrain_shadow(dt.dem(spark, d), 60.0, 110.0, 10, 20, 30.0, 600.0)


@query("detector_table", f"""WITH {_PX}, m AS (SELECT scene, cloud, 'threshold' AS method, CASE WHEN {_THR} >= 0.5 THEN 1 ELSE 0 END AS pred FROM px UNION ALL SELECT scene, cloud, 'fmask', CASE WHEN {_FMC} >= 0.5 THEN 1 ELSE 0 END FROM px),
i AS (SELECT method, scene, CAST(count(*) FILTER (WHERE pred = 1 AND cloud = 1) AS DOUBLE)/nullif(count(*) FILTER (WHERE pred = 1 OR cloud = 1), 0) AS iou FROM m GROUP BY 1, 2)
SELECT method, round(avg(iou), 6) AS iou, count(iou) AS scenes FROM i GROUP BY method""")  # fmt: skip
def detector_table(spark: SparkSession, d: str) -> DataFrame:
    px = dt.pixels(spark, d)
    parts = [detect.probability(px, m, thermal=False).select("scene", "cloud", F.lit(m).alias("method"), F.col("is_cloud").alias("pred")) for m in ("threshold", "fmask")]
    per = parts[0].unionByName(parts[1]).groupBy("method", "scene").agg(F.try_divide(F.count_if((F.col("pred") == 1) & (F.col("cloud") == 1)).cast("double"), F.count_if((F.col("pred") == 1) | (F.col("cloud") == 1))).alias("iou"))
    return per.groupBy("method").agg(F.avg("iou").alias("iou"), F.count("iou").alias("scenes"))


@query("chunk_plan", "SELECT CAST(i AS INT) AS block, CAST(i*7 + 1 AS INT) AS row_start, CAST(least(7, 30 - i*7) AS INT) AS n_rows FROM (SELECT unnest(generate_series(0, 4)) AS i) g")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    from skyobs.operators.engine import chunks

    return chunks(spark, dt.ROWS, dt.COLS, layers=1, budget=350).select((F.col("block") - 1).cast("int").alias("block"), "row_start", "n_rows")
