"""Queries of the study pipeline: sites, scene indexes and tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.functions import special
from skyobs.functions.exprs import period
from skyobs.operators import detect, scenes
from skyobs.plans.availability import _OBS
from skyobs.plans.pixels import _PX, _SCL
from skyobs.plans.registry import registry
from skyobs.sources import driver_tables as dt
from skyobs.sources import harvest

QUERIES, SQL, query = registry(4)


@query("obs_summary", f"WITH {_OBS} SELECT sensor, count(*) AS n, count(DISTINCT cell) AS n_cells, min(date) AS first, max(date) AS last, round(avg(cloud_fraction), 4) AS mean_cloud FROM obs GROUP BY sensor")
def obs_summary(spark: SparkSession, d: str) -> DataFrame:
    return scenes.observation_summary(dt.obs(spark, d))


@query("class_counts", f"{_SCL} SELECT scene, CASE WHEN fill THEN 'fill' WHEN cloud THEN 'cloud_thick' WHEN shadow THEN 'cloud_shadow' WHEN snow THEN 'snow_ice' WHEN water THEN 'clear_water' ELSE 'clear_land' END AS class, count(*) AS n FROM f GROUP BY 1, 2")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return scenes.class_counts(detect.qa_decode(dt.pixels(spark, d), "scl", "sentinel-2-msi"))


_SCENES = "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS datetime, CASE o_orderkey % 2 WHEN 0 THEN 'landsat-8-9-oli' ELSE 'sentinel-2-msi' END AS sensor FROM "


@query("cube_index", f"WITH s AS ({_SCENES} orders) SELECT id, sensor, row_number() OVER (PARTITION BY sensor ORDER BY datetime, id) AS position FROM s")
def cube_index(spark: SparkSession, d: str) -> DataFrame:
    table = spark.sql(_SCENES + "{source}", source=spark.read.parquet(f"{d}/orders.parquet"))
    return scenes.cube(table).select("id", "sensor", F.col("position").cast("long").alias("position"))


@query("geometry_source", f"WITH s AS ({_SCENES} orders) SELECT CASE WHEN id % 3 = 0 THEN 'metadata' ELSE 'computed' END AS geometry_source, count(*) AS n FROM s GROUP BY 1")
def geometry_source(spark: SparkSession, d: str) -> DataFrame:
    table = spark.sql(_SCENES + "{source}", source=spark.read.parquet(f"{d}/orders.parquet"))
    angle = F.when(F.col("id") % 3 == 0, F.lit(40.0))
    full = table.withColumns({"sun_zenith": angle, "sun_azimuth": angle, "lon": F.lit(10.0), "lat": F.lit(50.0)})
    return scenes.with_geometry(full).groupBy("geometry_source").agg(F.count(F.lit(1)).alias("n"))


@query("mask_coverage", f"WITH {_PX} SELECT scene, round(avg(CAST(cloud AS DOUBLE)), 4) AS coverage FROM px GROUP BY scene")
def mask_coverage(spark: SparkSession, d: str) -> DataFrame:
    masks = scenes.MaskSet(dt.pixels(spark, d).withColumnRenamed("cloud", "is_cloud"), "planted")
    return masks.mask().groupBy("scene").agg(F.avg(F.col("is_cloud").cast("double")).alias("coverage"))


@query("site_boxes", "WITH p AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS name, CAST((s_suppkey*37) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey*13) % 140 - 70 AS DOUBLE) AS lat FROM supplier), r AS (SELECT name, lat, k, lon + k*37 + 180 AS x FROM p, (VALUES (0), (1), (2)) t(k)), q AS (SELECT name || '#' || CAST(k AS VARCHAR) AS site, lat, x - 360*floor(x/360) - 180 AS lon FROM r) SELECT site, lon, lat, lon - 0.25 AS west, lon + 0.25 AS east, lat - 0.25 AS south, lat + 0.25 AS north FROM q")
def site_boxes(spark: SparkSession, d: str) -> DataFrame:
    named = dt.footprints(spark, d).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), (F.col("id") * 37 % 360 - 180).cast("double").alias("lon"), F.col("lat0").alias("lat"), F.lit("any").alias("regime"))
    return harvest.site_boxes(named, replicas=3).drop("regime")


@query("clustering_ratio", f"""WITH {_OBS}, u AS (SELECT cell, {"CAST(year(date) AS VARCHAR)"} AS period, CAST(count(*) FILTER (WHERE cloud_fraction <= 0.2 AND sensor LIKE 'landsat%') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE cloud_fraction <= 0.2 AND sensor LIKE 'sentinel%') AS DOUBLE) AS b FROM obs GROUP BY 1, 2)
SELECT period, round(100*(sum(b) - sum(a))/sum(a), 4) AS pct_change, round(CAST(count(*) FILTER (WHERE b < 6) AS DOUBLE)/nullif(count(*) FILTER (WHERE a < 6), 0), 4) AS failure_ratio FROM u GROUP BY period""")  # fmt: skip
def clustering_ratio(spark: SparkSession, d: str) -> DataFrame:
    clear = lambda name: F.count_if((F.col("cloud_fraction") <= 0.2) & F.col("sensor").startswith(name)).cast("double")
    u = dt.obs(spark, d).groupBy("cell", period(F.col("date"), "year").alias("period")).agg(clear("landsat").alias("a"), clear("sentinel").alias("b"))
    return u.groupBy("period").agg(((F.sum("b") - F.sum("a")) / F.sum("a") * 100).alias("pct_change"), F.try_divide(F.count_if(F.col("b") < 6).cast("double"), F.count_if(F.col("a") < 6)).alias("failure_ratio"))


_Z = "CAST(1.959963984540054 AS DOUBLE)"


@query("cross_sensor_test", f"""WITH {_OBS}, c AS (SELECT cell, year(date) AS y, avg(cloud_fraction) FILTER (WHERE sensor LIKE 'landsat%') AS a, avg(cloud_fraction) FILTER (WHERE sensor LIKE 'sentinel%') AS b FROM obs GROUP BY 1, 2),
s AS (SELECT count(*) AS n, corr(a, b) AS r, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM c WHERE a IS NOT NULL AND b IS NOT NULL),
t AS (SELECT *, n - 1 AS v, {_Z} AS z, atanh(r) AS fz, {_Z}/sqrt(n - 3) AS w FROM s),
q AS (SELECT *, (z + (pow(z,3) + z)/(4*v) + (5*pow(z,5) + 16*pow(z,3) + 3*z)/(96*pow(v,2)) + (3*pow(z,7) + 19*pow(z,5) + 17*pow(z,3) - 15*z)/(384*pow(v,3)))*sd/sqrt(n) AS half FROM t)
SELECT n, round(m, 4) AS mean_diff, round(m - half, 4) AS low, round(m + half, 4) AS high, round(r, 4) AS r, round((exp(2*(fz - w)) - 1)/(exp(2*(fz - w)) + 1), 4) AS r_low, round((exp(2*(fz + w)) - 1)/(exp(2*(fz + w)) + 1), 4) AS r_high FROM q""")  # fmt: skip
def cross_sensor_test(spark: SparkSession, d: str) -> DataFrame:
    """Paired difference of mean cloud between two sensors: t interval and the interval of the correlation (Fisher)."""
    mean = lambda name: F.avg(F.when(F.col("sensor").startswith(name), F.col("cloud_fraction")))
    c = dt.obs(spark, d).groupBy("cell", period(F.col("date"), "year").alias("period")).agg(mean("landsat").alias("a"), mean("sentinel").alias("b")).dropna(subset=["a", "b"])
    diff = F.col("a") - F.col("b")
    s = c.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"), F.avg(diff).alias("m"), F.stddev_samp(diff).alias("sd")).first()
    n, r = s["n"], s["r"]  # one row; intervals are null where there are too few pairs, or no spread, for them
    half = special.t_quantile(0.975, n - 1) * s["sd"] / math.sqrt(n) if n > 1 else None
    bounds = (None, None) if half is None else (s["m"] - half, s["m"] + half)
    known = n > 3 and r is not None and math.isfinite(r) and abs(r) < 1
    z, w = (math.atanh(r), 1.959963984540054 / math.sqrt(n - 3)) if known else (0.0, 0.0)
    return spark.createDataFrame([(n, s["m"], *bounds, r, math.tanh(z - w) if known else None, math.tanh(z + w) if known else None)], "n long, mean_diff double, low double, high double, r double, r_low double, r_high double")
