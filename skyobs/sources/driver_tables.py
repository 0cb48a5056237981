"""Satellite-like views over the driver's tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Text that both engines run: table, then select list.
OBS = """CAST(l_suppkey AS BIGINT) + 1 AS cell, CAST(l_shipdate AS DATE) AS date,
 CASE l_returnflag WHEN 'A' THEN 'landsat-8-9-oli' WHEN 'N' THEN 'sentinel-2-msi' ELSE 'modis-mod09ga' END AS sensor,
 l_linestatus AS platform, CAST(l_discount AS DOUBLE) * 10 AS cloud_fraction"""
PTS = """CAST(c_custkey AS BIGINT) AS id, CAST(((c_custkey*37) % 360) - 180 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS lon,
 CAST(((c_custkey*13) % 140) - 70 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS lat"""
FOOT = """CAST(s_suppkey AS BIGINT) AS id, CAST((s_suppkey*37) % 358 - 180 AS DOUBLE) AS lon0, CAST((s_suppkey*13) % 140 - 70 AS DOUBLE) AS lat0"""
DEM = """CAST(floor(p_partkey/200) AS BIGINT) AS scene, CAST(floor((p_partkey % 200)/20) AS INT) + 1 AS row,
 CAST(p_partkey % 20 AS INT) + 1 AS col, CAST(p_size AS DOUBLE)*20 AS z"""
EVAL = """CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS truth, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS pred,
 CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS pred_b, CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS pred_c,
 CAST(l_discount AS DOUBLE)*10 AS prob, l_suppkey % 20 AS block"""

#: Rasters of 30 rows and 50 columns, one pixel an order; metres a pixel, and the sun's zenith and azimuth in degrees.
ROWS, COLS, RES, ZENITH, AZIMUTH = 30, 50, 100.0, 45.0, 110.0
#: Whole-pixel shadow shifts of the planted heights 600, 800, ... 1400 m: (columns, rows).
PLANTED = [(-6, -2), (-8, -3), (-9, -3), (-11, -4), (-13, -5)]


def px_sql(source: str = "orders") -> str:
    """Pixels with a disc of cloud a scene, its shadow at a planted height, bands by modular arithmetic and quality codes."""
    scene = "CAST(floor(o_orderkey/1500) AS BIGINT)"
    base = f"""SELECT {scene} AS scene, CAST(floor((o_orderkey % 1500)/50) AS INT) + 1 AS row, CAST(o_orderkey % 50 AS INT) + 1 AS col,
 CAST(o_custkey AS BIGINT) AS k, CAST(o_orderkey AS BIGINT) AS o FROM {source}"""
    shift = lambda at: "CASE scene % 5 " + " ".join(f"WHEN {i} THEN {s[at]}" for i, s in enumerate(PLANTED)) + " END"
    disc = lambda r, c: f"(({r}) - 15 - scene % 5)*(({r}) - 15 - scene % 5) + (({c}) - 30 - scene % 7)*(({c}) - 30 - scene % 7) <= 16 + 5*(scene % 4)"
    flags = f"SELECT *, CASE WHEN {disc('row', 'col')} THEN 1 ELSE 0 END AS cloud, CASE WHEN {disc(f'row - ({shift(1)})', f'col - ({shift(0)})')} THEN 1 ELSE 0 END AS planted FROM ({base}) b"
    band = lambda start, mod, step, name, bright, dim: (
        f"(CAST({start} AS DOUBLE) + CAST((k*{step} + o) % {mod} AS DOUBLE)/1000) * CASE WHEN cloud = 1 THEN 1 WHEN planted = 1 THEN CAST({dim} AS DOUBLE) ELSE 1 END + cloud*CAST({bright} AS DOUBLE) AS {name}"
    )
    bands = ", ".join(band(*b) for b in [(0.05, 21, 3, "blue", 0.40, 1), (0.07, 23, 5, "green", 0.40, 1), (0.05, 31, 7, "red", 0.42, 1), (0.28, 41, 11, "nir", 0.25, 0.45), (0.18, 37, 13, "swir16", 0.20, 0.45), (0.10, 29, 17, "swir22", 0.18, 1)])
    return f"""SELECT scene, row, col, cloud, {bands}, CAST((k*3 + o) % 17 AS DOUBLE)/2000 + cloud*CAST(0.01 AS DOUBLE) AS cirrus,
 CAST(295 AS DOUBLE) + CAST((k*19 + o) % 50 AS DOUBLE)/10 - cloud*15 AS tir1, CAST((k*31 + o*7) % 65536 AS INT) AS qa, CAST(k % 12 AS INT) AS scl FROM ({flags}) f"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, select: str) -> DataFrame:
    return spark.sql(f"SELECT {select} FROM {{source}}", source=_table(spark, sf_dir, name))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", OBS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", PTS)


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", FOOT)


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", DEM)


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", EVAL)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(px_sql("{source}"), source=_table(spark, sf_dir, "orders"))
